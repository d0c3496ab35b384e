import os
import re

import pytest

from stridewell.operators import health as h
from stridewell.plans import facade
from stridewell.sources import driver_tables as t

SF = "/root/testdata/sf0.001"


def test_names_resolve():
    known = ["resting_heart_rate", "step_count", "vo2_max", "sleep_deep", "sleep_rem"]
    for name, metric in [("step_count", "step_count"), (" RHR ", "resting_heart_rate"), ("vikt", "weight_body_mass"), ("deep", "sleep_deep"), ("sleep", "sleep"), ("nothing", "nothing")]:
        assert facade.resolve_metric(name, known) == metric


def test_explanations():
    assert facade.explain_metric("ACWR")["summary"] == {"status": "ok", "metric": "acwr"}
    assert facade.explain_metric("x")["summary"]["status"] == "error"
    assert "Monotony" in facade.resource_metrics(["vo2_max"]) and "over 1.5" in facade.resource_thresholds()


def test_measures_are_grouped():
    text = facade.resource_metrics(["vo2_max", "step_count", "own_thing"])
    assert text.index("### Fitness\n- vo2_max") < text.index("### Activity\n- step_count: step count") < text.index("### Ungrouped\n- own_thing") and "### Body" not in text


def test_prompts_name_tools_that_exist():
    for text in (facade.prompt_daily_check(), facade.prompt_weekly_review(2), facade.prompt_fitness_review()):
        names = re.findall(r"get_\w+", text)
        assert len(names) >= 3 and all(hasattr(facade.Engine, n) for n in names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_tools(spark):
    health = t.health(spark, SF)
    e = facade.Engine(t.activities(spark, SF), h.aggregate_daily(health), t.samples(spark, SF), h.resting_hr(health), t.AS_OF)
    tools = [
        e.get_readiness(), e.get_sleep(), e.get_hrv(), e.get_training_load(), e.get_training_load("acwr"), e.get_training_load("monotony"), e.get_efficiency(), e.get_efficiency("hre"), e.get_zones(),
        e.get_sessions(after="2001", before="2001-03"), e.get_monthly_summary(), e.get_monthly_summary("status"), e.get_monthly_summary("last"), e.get_yearly_summary(), e.get_yearly_summary("top"),
        e.get_recovery_hr(), e.get_resting_hr(), e.get_health_metric("steps", known=["step_count"]), e.compare_periods(("2000", "2000-12-31"), ("-1y", "2001-08-01")), e.weeks(),
    ]
    for df in tools:
        assert "athlete_id" in df.columns and df.count() > 0
    assert e.get_vo2max().count() == 0 and e.get_decoupling(smooth_s=172_800.0).count() >= 0
    assert e.get_readiness(after="-2w", before="-1w").count() == 8 * 8
