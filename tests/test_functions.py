from datetime import date

import pytest
from pyspark.sql import functions as F

from stridewell.functions import expr
from stridewell.functions.dates import build_date_range, iso_week_label, parse_date_expr, preset_range, sunday_week

TODAY = date(2024, 3, 31)


@pytest.mark.parametrize(
    ("text", "day"),
    [("2024", date(2024, 1, 1)), ("2024-05", date(2024, 5, 1)), ("2024-05-07", date(2024, 5, 7)), ("-7d", date(2024, 3, 24)), ("-2w", date(2024, 3, 17)), ("-1m", date(2024, 2, 29)), ("-1y", date(2023, 3, 31)), ("3d", date(2024, 4, 3))],
)
def test_date_expressions(text, day):
    assert parse_date_expr(text, TODAY) == day


@pytest.mark.parametrize("text", ["", None, "yesterday", "5x", "2024-13"])
def test_bad_date_expressions(text):
    with pytest.raises(ValueError):
        parse_date_expr(text, TODAY)


def test_ranges():
    assert build_date_range("2024-01-01", "2024-02-01", today=TODAY) == (date(2024, 1, 1), date(2024, 2, 1))
    assert build_date_range("2024-01-31", span="1m", today=TODAY) == (date(2024, 1, 31), date(2024, 2, 29))
    assert build_date_range(today=TODAY) == (None, None)
    for bad in ({"before": "2024", "span": "1m", "after": "2023"}, {"span": "1m"}):
        with pytest.raises(ValueError):
            build_date_range(today=TODAY, **bad)
    assert preset_range("ytd", TODAY) == (date(2024, 1, 1), None)
    assert preset_range("3m", TODAY) == (date(2024, 1, 1), None)
    assert preset_range("all", TODAY) == (None, None)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def null():
    return F.lit(None).cast("double")


@pytest.mark.parametrize(("minutes", "text"), [(5.5, "5:30"), (4.0, "4:00"), (6.25, "6:15"), (3.75, "3:45"), (5.1, "5:06"), (75.0, "75:00")])
def test_pace(spark, minutes, text):
    assert one(spark, expr.pace_mmss(F.lit(minutes))) == text
    assert one(spark, expr.pace_mmss(F.lit(75.0), compat=True)) == "15:00"


@pytest.mark.parametrize(
    ("score", "x", "y"),
    [(expr.score_hrv, 0, 75), (expr.score_hrv, -2, 0), (expr.score_hrv, 1, 100), (expr.score_hrv, -1, 50), (expr.score_rhr, 0, 80), (expr.score_rhr, -3, 100), (expr.score_rhr, 8, 0), (expr.score_rhr, 5, 25), (expr.score_load, 0, 90), (expr.score_load, 1, 70), (expr.score_load, 3, 10)],
)
def test_scores(spark, score, x, y):
    assert one(spark, score(F.lit(float(x)))) == pytest.approx(y)
    assert one(spark, score(null())) is None


def test_sleep_score(spark):
    f = lambda *x: one(spark, expr.score_sleep(*[null() if v is None else F.lit(float(v)) for v in x]))
    assert [f(h, None, None) for h in (8, 7, 4, 6)] == pytest.approx([100, 75, 0, 50])
    assert f(7, 1, 2) == pytest.approx(85)
    assert f(7, 0.2, 0.3) == pytest.approx(65)
    assert f(None, 1, 1) is None


def test_composite(spark):
    f = lambda a, b: one(spark, expr.weighted_composite({"a": null() if a is None else F.lit(a), "b": null() if b is None else F.lit(b)}, {"a": 0.5, "b": 0.5}))
    assert f(80.0, 60.0) == pytest.approx(70)
    assert f(80.0, None) == pytest.approx(80)
    assert f(None, None) is None


@pytest.mark.parametrize(("z", "pi"), [((80, 8, 12), 2.08), ((74, 11, 15), 2.00), ((77, 17, 6), 1.43), ((70, 20, 10), 1.54), ((90, 10, 0), 0), ((99.5, 0, 0.5), 0)])
def test_polarization(spark, z, pi):
    assert one(spark, expr.polarization(*[F.lit(float(x)) for x in z])) == pytest.approx(pi, abs=0.02)


def test_weeks(spark):
    day = F.lit("2021-01-03").cast("date")
    assert one(spark, sunday_week(day)) == date(2021, 1, 3)
    assert one(spark, iso_week_label(day)) == "2021-W53"
    assert one(spark, expr.hour_fraction(F.lit("2024-01-10 22:30:00 +0000"))) == pytest.approx(23.5)
    assert one(spark, expr.hour_fraction(F.lit("no time"))) is None


def test_trimp_needs_no_reserve(spark):
    assert one(spark, expr.trimp(F.lit(60.0), F.lit(40.0), F.lit(50.0), F.lit(190.0))) == 0
    assert one(spark, expr.trimp(F.lit(60.0), F.lit(500.0), F.lit(50.0), F.lit(190.0))) == pytest.approx(60 * 0.64 * 2.718281828459045**1.92)
