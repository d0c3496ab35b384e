"""Daily readiness of each athlete from health measures and training load."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stridewell.functions import expr
from stridewell.functions.dates import within
from stridewell.operators import health as h
from stridewell.operators import metrics
from stridewell.operators import timeseries as ts
from stridewell.operators.joins import preceding_mean


def readiness(daily: DataFrame, activities: DataFrame, resting: DataFrame, as_of: date, hr_max_bpm: float = 190.0, after: date | None = None, before: date | None = None, keys: Sequence[str] = ts.KEYS, wrist: bool = True) -> DataFrame:
    """Scores of heart rate variability, sleep, resting heart rate, load and wrist temperature, their composite, flags and status.

    daily: one value for each (date, metric). Days are those with a measure or with a training load. The range is taken
    last, so that windows see the whole history. wrist=False leaves wrist temperature out and shares its weight.
    """
    load = metrics.pmc(activities, as_of, hr_max_bpm, resting, keys=keys)
    on = [*keys, "date"]
    d = h.readiness_inputs(daily, keys).join(load, on, "full")
    ln, w = F.col("ln_rmssd"), W.partitionBy(*keys).orderBy("date")
    d = d.withColumn("ln_rmssd_7d_mean", ts.rolling_mean(ln, 7, keys)).withColumn("ln_rmssd_7d_sd", ts.rolling_sd(ln, 7, keys))
    d = d.withColumn("hrv_z", F.when(F.col("ln_rmssd_7d_sd") > 0, (ln - F.col("ln_rmssd_7d_mean")) / F.col("ln_rmssd_7d_sd")))
    d = preceding_mean(d, resting, "rhr", "rhr_30d_mean", keys=keys)
    d = d.withColumn("rhr_deviation", F.col("resting_heart_rate") - F.col("rhr_30d_mean"))
    temperature = F.col("apple_sleeping_wrist_temperature")
    d = d.withColumn("wrist_temp_14d", ts.rolling_median(temperature, 14, 3, keys)).withColumn("wrist_temp_deviation", temperature - F.col("wrist_temp_14d"))
    d = d.withColumn("trimp_yesterday", F.lag("daily_trimp", 1, 0.0).over(w)).withColumn("trimp_ratio", F.when(F.col("atl") > 0, F.col("trimp_yesterday") / F.col("atl")))
    d = d.withColumns({"hrv_score": expr.score_hrv(F.col("hrv_z")), "sleep_score": expr.score_sleep(F.col("sleep_totalSleep"), F.col("sleep_deep"), F.col("sleep_rem")), "rhr_score": expr.score_rhr(F.col("rhr_deviation")), "trimp_score": expr.score_load(F.col("trimp_ratio")), "wrist_temp_score": expr.score_wrist(F.col("wrist_temp_deviation"))})
    weights = expr.WEIGHTS_WRIST if wrist else expr.WEIGHTS
    scores = {k: F.col(f"{k}_score") for k in weights}
    d = d.withColumn("readiness_score", expr.weighted_composite(scores, weights)).withColumn("n_components", expr.n_components(scores))
    d = ts.consecutive_flag(d, "rhr_deviation", "rhr_flag", 5, 3, keys)
    d = ts.consecutive_flag(d, "wrist_temp_deviation", "wrist_temp_flag", 0.5, 2, keys)
    no = lambda c: F.coalesce(c, F.lit(False))
    d = d.withColumns({
        "hrv_flag": no(F.col("hrv_z") < -1),
        "sleep_flag": no((F.col("sleep_totalSleep") < 7) & (F.col("hrv_z") < 0)),
        "load_flag": no((F.col("atl") > 0) & (F.col("trimp_yesterday") > F.col("atl") * 2)),
        "readiness_status": expr.readiness_status(F.col("readiness_score")),
        "data_quality": expr.data_quality(F.col("n_components"), len(weights)),
    })
    columns = "readiness_score readiness_status ln_rmssd ln_rmssd_7d_mean ln_rmssd_7d_sd hrv_z hrv_score hrv_flag resting_heart_rate rhr_30d_mean rhr_deviation rhr_score rhr_flag sleep_totalSleep sleep_deep sleep_rem sleep_score sleep_flag daily_trimp atl ctl tsb trimp_score load_flag".split()
    if wrist:
        columns += "apple_sleeping_wrist_temperature wrist_temp_14d wrist_temp_deviation wrist_temp_score wrist_temp_flag".split()
    names = {"resting_heart_rate": "resting_hr", "sleep_totalSleep": "sleep_total", "apple_sleeping_wrist_temperature": "wrist_temp"}
    out = d.select(*on, *[F.col(c).alias(names.get(c, c)) for c in columns], "data_quality")
    return out.where(within(F.col("date"), after, before))
