"""Series of training measures: efficiency, load ratios, monotony, recovery, training impulse, fitness and fatigue."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stridewell.functions.dates import sunday_week
from stridewell.functions.expr import is_running, trimp

from . import timeseries as ts
from .joins import preceding_mean

KEYS = ts.KEYS


def runs(activities: DataFrame) -> DataFrame:
    return activities.where(is_running()).withColumn("date", F.to_date("session_start"))


def _rolled(per_run: DataFrame, value: str, rows: int, keys: Sequence[str]) -> DataFrame:
    """per_run with the mean over `rows` days of its daily means; runs keep their rows."""
    return ts.rolling_day_mean(per_run, value, f"{value}_rolling{rows}", rows, keys)


def efficiency(activities: DataFrame, rows: int = 28, keys: Sequence[str] = KEYS) -> DataFrame:
    """Metres a minute by heart beat of runs over 5 km."""
    r = runs(activities).where((F.col("distance_m") > 5000) & (F.col("avg_hr") > 0))
    r = r.select(*keys, "activity_id", "date", (F.col("distance_m") / 1000).alias("distance_km"), (F.col("avg_speed_m_s") * 60 / F.col("avg_hr")).alias("ef"))
    return _rolled(r, "ef", rows, keys)


def heart_rate_efficiency(activities: DataFrame, rows: int = 28, keys: Sequence[str] = KEYS) -> DataFrame:
    """Heart beats a kilometre of runs over 5 km."""
    r = runs(activities).where((F.col("distance_m") > 5000) & (F.col("avg_hr") > 0) & (F.col("avg_pace_min_km") > 0))
    r = r.select(*keys, "activity_id", "date", (F.col("distance_m") / 1000).alias("distance_km"), (F.col("avg_hr") * F.col("avg_pace_min_km")).alias("hre"))
    return _rolled(r, "hre", rows, keys)


def recovery(activities: DataFrame, rows: int = 28, keys: Sequence[str] = KEYS) -> DataFrame:
    r = runs(activities).where(F.col("recovery_hr") > 0)
    r = r.select(*keys, "activity_id", "date", (F.col("distance_m") / 1000).alias("distance_km"), "avg_hr", "recovery_hr")
    return _rolled(r, "recovery_hr", rows, keys)


def daily_km(activities: DataFrame, as_of: date, keys: Sequence[str] = KEYS) -> DataFrame:
    """Kilometres of each day up to as_of, 0 without a run."""
    daily = runs(activities).groupBy(*keys, "date").agg((F.sum("distance_m") / 1000).alias("daily_km"))
    return ts.on_spine(daily, keys, until=as_of).withColumn("daily_km", F.coalesce("daily_km", F.lit(0.0)))


def acwr(activities: DataFrame, as_of: date, keys: Sequence[str] = KEYS) -> DataFrame:
    """Acute to chronic workload ratios: coupled (7 days to 28) and uncoupled (7 days to the 28 before them), and the change on the week before."""
    w = W.partitionBy(*keys).orderBy("date")
    km = F.col("daily_km")
    rows = daily_km(activities, as_of, keys).withColumn("weekly_km", ts.rolling_sum(km, 7, keys))
    rows = rows.withColumn("chronic_km", ts.rolling_mean(km, 28, keys) * 7)
    before = F.when(F.row_number().over(w) >= 36, F.avg(km).over(w.rowsBetween(-35, -8)) * 7)
    rows = rows.withColumn("uncoupled_km", before).withColumn("week_ago", F.lag("weekly_km", 7).over(w))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return rows.select(
        *keys, "date", "daily_km", "weekly_km", "chronic_km", ratio(F.col("weekly_km"), F.col("chronic_km")).alias("acwr"),
        ratio(F.col("weekly_km"), F.col("uncoupled_km")).alias("acwr_uncoupled"),
        (ratio(F.col("weekly_km") - F.col("week_ago"), F.col("week_ago")) * 100).alias("weekly_pct_change"),
    )


def monotony(activities: DataFrame, as_of: date, keys: Sequence[str] = KEYS) -> DataFrame:
    km = F.col("daily_km")
    rows = daily_km(activities, as_of, keys).withColumn("weekly_km", ts.rolling_sum(km, 7, keys))
    rows = rows.withColumn("mean7", ts.rolling_mean(km, 7, keys)).withColumn("sd7", ts.rolling_sd(km, 7, keys))
    rows = rows.withColumn("monotony", F.when(F.col("sd7") > 0, F.col("mean7") / F.col("sd7")))
    return rows.withColumn("strain", F.col("weekly_km") * F.col("monotony")).drop("mean7", "sd7")


def hr_max(activities: DataFrame, keys: Sequence[str] = KEYS, least: int = 10) -> DataFrame:
    """The 98th percentile of the highest heart rates of runs over 20 minutes, where there are at least `least`."""
    r = runs(activities).where((F.col("duration_min") > 20) & (F.col("max_hr") > 0))
    return r.groupBy(*keys).agg(F.percentile("max_hr", F.lit(0.98)).alias("hr_max"), F.count("*").alias("n_runs")).where(F.col("n_runs") >= least)


def hr_max_trend(activities: DataFrame, keys: Sequence[str] = KEYS, least: int = 5) -> DataFrame:
    """The yearly percentile and its least-squares line: hr_max is the line's value, rounded, 150 at least; with one year alone, that year's."""
    r = runs(activities).where((F.col("duration_min") > 20) & (F.col("max_hr") > 0)).withColumn("year", F.year("date"))
    yearly = r.groupBy(*keys, "year").agg(F.percentile("max_hr", F.lit(0.98)).alias("p98"), F.count("*").alias("n_runs")).where(F.col("n_runs") >= least)
    line = yearly.groupBy(*keys).agg(F.regr_slope("p98", "year").alias("slope"), F.regr_intercept("p98", "year").alias("intercept"), F.count("*").alias("n_years"))
    fitted = F.when(F.col("n_years") >= 2, F.col("intercept") + F.col("slope") * F.col("year")).otherwise(F.col("p98"))
    return yearly.join(line, list(keys)).withColumn("hr_max", F.greatest(F.lit(150.0), F.round(fitted)))


def trimp_daily(activities: DataFrame, hr_max_bpm: float | Column = 190.0, resting: DataFrame | None = None, hr_rest: float = 50.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Training impulse of each day with a run over 10 minutes that has a heart rate; resting heart rates are the mean of the 30 days before."""
    r = runs(activities).where((F.col("avg_hr") > 0) & (F.col("duration_min") > 10))
    rest: Column = F.lit(hr_rest)
    if resting is not None:
        r = preceding_mean(r.select(*keys, "date", "duration_min", "avg_hr"), resting, "rhr", "hr_rest", fallback=hr_rest, keys=keys)
        rest = F.col("hr_rest")
    highest = hr_max_bpm if isinstance(hr_max_bpm, Column) else F.lit(hr_max_bpm)
    return r.withColumn("trimp", trimp(F.col("duration_min"), F.col("avg_hr"), rest, highest)).groupBy(*keys, "date").agg(F.sum("trimp").alias("daily_trimp"))


def pmc(activities: DataFrame, as_of: date, hr_max_bpm: float = 190.0, resting: DataFrame | None = None, hr_rest: float = 50.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Daily impulse, fatigue (7 days), fitness (42 days) and form."""
    daily = ts.on_spine(trimp_daily(activities, hr_max_bpm, resting, hr_rest, keys), keys, until=as_of).withColumn("daily_trimp", F.coalesce("daily_trimp", F.lit(0.0)))
    return ts.ewma(daily, "daily_trimp", {"atl": 7, "ctl": 42}, keys).withColumn("tsb", F.col("ctl") - F.col("atl"))


def weekly_km(activities: DataFrame, as_of: date, days: int = 84, keys: Sequence[str] = KEYS, sunday: bool = False) -> DataFrame:
    r = runs(activities).where((F.col("date") > F.date_sub(F.lit(as_of), days)) & (F.col("date") <= F.lit(as_of)))
    week = sunday_week(F.col("date")) if sunday else F.date_trunc("week", "date").cast("date")
    return r.groupBy(*keys, week.alias("week")).agg((F.sum("distance_m") / 1000).alias("km"), F.count("*").alias("n_runs"))


def hrv_band(health: DataFrame, rows: int = 7, metric: str = "heart_rate_variability", keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and one deviation around it over the last `rows` observations."""
    x = F.col("value")
    daily = health.where(F.col("metric") == metric).select(*keys, "date", "value")
    out = daily.withColumn("mean", ts.rolling_mean(x, rows, keys)).withColumn("sd", ts.rolling_sd(x, rows, keys))
    return out.withColumn("low", F.col("mean") - F.col("sd")).withColumn("high", F.col("mean") + F.col("sd"))


def vo2max(daily: DataFrame, activities: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """date, value and origin: from health values first, then the best of what activities report, where they have it."""
    own = daily.where(F.col("metric") == "vo2_max").select(*keys, "date", "value", F.lit("health").alias("origin"))
    if "vo2_max" not in activities.columns:
        return own
    other = runs(activities).where(F.col("vo2_max") > 0).select(*keys, "date", F.col("vo2_max").alias("value"), F.lit("device").alias("origin"))
    return ts.keep_first(own.unionByName(other), [*keys, "date"], [F.col("origin").desc(), F.col("value").desc()])
