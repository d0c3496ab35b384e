"""Reports: calendar comparisons filter before they aggregate, series reports after their windows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridewell.functions.dates import iso_week_label, within
from stridewell.functions.expr import is_running, pace_mmss
from stridewell.operators import metrics, sessions
from stridewell.operators import timeseries as ts

KEYS = ts.KEYS
RANGE = tuple[date | None, date | None]
ALL: RANGE = (None, None)


def ranged(activities: DataFrame, span: RANGE = ALL) -> DataFrame:
    return activities.where(within(F.col("session_start"), *span))


def tail_or_range(df: DataFrame, n: int, span: RANGE = ALL, day: str = "date", tie: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of the range, or without one the last n of each key."""
    if any(span):
        return df.where(within(F.col(day), *span))
    return ts.latest(df, keys, [F.col(day).desc(), *[F.col(t).desc() for t in tie]], n)


def _totals(df: DataFrame, by: Sequence[str | Column], per_day: int | None = None) -> DataFrame:
    km = F.sum("distance_m") / 1000
    first = [(km / per_day).alias("km_per_day")] if per_day else []
    return df.groupBy(*by).agg(*first, km.alias("km_total"), (F.max("distance_m") / 1000).alias("km_max"), F.avg("avg_pace_min_km").alias("pace_mean"), F.count("*").alias("n_runs"))


def _by_year(activities: DataFrame, test: Column, per_day: int, n: int | None, span: RANGE, keys: Sequence[str]) -> DataFrame:
    out = _totals(ranged(activities, span).where(is_running() & test), [*keys, F.year("session_start").alias("year")], per_day)
    return out if n is None else ts.latest(out, keys, [F.col("year").desc()], n)


def datesum(activities: DataFrame, span: RANGE = ALL, keys: Sequence[str] = KEYS) -> DataFrame:
    return ranged(activities, span).where(is_running()).groupBy(*keys).agg(
        (F.sum("distance_m") / 1000).alias("km_total"), (F.max("distance_m") / 1000).alias("km_max"), (F.avg("distance_m") / 1000).alias("km_mean"),
        F.avg("avg_pace_min_km").alias("pace_mean"), F.min("avg_pace_min_km").alias("pace_best"), F.avg("avg_hr").alias("hr_mean"), F.count("*").alias("n_runs"),
    )


def monthtop(activities: DataFrame, n: int = 10, span: RANGE = ALL, keys: Sequence[str] = KEYS) -> DataFrame:
    out = _totals(ranged(activities, span).where(is_running()), [*keys, F.date_format("session_start", "yyyy-MM").alias("year_month")])
    return ts.latest(out, keys, [F.col("km_total").desc(), F.col("year_month").desc()], n)


def monthstatus(activities: DataFrame, as_of: date, n: int | None = None, span: RANGE = ALL, keys: Sequence[str] = KEYS) -> DataFrame:
    start = F.col("session_start")
    return _by_year(activities, (F.month(start) == as_of.month) & (F.dayofmonth(start) <= as_of.day), as_of.day, n, span, keys)


def monthlast(activities: DataFrame, as_of: date, n: int | None = None, span: RANGE = ALL, keys: Sequence[str] = KEYS) -> DataFrame:
    return _by_year(activities, F.month("session_start") == (as_of.month - 2) % 12 + 1, as_of.day, n, span, keys)


def yearstop(activities: DataFrame, as_of: date, n: int | None = None, span: RANGE = ALL, keys: Sequence[str] = KEYS) -> DataFrame:
    return _by_year(activities, F.lit(True), as_of.timetuple().tm_yday, n, span, keys)


def yearstatus(activities: DataFrame, as_of: date, n: int | None = None, span: RANGE = ALL, keys: Sequence[str] = KEYS) -> DataFrame:
    today = as_of.timetuple().tm_yday
    return _by_year(activities, F.dayofyear("session_start") <= today, today, n, span, keys)


def pace_by_year(activities: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    r = activities.where(is_running())
    return r.groupBy(*keys, F.year("session_start").alias("year")).agg(F.sum("duration_min").alias("minutes"), F.avg("avg_pace_min_km").alias("pace_mean"), F.min("avg_pace_min_km").alias("pace_best"))


def distance_by_year(activities: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    r = activities.where(is_running())
    km = F.col("distance_m") / 1000
    return r.groupBy(*keys, F.year("session_start").alias("year")).agg(F.max(km).alias("km_max"), F.sum(km).alias("km_total"), F.avg(km).alias("km_mean"))


def mostrecent(activities: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return activities.groupBy(*keys).agg(F.count("*").alias("n_activities"), F.min("session_start").alias("first_start"), F.max("session_start").alias("last_start"), (F.sum("distance_m") / 1000).alias("km_total"))


def runs_month(activities: DataFrame, as_of: date, n: int | None = None, span: RANGE = ALL, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs of the range, or of as_of's month, the newest first."""
    start = as_of.replace(day=1)
    span = span if any(span) else (start, date(start.year + start.month // 12, start.month % 12 + 1, 1))
    r = ranged(activities, span).where(is_running())
    out = r.select(*keys, "activity_id", "session_start", F.year("session_start").alias("year"), F.month("session_start").alias("month"), F.dayofmonth("session_start").alias("day"), (F.col("distance_m") / 1000).alias("km"), F.col("avg_pace_min_km").alias("pace"), F.col("avg_hr").alias("hr"))
    return out if n is None else ts.latest(out, keys, [F.col("session_start").desc(), F.col("activity_id").desc()], n)


def month_footer(runs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Count, kilometres and mean pace of a list of runs."""
    return runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.sum("km").alias("km"), F.avg("pace").alias("pace_mean"))


def recent_runs(activities: DataFrame, n: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    r = ts.latest(activities.where(is_running()), keys, [F.col("session_start").desc(), F.col("activity_id").desc()], n)
    return r.select(*keys, "activity_id", "session_start", (F.col("distance_m") / 1000).alias("km"), pace_mmss(F.col("avg_pace_min_km")).alias("pace"), F.col("avg_hr").alias("hr"))


def compare_periods(activities: DataFrame, first: RANGE, second: RANGE, keys: Sequence[str] = KEYS) -> DataFrame:
    """Both periods in one scan; they may overlap."""
    marks = [F.when(within(F.col("session_start"), *span), F.lit(name)) for name, span in (("first", first), ("second", second))]
    r = activities.where(is_running()).withColumn("period", F.explode(F.array_compact(F.array(*marks))))
    return datesum(r, keys=[*keys, "period"])


def datesum_buckets(activities: DataFrame, span: tuple[date, date], keys: Sequence[str] = KEYS) -> DataFrame:
    """Kilometres by day under 60 days, by ISO week under 18 months, else by month."""
    days = (span[1] - span[0]).days
    day = F.to_date("session_start")
    bucket = day.cast("string") if days < 60 else iso_week_label(day) if days / 30.44 < 18 else F.date_format(day, "yyyy-MM")
    return ranged(activities, span).where(is_running()).groupBy(*keys, bucket.alias("bucket")).agg((F.sum("distance_m") / 1000).alias("km"), F.count("*").alias("n_runs"))


def ef(activities: DataFrame, n: int = 28, span: RANGE = ALL) -> DataFrame:
    return tail_or_range(metrics.efficiency(activities), n, span, tie=["activity_id"])


def hre(activities: DataFrame, n: int = 28, span: RANGE = ALL) -> DataFrame:
    return tail_or_range(metrics.heart_rate_efficiency(activities), n, span, tie=["activity_id"])


def acwr(activities: DataFrame, as_of: date, n: int = 28, span: RANGE = ALL) -> DataFrame:
    return tail_or_range(metrics.acwr(activities, as_of).select(*KEYS, "date", "daily_km", "weekly_km", "acwr"), n, span)


def monotony(activities: DataFrame, as_of: date, n: int = 28, span: RANGE = ALL) -> DataFrame:
    return tail_or_range(metrics.monotony(activities, as_of), n, span)


def pmc(activities: DataFrame, as_of: date, n: int = 28, span: RANGE = ALL, **settings) -> DataFrame:
    return tail_or_range(metrics.pmc(activities, as_of, **settings), n, span)


def recovery_hr(activities: DataFrame, n: int = 28, span: RANGE = ALL) -> DataFrame:
    return tail_or_range(metrics.recovery(activities).drop("avg_hr"), n, span, tie=["activity_id"])


def hr_zones(zones: sessions.Zones, n: int = 12, span: RANGE = ALL) -> DataFrame:
    months = sessions.polarization_index(zones.monthly).withColumn("date", F.to_date(F.concat("year_month", F.lit("-01"))))
    return tail_or_range(months, n, span)


def decoupling(series: DataFrame, n: int = 28, span: RANGE = ALL) -> DataFrame:
    return tail_or_range(series, n, span, tie=["activity_id"])


def metric(daily: DataFrame, name: str, n: int = 30, span: RANGE = ALL) -> DataFrame:
    return tail_or_range(daily.where(F.col("metric") == name).select(*KEYS, "date", "metric", "value"), n, span)


def readiness(series: DataFrame, n: int = 14, span: RANGE = ALL) -> DataFrame:
    return tail_or_range(series, n, span)


def year_of(series: DataFrame, as_of: date) -> DataFrame:
    """The days of a series in the year before a day, for a panel."""
    return series.where(within(F.col("date"), as_of - timedelta(days=365), None))


def acwr_panel(activities: DataFrame, as_of: date) -> DataFrame:
    """A year of daily ratios."""
    return year_of(metrics.acwr(activities, as_of), as_of)


def series_panel(series: DataFrame, activities: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weekly kilometres between the first and the last week of a series, for the bars under it."""
    from stridewell.functions.dates import monday_week

    ends = series.groupBy(*keys).agg(F.min("date").alias("__a"), F.max("date").alias("__z"))
    weeks = metrics.runs(activities).groupBy(*keys, monday_week(F.col("date")).alias("week")).agg((F.sum("distance_m") / 1000).alias("km"))
    return weeks.join(ends, list(keys)).where((F.col("week") >= F.col("__a")) & (F.col("week") <= F.col("__z"))).drop("__a", "__z")
