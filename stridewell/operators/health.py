"""Health measures: parsing, cleaning of sources, daily values, priority of sources, wide form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stridewell.functions.expr import plain_spaces

from .timeseries import keep_first

#: Measures that add up over a day, those of which the least counts, and those of which the largest does.
SUMMED = ("step_count", "active_energy", "basal_energy_burned", "flights_climbed", "apple_exercise_time", "apple_stand_time", "apple_stand_hour", "walking_running_distance", "cycling_distance", "mindful_minutes", "time_in_daylight")
LEAST = ("resting_heart_rate", "heart_rate_min")
LARGEST = ("heart_rate_max",)
#: Measures whose values from sources with this name are copies of another source's.
MIXED_METRICS, MIXED_SOURCE = ("resting_heart_rate",), "Connect"
#: Fixed value: the metric whose samples are nights or segments of them.
SLEEP = "sleep_analysis"
#: Sources, the most trusted first.
PRIORITY = ("watch", "ring", "phone")
WIDE = ("heart_rate_variability", "resting_heart_rate", "sleep_totalSleep", "sleep_deep", "sleep_rem", "apple_sleeping_wrist_temperature")


def rank(source: Column, priority: Sequence[str] = PRIORITY, last: int = 99) -> Column:
    out = F.lit(last)
    for i, s in reversed(list(enumerate(priority, 1))):
        out = F.when(source == s, i).otherwise(out)
    return out


def push_samples(raw: DataFrame, body: str = "body", schema: str | None = None, seen: Observation | None = None) -> DataFrame:
    """name, units, place and sample (a struct) of each sample of pushed JSON bodies, besides their other columns.

    Metrics are under data.metrics, else under metrics. A body that can't be read gives no row; seen counts `bodies` and
    `unreadable` in the same pass. place orders the samples of a body.
    """
    from stridewell.schemas import PUSH

    parsed = raw.withColumn("__j", F.from_json(F.col(body), schema or PUSH))
    keep = [c for c in raw.columns if c != body]
    parsed = parsed.select(*keep, F.coalesce("__j.data.metrics", "__j.metrics").alias("__m"))
    if seen is not None:
        parsed = parsed.observe(seen, F.count("*").alias("bodies"), F.count_if(F.col("__m").isNull()).alias("unreadable"))
    m = parsed.select(*keep, F.posexplode("__m").alias("__i", "__m"))
    return m.select(*keep, F.col("__m.name").alias("name"), F.col("__m.units").alias("units"), "__i", F.posexplode("__m.data").alias("__k", "sample")).select(*keep, "name", "units", F.struct("__i", "__k").alias("place"), "sample")


def quantities(samples: DataFrame) -> DataFrame:
    """metric, units, at (the full time as it was sent), date, value and source of samples (name, units, sample) that aren't sleep, besides their other columns.

    A heart_rate sample with Min, Avg and Max becomes three rows; one that holds no value becomes none.
    """
    keep = [c for c in samples.columns if c not in ("name", "units", "sample")]
    three = F.array(*[F.struct(F.concat(F.col("name"), F.lit(f"_{k.lower()}")).alias("metric"), F.col(f"sample.{k}").alias("value")) for k in ("Min", "Avg", "Max")])
    one = F.array(F.struct(F.col("name").alias("metric"), F.col("sample.qty").alias("value")))
    at = F.coalesce("sample.date", "sample.startDate", F.lit(""))
    rows = samples.where(F.col("name") != SLEEP).select(*keep, "units", at.alias("at"), F.col("sample.source").alias("source"), F.explode(F.when(F.col("sample.Avg").isNotNull(), three).otherwise(one)).alias("__v"))
    return rows.select(*keep, F.col("__v.metric").alias("metric"), "units", "at", F.expr("try_to_date(substring(at, 1, 10))").alias("date"), F.col("__v.value").alias("value"), "source").where("value is not null")


def parse_push(raw: DataFrame, body: str = "body", schema: str | None = None) -> DataFrame:
    """The quantities of pushed JSON bodies; `measures.measures` has their nights as well."""
    return quantities(push_samples(raw, body, schema).drop("place")).drop("at")


def clean_sources(df: DataFrame, keys: Sequence[str] = ("athlete_id",)) -> DataFrame:
    """Without copied resting heart rates where the original is there, and without nights that can't be.

    A (date, source) whose sleep_totalSleep is over 16 hours, or under 2 with over 4 hours in bed by any such pair of
    values of that date, loses all its sleep rows. Two windows; no join.
    """
    source = plain_spaces(F.col("source"))
    rows = df.withColumn("source", source)
    mixed = F.coalesce(F.col("source").contains(MIXED_SOURCE), F.lit(False))
    pure = F.max((~mixed).cast("int")).over(W.partitionBy(*keys, "date", "metric"))
    rows = rows.withColumn("__pure", pure).where(~(F.col("metric").isin(*MIXED_METRICS) & mixed & (F.col("__pure") == 1))).drop("__pure")
    night = W.partitionBy(*keys, "date", "source")
    value = lambda m: F.when(F.col("metric") == m, F.col("value"))
    both = (F.max(value("sleep_inBed")).over(night) > 4) & F.max(value("sleep_totalSleep")).over(night).isNotNull()
    rows = rows.withColumn("__in_bed", F.coalesce(both, F.lit(False)))
    short = (F.col("metric") == "sleep_totalSleep") & (F.col("value") < 2) & F.max("__in_bed").over(W.partitionBy(*keys, "date"))
    rows = rows.withColumn("__bad", F.coalesce(((F.col("metric") == "sleep_totalSleep") & (F.col("value") > 16)) | short, F.lit(False)))
    rows = rows.withColumn("__bad", F.max("__bad").over(night))
    return rows.where(~(F.col("__bad") & F.col("metric").startswith("sleep_"))).drop("__in_bed", "__bad")


def aggregate_daily(df: DataFrame, keys: Sequence[str] = ("athlete_id",)) -> DataFrame:
    """One value for each (date, metric): sum, least, largest or mean by the metric's rule; the first source."""
    metric = F.col("metric")
    value = F.when(metric.isin(*SUMMED), F.sum("value")).when(metric.isin(*LEAST), F.min("value")).when(metric.isin(*LARGEST), F.max("value")).otherwise(F.avg("value"))
    return df.groupBy(*keys, "date", "metric").agg(value.alias("value"), F.min_by("source", "seq").alias("source"))


def priority_dedup(new: DataFrame, cached: DataFrame | None = None, keys: Sequence[str] = ("athlete_id",), priority: Sequence[str] = PRIORITY) -> DataFrame:
    """One row for each (date, metric): from the most trusted source, new before cached, then the first."""
    rows = new.withColumn("__cached", F.lit(0))
    if cached is not None:
        rows = rows.unionByName(cached.withColumn("__cached", F.lit(1)))
    return keep_first(rows, [*keys, "date", "metric"], [rank(F.col("source"), priority), F.col("__cached"), F.col("seq")]).drop("__cached")


def wide(df: DataFrame, metrics: Sequence[str] = WIDE, keys: Sequence[str] = ("athlete_id",)) -> DataFrame:
    """A column for each listed metric, so that the schema doesn't depend on the data; values must be unique for (date, metric)."""
    return df.where(F.col("metric").isin(*metrics)).groupBy(*keys, "date").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def readiness_inputs(df: DataFrame, keys: Sequence[str] = ("athlete_id",)) -> DataFrame:
    hrv = F.col("heart_rate_variability")
    return wide(df, WIDE, keys).withColumn("ln_rmssd", F.when(hrv > 0, F.log(hrv)))


def resting_hr(df: DataFrame, keys: Sequence[str] = ("athlete_id",)) -> DataFrame:
    """The least plausible resting heart rate of each day, without copies from other devices."""
    rows = df.where((F.col("metric") == "resting_heart_rate") & ~F.coalesce(F.col("source").contains(MIXED_SOURCE), F.lit(False)) & F.col("value").between(30, 100))
    return rows.groupBy(*keys, "date").agg(F.min("value").alias("rhr"))


def body_composition(df: DataFrame, known_dates: DataFrame | None = None, keys: Sequence[str] = ("athlete_id",)) -> DataFrame:
    """Fat percentage and lean mass of (ts, weight, fat_mass), one row for each timestamp, on days not known yet; rounded to 6 digits."""
    rows = keep_first(df, [*keys, "ts"], ["seq"]).withColumn("date", F.to_date("ts"))
    if known_dates is not None:
        rows = rows.join(known_dates.select(*keys, "date").distinct(), [*keys, "date"], "left_anti")
    return rows.select(*keys, "ts", "date", "weight", F.round(F.try_divide(F.col("fat_mass") * 100, F.col("weight")), 6).alias("fat_pct"), F.round(F.col("weight") - F.col("fat_mass"), 6).alias("lean_mass"))


def heart_rate_rows(df: DataFrame, keys: Sequence[str] = ("athlete_id", "date", "source")) -> DataFrame:
    """One row each for the least, mean and largest heart rate."""
    return df.unpivot(list(keys), ["heart_rate_min", "heart_rate_avg", "heart_rate_max"], "metric", "value").where("value is not null")


def stats(df: DataFrame, keys: Sequence[str] = ("athlete_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct("metric").alias("n_metrics"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
