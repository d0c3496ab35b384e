"""Nights from sleep segments: assignment to dates, choice of a source, totals and times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stridewell.functions.expr import hour_fraction, plain_spaces

from .health import PRIORITY, SLEEP, rank

#: Stages as devices name them, in English and Swedish; others are dropped.
STAGES = {"Core": "core", "Deep": "deep", "REM": "rem", "Awake": "awake", "In Bed": "inBed", "Asleep": "asleep", "Kärna": "core", "Djup": "deep", "Vaken": "awake", "I sängen": "inBed", "Sova": "asleep"}
SUFFIXES = ("core", "deep", "rem", "awake", "inBed", "asleep")
TIMES = ("sleepStart", "sleepEnd", "inBedStart", "inBedEnd")


def night(start: Column, end: Column) -> Column:
    """The date a segment (text times) counts for: the day after its start from 18 o'clock on, else the day of its end."""
    day = lambda c: F.try_to_date(F.substring(c, 1, 10))
    return F.when(F.substring(start, 12, 2).try_cast("int") >= 18, F.date_add(day(start), 1)).otherwise(day(end))


def segments(raw: DataFrame, keys: Sequence[str] = ("athlete_id",)) -> DataFrame:
    """Segments with date and suffix, each once; unknown stages are dropped."""
    names = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    rows = raw.withColumn("suffix", F.try_element_at(names, F.col("stage"))).where("suffix is not null").withColumn("source", plain_spaces(F.col("source")))
    rows = rows.withColumn("date", night(F.col("start_ts"), F.col("end_ts")))
    return rows.dropDuplicates([*keys, "date", "stage", "hours", "source", "start_ts", "end_ts"])


def best_source(rows: DataFrame, keys: Sequence[str] = ("athlete_id",), priority: Sequence[str] = PRIORITY) -> DataFrame:
    """The source of each night: one with sleep stages first, then by priority, then by name."""
    staged = rows.groupBy(*keys, "date", "source").agg(F.max(F.col("suffix").isin("core", "deep", "rem")).alias("has_staging"))
    w = W.partitionBy(*keys, "date").orderBy(F.col("has_staging").desc(), rank(F.col("source"), priority), "source")
    return staged.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(*keys, "date", "source", "has_staging")


def summed(suffix: str, hours: str) -> dict[str, Column]:
    """Aggregates of a night's segments by field: hours of each stage (0 if there are none), and when sleep and bed began and ended."""
    of = lambda s: F.when(F.col(suffix) == s, F.col(hours))
    bed = F.col(suffix) == "inBed"
    stages = {s: F.coalesce((F.max if s in ("asleep", "inBed") else F.sum)(of(s)), F.lit(0.0)) for s in SUFFIXES}
    starts, ends = F.col("start_ts"), F.col("end_ts")
    times = {"sleepStart": F.min(F.when(~bed, starts)), "sleepEnd": F.max(F.when(~bed, ends)), "inBedStart": F.min(F.when(bed, starts)), "inBedEnd": F.max(F.when(bed, ends))}
    return stages | times


def total_sleep() -> Column:
    """Hours asleep of a night by its hours of each stage."""
    stages = F.col("core") + F.col("deep") + F.col("rem")
    return F.when(stages > 0, stages).when(F.col("asleep") > 0, F.col("asleep")).when(F.col("inBed") > 0, F.col("inBed")).otherwise(0.0)


def nights(raw: DataFrame, keys: Sequence[str] = ("athlete_id",), priority: Sequence[str] = PRIORITY) -> DataFrame:
    """Hours of each stage, total sleep, and when sleep and bed began and ended (text), of the best source of each night.

    The best source is the first of those with sleep stages, by priority, then by name. Each source's night is summed up where its
    segments are, so that only sums are dealt by night, and no task holds the segments of a night however many they are.
    """
    staged = F.max(F.col("suffix").isin("core", "deep", "rem")).alias("__staged")
    nightly = segments(raw, keys).groupBy(*keys, "date", "source").agg(staged, *[c.alias(f) for f, c in summed("suffix", "hours").items()])
    first = W.partitionBy(*keys, "date").orderBy(F.col("__staged").desc(), rank(F.col("source"), priority), "source")
    return nightly.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__staged", "__nth").withColumn("totalSleep", total_sleep())


def long_rows(nightly: DataFrame, keys: Sequence[str] = ("athlete_id",), zone: str = "Europe/Stockholm") -> DataFrame:
    """sleep_* rows (date, metric, value, source): hours, and times as hours of the day; what is missing or can't be read gives no row."""
    one = lambda f, v: F.struct(F.lit(f"sleep_{f}").alias("metric"), v.cast("double").alias("value"))
    rows = F.array(*[one(f, F.col(f)) for f in ("totalSleep", *SUFFIXES)], *[one(f, hour_fraction(F.col(f), zone)) for f in TIMES])
    return nightly.select(*keys, "date", "source", F.explode(rows).alias("r")).where("r.value is not null").select(*keys, "date", "r.metric", "r.value", "source")


aggregated_rows = long_rows


def from_samples(samples: DataFrame, keys: Sequence[str] = ("athlete_id",), zone: str = "Europe/Stockholm", priority: Sequence[str] = PRIORITY) -> DataFrame:
    """sleep_* rows (date, metric, value, source) of sleep samples (name, sample) in either format, told apart sample by sample.

    A sample with totalSleep is a night that the device has summed up; another with a stage in value is a segment,
    from which nights are made. Other samples, and segments of stages that no one knows, give no row.
    """
    from .measures import measures

    return measures(samples.where(F.col("name") == SLEEP), keys, zone, priority)


def stage_trend(nightly: DataFrame, unit: str, keys: Sequence[str] = ("athlete_id",)) -> DataFrame:
    """Mean hours of each stage by day, week or month."""
    return nightly.groupBy(*keys, F.date_trunc(unit, F.col("date")).cast("date").alias("period")).agg(*[F.avg(s).alias(s) for s in ("core", "deep", "rem", "awake")], F.count("*").alias("n_nights"))
