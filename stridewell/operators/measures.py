"""Measures of health samples of any kind, in one pass: quantities, heart rates, summed-up nights and segments of nights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stridewell.functions.expr import hour_fraction, plain_spaces

from .health import PRIORITY, SLEEP, rank
from .sleep import STAGES, SUFFIXES, TIMES, night, summed, total_sleep

#: Parts of a source's day that are dealt to tasks of their own.
SLICES = 64
ROW = "struct<metric:string,value:double,date:date,source:string,start_ts:string,end_ts:string,stage:string>"


def _row(metric: Column, value: Column, date: Column, source: Column, start: Column | None = None, end: Column | None = None, stage: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(metric.alias("metric"), value.cast("double").alias("value"), date.alias("date"), source.alias("source"), *[(none if c is None else c).alias(n) for c, n in ((start, "start_ts"), (end, "end_ts"), (stage, "stage"))])


def rows_of(name: Column, sample: Column, zone: str) -> Column:
    """The rows (ROW) that a sample gives: three of a heart rate, eleven of a night at most, one of another; none of what can't be read.

    A segment has start_ts, end_ts and stage, its suffix as metric and its hours as value.
    """
    day, source = F.try_to_date(F.substring(sample["date"], 1, 10)), sample["source"]
    three = [_row(F.concat(name, F.lit(f"_{k.lower()}")), sample[k], day, source) for k in ("Min", "Avg", "Max")]
    nights = [_row(F.lit(f"sleep_{f}"), sample[f], day, source) for f in ("totalSleep", *SUFFIXES)] + [_row(F.lit(f"sleep_{f}"), hour_fraction(sample[f], zone), day, source) for f in TIMES]
    start, end = (F.coalesce(*[sample[n] for n in names], F.lit("")) for names in (("startDate", "start", "date"), ("endDate", "end", "date")))
    suffix = F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), sample["value"])
    segment = _row(suffix, F.coalesce(sample["qty"], F.lit(0.0)), night(start, end), plain_spaces(source), start, end, sample["value"])
    asleep = F.when(sample["totalSleep"].isNotNull(), F.array(*nights)).when(suffix.isNotNull(), F.array(segment))
    found = F.when(name == SLEEP, asleep).when(sample["Avg"].isNotNull(), F.array(*three)).otherwise(F.array(_row(name, sample["qty"], day, source)))
    return F.filter(F.coalesce(found, F.array().cast(f"array<{ROW}>")), lambda r: r["value"].isNotNull() & r["date"].isNotNull())


def measures(samples: DataFrame, keys: Sequence[str] = ("athlete_id",), zone: str = "Europe/Stockholm", priority: Sequence[str] = PRIORITY, seen: Observation | None = None) -> DataFrame:
    """keys, date, metric, value and source of samples (name, sample): quantities as they are, and sleep_* rows of nights.

    Nights come from samples that a device has summed up, and from the segments of each night's best source; see
    `sleep.nights`. The samples are read and parsed once, and dealt twice. First by SLICES of each source's day, in which repeated segments meet and
    are summed up; then by day, but each quantity by itself. So no task gets a day or a night whole, and each sorts its rows once: what
    is grouped later goes by the first columns of that order. seen counts `samples` and `dropped` (those that give no row) in the same pass.
    """
    rows = samples.select(*keys, rows_of(F.col("name"), F.col("sample"), zone).alias("__rows"))
    if seen is not None:
        rows = rows.observe(seen, F.count("*").alias("samples"), F.count_if(F.size("__rows") == 0).alias("dropped"))
    rows = rows.select(*keys, F.explode("__rows").alias("r")).select(*keys, "r.*")
    # values are grouped by as text, since Spark sorts anew wherever it groups by doubles; quantity is null of a segment
    rows = rows.withColumn("number", F.col("value").cast("string"))
    rows = rows.withColumn("quantity", F.when(F.col("start_ts").isNull(), F.struct("metric", "number", "source")))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("metric", "number", "stage", "start_ts", "end_ts"), F.lit(SLICES))).repartition(*keys, "date", "source", "slice")
    group = [*keys, "date", "source", "slice", "quantity"]
    once = rows.groupBy(*group, "stage", "number", "start_ts", "end_ts").agg(F.first("metric").alias("metric"), F.first("value").alias("value"), F.count("*").alias("times"))
    staged = F.max(F.col("metric").isin("core", "deep", "rem"))
    parts = once.groupBy(*group).agg(staged.alias("staged"), F.first("value").alias("value"), F.max("times").alias("times"), *[c.alias(f) for f, c in summed("metric", "value").items()])

    parts = parts.withColumn("place", F.when(F.col("quantity").isNotNull(), F.xxhash64("quantity"))).repartition(*keys, "date", "place")
    most = ("staged", "value", "times", "inBed", "asleep", "sleepEnd", "inBedEnd")
    whole = {f: (F.max if f in most else F.min if f in TIMES else F.sum)(f) for f in ("staged", "value", "times", *SUFFIXES, *TIMES)}
    sources = parts.groupBy(*keys, "date", "place", "quantity", "source").agg(*[c.alias(f) for f, c in whole.items()])
    order = F.struct(~F.col("staged"), rank(F.col("source"), priority), "source")
    best = sources.groupBy(*keys, "date", "place", "quantity").agg(F.min_by(F.struct("source", "value", "times", *SUFFIXES, *TIMES), order).alias("n")).select(*keys, "date", "quantity", "n.*")
    one = lambda f, v: F.struct(F.lit(f"sleep_{f}").alias("metric"), v.alias("value"))
    night_rows = F.array(one("totalSleep", total_sleep()), *[one(f, F.col(f)) for f in SUFFIXES], *[one(f, hour_fraction(F.col(f), zone)) for f in TIMES])
    quantity = F.struct(F.col("quantity.metric").alias("metric"), "value")
    out = best.select(*keys, "date", "source", F.when(F.col("quantity").isNull(), night_rows).alias("night"), quantity.alias("quantity"), F.col("times").cast("int").alias("times"))
    out = out.select(*keys, "date", "source", F.explode(F.coalesce("night", F.array_repeat("quantity", F.col("times")))).alias("r"))
    return out.where("r.value is not null").select(*keys, "date", "r.metric", "r.value", "source")
