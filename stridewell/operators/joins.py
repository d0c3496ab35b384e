"""Joins on time: nearest within a tolerance, near duplicates, and means over preceding days; all are windows or equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _around(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, seconds: int, keys: Sequence[str], tie: str | None = None) -> DataFrame:
    """Each left row (a struct) with the last right row at or before its time and the first at or after it, among those in its slot of `seconds` and the two beside it.

    Right rows are put into three slots and left rows into one, and both are sorted together within a slot: rows are
    passed once in either direction, so the work doesn't grow with the number of pairs. Of right rows of one time the
    one with the smallest `tie` counts.
    """
    micros = lambda c: F.unix_micros(F.col(c))
    slot = lambda c: F.floor(micros(c) / (seconds * 1_000_000)).cast("long")
    own = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    of_left, of_right = left.select(F.struct("*").alias("x")).schema["x"].dataType, right.select(F.struct("*").alias("x")).schema["x"].dataType
    a = left.select(*own, slot(left_ts).alias("slot"), micros(left_ts).alias("at"), F.struct("*").alias("row"), F.lit(None).cast(of_right).alias("other"))
    b = right.where(F.col(right_ts).isNotNull()).select(*own, F.explode(F.array(*[slot(right_ts) + k for k in (-1, 0, 1)])).alias("slot"), micros(right_ts).alias("at"), F.lit(None).cast(of_left).alias("row"), F.struct("*").alias("other"))
    last = F.col("row").isNotNull(), (F.col(f"other.{tie}").desc() if tie else F.lit(0))
    near = W.partitionBy(*[f"k{i}" for i in range(len(keys))], "slot").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("before", F.last("other", ignorenulls=True).over(near.orderBy("at", *last))).withColumn("after", F.last("other", ignorenulls=True).over(near.orderBy(F.col("at").desc(), *last)))
    return both.where("row is not null").select("row", "at", "before", "after")


def nearest_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, left_key: str, right_key: str, tolerance: int = 120, keys: Sequence[str] = ()) -> DataFrame:
    """Each left row with the right row closest in time, at most `tolerance` seconds away; of equally close ones the smallest right_key.

    Right columns are null where there is none; a right row may serve several left ones. Column names must differ, but for keys.
    """
    near = _around(left, right, left_ts, right_ts, tolerance, keys, right_key)
    gap = lambda c: F.abs(F.col("at") - F.unix_micros(F.col(f"{c}.{right_ts}")))
    near = near.withColumn("gap", F.least(gap("before"), gap("after")))
    first = F.coalesce((gap("before") < gap("after")) | ((gap("before") == gap("after")) & (F.col(f"before.{right_key}") <= F.col(f"after.{right_key}"))), gap("before").isNotNull())
    best = F.when(F.col("gap") <= tolerance * 1_000_000, F.when(first, F.col("before")).otherwise(F.col("after")))
    return near.select("row", best.alias("best")).select("row.*", *[F.col(f"best.{c}").alias(c) for c in right.columns if c not in keys])


def near_duplicates(new: DataFrame, known: DataFrame, new_ts: str, known_ts: str, seconds: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of new that start less than `seconds` from a known start."""
    near = _around(new, known.select(*keys, known_ts), new_ts, known_ts, seconds, keys)
    gap = lambda c: F.abs(F.col("at") - F.unix_micros(F.col(f"{c}.{known_ts}")))
    return near.where(F.least(gap("before"), gap("after")) < seconds * 1_000_000).select("row.*")


def preceding_mean(targets: DataFrame, observed: DataFrame, value: str, out: str, days: int = 30, fallback: float | None = None, keys: Sequence[str] = ("athlete_id",), day: str = "date") -> DataFrame:
    """Adds to each target day the mean of the observations of the `days` days before it.

    Without any, and for days before the first or more than one day after the last observation, it is `fallback`.
    Targets and observations are united and taken by one range window, which needs no join of days to days.
    """
    t = targets.withColumn("__target", F.lit(True)).withColumn("__x", F.lit(None).cast("double"))
    o = observed.select(*keys, day, F.col(value).cast("double").alias("__x")).withColumn("__target", F.lit(False))
    n = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    every = W.partitionBy(*keys)
    both = t.unionByName(o, allowMissingColumns=True).withColumn("__n", n)
    both = both.withColumn("__mean", F.avg("__x").over(every.orderBy("__n").rangeBetween(-days, -1)))
    both = both.withColumn("__first", F.min(F.when(F.col("__x").isNotNull(), F.col("__n"))).over(every)).withColumn("__last", F.max(F.when(F.col("__x").isNotNull(), F.col("__n"))).over(every))
    fine = (F.col("__n") >= F.col("__first")) & (F.col("__n") <= F.col("__last") + 1)
    mean = F.coalesce(F.when(fine, F.col("__mean")), F.lit(fallback).cast("double"))
    return both.where("__target").withColumn(out, mean).select(*targets.columns, out)


def changed_rows(after: DataFrame, before: DataFrame, keys: Sequence[str] = ("athlete_id", "date", "metric"), value: str = "value") -> DataFrame:
    """Rows of after whose keys and value aren't in before; null equals null, and values are compared exactly."""
    b = before.select(*[F.col(c).alias(f"__{c}") for c in (*keys, value)])
    test = F.lit(True)
    for c in (*keys, value):
        test = test & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return after.join(b, test, "left_anti")


def new_rows(found: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys aren't known yet."""
    return found.join(known.select(*keys).distinct(), list(keys), "left_anti")
