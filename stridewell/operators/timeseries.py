"""Date spines and window operators over (keys, day) series; every window is partitioned by the keys."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("athlete_id",)


def date_spine(df: DataFrame, keys: Sequence[str] = KEYS, day: str = "date", until: date | None = None) -> DataFrame:
    """keys and each day from a key's first to its last one, or to `until` where that is later."""
    last = F.max(day) if until is None else F.greatest(F.max(day), F.lit(until))
    return df.groupBy(*keys).agg(F.min(day).alias("__a"), last.alias("__z")).where("__a is not null").select(*keys, F.explode(F.sequence("__a", "__z", F.expr("interval 1 day"))).alias(day))


def on_spine(daily: DataFrame, keys: Sequence[str] = KEYS, day: str = "date", until: date | None = None) -> DataFrame:
    """daily with a row for each day of its spine; the measures of added days are null. Rows without a day are dropped.

    Each row brings the days up to the next one, so that no join is needed and one deal by the keys serves this and later windows.
    """
    following = F.lead(day).over(W.partitionBy(*keys).orderBy(day))
    last = F.col(day) if until is None else F.greatest(F.col(day), F.lit(until))
    rows = daily.where(F.col(day).isNotNull()).withColumn("__last", F.greatest(F.col(day), F.coalesce(F.date_sub(following, 1), last)))
    rows = rows.withColumn("__day", F.explode(F.sequence(day, "__last", F.expr("interval 1 day"))))
    return rows.select(*[F.col("__day").alias(c) if c == day else F.col(c) if c in keys else F.when(F.col("__day") == F.col(day), F.col(c)).alias(c) for c in daily.columns])


def window(rows: int | None = None, keys: Sequence[str] = KEYS, order: Sequence[str] = ("date",)):
    w = W.partitionBy(*keys).orderBy(*order)
    return w if rows is None else w.rowsBetween(-(rows - 1), 0)


def full(value: Column, rows: int, keys: Sequence[str] = KEYS, order: Sequence[str] = ("date",)) -> Column:
    """value where as many rows have been seen, else null."""
    return F.when(F.row_number().over(window(None, keys, order)) >= rows, value)


def rolling_sum(x: Column, rows: int, keys: Sequence[str] = KEYS, order: Sequence[str] = ("date",)) -> Column:
    return full(F.coalesce(F.sum(x).over(window(rows, keys, order)), F.lit(0.0)), rows, keys, order)


def rolling_mean(x: Column, rows: int, keys: Sequence[str] = KEYS, order: Sequence[str] = ("date",)) -> Column:
    return full(F.avg(x).over(window(rows, keys, order)), rows, keys, order)


def rolling_day_mean(df: DataFrame, value: str, out: str, days: int, keys: Sequence[str] = KEYS, day: str = "date") -> DataFrame:
    """Adds to each row the mean of the daily means of the last `days` days, its own included, once so many days have passed since the first.

    A day may have several rows, or none. One range window over the days; neither a spine nor a join.
    """
    own, every = W.partitionBy(*keys, day), W.partitionBy(*keys)
    daily = F.when(F.row_number().over(own.orderBy(F.lit(0))) == 1, F.avg(value).over(own))
    rows = df.withColumn("__daily", daily).withColumn("__n", F.unix_date(day))
    mean = F.avg("__daily").over(every.orderBy("__n").rangeBetween(1 - days, 0))
    return rows.withColumn(out, F.when(F.col("__n") - F.min("__n").over(every) >= days - 1, mean)).drop("__daily", "__n")


def rolling_sd(x: Column, rows: int, keys: Sequence[str] = KEYS, order: Sequence[str] = ("date",)) -> Column:
    return full(F.stddev_samp(x).over(window(rows, keys, order)), rows, keys, order)


def rolling_median(x: Column, rows: int, least: int, keys: Sequence[str] = KEYS, order: Sequence[str] = ("date",)) -> Column:
    """Median of up to `rows` rows, if `least` of them have a value."""
    w = window(rows, keys, order)
    return F.when(F.count(x).over(w) >= least, F.percentile(x, F.lit(0.5)).over(w))


def ewma(df: DataFrame, value: str, spans: dict[str, float], keys: Sequence[str] = KEYS, day: str = "date", block: int = 64) -> DataFrame:
    """Adds, for each name and span, e = (1 - r) * e_before + r * value with r = 2 / (span + 1).

    The first value that isn't null is the seed; nulls after it count as 0, and rows before it stay null. Rows are cut
    into blocks: within a block the sum has a closed form, and only block ends are folded, so a key's history is never
    gathered row by row, and no power of 1 - r goes beyond a block.
    """
    order = W.partitionBy(*keys).orderBy(day)
    seen = F.last(F.when(F.col(value).isNotNull(), True), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = df.withColumn("__on", F.coalesce(seen, F.lit(False)))
    rows = rows.withColumn("__n", F.sum(F.col("__on").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1)
    rows = rows.withColumn("__b", F.when(F.col("__on"), F.floor(F.col("__n") / block)).otherwise(-1)).withColumn("__j", (F.col("__n") % block).cast("double"))
    inside = W.partitionBy(*keys, "__b").orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    x = F.coalesce(F.col(value), F.lit(0.0))
    rates = {name: 2.0 / (span + 1.0) for name, span in spans.items()}
    for name, r in rates.items():
        if r == 1.0:  # a span of 1 is the value itself
            rows = rows.withColumn(f"__part_{name}", F.when(F.col("__on"), x))
            continue
        rows = rows.withColumn(f"__part_{name}", F.sum(x * r * F.pow(F.lit(1.0 - r), -F.col("__j"))).over(inside) * F.pow(F.lit(1.0 - r), F.col("__j")))
    ends = rows.where("__b >= 0").groupBy(*keys, "__b").agg(F.min_by(value, "__j").alias("__first"), *[F.max_by(f"__part_{n}", "__j").alias(f"__part_{n}") for n in rates])
    blocks = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__b", "__first", *[f"__part_{n}" for n in rates]))).alias("__all"))

    def fold(state: Column, x: Column) -> Column:
        after = F.struct(*[(state["now"][n] * float((1.0 - r) ** block) + x[f"__part_{n}"]).alias(n) for n, r in rates.items()])
        return F.struct(F.concat(state["starts"], F.array(state["now"])).alias("starts"), after.alias("now"))

    kind = "struct<" + ",".join(f"{n}:double" for n in rates) + ">"
    seed = F.struct(F.array().cast(f"array<{kind}>").alias("starts"), F.struct(*[F.element_at("__all", 1)["__first"].alias(n) for n in rates]).alias("now"))
    starts = blocks.select(*keys, F.posexplode(F.aggregate("__all", seed, fold, lambda s: s["starts"])).alias("__b", "__start")).withColumn("__b", F.col("__b").cast("long"))
    out = rows.withColumn("__b", F.col("__b").cast("long")).join(starts, [*keys, "__b"], "left")
    for name, r in rates.items():
        out = out.withColumn(name, F.col("__start")[name] * F.pow(F.lit(1.0 - r), F.col("__j") + 1) + F.col(f"__part_{name}"))
    return out.select(*df.columns, *rates)


def consecutive_flag(df: DataFrame, value: str, out: str, threshold: float, least: int, keys: Sequence[str] = KEYS, order: Sequence[str] = ("date",)) -> DataFrame:
    """Adds whether a row is in a run of at least `least` rows above the threshold; a null breaks a run."""
    w = W.partitionBy(*keys).orderBy(*order)
    above = F.coalesce(F.col(value) > threshold, F.lit(False))
    rows = df.withColumn("__above", above)
    rows = rows.withColumn("__run", F.row_number().over(w) - F.row_number().over(W.partitionBy(*keys, "__above").orderBy(*order)))
    length = F.count("*").over(W.partitionBy(*keys, "__above", "__run"))
    return rows.withColumn(out, F.col("__above") & (length >= least)).drop("__above", "__run")


def cumulative(df: DataFrame, value: str, out: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row of each key: the first in a total order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key in the order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")
