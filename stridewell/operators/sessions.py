"""Measures within sessions: heart rate zones and aerobic decoupling; one row a sample, keyed by activity_id."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stridewell.functions.expr import is_running, polarization

from . import timeseries as ts

KEYS = ts.KEYS


class Zones(NamedTuple):
    per_activity: DataFrame
    monthly: DataFrame


def shares(df: DataFrame, keys: Sequence[str], period: Column, name: str) -> DataFrame:
    """Percent of zone seconds and minutes by period: ratios of sums."""
    out = df.groupBy(*keys, period.alias(name)).agg(*[F.sum(z).alias(z) for z in ("z1", "z2", "z3")], F.count("*").alias("n_activities")).withColumn("total", F.col("z1") + F.col("z2") + F.col("z3"))
    return out.select(*keys, name, *[(F.col(z) / F.col("total") * 100).alias(f"{z}_pct") for z in ("z1", "z2", "z3")], "n_activities", (F.col("total") / 60).alias("total_min"))


def monthly(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return shares(df, keys, F.date_format("date", "yyyy-MM"), "year_month")


def _with_shares(df: DataFrame) -> DataFrame:
    total = F.col("z1") + F.col("z2") + F.col("z3")
    return df.where(total > 0).select("*", *[(F.col(z) / total * 100).alias(f"{z}_pct") for z in ("z1", "z2", "z3")])


def device_zones(activities: DataFrame, keys: Sequence[str] = KEYS, all_five: bool = True) -> Zones:
    """Three zones of the five that a device reports: the lowest two, the third, the highest two."""
    five = [F.col(f"z{i}_s") for i in range(1, 6)]
    there = is_running()
    for z in five if all_five else (five[0], five[4]):
        there = there & z.isNotNull()
    r = activities.where(there).select(*keys, "activity_id", F.to_date("session_start").alias("date"), (five[0] + five[1]).alias("z1"), five[2].alias("z2"), (five[3] + five[4]).alias("z3"))
    per = _with_shares(r)
    return Zones(per, monthly(per, keys))


def sample_zones(activities: DataFrame, samples: DataFrame, hr_max: Column | float = 190.0, low: float = 0.80, high: float = 0.90, keys: Sequence[str] = KEYS) -> Zones:
    """Zones counted in samples: below 80 % of the highest heart rate, up to 90 %, and above. hr_max may be a column of activities."""
    meta = activities.where(is_running()).select(*keys, "activity_id", F.to_date("session_start").alias("date"), (hr_max if isinstance(hr_max, Column) else F.lit(hr_max)).alias("__max"))
    s = samples.where(F.col("heart_rate") > 0).join(meta, "activity_id")
    hr, m = F.col("heart_rate"), F.col("__max")
    count = lambda c: F.count_if(c).cast("double")
    per = s.groupBy(*keys, "activity_id", "date").agg(count(hr < m * low).alias("z1"), count((hr >= m * low) & (hr < m * high)).alias("z2"), count(hr >= m * high).alias("z3"))
    per = _with_shares(per)
    return Zones(per, monthly(per, keys))


def hybrid_zones(activities: DataFrame, samples: DataFrame, hr_max: Column | float = 190.0, keys: Sequence[str] = KEYS) -> Zones:
    """Zones from samples, and from the device where an activity has none."""
    own = sample_zones(activities, samples, hr_max, keys=keys).per_activity.withColumn("origin", F.lit("samples"))
    rest = device_zones(activities, keys).per_activity.join(own.select("activity_id"), "activity_id", "left_anti").withColumn("origin", F.lit("device"))
    per = own.unionByName(rest)
    return Zones(per, monthly(per, keys))


def cross_validation(activities: DataFrame, samples: DataFrame, hr_max: float = 190.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Device less sample percentages of activities that have both."""
    a, b = device_zones(activities, keys, all_five=False).per_activity, sample_zones(activities, samples, hr_max, keys=keys).per_activity
    right = b.select("activity_id", *[F.col(f"{z}_pct").alias(f"{z}_samples") for z in ("z1", "z2", "z3")])
    return a.join(right, "activity_id").select(*keys, "activity_id", "date", *[F.col(f"{z}_pct").alias(f"{z}_device") for z in ("z1", "z2", "z3")], *[f"{z}_samples" for z in ("z1", "z2", "z3")], *[(F.col(f"{z}_pct") - F.col(f"{z}_samples")).alias(f"{z}_diff") for z in ("z1", "z2", "z3")])


def polarization_index(months: DataFrame) -> DataFrame:
    z = [F.col(f"z{i}_pct") for i in (1, 2, 3)]
    return months.withColumn("pi", polarization(*z)).withColumn("has_zero_zone", (z[1] == 0) | (z[2] == 0))


def rollup(samples: DataFrame) -> DataFrame:
    """Summary of each session from its samples."""
    return samples.groupBy("activity_id").agg(F.count("*").alias("n_samples"), F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.avg("speed").alias("avg_speed"), F.avg(F.when(F.col("heart_rate") > 0, F.col("heart_rate"))).alias("avg_hr"), F.max("heart_rate").alias("max_hr"))


def repair_candidates(activities: DataFrame, samples: DataFrame) -> DataFrame:
    """Activities with a heart rate whose samples are missing or have none."""
    fine = samples.where(F.col("heart_rate") > 0).select("activity_id").distinct()
    return activities.where(F.col("avg_hr").isNotNull()).join(fine, "activity_id", "left_anti")


def ten_minute_means(samples: DataFrame) -> DataFrame:
    """Mean heart rate in slots of 10 minutes, rounded to the nearest, and the mean of these means."""
    slot = F.timestamp_seconds(F.floor((F.unix_micros("ts") / 1_000_000 + 300) / 600) * 600)
    slots = samples.groupBy("activity_id", slot.alias("slot")).agg(F.avg("heart_rate").alias("mean_hr"))
    return slots.groupBy("activity_id").agg(F.avg("mean_hr").alias("mean_of_means"), F.count("*").alias("n_slots"))


def decoupling(samples: DataFrame, warmup_s: float = 600, smooth_s: float = 30, max_speed_diff_pct: float = 10, least: int = 10) -> DataFrame:
    """How far the ratio of smoothed speed to heart rate falls from the first to the second half of each session, in percent.

    Samples without speed or heart rate and the warm-up are left out; the smoothing takes as many samples as smooth_s
    holds at the session's median interval, 3 at least. The width differs by session, which no window frame can, so a
    trailing mean is the difference of two running sums, of which the earlier one is taken from an array of the
    session's. A session is a bounded recording; all steps share one deal of the samples by session.
    Sessions with fewer than `least` samples at any step, or with halves whose speeds differ by more, are left out.
    """
    order = W.partitionBy("activity_id").orderBy("ts")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy("activity_id")
    second = F.unix_micros("ts") / 1_000_000
    s = samples.where((F.col("speed") > 0) & (F.col("heart_rate") > 0)).select("activity_id", "ts", "speed", "heart_rate", second.alias("at"))
    s = s.withColumn("__n", F.count("*").over(every)).withColumn("__first", F.min("at").over(every)).where((F.col("__n") >= least) & (F.col("at") - F.col("__first") >= warmup_s))
    s = s.withColumn("__n", F.count("*").over(every)).where(F.col("__n") >= least)
    s = s.withColumn("rn", F.row_number().over(order)).withColumn("cum", F.sum("speed").over(upto)).withColumn("__gap", F.col("at") - F.lag("at").over(order))
    width = F.greatest(F.bround(F.lit(float(smooth_s)) / F.greatest(F.percentile("__gap", F.lit(0.5)), F.lit(1.0))), F.lit(3.0)).cast("int")
    whole = s.groupBy("activity_id").agg(width.alias("width"), F.sort_array(F.collect_list(F.struct("rn", "at", "heart_rate", "cum"))).alias("x"))
    smooth = lambda e, i: (e["cum"] - F.coalesce(F.get(F.col("x"), i - F.col("width"))["cum"], F.lit(0.0))) / F.col("width")
    points = F.transform("x", lambda e, i: F.struct(e["at"].alias("at"), e["heart_rate"].alias("heart_rate"), smooth(e, i).alias("smooth")))
    s = whole.select("activity_id", "width", F.explode(F.slice(points, F.col("width"), F.greatest(F.size("x") - F.col("width") + 1, F.lit(0)))).alias("p")).select("activity_id", "width", "p.*")
    s = s.withColumn("__n", F.count("*").over(every)).where(F.col("__n") >= least)
    s = s.withColumn("__start", F.min("at").over(every)).withColumn("__end", F.max("at").over(every))
    first = F.col("at") - F.col("__start") <= (F.col("__end") - F.col("__start")) / 2
    mean = lambda c, test: F.avg(F.when(test, c))
    ratio = F.col("smooth") / F.col("heart_rate")
    out = s.groupBy("activity_id").agg(
        F.first("width").alias("width"), F.count("*").alias("n_points"), mean(F.col("smooth"), first).alias("__m1"), mean(F.col("smooth"), ~first).alias("__m2"),
        mean(ratio, first).alias("ratio_first"), mean(ratio, ~first).alias("ratio_second"),
    )
    differ = F.abs(F.col("__m1") - F.col("__m2")) / F.greatest("__m1", "__m2") * 100
    out = out.where((differ <= max_speed_diff_pct) & F.col("ratio_first").isNotNull() & F.col("ratio_second").isNotNull() & (F.col("ratio_first") != 0))
    return out.drop("__m1", "__m2").withColumn("decoupling_pct", (F.col("ratio_first") - F.col("ratio_second")) / F.col("ratio_first") * 100)


def decoupling_series(activities: DataFrame, samples: DataFrame, rows: int = 28, min_duration: float = 45, min_pace: float = 5.0, keys: Sequence[str] = KEYS, **settings) -> DataFrame:
    """Decoupling of runs over 45 minutes slower than 5 min/km, and its mean over 28 days."""
    r = activities.where(is_running() & (F.col("duration_min") > min_duration) & (F.col("avg_pace_min_km") > min_pace))
    r = r.select(*keys, "activity_id", F.to_date("session_start").alias("date"), (F.col("distance_m") / 1000).alias("distance_km"), "avg_pace_min_km", "avg_hr")
    per = r.join(decoupling(samples.join(r.select("activity_id"), "activity_id", "left_semi"), **settings), "activity_id")
    return ts.rolling_day_mean(per, "decoupling_pct", f"decoupling_rolling{rows}", rows, keys)
