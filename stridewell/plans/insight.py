"""Short texts about the latest run and about changed health measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stridewell.functions.expr import is_running, pace_mmss
from stridewell.operators import timeseries as ts

#: Measures that are always told, and by how much others must differ from their week to be told.
ALWAYS = ("vo2_max", "blood_oxygen_saturation", "cardio_recovery", "respiratory_rate", "apple_sleeping_wrist_temperature", "running_ground_contact_time", "running_power", "running_speed", "running_stride_length", "running_vertical_oscillation")
THRESHOLDS = {"heart_rate_variability": 5.0, "resting_heart_rate": 4.0, "sleep_totalSleep": 0.5, "sleep_deep": 0.3}
#: Measures that are never told.
NEVER = (
    "step_count", "active_energy", "basal_energy_burned", "flights_climbed", "apple_exercise_time", "walking_running_distance", "heart_rate", "heart_rate_min", "heart_rate_avg",
    "heart_rate_max", "environmental_audio_exposure", "headphone_audio_exposure", "physical_effort", "apple_stand_hour", "apple_stand_time", "stair_speed_up", "stair_speed_down",
    "time_in_daylight", "walking_speed", "walking_step_length", "walking_asymmetry_percentage", "walking_double_support_percentage", "walking_heart_rate_average", "dietary_energy",
    "dietary_sugar", "dietary_water", "protein", "carbohydrates", "total_fat", "fiber", "saturated_fat", "monounsaturated_fat", "polyunsaturated_fat", "sodium", "potassium", "calcium",
    "iron", "zinc", "magnesium", "manganese", "copper", "phosphorus", "selenium", "iodine", "caffeine", "vitamin_a", "vitamin_b6", "vitamin_c", "vitamin_e", "vitamin_k", "folate", "niacin",
    "riboflavin", "thiamin", "pantothenic_acid", "body_fat_percentage", "body_mass_index", "lean_body_mass", "weight_body_mass", "height", "handwashing", "mindful_minutes",
    "number_of_times_fallen", "cycling_distance", "swimming_distance", "swimming_stroke_count", "distance_downhill_snow_sports", "six_minute_walking_test_distance", "sleep_rem",
    "sleep_core", "sleep_awake", "sleep_inBed", "sleep_asleep", "sleep_inBedStart", "sleep_inBedEnd", "sleep_sleepStart", "sleep_sleepEnd", "sleep_analysis", "basal_body_temperature",
)
SHORT_NIGHT = 5.5


def run_insight(activities: DataFrame, keys: Sequence[str] = ts.KEYS) -> DataFrame:
    """The latest run of each athlete and what is good about it against the month's earlier runs: faster, longer, or else the month's total."""
    r = activities.where(is_running()).withColumn("month", F.date_format("session_start", "yyyy-MM"))
    last = ts.latest(r, keys, [F.col("session_start").desc(), F.col("activity_id").desc()], 1).select(*keys, "month", F.col("session_start").alias("at"), (F.col("distance_m") / 1000).alias("km"), F.col("avg_pace_min_km").alias("pace"), F.col("avg_hr").alias("hr"))
    m = r.join(last.select(*keys, "month", "at"), [*keys, "month"])
    before = F.col("session_start") < F.col("at")
    month = m.groupBy(*keys).agg(F.count_if(before).alias("n"), F.avg(F.when(before, F.col("avg_pace_min_km"))).alias("avg_pace"), F.avg(F.when(before, F.col("distance_m") / 1000)).alias("avg_km"), (F.sum("distance_m") / 1000).alias("month_km"))
    d = last.join(month, list(keys))
    faster = (F.col("n") >= 2) & ((F.col("pace") - F.col("avg_pace")) * 60 < -5)
    longer = (F.col("n") >= 2) & (F.col("km") > F.col("avg_km") * 1.1)
    d = d.withColumn("kind", F.when(faster, "faster").when(longer, "longer").otherwise("total"))
    good = F.when(F.col("kind") == "faster", F.concat(F.lit("faster than the month's mean of "), pace_mmss(F.col("avg_pace")))).when(F.col("kind") == "longer", F.format_string("longer than the month's mean of %.1f km", "avg_km")).otherwise(F.format_string("%.0f km this month", "month_km"))
    text = F.concat(F.format_string("Run of %.1f km, ", "km"), pace_mmss(F.col("pace")), F.lit("/km, heart rate "), F.coalesce(F.format_string("%.0f", "hr"), F.lit("unknown")), F.lit(": "), good, F.lit("."))
    return d.withColumn("text", text).select(*keys, "kind", F.col("at").alias("session_start"), "km", "pace", "hr", "n", "avg_pace", "avg_km", "month_km", "text")


def health_changes(after: DataFrame, before: DataFrame, keys: Sequence[str] = ts.KEYS) -> DataFrame:
    """Changed measures of the latest changed day that are worth telling, with their difference from the 7 days before.

    after and before hold one value for each (key, date, metric). Measures with a threshold are told if they differ by it
    from at least two earlier values, or if there are fewer; a short night always; others always, but for those that never
    are. Both states are put side by side in one aggregation; the latest changed day is a window over that.
    """
    rows = after.select(*keys, "date", "metric", F.struct("value").alias("a"), F.lit(None).cast("struct<value:double>").alias("b"))
    rows = rows.unionByName(before.select(*keys, "date", "metric", F.lit(None).cast("struct<value:double>").alias("a"), F.struct("value").alias("b")))
    rows = rows.groupBy(*keys, "date", "metric").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    changed = F.col("a").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))
    rows = rows.withColumn("changed", changed).withColumn("focus", F.max(F.when(F.col("changed"), F.col("date"))).over(W.partitionBy(*keys)))
    rows = rows.where(~F.col("metric").isin(*NEVER) & F.col("date").between(F.date_sub("focus", 7), F.col("focus")))
    earlier = F.when(F.col("date") < F.col("focus"), F.col("b"))
    own = F.when((F.col("date") == F.col("focus")) & F.col("changed"), F.col("a"))
    d = rows.groupBy(*keys, F.col("focus").alias("date"), "metric").agg(F.max(own).alias("own"), F.count(earlier).alias("n_week"), F.avg(earlier["value"]).alias("avg_week")).where("own is not null")
    d = d.withColumn("value", F.col("own.value")).withColumn("avg_week", F.when(F.col("n_week") >= 2, F.col("avg_week"))).withColumn("delta", F.col("value") - F.col("avg_week"))
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv]), F.col("metric"))
    short = (F.col("metric") == "sleep_totalSleep") & (F.col("value") < SHORT_NIGHT)
    told = limit.isNull() | short | F.col("avg_week").isNull() | (F.abs("delta") >= limit)
    why = F.when(limit.isNull(), "always").when(short, "short night").when(F.col("avg_week").isNull(), "no week").otherwise("differs")
    return d.where(F.coalesce(told, F.lit(False))).select(*keys, "date", "metric", "value", F.when(why == "differs", F.col("delta")).alias("delta"), why.alias("why"))


def health_insight(changes: DataFrame, keys: Sequence[str] = ts.KEYS) -> DataFrame:
    """One sentence for each athlete; measures in the order of their names."""
    part = F.concat(F.col("metric"), F.lit(" "), F.format_string("%.1f", "value"), F.when(F.col("why") == "differs", F.format_string(" (%+.1f vs 7d)", "delta")).when(F.col("why") == "short night", " (short night)").otherwise(""))
    parts = changes.groupBy(*keys, "date").agg(F.array_sort(F.collect_list(F.struct("metric", part.alias("p")))).alias("p"))
    return parts.select(*keys, "date", F.concat(F.lit("Health "), F.date_format("date", "d MMM"), F.lit(": "), F.array_join(F.transform("p", lambda x: x["p"]), ", ")).alias("text"))


def overview(activities: DataFrame, as_of, readiness: DataFrame | None = None, keys: Sequence[str] = ts.KEYS, **settings) -> DataFrame:
    """Latest fitness, form, workload ratio and weekly distance of each athlete, with labels."""
    from stridewell.functions.expr import acwr_zone, tsb_zone
    from stridewell.operators import metrics

    w = W.partitionBy(*keys).orderBy(F.col("date").desc())
    last = lambda df: df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    a = last(metrics.acwr(activities, as_of, keys)).select(*keys, "date", "weekly_km", "acwr")
    p = last(metrics.pmc(activities, as_of, keys=keys, **settings)).select(*keys, "ctl", "atl", "tsb")
    out = a.join(p, list(keys), "left").withColumn("acwr_zone", acwr_zone(F.col("acwr"))).withColumn("tsb_zone", tsb_zone(F.col("tsb")))
    if readiness is not None:
        out = out.join(last(readiness).select(*keys, "readiness_score", "readiness_status"), list(keys), "left")
    return out
