"""The engine's tables made of generic orders and events, so that every query runs on the same test data as its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2001, 8, 1)
#: Numbers of events of which the samples of a metric's day stand in one file.
FILE = 100_000


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    second = (k % 86400).cast("int")
    sport = F.when(F.col("o_orderstatus") == "F", "running").when(F.col("o_orderstatus") == "P", "trail_running").otherwise("cycling")
    distance = (2000 + F.floor("o_totalprice").cast("long") % 18000).cast("double")
    pace = 4 + (k % 31).cast("double") / 10
    a = o.select(
        (F.col("o_custkey") % 8).alias("athlete_id"), k.alias("activity_id"),
        F.timestamp_add("SECOND", second, F.col("o_orderdate").cast("timestamp")).alias("session_start"), sport.alias("sport"), distance.alias("distance_m"), pace.alias("avg_pace_min_km"),
        F.when(k % 17 != 0, (118 + k % 53).cast("double")).alias("avg_hr"),
        *[(F.when(k % 11 != 0, k % m) if i == 1 else k % m).cast("double").alias(f"z{i}_s") for i, m in enumerate((907, 613, 311, 127, 61), 1)],
        F.when(k % 3 != 0, (80 + k % 41).cast("double")).alias("recovery_hr"), (150 + k % 47).cast("double").alias("max_hr"),
    )
    return a.withColumn("avg_speed_m_s", 1000 / (60 * F.col("avg_pace_min_km"))).withColumn("duration_min", F.col("distance_m") / 1000 * F.col("avg_pace_min_km"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind, v = _events(spark, sf_dir), F.col("event_type"), F.col("value")
    metric = F.when(kind == "view", "step_count").when(kind == "click", "resting_heart_rate").when(kind == "purchase", "heart_rate_variability").when(kind == "signup", "sleep_totalSleep").otherwise("apple_sleeping_wrist_temperature")
    value = F.when(kind == "view", v * 10).when(kind == "click", 40 + v / 10).when(kind == "purchase", 30 + v / 4).when(kind == "signup", 4 + F.least(v, F.lit(100.0)) / 20).otherwise((v - 50) / 100)
    source = F.element_at(F.array(*map(F.lit, ("watch", "ring", "phone", "Connect"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select((F.col("user_id") % 8).alias("athlete_id"), F.date_sub(F.to_date("ts"), 8217).alias("date"), metric.alias("metric"), value.alias("value"), source.alias("source"), F.col("event_id").alias("seq"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return _events(spark, sf_dir).select(F.col("user_id").alias("activity_id"), "ts", (F.lit(2.5) + F.least(F.col("value"), F.lit(100.0)) / 200).alias("speed"), (F.lit(110.0) + k * 0.8).alias("heart_rate"))


def device_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, sf_dir)
    left = e.where("event_type = 'click'").select(F.col("event_id").alias("activity_id"), F.col("ts").alias("session_start"))
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("device_id"), F.col("ts").alias("device_ts"), F.col("value").alias("device_value"))
    return left, right


def pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushed JSON bodies, one for each event: three shapes of samples in two shapes of bodies."""
    e = _events(spark, sf_dir)
    day = F.date_format("ts", "yyyy-MM-dd HH:mm:ss +0000")
    one = F.struct(day.alias("date"), F.col("value").alias("qty"), F.lit("watch").alias("source"))
    three = F.struct(day.alias("date"), F.col("value").alias("Min"), (F.col("value") + 5).alias("Avg"), (F.col("value") + 9).alias("Max"), F.lit("ring").alias("source"))
    sample = F.when(F.col("event_type") == "click", F.to_json(F.struct(F.lit("heart_rate").alias("name"), F.lit("bpm").alias("units"), F.array(three).alias("data")))).otherwise(F.to_json(F.struct(F.col("event_type").alias("name"), F.lit("u").alias("units"), F.array(one).alias("data"))))
    body = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"data":{"metrics":['), sample, F.lit("]}}"))).otherwise(F.concat(F.lit('{"metrics":['), sample, F.lit("]}")))
    return e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 8).alias("athlete_id"), body.alias("body"))


def sleep_segments(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Segments as text times with an offset; every fifth is repeated, and some have a stage that no one knows. keep: further columns of events."""
    e = _events(spark, sf_dir)
    stage = F.element_at(F.array(*map(F.lit, ("Core", "Deep", "REM", "Awake", "In Bed", "Asleep", "Unknown"))), (F.col("event_id") % 7 + 1).cast("int"))
    hours = F.round(F.col("value") % 4, 2)
    end = F.timestamp_add("MINUTE", (F.col("event_id") % 240).cast("int"), F.col("ts"))
    form = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss +0000")
    source = F.element_at(F.array(*map(F.lit, ("watch", "ring", "phone", "bed"))), (F.floor(F.col("event_id") / 3) % 4 + 1).cast("int"))
    rows = e.select((F.col("user_id") % 8).alias("athlete_id"), form(F.col("ts")).alias("start_ts"), form(end).alias("end_ts"), stage.alias("stage"), hours.alias("hours"), source.alias("source"), F.col("event_id").alias("__k"), *keep)
    return rows.drop("__k").unionByName(rows.where("__k % 5 = 0").drop("__k"))


def _sleep_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """athlete_id, event_id, day (text), and a JSON sample of sleep: segments under two pairs of names with Swedish stages, nights that a device
    has summed up (of athletes from 100 on), and quantities without either, which no one can read."""
    e = _events(spark, sf_dir)
    stages = F.create_map(*[F.lit(x) for kv in (("Core", "Kärna"), ("Deep", "Djup"), ("REM", "REM"), ("Awake", "Vaken"), ("In Bed", "I sängen"), ("Asleep", "Sova"), ("Unknown", "Okänd")) for x in kv])
    s = sleep_segments(spark, sf_dir, ("event_id",)).withColumn("value", stages[F.col("stage")])
    named = [F.to_json(F.struct(F.col("start_ts").alias(a), F.col("end_ts").alias(z), "value", F.col("hours").alias("qty"), "source")) for a, z in (("startDate", "endDate"), ("start", "end"))]
    segments = s.select("athlete_id", "event_id", F.left("end_ts", F.lit(10)).alias("day"), F.when(F.col("source") == "ring", named[1]).otherwise(named[0]).alias("sample"))
    form = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss +0000")
    v, k = F.col("value"), F.col("event_id")
    night = F.struct(form("ts").alias("date"), F.round(v % 8, 2).alias("totalSleep"), F.round(v % 3, 2).alias("core"), F.when(k % 2 == 0, F.round(v % 2, 2)).alias("deep"), form("ts").alias("sleepStart"), F.lit("").alias("inBedStart"), F.lit("watch").alias("source"), F.lit("REM").alias("value"))
    whole = e.where("event_type = 'purchase'").select((100 + F.col("user_id") % 8).alias("athlete_id"), "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.to_json(night).alias("sample"))
    other = e.where("event_type = 'click'").select((F.col("user_id") % 8).alias("athlete_id"), "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.to_json(F.struct(form("ts").alias("date"), v.alias("qty"))).alias("sample"))
    return segments.unionByName(whole).unionByName(other)


def sleep_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushed JSON bodies with one sleep sample each."""
    return _sleep_samples(spark, sf_dir).select("athlete_id", F.concat(F.lit('{"data":{"metrics":[{"name":"sleep_analysis","units":"hr","data":['), "sample", F.lit("]}]}}")).alias("body"))


def canonical_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of a metric's day: the sleep samples, and from each event a quantity or the three figures of a heart rate.

    A day of many samples comes in several files, one for each FILE events, as no device sends a file without end.
    """
    e = _events(spark, sf_dir)
    v, day = F.col("value"), F.date_format("ts", "yyyy-MM-dd")
    one = F.to_json(F.struct(day.alias("date"), v.alias("qty"), F.lit("watch").alias("source")))
    three = F.to_json(F.struct(day.alias("date"), v.alias("Min"), (v + 5).alias("Avg"), (v + 9).alias("Max"), F.lit("ring").alias("source")))
    metric = F.when(F.col("event_type") == "click", "heart_rate").otherwise(F.col("event_type"))
    rows = e.select((F.col("user_id") % 8).alias("athlete_id"), "event_id", day.alias("day"), metric.alias("metric"), F.when(F.col("event_type") == "click", three).otherwise(one).alias("sample"))
    rows = rows.unionByName(_sleep_samples(spark, sf_dir).withColumn("metric", F.lit("sleep_analysis")))
    body = F.concat(F.lit('{"metric":"'), "metric", F.lit('","date":"'), "day", F.lit('","units":"u","samples":['), F.array_join(F.collect_list("sample"), ","), F.lit("]}"))
    return rows.groupBy("athlete_id", "metric", "day", F.floor(F.col("event_id") / FILE).alias("file")).agg(body.alias("body")).select("athlete_id", "body")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighings in slots of ten minutes, so that timestamps repeat."""
    e = _events(spark, sf_dir)
    ts = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 600) * 600)
    return e.select((F.col("user_id") % 8).alias("athlete_id"), ts.alias("ts"), (60 + F.col("value") % 30).alias("weight"), (10 + F.col("value") % 7).alias("fat_mass"), F.col("event_id").alias("seq"))


# The same tables in SQL.
A = """a AS (SELECT o_custkey % 8 AS athlete_id, o_orderkey AS activity_id, o_orderdate + to_seconds(o_orderkey % 86400) AS session_start,
  CAST(o_orderdate + to_seconds(o_orderkey % 86400) AS DATE) AS date,
  CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'P' THEN 'trail_running' ELSE 'cycling' END AS sport,
  CAST(2000 + CAST(floor(o_totalprice) AS BIGINT) % 18000 AS DOUBLE) AS distance_m,
  4 + CAST(o_orderkey % 31 AS DOUBLE) / 10 AS avg_pace_min_km, 1000 / (60 * (4 + CAST(o_orderkey % 31 AS DOUBLE) / 10)) AS avg_speed_m_s,
  CAST(2000 + CAST(floor(o_totalprice) AS BIGINT) % 18000 AS DOUBLE) / 1000 * (4 + CAST(o_orderkey % 31 AS DOUBLE) / 10) AS duration_min,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(118 + o_orderkey % 53 AS DOUBLE) END AS avg_hr,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 907 AS DOUBLE) END AS z1_s, CAST(o_orderkey % 613 AS DOUBLE) AS z2_s,
  CAST(o_orderkey % 311 AS DOUBLE) AS z3_s, CAST(o_orderkey % 127 AS DOUBLE) AS z4_s, CAST(o_orderkey % 61 AS DOUBLE) AS z5_s,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(80 + o_orderkey % 41 AS DOUBLE) END AS recovery_hr, CAST(150 + o_orderkey % 47 AS DOUBLE) AS max_hr
  FROM orders), r AS (SELECT * FROM a WHERE contains(sport, 'running'))"""
H = """h AS (SELECT user_id % 8 AS athlete_id, CAST(ts AS DATE) - 8217 AS date,
  CASE event_type WHEN 'view' THEN 'step_count' WHEN 'click' THEN 'resting_heart_rate' WHEN 'purchase' THEN 'heart_rate_variability'
    WHEN 'signup' THEN 'sleep_totalSleep' ELSE 'apple_sleeping_wrist_temperature' END AS metric,
  CASE event_type WHEN 'view' THEN value * 10 WHEN 'click' THEN 40 + value / 10 WHEN 'purchase' THEN 30 + value / 4
    WHEN 'signup' THEN 4 + least(value, 100) / 20 ELSE (value - 50) / 100 END AS value,
  CASE event_id % 4 WHEN 0 THEN 'watch' WHEN 1 THEN 'ring' WHEN 2 THEN 'phone' ELSE 'Connect' END AS source, event_id AS seq FROM events)"""
D = f"""{H}, d AS (SELECT athlete_id, date, metric, CASE WHEN metric = 'step_count' THEN sum(value) WHEN metric = 'resting_heart_rate' THEN min(value)
  ELSE avg(value) END AS value, arg_min(source, seq) AS source FROM h GROUP BY 1, 2, 3)"""
S = """s AS (SELECT user_id AS activity_id, ts, 2.5::DOUBLE + least(value, 100) / 200 AS speed,
  110::DOUBLE + 0.8::DOUBLE * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS heart_rate FROM events)"""
R = f"""{H}, rhr AS (SELECT athlete_id, date, min(value) AS rhr FROM h WHERE metric = 'resting_heart_rate' AND source <> 'Connect'
  AND value BETWEEN 30 AND 100 GROUP BY ALL)"""
SEGMENTS = """seg AS (SELECT user_id % 8 AS athlete_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' +0000' AS start_ts,
  strftime(ts + to_minutes(event_id % 240), '%Y-%m-%d %H:%M:%S') || ' +0000' AS end_ts,
  CASE event_id % 7 WHEN 0 THEN 'core' WHEN 1 THEN 'deep' WHEN 2 THEN 'rem' WHEN 3 THEN 'awake' WHEN 4 THEN 'inBed' WHEN 5 THEN 'asleep' END AS suffix,
  round(value % 4, 2) AS hours, CASE (event_id // 3) % 4 WHEN 0 THEN 'watch' WHEN 1 THEN 'ring' WHEN 2 THEN 'phone' ELSE 'bed' END AS source,
  CASE WHEN hour(ts) >= 18 THEN CAST(ts AS DATE) + 1 ELSE CAST(ts + to_minutes(event_id % 240) AS DATE) END AS date FROM events),
  sd AS (SELECT DISTINCT * FROM seg WHERE suffix IS NOT NULL),
  pick AS (SELECT *, row_number() OVER (PARTITION BY athlete_id, date ORDER BY has_staging DESC,
      CASE source WHEN 'watch' THEN 1 WHEN 'ring' THEN 2 WHEN 'phone' THEN 3 ELSE 99 END, source) AS k
    FROM (SELECT athlete_id, date, source, bool_or(suffix IN ('core','deep','rem')) AS has_staging FROM sd GROUP BY ALL)),
  nights AS (SELECT athlete_id, date, source, coalesce(sum(hours) FILTER (suffix = 'core'), 0) AS core, coalesce(sum(hours) FILTER (suffix = 'deep'), 0) AS deep,
    coalesce(sum(hours) FILTER (suffix = 'rem'), 0) AS rem, coalesce(sum(hours) FILTER (suffix = 'awake'), 0) AS awake,
    coalesce(max(hours) FILTER (suffix = 'inBed'), 0) AS "inBed", coalesce(max(hours) FILTER (suffix = 'asleep'), 0) AS asleep,
    min(start_ts) FILTER (suffix <> 'inBed') AS "sleepStart", max(end_ts) FILTER (suffix <> 'inBed') AS "sleepEnd",
    min(start_ts) FILTER (suffix = 'inBed') AS "inBedStart", max(end_ts) FILTER (suffix = 'inBed') AS "inBedEnd"
    FROM sd JOIN (SELECT athlete_id, date, source FROM pick WHERE k = 1) USING (athlete_id, date, source) GROUP BY ALL),
  nt AS (SELECT *, CASE WHEN core + deep + rem > 0 THEN core + deep + rem WHEN asleep > 0 THEN asleep WHEN "inBed" > 0 THEN "inBed" ELSE 0 END AS "totalSleep" FROM nights)"""
