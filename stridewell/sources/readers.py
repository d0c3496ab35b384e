"""Readers of device and health files into the engine's tables."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridewell import schemas
from stridewell.operators import health as h
from stridewell.operators.measures import measures

#: Event time at the start of a device file's name, before the first underscore. Hadoop can't open local names with
#: colons, so hyphens may stand for them.
NAME_TIME = r"^(\d{4}-\d{2}-\d{2}T\d{2})[:-](\d{2})[:-](\d{2})[^_]*_.*$"


def _struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def filename_time(name: Column) -> Column:
    """Event time of a device file's name, UTC; null if the name has another form."""
    time = F.when(name.rlike(NAME_TIME), F.regexp_replace(name, NAME_TIME, "$1:$2:$3"))
    return F.try_to_timestamp(time, F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def activities(spark: SparkSession, path: str) -> DataFrame:
    """The activities table, or an empty one where there is none yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], _struct(schemas.ACTIVITIES))
    return spark.read.schema(_struct(schemas.ACTIVITIES)).parquet(path)


def dual_format(df: DataFrame, body: str, fields: str, nested_only: bool = False, seen: Observation | None = None) -> DataFrame:
    """Adds the fields of JSON bodies that hold them under summaryDTO (old format) or at the top (new format).

    The format is chosen for a whole body, not field by field; nested_only leaves the fields of new bodies null. A body
    that can't be read has null fields; seen counts `bodies` and `unreadable` in the same pass.
    """
    names = [f.name for f in _struct(fields).fields]
    j = F.from_json(F.col(body), f"struct<summaryDTO: struct<{fields.replace(' double', ': double')}>, {fields.replace(' double', ': double')}, _corrupt_record: string>")
    out = df.withColumn("__j", j)
    if seen is not None:
        out = out.observe(seen, F.count("*").alias("bodies"), F.count_if(F.col("__j._corrupt_record").isNotNull()).alias("unreadable"))
    old = F.col("__j.summaryDTO").isNotNull()
    return out.select(*df.columns, *[F.when(old, F.col(f"__j.summaryDTO.{n}")).otherwise(F.lit(None) if nested_only else F.col(f"__j.{n}")).alias(n) for n in names])


def device_prefix(name: Column) -> Column:
    """What the two files of an activity have in common."""
    return F.regexp_replace(name, r"_(summary|details)\.json$", "")


def device_metrics(spark: SparkSession, path: str, only: Column | None = None, summaries: Observation | None = None, details: Observation | None = None) -> DataFrame:
    """Pairs of PREFIX_summary.json and PREFIX_details.json files: all fields of the first, those of the second where it is there.

    only is a filter on _metadata, by which files are left out before any is read. A summary that can't be read gives a row of nulls;
    summaries and details count `bodies` and `unreadable` of either kind while the result is read.
    """
    files = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    files = (files if only is None else files.where(only)).select(F.col("_metadata.file_name").alias("file_name"), "value")
    prefix = device_prefix(F.col("file_name"))
    part = lambda kind, fields, nested, seen: dual_format(files.where(F.col("file_name").endswith(f"_{kind}.json")), "value", fields, nested, seen).withColumn("prefix", prefix).withColumn("name", F.col("file_name")).drop("value", "file_name")
    summary = part("summary", schemas.DEVICE_SUMMARY, False, summaries).withColumn("device_ts", filename_time(F.col("name"))).drop("name")
    return summary.join(part("details", schemas.DEVICE_DETAILS, True, details).drop("name"), "prefix", "left")


class Counted:
    """What a reader has met, known once its result has been read: bodies, unreadable ones, samples, and those that gave no row."""

    def __init__(self) -> None:
        self.bodies, self.samples = Observation(), Observation()

    def get(self) -> dict[str, int]:
        return self.bodies.get | self.samples.get


def _measures(samples: DataFrame, counted: Counted | None) -> DataFrame:
    """athlete_id, date, metric, value, source and seq of samples (athlete_id, name, sample): quantities and nights."""
    return measures(samples, seen=counted and counted.samples).withColumn("seq", F.xxhash64("date", "metric", "value", "source"))


def health_pushes(spark: SparkSession, path: str, athlete_id: int = 0, counted: Counted | None = None) -> DataFrame:
    """Measures of pushed files: athlete_id, date, metric, value, source, seq; nights from either format of sleep samples.

    Files are read, and their bodies parsed, once.
    """
    raw = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    bodies = raw.select(F.lit(athlete_id).cast("long").alias("athlete_id"), F.col("value").alias("body"))
    return _measures(h.push_samples(bodies, seen=counted and counted.bodies), counted)


def canonical_samples(raw: DataFrame) -> DataFrame:
    """name, units and sample of per-metric, per-day records, besides their other columns."""
    keep = [c for c in raw.columns if c not in ("metric", "date", "units", "samples")]
    return raw.select(*keep, F.col("metric").alias("name"), "units", F.explode("samples").alias("sample"))


def canonical_bodies(raw: DataFrame, body: str = "body", counted: Counted | None = None) -> DataFrame:
    """metric, date, units and samples of JSON bodies of per-metric, per-day files, besides their other columns."""
    keep = [c for c in raw.columns if c != body]
    parsed = raw.select(*keep, F.from_json(body, _struct(schemas.CANONICAL)).alias("j"))
    if counted:
        parsed = parsed.observe(counted.bodies, F.count("*").alias("bodies"), F.count_if(F.col("j.metric").isNull()).alias("unreadable"))
    return parsed.select(*keep, "j.*")


def canonical_measures(raw: DataFrame, body: str = "body", counted: Counted | None = None) -> DataFrame:
    """Measures of JSON bodies (athlete_id, body) of per-metric, per-day files."""
    return _measures(canonical_samples(canonical_bodies(raw.select("athlete_id", body), body, counted)), counted)


def canonical(spark: SparkSession, path: str, athlete_id: int = 0, counted: Counted | None = None) -> DataFrame:
    """Measures of per-metric, per-day files, neither cleaned nor summed up; an empty file gives no row."""
    raw = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    return canonical_measures(raw.select(F.lit(athlete_id).cast("long").alias("athlete_id"), F.col("value").alias("body")), counted=counted)


def resting_hr(spark: SparkSession, path: str, athlete_id: int = 0) -> DataFrame:
    """date, rhr and source of a CSV with a header, by position; a bad line is null and dropped."""
    df = spark.read.option("header", "true").option("mode", "PERMISSIVE").schema("date string, rhr double, source string").csv(path)
    return df.select(F.lit(athlete_id).cast("long").alias("athlete_id"), F.expr("try_to_date(substring(date, 1, 10))").alias("date"), "rhr", "source").where("date is not null and rhr is not null")


def csv(spark: SparkSession, path: str, ddl: str, sep: str = ",") -> DataFrame:
    return spark.read.option("header", "true").option("mode", "PERMISSIVE").option("sep", sep).schema(ddl).csv(path)


def tcx_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of track files, however their suffix is written."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][cC][xX]").load(path).select("path", "length", "modificationTime")


def tcx_samples(spark: SparkSession, path: str) -> DataFrame:
    """Trackpoints of track files: activity_id is a hash of the file's name."""
    ddl = "Time string, DistanceMeters double, AltitudeMeters double, HeartRateBpm struct<Value: double>, Extensions struct<TPX: struct<Speed: double>>"
    df = spark.read.format("xml").option("rowTag", "Trackpoint").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][cC][xX]").schema(_struct(ddl)).load(path)
    return df.select(F.xxhash64(F.col("_metadata.file_name")).alias("activity_id"), F.try_to_timestamp("Time").alias("ts"), F.col("Extensions.TPX.Speed").alias("speed"), F.col("HeartRateBpm.Value").alias("heart_rate"), F.col("DistanceMeters").alias("distance_m")).where("ts is not null")


def weight_archive(spark: SparkSession, path: str, athlete_id: int = 0) -> DataFrame:
    """ts, weight, fat_mass and seq of zip archives that hold weight.csv; archives are read on executors."""

    def rows(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = {n.rsplit("/", 1)[-1]: n for n in z.namelist()}
                    if "weight.csv" not in names:
                        continue
                    w = pd.read_csv(io.BytesIO(z.read(names["weight.csv"])))
                    yield pd.DataFrame({"ts": pd.to_datetime(w.iloc[:, 0], utc=True, errors="coerce").dt.tz_localize(None), "weight": pd.to_numeric(w.iloc[:, 1], errors="coerce"), "fat_mass": pd.to_numeric(w.iloc[:, 2], errors="coerce"), "seq": range(len(w))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")
    return files.mapInPandas(rows, "ts timestamp, weight double, fat_mass double, seq long").withColumn("athlete_id", F.lit(athlete_id).cast("long"))
