"""Repeated imports of folders of files: only what has changed is parsed, and only what it touches is written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridewell.operators import health as h
from stridewell.streaming.ingest import exists

from . import readers

#: Samples of imported files; `file` is the key of the file that they come from.
IMPORTED = "athlete_id long, at string, date date, value double, units string, source string, file string, metric string, month date"
KNOWN = "key string, md5 string, run long"
#: Suffixes of the metrics that samples of one file may give.
SUFFIXES = ("", "_min", "_avg", "_max")
#: Names of files that are read one by one; of more, the whole folder is listed.
BOUND = 5000


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def known_files(spark: SparkSession, state: str) -> DataFrame:
    """key and md5 of the files that earlier runs have imported, as the last of these has seen them."""
    rows = spark.read.schema(KNOWN).parquet(f"{state}/manifest") if exists(spark, f"{state}/manifest") else spark.createDataFrame([], KNOWN)
    return rows.groupBy("key").agg(F.max_by("md5", "run").alias("md5"))


def imported_samples(spark: SparkSession, table: str) -> DataFrame:
    """The samples that `import_canonical` has stored; none where nothing has been imported yet."""
    return spark.read.schema(IMPORTED).parquet(table) if exists(spark, table) else spark.createDataFrame([], IMPORTED)


def _applied(spark: SparkSession, table: str, state: str) -> None:
    """Brings a finished merge into the table, and forgets it. It may be applied again, so that a run that was cut off here is taken up by the next."""
    merge = f"{state}/merge"
    if not exists(spark, f"{merge}/done"):
        _delete(spark, merge)
        return
    rows = spark.read.schema(IMPORTED).parquet(f"{merge}/rows")
    rows.hint("rebalance", F.col("metric"), F.col("month")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric", "month").parquet(table)
    for metric, month in spark.read.parquet(f"{merge}/emptied").collect():
        _delete(spark, f"{table}/metric={metric}/month={month}")
    files = spark.read.schema(KNOWN).parquet(f"{merge}/files")
    if not files.join(known_files(spark, state), ["key", "md5"], "left_anti").isEmpty():
        files.write.mode("append").parquet(f"{state}/manifest")
    _delete(spark, merge)


def import_canonical(spark: SparkSession, folder: str, table: str, state: str, athlete_id: int | None = None, metrics: Sequence[str] | None = None) -> dict[str, int]:
    """Brings a table of samples (IMPORTED, partitioned by metric and month) up to date with a folder of METRIC/DAY.json files.

    A file is known by athlete, metric folder and name, and unchanged if its md5 is that of the last import. Changed files alone
    are parsed; what the table holds of them is replaced by what they hold now, whole: a file that was rewritten with
    fewer samples leaves exactly those. Only partitions that hold samples of changed files, before or after, are
    written again; the others keep their files. Files that are gone keep their samples. With metrics, files of other
    folders are left aside. athlete_id None takes the id from the folder above the metric's (0 if it isn't a number). Nights are no samples of
    this table: `ingest_pushes` keeps them whole.

    The changed bodies, and then the merged partitions, are written to `state` before the table is touched; a run that
    dies is repeated, or completed, by the next. One run at a time must use a table. Returns the numbers of files, changed and unreadable
    ones, and of samples written for them.
    """
    _applied(spark, table, state)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    path = F.split("path", "/")
    part = lambda k: F.coalesce(F.try_element_at(path, F.lit(k)), F.lit(""))
    own = F.coalesce(F.regexp_extract(part(-3), r"^(?:athlete(?:_id)?=)?(\d+)$", 1).try_cast("long"), F.lit(0).cast("long"))
    athlete = own if athlete_id is None else F.lit(athlete_id).cast("long")
    files = files.select(athlete.alias("athlete_id"), F.concat_ws("/", athlete.cast("string"), part(-2), part(-1)).alias("key"), part(-2).alias("folder"), F.md5("content").alias("md5"), F.col("content").cast("string").alias("body"))
    if metrics is not None:
        files = files.where(F.col("folder").isin(*metrics))
    merge = f"{state}/merge"
    files.join(known_files(spark, state).select("key", "md5"), ["key", "md5"], "left_anti").write.parquet(f"{merge}/changed")
    changed = spark.read.parquet(f"{merge}/changed")
    run = (spark.read.schema(KNOWN).parquet(f"{state}/manifest").agg(F.max("run")).first()[0] or 0) + 1 if exists(spark, f"{state}/manifest") else 1
    counted = readers.Counted()
    bodies = readers.canonical_bodies(changed.select("athlete_id", F.col("key").alias("file"), "body"), counted=counted)
    fresh = h.quantities(readers.canonical_samples(bodies)).where("date is not null").withColumn("month", F.trunc("date", "month"))
    names = [f for f, _ in _columns()]
    fresh.select(*names).write.parquet(f"{merge}/fresh")
    fresh = spark.read.schema(IMPORTED).parquet(f"{merge}/fresh")

    stored = imported_samples(spark, table)
    touched = sorted({f"{m}{s}" for (m,) in changed.select("folder").distinct().collect() for s in SUFFIXES})
    stored = stored.where(F.col("metric").isin(*touched)) if touched else stored.limit(0)
    keys = changed.select(F.col("key").alias("file"))
    before = stored.select("metric", "month", "file").join(keys, "file", "left_semi").select("metric", "month").distinct()
    parts = before.unionByName(fresh.select("metric", "month").distinct()).distinct()
    parts.write.parquet(f"{merge}/parts")
    parts = spark.read.parquet(f"{merge}/parts")
    kept = stored.join(keys, "file", "left_anti").join(parts, ["metric", "month"], "left_semi")
    fresh.unionByName(kept.select(*names)).select(*names).write.parquet(f"{merge}/rows")
    rows = spark.read.schema(IMPORTED).parquet(f"{merge}/rows")
    parts.join(rows.select("metric", "month"), ["metric", "month"], "left_anti").select("metric", F.col("month").cast("string")).write.parquet(f"{merge}/emptied")
    changed.select("key", "md5", F.lit(run).cast("long").alias("run")).write.parquet(f"{merge}/files")
    spark.range(1).write.parquet(f"{merge}/done")
    told = {"files": files.select("key").count(), "changed": changed.count(), "unreadable": counted.bodies.get["unreadable"], "samples": fresh.count()}
    _applied(spark, table, state)
    return told


def _columns() -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ")) for c in IMPORTED.split(",")]


def device_metrics(spark: SparkSession, folder: str, cache: str) -> DataFrame:
    """Rows of `readers.device_metrics` for a folder of device files, of which only new and modified pairs are read.

    Names and times of change come from the listing alone; each pair of which a file is new or has another time than at the last call is read
    again and replaces its row. Pairs whose files are gone stay. One caller at a time must use a cache.
    """
    seen_schema, wanted = "name string, modified timestamp", readers.device_metrics
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(folder)
    now = listed.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"))
    seen = spark.read.schema(seen_schema + ", run long").parquet(f"{cache}/seen") if exists(spark, f"{cache}/seen") else spark.createDataFrame([], seen_schema + ", run long")
    run = (seen.agg(F.max("run")).first()[0] or 0) + 1
    last = seen.groupBy("name").agg(F.max_by("modified", "run").alias("modified"))
    new = now.join(last, ["name", "modified"], "left_anti")
    prefix = readers.device_prefix(F.col("name"))
    touched = now.withColumn("prefix", prefix).join(new.select(prefix.alias("prefix")).distinct(), "prefix", "left_semi").select("name")
    names = [r[0] for r in touched.limit(BOUND + 1).collect()]
    if names:
        only = F.col("_metadata.file_name").isin(*names) if len(names) <= BOUND else None
        rows = wanted(spark, folder, only)
        if only is None:
            rows = rows.join(new.select(prefix.alias("prefix")).distinct(), "prefix", "left_semi")
        rows.withColumn("run", F.lit(run).cast("long")).write.mode("append").parquet(f"{cache}/rows")
        new.withColumn("run", F.lit(run).cast("long")).write.mode("append").parquet(f"{cache}/seen")
    if not exists(spark, f"{cache}/rows"):
        return wanted(spark, folder, F.lit(False))
    rows = spark.read.parquet(f"{cache}/rows")
    return rows.groupBy("prefix").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("prefix", "run")]), "run").alias("r")).select("prefix", "r.*")
