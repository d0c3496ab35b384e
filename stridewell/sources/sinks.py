"""Sinks: tables, exports, an envelope for tools, and a manifest of imported files."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridewell.operators.timeseries import keep_first

#: Formats by file suffix.
FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "xlsx": "xlsx"}
#: Rows of an xlsx file at most: it is written by the driver, which holds all of them.
XLSX_ROWS = 100_000
PART_ROWS = 2_000_000


def save_activities(df: DataFrame, path: str, keys: Sequence[str] = ("athlete_id", "session_start")) -> None:
    """One row for each key, partitioned by year; a year is written in parts of about PART_ROWS rows, however large it is, each sorted by the keys."""
    rows = keep_first(df, keys, ["activity_id"]).withColumn("year", F.year("session_start"))
    parts = max(1, df.count() // PART_ROWS)
    rows.repartitionByRange(parts, "year", *keys).sortWithinPartitions("year", *keys).write.mode("overwrite").partitionBy("year").parquet(path)


def save_table(df: DataFrame, path: str, kind: str | None = None) -> str:
    """Writes a result as csv, json lines, parquet, or xlsx; the format is given or that of the suffix.

    An xlsx file goes through the driver; a result of more than XLSX_ROWS rows raises a ValueError, and nothing is written.
    """
    kind = kind or os.path.splitext(path)[1].lstrip(".") or os.environ.get("STRIDEWELL_FORMAT", "csv")
    if kind not in FORMATS:
        raise ValueError(f"unknown format: {kind}")
    if kind == "xlsx":
        table = df.limit(XLSX_ROWS + 1).toPandas()
        if len(table) > XLSX_ROWS:
            raise ValueError(f"more than {XLSX_ROWS} rows are too many for xlsx; write csv or parquet, which executors write in parts")
        table.to_excel(path, index=False)
    else:
        writer = df.write.mode("overwrite")
        (writer.option("header", "true") if kind == "csv" else writer).format(FORMATS[kind]).save(path)
    return kind


def envelope(df: DataFrame, most: int = 1000, days: Sequence[str] = ("date", "session_start")) -> dict:
    """A tool's answer: number of rows, range of days, and the first `most` rows."""
    day = next((d for d in days if d in df.columns), None)
    about = df.agg(F.count("*").alias("n"), *([F.min(day).cast("string").alias("a"), F.max(day).cast("string").alias("z")] if day else [])).first()
    details = [r.asDict(recursive=True) for r in df.limit(most).collect()]
    return {"schema_version": 1, "summary": {"record_count": about["n"], "date_range": [about["a"], about["z"]] if day else None}, "details": details, "_meta": {"truncated": about["n"] > most, "columns": df.columns}}


def manifest(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """key (metric folder and file name) and md5 of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("key"), F.md5("content").alias("md5"), "path")


def changed_files(now: DataFrame, known: DataFrame) -> DataFrame:
    return now.join(known.select("key", "md5"), ["key", "md5"], "left_anti")
