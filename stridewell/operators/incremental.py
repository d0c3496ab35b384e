"""Results by activity that are kept and only worked out for what is new."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


def _read(spark: SparkSession, path: str, mark: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Kept results and the activities they cover, of one fingerprint."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/seen/params={mark}")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None, None
    return spark.read.parquet(f"{path}/results/params={mark}"), spark.read.parquet(f"{path}/seen/params={mark}")


def cached(activities: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, params: dict) -> DataFrame:
    """compute's rows (with activity_id) for all activities; those seen before with the same params come from `path`.

    compute gets the new activities alone. Activities without a result are remembered too, so that they aren't tried
    again; other params start anew. The call itself runs the work and appends to `path`, so one caller at a time must use
    a path; only the rows that it returns are lazy. Results are written before the list of what they cover: a run that is cut off
    between the two is repeated, and its rows are told apart by activity_id when they are read.
    """
    spark = activities.sparkSession
    mark = fingerprint(params)
    kept, seen = _read(spark, path, mark)
    new = activities if seen is None else activities.join(seen.select("activity_id"), "activity_id", "left_anti")
    if seen is None or not new.isEmpty():
        compute(new).write.mode("append").parquet(f"{path}/results/params={mark}")
        new.select("activity_id").write.mode("append").parquet(f"{path}/seen/params={mark}")
        kept, _ = _read(spark, path, mark)
    return kept.dropDuplicates(["activity_id"])
