"""Helpers that the operators share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but these six ASCII characters; bytes.split() and this pattern agree on that.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def tune(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes as well as by rows, so that long texts can't fill a worker.

    These are settings of the session, which hold for later queries too: they are read when a lazy result is worked out.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A ValueError where it is unset, in any mode, as it can't be set later."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        raise ValueError("start the session with spark.checkpoint.dir, a folder that the driver and all executors share")
    return found.rstrip("/")


_OWN = threading.local()


def _tables() -> list[str]:
    """Tables in the shared folder that this thread has written and nobody has removed yet, in the order of writing."""
    return _OWN.__dict__.setdefault("paths", [])


def own(path: str) -> str:
    """Notes a folder in the shared one that `removed` or `scratch` shall delete."""
    _tables().append(path)
    return path


def written(df: DataFrame, tag: str, **options) -> DataFrame:
    """Cuts the lineage with a table in the shared folder, which outlives executors; `removed` deletes it, or `scratch`."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(own(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables() -> list[str]:
    """Paths of the tables that `written` has made in this thread and nobody has removed. Results that are still to be read need theirs."""
    return list(_tables())


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of `written` that no result needs any more."""
    for path in paths:
        if path in _tables():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            _tables().remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what `written` has made within it. Results that are still to be read must be read, or written elsewhere, before it ends."""
    before = tables()
    try:
        yield
    finally:
        removed(spark, [t for t in tables() if t not in before])


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text, 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_place(df: DataFrame) -> DataFrame:
    """df with columns c0, c1 and so on: names with dots or backticks can't go to Python workers."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def sortable(t: T.DataType) -> bool:
    return not _has_map(t)


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t.fields)
    return _has_map(t.elementType) if isinstance(t, T.ArrayType) else isinstance(t, (T.MapType, T.VariantType))


def row_hash(df: DataFrame, prefix: str = "", seed: int = 0) -> Column:
    """A 64-bit hash of all columns of df (with plain names), maps and variants included; another one for each seed."""
    columns = [(F.col(prefix + f.name), f.dataType) for f in df.schema.fields]
    return F.xxhash64(*[F.lit(seed)] * (seed > 0), *[F.to_json(F.struct(c)) if _has_map(t) else c for c, t in columns])


def with_length(docs: DataFrame) -> DataFrame:
    """docs whose n_chars, if they have it, follows the text; other columns, of whatever names, stay."""
    titles, places = docs.columns, by_place(docs)
    n = F.length(F.col(f"c{titles.index('text')}").cast("string")).cast("long")
    return places.select(*[n.alias(c) if t == "n_chars" else F.col(c) for c, t in zip(places.columns, titles, strict=True)]).toDF(*titles)
