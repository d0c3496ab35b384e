"""Training-order materialisation: token sequences in a keyed random order, as fixed-stride binary shards."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own, removed, shared_dir, tables, tune, written
from .tokens import encoder

#: Shards have at least so many bytes, and there are about so many at most, if not told otherwise.
SHARD_BYTES, SHARDS = 32 << 20, 50_000
#: Ids of a chunk of the table between the passes.
CHUNK = 1 << 19
#: Bytes of a shard that a task reads.
READ_BYTES = 32 << 20
#: Ends each record of a shard, as Spark's text writer does.
RECORD_END = 1


def permuted(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A bijection of 0..n-1, by a balanced Feistel network over the next even power of two with cycle-walking.

    The network permutes at most 4n values; a value that lands at n or beyond is sent through again until it lands below.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        out = once(np.asarray(index, np.uint64))
        while (far := out >= n).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


def write_shards(docs: DataFrame, path: str, key: int = 0, seq_len: int = 2048, shard_bytes: int | None = None, end_id: int = 50256, json_path: str | None = None, ranks_path: str | None = None) -> dict:
    """Tokenises every whole text, cuts the stream of ids into sequences of seq_len and writes them in training order.

    The stream holds the documents in the order of the input's partitions, each followed by end_id (a null or empty text:
    end_id alone); the last sequence is filled up with end_id. Sequence i goes to slot permuted(i). Shard k is the file
    part-k of `path` and holds slots k*per_shard and on, each a record of 2*seq_len bytes (ids as little-endian unsigned
    16-bit; larger ids raise an error) and one byte, so slot s starts at byte (s - k*per_shard) * stride. `read_shards` resumes from a slot number alone.

    Each text is tokenised once: the ids of each partition go to a table in the shared folder, in chunks that know their
    place in it, and one number a partition comes to the driver, as in zipWithIndex. From the table the sequences are
    dealt by their slots and written; then it is removed. Both passes are plain map stages, so a lost executor costs its
    own tasks only. Returns n_tokens, n_sequences, seq_len, stride, per_shard and n_shards. An empty input writes no
    shard. Repeated rows and null doc_ids are documents of their own; other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of a partition in order: compressed chunks with their place."""
        small = zstandard.ZstdCompressor(level=6)
        encode, part = encoder(json_path, ranks_path), TaskContext.get().partitionId()
        at, held, size = 0, [], 0

        def chunk() -> pa.RecordBatch:
            nonlocal at, held, size
            out = pa.RecordBatch.from_pydict({"part": [part], "at": [at], "n": [size], "ids": pa.array([small.compress(np.concatenate(held).tobytes())], pa.binary())})
            at, held, size = at + size, [], 0
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                ids = np.append(encode(t), np.uint32(end_id))
                if ids.max() > 65_535:
                    raise ValueError("ids beyond 65,535 don't fit into unsigned 16-bit records; use a smaller vocabulary")
                held.append(ids.astype("<u2"))
                size += len(ids)
                if size >= CHUNK:
                    yield chunk()
        if size:
            yield chunk()

    before = tables()
    stored = written(texts.mapInArrow(encoded, "part long, at long, n long, ids binary"), "ids")
    counted = {r["part"]: r["n"] for r in stored.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(counted):
        base[part], total = total, total + counted[part]
    n_seq = -(-total // seq_len)
    stride = 2 * seq_len + RECORD_END
    per_shard = max(1, (shard_bytes or max(SHARD_BYTES, 2 * total // SHARDS)) // stride)
    n_shards = -(-n_seq // per_shard)
    said = {"n_tokens": total, "n_sequences": n_seq, "seq_len": seq_len, "stride": stride, "per_shard": per_shard, "n_shards": n_shards}
    if not total:
        removed(spark, [t for t in tables() if t not in before])
        return said

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """slot, at (first token in the sequence) and the ids, compressed, of the parts of sequences that each chunk holds."""
        small, large = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for b in batches:
            for part, at, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, first = np.frombuffer(large.decompress(raw), "<u2"), base[part] + at
                if first + n == total:
                    ids = np.append(ids, np.full(n_seq * seq_len - total, end_id, "<u2"))
                bounds = np.unique(np.r_[0, np.arange(seq_len - first % seq_len, len(ids), seq_len), len(ids)])
                starts = first + bounds[:-1]
                pieces = [small.compress(ids[x:y].tobytes()) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"slot": permuted(starts // seq_len, n_seq, key), "at": starts % seq_len, "ids": pa.array(pieces, pa.binary())})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of a slot arrive together and in order."""
        large = zstandard.ZstdDecompressor()
        held: list[bytes] = []
        size = 0
        for b in batches:
            out = []
            for ids in map(large.decompress, b.column(2).to_pylist()):
                held.append(ids)
                size += len(ids)
                if size == 2 * seq_len:
                    out.append(b"".join(held))
                    held, size = [], 0
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})
        if held:
            raise ValueError("a sequence lacks a part")

    parts = stored.mapInArrow(cut, "slot long, at long, ids binary")
    ranged = parts.repartitionById(n_shards, F.expr(f"cast(slot div {per_shard} as int)")).sortWithinPartitions("slot", "at")
    ranged.mapInArrow(whole, "value binary").select(F.col("value").cast("string")).write.text(path, lineSep="\n")
    removed(spark, [t for t in tables() if t not in before])
    return said


def read_shards(spark: SparkSession, path: str, layout: dict, start: int = 0, read_bytes: int = READ_BYTES) -> DataFrame:
    """slot, shard, seq_len and ids_crc32 (of the ids as unsigned 16-bit) of each record from slot `start` on.

    layout is what `write_shards` has returned. Shards are read record by record, in splits of about read_bytes that begin at
    a multiple of the stride, so that a task's memory doesn't depend on a shard's size; to resume, shards before that of
    `start` aren't opened. Without records there are no rows.
    """
    seq_len, stride, per_shard = layout["seq_len"], layout["stride"], layout["per_shard"]
    schema = "slot long, shard long, seq_len long, ids_crc32 long"
    if start >= layout["n_sequences"]:
        return spark.createDataFrame([], schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    names = [n for n in names if (m := re.match(r"part-(\d+)", n)) and int(m[1]) >= start // per_shard]
    conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(stride), "mapreduce.input.fileinputformat.split.maxsize": str(read_bytes)}
    kinds = ("org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable")
    records = spark.sparkContext.newAPIHadoopFile(",".join(f"{path}/{n}" for n in names), *kinds, conf=conf)
    rows = records.map(lambda r: (r[0], zlib.crc32(r[1][: 2 * seq_len])))
    df = spark.createDataFrame(rows, "at long, ids_crc32 long", verifySchema=False)
    shard = F.regexp_extract(F.input_file_name(), r"part-(\d+)[^/]*$", 1).cast("long")  # a task reads one file
    df = df.select(shard.alias("shard"), "at", "ids_crc32")
    return df.select((F.col("shard") * per_shard + F.col("at")).alias("slot"), "shard", F.lit(seq_len).cast("long").alias("seq_len"), "ids_crc32").where(F.col("slot") >= start)


def documents_in_order(docs: DataFrame, key: int = 0, **settings) -> DataFrame:
    """Writes documents as shards to a new folder in the shared one and returns what the shards then hold; see `write_shards` for nulls, repeats and empty tables.

    The folder stays until `common.removed`, or the `common.scratch` around the call, deletes it.
    """
    path = own(f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}")
    return read_shards(docs.sparkSession, path, write_shards(docs, path, key, **settings))
