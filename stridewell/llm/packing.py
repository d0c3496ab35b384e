"""Packing of examples into training sequences by vector bin packing."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, partitions, row_hash, sortable, tune
from .tokens import encoder

#: Limits of a sequence: tokens, segments, tokens that bear loss.
LIMITS = (2048, 16, 1792)
#: The first share of a document's tokens is its prompt, which bears no loss. It is cut into pieces of FILLER at most, which fill up
#: sequences that have reached their tokens with loss.
PROMPT, FILLER = 0.25, 256
#: Examples that are packed together; bounds a worker's memory whatever the input's size or skew.
CHUNK = 8192


def pack_chunk(sizes: np.ndarray, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bin and position in it of each row of sizes (n x dimensions), by the dot-product heuristic.

    One bin is open at a time; of the examples that still fit in every dimension, the one with the largest dot product
    of its sizes and what is left, each weighted by the dimension's total demand, goes in next. Equal vectors are
    interchangeable and are taken in row order. An example that is larger than the limits has a bin of its own.
    """
    cap = np.asarray(limits, np.int64)
    kinds, which = np.unique(sizes, axis=0, return_inverse=True)
    rows: dict[int, list[int]] = defaultdict(list)
    for i in range(len(sizes) - 1, -1, -1):
        rows[int(which[i])].append(i)
    left = np.array([len(rows[k]) for k in range(len(kinds))])
    weight = sizes.sum(0) / np.maximum(cap, 1) / np.maximum(cap, 1)
    bins, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    current, room, n, placed = 0, cap.copy(), 0, 0
    while placed < len(sizes):
        fits = (left > 0) & (kinds <= room).all(1)
        if not fits.any():
            if n == 0:
                fits = left > 0  # larger than the limits
            else:
                current, room, n = current + 1, cap.copy(), 0
                continue
        score = np.where(fits, kinds @ (weight * np.maximum(room, 0)), -1.0)
        k = len(score) - 1 - int(np.argmax(score[::-1]))  # of equal scores, the larger sizes
        i = rows[k].pop()
        left[k] -= 1
        bins[i], at[i] = current, n
        room, n, placed = room - kinds[k], n + 1, placed + 1
    return bins, at


def pack(examples: DataFrame, limits: tuple[int, int, int] = LIMITS, chunk: int = CHUNK, n_partitions: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to examples with the long columns `length` and `loss_tokens`; all other columns stay,
    except that earlier columns of those two names are replaced.

    Examples are dealt out by a hash of all their columns, in sorted order, and packed `chunk` at a time, so that no
    source, key or group of copies meets in one task's memory. A sequence takes at most limits[0] tokens, limits[1]
    examples and limits[2] tokens that bear loss. offset is an example's first token in its sequence, without gaps.
    Null lengths count as 0. An empty input gives an empty result. Reruns with as many partitions agree.
    """
    spark = examples.sparkSession
    tune(spark)
    n_partitions = n_partitions or partitions(spark)
    examples = examples.drop("sequence_id", "offset")
    titles = examples.columns
    measured = [f"c{titles.index(c)}" for c in ("length", "loss_tokens")]
    examples = by_place(examples)
    names = examples.columns
    dealt = examples.withColumn("deal", row_hash(examples)).repartition(n_partitions, "deal").sortWithinPartitions("deal", *[c for c in names if sortable(examples.schema[c].dataType)])
    schema = T.StructType([*examples.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId() << 40
        waiting: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done, waiting
            table = pa.Table.from_batches(waiting).select(names)
            waiting = []
            length, loss = (table[c].to_numpy().astype("float64") for c in measured)
            sizes = np.stack([np.nan_to_num(length), np.ones(len(length)), np.nan_to_num(loss)], 1).astype(np.int64)
            bins, at = pack_chunk(sizes, limits)
            order = np.lexsort((at, bins))
            ends = np.cumsum(sizes[order, 0])
            first = np.r_[True, np.diff(bins[order]) > 0]
            starts = ends - sizes[order, 0]
            offset = starts - starts[first][np.cumsum(first) - 1]
            table = table.take(pa.array(order)).append_column("sequence_id", pa.array(bins[order] + done)).append_column("offset", pa.array(offset))
            done += int(bins.max()) + 1
            yield from table.combine_chunks().to_batches()

        for b in batches:
            while b.num_rows:
                room = chunk - sum(x.num_rows for x in waiting)
                waiting.append(b.slice(0, room))
                b = b.slice(room)
                if sum(x.num_rows for x in waiting) >= chunk:
                    yield from flush()
        if waiting:
            yield from flush()

    return dealt.mapInArrow(run, schema).toDF(*titles, "sequence_id", "offset")


def cuts(n: int, limits: tuple[int, int, int] = LIMITS, prompt: float = PROMPT, filler: int = FILLER) -> list[tuple[int, int]]:
    """End and tokens with loss of each piece of a document of n tokens, whose first int(n * prompt) bear no loss.

    A prompt longer than `filler` is cut into pieces of that length, apart from the rest; other pieces take as many tokens as the limits allow.
    """
    free, out, s = int(n * prompt), [], 0
    while s < n:
        if s < free and free > filler:
            e = min(free, s + filler, s + limits[0])
        else:
            e = min(n, s + limits[0], max(s, free) + limits[2])
        out.append((e, max(0, e - max(s, free))))
        s = e
    return out


def token_pieces(docs: DataFrame, limits: tuple[int, int, int] = LIMITS, end_id: int = 1, with_ids: bool = True, prompt: float = PROMPT, filler: int = FILLER, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """The ids of each whole text and end_id, cut into pieces (see `cuts`) that the limits of a sequence allow.

    doc_id, start, length, loss_tokens, ids_crc32, doc_tokens and, with_ids, ids (binary, little-endian unsigned 32-bit). A null or empty text
    has the piece [end_id]; repeated rows and null doc_ids are documents of their own; other columns are ignored.
    """
    tune(docs.sparkSession)
    names = ["doc_id", "start", "length", "loss_tokens", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    types = [pa.int64()] * 6 + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                s = 0
                for e, loss in cuts(len(ids), limits, prompt, filler):
                    piece = ids[s:e].tobytes()
                    out.append((doc, s, e - s, loss, zlib.crc32(piece), len(ids), piece)[: len(names)])
                    s = e
            for i in range(0, len(out), 4096):
                cols = list(zip(*out[i : i + 4096], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, loss_tokens long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def packed_documents(docs: DataFrame, limits: tuple[int, int, int] = LIMITS) -> DataFrame:
    """Pieces of documents with the sequence that each one goes to; the first quarter of a document bears no loss. The ids stay with the documents.

    A null text counts as empty; an empty table gives an empty result.
    """
    out = pack(token_pieces(docs, limits, with_ids=False), limits)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")
