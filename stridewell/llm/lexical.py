"""Ranked lexical search on an index of two levels: byte impacts that bound scores, and counts that give them exactly."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import tune, written

#: Terms, as a pattern: runs of ASCII letters and digits and of all characters beyond ASCII; of letters only A to Z are lowered.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SIGNS = bytes(c + 32 * (65 <= c <= 90) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Terms of a segment of the index, and bytes of a text that are split at a time.
SEGMENT, PIECE = 1 << 20, 1 << 22
#: Impacts are below this; a byte stands for a 255th of it, rounded upwards.
WHOLE = 1_000_000
UPPER = np.arange(256, dtype=np.int64) * WHOLE // 255
#: No impact is further below its byte's bound.
GAP = WHOLE // 255 + 1
#: One in so many tasks' segments is searched first, to raise the bar for the others.
LOTS = 16
#: Bytes of items that are searched for in one pass over the index.
BLOCK = 8 << 20


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text (UTF-8) in order, some PIECE bytes at a time."""
    plain, at = text.translate(_SIGNS), 0
    while at < len(plain):
        cut = plain.find(b" ", at + PIECE)
        end = len(plain) if cut < 0 else cut
        yield plain[at:end].split()
        at = end


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest asks for; `_whole` tells from the length."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _whole(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{max(1, len(raw) // max(n, 1))}")


@dataclass
class Index:
    """table: a row for each segment; n_docs: documents with a term; n_terms: all their terms."""

    table: DataFrame
    n_docs: int
    n_terms: int


def _saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Impacts of terms that occur tf times in documents of relative lengths m."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _relative(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's length for its impacts: 100 is the mean, and a quarter of the difference counts."""
    return 75 + (25 * n * n_docs) // n_terms


def index(docs: DataFrame) -> Index:
    """Indexes the whole text of every document, in segments of about SEGMENT terms, which a task makes of its own rows.

    The first level of a segment is, for each term, the documents that hold it (`places`) and a byte each that bounds
    the impact from above (`impacts`); the second is how often they hold it (`counts`) and how long they are (`lengths`).
    Two passes: lengths are summed first, as impacts need their mean (from bytes; a pattern in the JVM takes ten times as long); nothing is shuffled. A null or empty text, or one without
    terms, is in no segment; repeated rows and null doc_ids are documents of their own; doc_id must be a whole number;
    other columns are ignored. The table is in the shared folder.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_terms = total = 0
        for b in batches:
            for text in b.column(0).cast(pa.binary()):
                signs = np.frombuffer((text.as_py() or b"").translate(_SIGNS), np.uint8) != 32
                n = int(np.count_nonzero(signs[1:] & ~signs[:-1])) + int(signs[:1].sum())
                with_terms, total = with_terms + (n > 0), total + n
        yield pa.RecordBatch.from_pydict({"docs": [with_terms], "terms": [total]})

    sums = docs.select("text").mapInArrow(counted, "docs long, terms long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("docs", "terms")])
    n_docs, n_terms = sums.first()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = int(TaskContext.get().partitionId() % LOTS > 0)
        vocabulary: dict[bytes, int] = {}
        ids: list[np.ndarray] = []
        found: list[tuple[int | None, int]] = []  # doc_id and length
        held = 0

        def segment() -> pa.RecordBatch:
            size = len(found)
            lengths = np.array([x for _, x in found], np.int64)
            key = np.concatenate(ids).astype(np.int64) * size + np.repeat(np.arange(size), lengths)
            key, counts = np.unique(key, return_counts=True)
            places, each = key % size, np.bincount(key // size, minlength=len(vocabulary))
            x = _saturated(counts, _relative(lengths, n_docs, n_terms)[places])
            row = {
                "lot": lot, "n": len(key), "doc_ids": np.array([0 if d is None else d for d, _ in found], "<i8").tobytes(), "no_id": np.array([d is None for d, _ in found]).tobytes(),
                "terms": b" ".join(vocabulary), "sizes": _packed(each), "places": _packed(places), "impacts": (-(-x * 255 // WHOLE)).astype(np.uint8).tobytes(), "counts": _packed(counts), "lengths": lengths.astype("<i8").tobytes(),
            }
            vocabulary.clear()
            ids.clear()
            found.clear()
            return pa.RecordBatch.from_pylist([row])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                length = 0
                for words in terms(text.as_py() or b""):
                    own = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words))
                    ids.append(own)
                    length += len(own)
                if length:
                    found.append((doc, length))
                    held += length
                if held >= SEGMENT:
                    yield segment()
                    held = 0
        if held:
            yield segment()

    schema = "lot long, n long, doc_ids binary, no_id binary, terms binary, sizes binary, places binary, impacts binary, counts binary, lengths binary"
    return Index(written(docs.mapInArrow(build, schema), "lexical", **{"parquet.block.size": 32 << 20}), n_docs, n_terms)


def _frequencies(table: DataFrame, wanted: dict[bytes, int]) -> np.ndarray:
    """In how many documents each wanted term stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            for raw, sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = raw.split(b" ")
                each = _whole(sizes, len(own))
                for i, t in enumerate(own):
                    if (k := wanted.get(t)) is not None:
                        total[k] += each[i]
        known = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": known, "df": total[known]})

    df = np.zeros(len(wanted), np.int64)
    for term, n in table.select("terms", "sizes").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    return df


def _candidates(table: DataFrame, wanted: dict[bytes, int], items: list[list[tuple[int, int]]], bars: list[int], k: int, n_docs: int, n_terms: int) -> DataFrame:
    """item (its number), doc_id and score: each task's k best documents of each item that reach the item's bar, and more of them at the last score.

    items holds, for each, its terms (numbers in wanted) with weights. Bounds from the bytes of all documents of a segment
    come first. k documents score at least the kth best bound less what rounding can have added; so only those whose bound
    reaches that, or the bar, are scored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bar = list(bars)
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]  # (-score, no id, doc_id)
        for b in batches:
            for s in b.to_pylist():
                own = s["terms"].split(b" ")
                ends = np.cumsum(_whole(s["sizes"], len(own)), dtype=np.int64)
                places, impacts, counts = _whole(s["places"], s["n"]), np.frombuffer(s["impacts"], np.uint8), _whole(s["counts"], s["n"])
                doc_ids, no_id = np.frombuffer(s["doc_ids"], "<i8"), np.frombuffer(s["no_id"], bool)
                m = _relative(np.frombuffer(s["lengths"], "<i8"), n_docs, n_terms)
                here = {}
                for i, t in enumerate(own):
                    if (j := wanted.get(t)) is not None:
                        part = slice(int(ends[i - 1]) if i else 0, int(ends[i]))
                        here[j] = (places[part].astype(np.int64), UPPER[impacts[part]], counts[part])
                for no, weighted in enumerate(items):
                    bound, gap = np.zeros(len(doc_ids), np.int64), 0
                    held = [(w, here[j]) for j, w in weighted if j in here]
                    for w, (at, up, _) in held:
                        bound[at] += w * up
                        gap += w * GAP
                    low = max(bar[no], 1)
                    if len(bound) > k:
                        low = max(low, int(np.partition(bound, -k)[-k]) - gap)
                    near = np.flatnonzero(bound >= low)
                    if not len(near):
                        continue
                    score = np.zeros(len(near), np.int64)
                    for w, (at, _, tf) in held:
                        i = np.minimum(np.searchsorted(at, near), len(at) - 1)
                        hit = at[i] == near
                        score[hit] += w * _saturated(tf[i[hit]].astype(np.int64), m[near[hit]])
                    good = score >= max(bar[no], 1)
                    score, near = score[good], near[good]
                    order = np.lexsort((doc_ids[near], no_id[near], -score))[:k]
                    merged = sorted(best[no] + list(zip((-score[order]).tolist(), no_id[near[order]].tolist(), doc_ids[near[order]].tolist(), strict=True)))
                    best[no] = merged[:k]
                    if len(merged) >= k:
                        bar[no] = max(bar[no], -merged[k - 1][0])
        rows = [(no, None if none else doc, -score) for no, found in enumerate(best) for score, none, doc in found]
        yield pa.RecordBatch.from_pydict({"item": pa.array([r[0] for r in rows], pa.int64()), "doc_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.int64())})

    return table.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(idx: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents with a score above 0 of each item (item_id, text), ties by doc_id.

    Scores and weights are whole numbers as `_saturated` and `weight` below have them, an item's repeated terms count again.
    Items are taken in blocks of about BLOCK bytes, which the driver holds one at a time; each block takes three passes over the
    index: document frequencies (of terms alone), a share of the segments, and the others with the bar that the share has set.
    Each task gives k rows an item at most. Equal items (same item_id and text) count once; null texts find nothing;
    other columns are ignored; null doc_ids come after others of their score.
    """
    spark = items.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, out = -(-size // BLOCK), spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")

    def weight(df: int) -> int:
        return math.floor(1000 * math.log((2 * idx.n_docs + 2) / (2 * df + 1)))

    for block in range(blocks):
        asked = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        wanted: dict[bytes, int] = {}
        weighted = [[(wanted.setdefault(t, len(wanted)), n) for t, n in Counter(t for part in terms(text.encode()) for t in part).items()] for _, text in asked]
        w = [weight(int(df)) if df else 0 for df in _frequencies(idx.table, wanted)]
        weighted = [[(j, n * w[j]) for j, n in x if w[j]] for x in weighted]
        held = lambda lot, bars: _candidates(idx.table.where(F.col("lot") == lot), wanted, weighted, bars, k, idx.n_docs, idx.n_terms)  # noqa: E731, B023
        first = written(_ranked(held(0, [0] * len(asked)), k), "first")
        bars = [0] * len(asked)
        for item, score in first.where(F.col("rank") == k).select("item", "score").collect():
            bars[item] = score
        found = _ranked(first.select("item", "doc_id", "score").unionByName(held(1, bars)), k)
        names = spark.createDataFrame([(no, r["item_id"]) for no, r in enumerate(asked)], f"item long, item_id {kind}")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


#: The same rows, for DuckDB.
ORACLE = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS t FROM documents
), total AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM doc WHERE len(t) > 0
), tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM doc) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), item AS (
  SELECT i, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
  ) GROUP BY ALL
), scored AS (
  SELECT i, item_id, r, doc_id, sum(times * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM item JOIN df USING (term) JOIN tf USING (term), total GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
) WHERE rank <= 20
"""
