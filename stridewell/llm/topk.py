"""Exact top-k search by inner product with the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, tune, written

#: Rows of a block of candidates and of a block of queries, and candidate blocks that a task holds at a time; they bound a worker's memory.
BLOCK, QUERY_BLOCK, HELD = 8192, 1024, 16
SCALE = 1024


def threshold_top_k(query: np.ndarray, vectors: np.ndarray, lists: np.ndarray, k: int, floor: int | None = None, step: int = 8) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Rows and scores of the k largest inner products (more, at ties with the kth), how many rows were scored and how deep the deepest list was read.

    lists[d] holds the rows by falling value of dimension d; a negative component of the query reads its list from the
    end. Lists are read in rounds, each in proportion to the size of its component: `step` entries on average first, then
    twice as many in all. The rows that they show are scored in full; once these are half of all rows, reading on
    costs more than it can save, and the rest is scored at once. A row that no list has shown yet scores no more
    than the values at the reading places allow; when that bound is below the kth score (or below `floor`, the kth score
    elsewhere), no further row can matter. Dimensions in which the query is 0 aren't read.
    """
    n = len(vectors)
    if not query.any():
        return np.arange(n), np.zeros(n, query.dtype), n, 0
    used = np.flatnonzero(query != 0)
    q, falling = query[used], query[used] > 0
    share = np.abs(q).astype(np.float64)
    share = share / share.mean()
    seen = np.zeros(n, bool)
    rows: list[np.ndarray] = []
    scores: list[np.ndarray] = []
    best = np.empty(0, query.dtype)
    depth, average = np.zeros(len(used), np.int64), 0
    while True:
        average = max(2 * average, step)
        was, depth = depth, np.minimum(n, np.ceil(average * share)).astype(np.int64)
        at = was.min() + np.arange(depth.max() - was.min())
        new = np.zeros(n, bool)
        for way in (True, False):
            d = np.flatnonzero(falling == way)
            part = lists[used[d]][:, at if way else n - 1 - at]
            new[part[(at >= was[d, None]) & (at < depth[d, None])]] = True
        if 2 * np.count_nonzero(new | seen) > n:
            new[:] = True
        fresh = np.flatnonzero(new & ~seen)
        seen |= new
        s = vectors[fresh] @ query if 4 * len(fresh) < n else (vectors @ query)[fresh]
        if s.dtype == object:
            s = np.minimum(np.maximum(s, -(2**63)), 2**63 - 1)
        rows.append(fresh)
        scores.append(s)
        best = np.concatenate([best, s])
        best = np.sort(best if len(best) <= k else best[best >= np.partition(best, -k)[-k]] if s.dtype != object else best)[-k:]
        last = lists[used, np.where(falling, depth - 1, n - depth)]
        bound = sum(q * vectors[last, used])
        kth = max([x for x in ((best[0] if len(best) == k else None), floor) if x is not None], default=None)
        if (kth is not None and bound < kth) or seen.all():
            break
    r, s = np.concatenate(rows), np.concatenate(scores)
    least = best[0] if len(best) else 0
    keep = s >= least
    return r[keep], s[keep], len(r), int(depth.max())


def _scaled(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double") * SCALE)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK, trace: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score: of each query the k rows of largest integer inner product, ties to smaller vec_id.

    Both inputs have vec_id and embedding; components become floor(1024 * x). A query's own row, known by its vec_id,
    isn't among its candidates. Rows with a null vec_id, a null vector, or null or non-finite components take no part;
    nor does a vector of another length than the query's. Repeated candidate rows are candidates each; of repeated
    queries the smallest vector counts. Other columns are ignored; an empty table gives an empty result.

    With trace: also n_scored, the candidates that were scored in full for the query, and n_candidates.

    Each candidate goes to one task, in a block of its own length and a salt; there are as many salts as hold HELD blocks
    each, and as many as there are tasks at least. A task sorts the lists of its blocks once; blocks of queries, which
    are sent to every salt, pass over them one at a time, and bring at most k rows (and ties of the kth) a query and
    block. Each block starts from the kth score in those before it. Products are exact: in double precision as far as
    that is exact, else in whole numbers of any size; a score beyond 64 bits counts as the limit.
    """
    spark = vectors.sparkSession
    tune(spark)

    def valid(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        fine = v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        return df.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), _scaled(v).alias("v"))

    asked = valid(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    salts = max(partitions(spark), vectors.count() // (block * HELD))

    def blocks(size: int, kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[int, np.ndarray]]] = {}

            def row(d: int) -> pa.RecordBatch:
                part = held.pop(d)
                ids = np.array([i for i, _ in part], np.int64)
                return pa.RecordBatch.from_pydict({"d": [d], "kind": [kind], "ids": [ids.tobytes()], "vectors": [np.floor(np.stack([v for _, v in part])).astype(np.float64).tobytes()]})

            for b in batches:
                for i, v in zip(b.column(0).to_numpy(zero_copy_only=False), b.column(1), strict=True):
                    x = v.values.to_numpy(zero_copy_only=False)
                    held.setdefault(len(x), []).append((int(i), x))
                    if len(held[len(x)]) >= size:
                        yield row(len(x))
            for d in list(held):
                yield row(d)

        return run

    made = "d long, kind long, ids binary, vectors binary"
    some = F.pmod(F.xxhash64("vec_id"), F.lit(partitions(spark)))
    asked = asked.repartition(some).mapInArrow(blocks(query_block, 1), made).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    given = valid(vectors).mapInArrow(blocks(block, 0), made).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    dealt = given.unionByName(asked).repartition(salts, "d", "salt").sortWithinPartitions("d", "salt", "kind").select("d", "salt", "kind", "ids", "vectors")

    def numbers(m: np.ndarray, exact: bool) -> np.ndarray:
        return m if exact else np.array([[int(x) for x in v] for v in m], object).reshape(m.shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []  # ids, vectors, lists and largest component of each candidate block of the salt at hand
        for b in batches:
            for r in range(b.num_rows):
                d, salt, kind, *blobs = (c[r].as_py() for c in b.columns)
                if (d, salt) != group:
                    group, held = (d, salt), []
                ids = np.frombuffer(blobs[0], np.int64)
                m = np.frombuffer(blobs[1], np.float64).reshape(len(ids), d)
                most = float(np.abs(m).max(initial=0))
                if not kind:
                    held.append((ids, m, np.argsort(-m.T, axis=1, kind="stable").astype(np.int32), most))
                    continue
                top: dict[int, list[int]] = {}  # of each query, its k best scores so far
                cost: dict[int, list[int]] = {int(i): [0, 0] for i in ids}
                for cid, raw, lists, largest in held:
                    exact = d * most * largest < 2.0**52
                    qs, cs = numbers(m, exact), numbers(raw, exact)
                    out: list[tuple] = []
                    for i, x in zip(ids.tolist(), qs, strict=True):
                        best = top.get(i, [])
                        own = int((cid == i).sum())
                        rows, scores, n, _ = threshold_top_k(x, cs, lists, k + own, best[0] if len(best) == k else None)
                        cost[i][0] += n
                        cost[i][1] += len(cid) - own
                        other = cid[rows] != i
                        rows, scores = rows[other], scores[other]
                        top[i] = sorted([*best, *scores.tolist()])[-k:]
                        order = sorted(range(len(rows)), key=lambda t: (-scores[t], cid[rows[t]]))
                        out += [(i, int(cid[rows[t]]), int(scores[t]), None, None) for t in order[:k]]
                    for s in range(0, len(out), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out[s : s + 10_000], strict=True)], found_as)
                if trace:
                    out = [(i, None, None, *c) for i, c in cost.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], found_as)

    found_as = ["query_id", "vec_id", "score", "n_scored", "n_candidates"]
    found = dealt.mapInArrow(run, ", ".join(f"{c} long" for c in found_as))
    if trace:
        found = written(found, "found")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    out = found.where("vec_id is not null").withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if trace:
        out = out.join(found.where("vec_id is null").groupBy("query_id").agg(F.sum("n_scored").alias("n_scored"), F.sum("n_candidates").alias("n_candidates")), "query_id")
    return out


def every_hundredth(embeddings: DataFrame) -> DataFrame:
    """Each row whose vec_id is divisible by 100, searched among all rows."""
    return search(embeddings, embeddings.where(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
"""
