import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewell.llm import packing as p
from stridewell.llm.tokens import encoder


@pytest.mark.parametrize("limits", [(100, 64, 100), (100, 5, 60), (1, 1, 1)])
def test_bins_keep_all_limits(limits):
    rng = np.random.default_rng(0)
    length = rng.integers(0, limits[0] + 1, 500)
    sizes = np.stack([length, np.ones(500, int), np.minimum(length // 2, limits[2])], 1)
    bins, at = p.pack_chunk(sizes, limits)
    for b in range(bins.max() + 1):
        assert (sizes[bins == b].sum(0) <= limits).all() and sorted(at[bins == b]) == list(range((bins == b).sum()))
    assert sorted(set(bins)) == list(range(bins.max() + 1))
    least = max(int(np.ceil(sizes[:, d].sum() / limits[d])) for d in range(3))
    assert bins.max() + 1 <= 1.25 * least + 2


def test_larger_than_the_limits():
    bins, at = p.pack_chunk(np.array([[500, 1, 0], [3, 1, 0]]), (100, 8, 100))
    assert bins[0] != bins[1]


def plain_cuts(n, limits, filler=256):
    """Ends of pieces, token by token: the first quarter bears no loss."""
    free = n // 4
    ends, length, loss = [], 0, 0
    for i in range(n):
        own = i >= free
        full = length == limits[0] or loss + own > limits[2]
        if free > filler and (i == free or (i < free and length == filler)):
            full = True
        if full and length:
            ends.append(i)
            length = loss = 0
        length, loss = length + 1, loss + own
    return [*ends, n]


@pytest.mark.parametrize("limits", [(2048, 16, 1792), (100, 5, 60), (256, 64, 256), (10, 2, 10)])
def test_cuts(limits):
    for n in [*range(1, 700), 2047, 2048, 2049, 5000, 30_000]:
        got = p.cuts(n, limits)
        assert [e for e, _ in got] == plain_cuts(n, limits)
        assert sum(x for _, x in got) == n - n // 4


def test_the_dot_product_heuristic():
    """Against a plain loop: of the rows that fit, the one with the largest product of its sizes and what is left, weighted."""
    rng = np.random.default_rng(2)
    limits = np.array((60, 7, 40))
    length = rng.integers(1, 50, 120)
    sizes = np.stack([length, np.ones(120, int), rng.integers(0, 41, 120) % (length + 1)], 1)
    weight = sizes.sum(0) / limits / limits
    left, bins, room, b = list(range(120)), {}, limits.copy(), 0
    while left:
        fit = [i for i in left if (sizes[i] <= room).all()]
        if not fit:
            b, room = b + 1, limits.copy()
            continue
        best = max((round(float(sizes[i] @ (weight * room)), 9), tuple(sizes[i])) for i in fit)
        i = next(i for i in fit if tuple(sizes[i]) == best[1])
        left.remove(i)
        bins[i], room = b, room - sizes[i]
    assert p.pack_chunk(sizes, tuple(limits))[0].tolist() == [bins[i] for i in range(120)]


def test_all_limits_bind(spark):
    rng = np.random.default_rng(1)
    n = np.r_[rng.integers(1, 40, 300), rng.integers(100, 3000, 300), rng.integers(5000, 20000, 20)]
    rows = []
    for k in n.tolist():
        s = 0
        for e, loss in p.cuts(k):
            rows.append((e - s, loss))
            s = e
    out = p.pack(spark.createDataFrame(rows, "length long, loss_tokens long"), n_partitions=1)
    sums = out.groupBy("sequence_id").agg(F.sum("length").alias("a"), F.count("*").alias("b"), F.sum("loss_tokens").alias("c")).collect()
    full = [sum(r[d] == m for r in sums) for d, m in zip("abc", p.LIMITS, strict=True)]
    assert all(r[d] <= m for r in sums for d, m in zip("abc", p.LIMITS, strict=True)) and min(full) > 3
    assert sum(r["a"] for r in sums) > 0.95 * 2048 * (len(sums) - 1)


def pieces(df, limits):
    out = p.packed_documents(df, limits).collect()
    encode = encoder()
    want = Counter()
    for r in df.collect():
        ids = np.append(encode(r["text"]), np.uint32(1)).astype("<u4")
        s = 0
        for e in plain_cuts(len(ids), limits):
            want[(r["doc_id"], s, e - s, zlib.crc32(ids[s:e].tobytes()), len(ids))] += 1
            s = e
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["loss_tokens"]))
    for x in sequences.values():
        at = 0
        for offset, length, _ in sorted(x):
            assert offset == at
            at += length
        assert at <= limits[0] and len(x) <= limits[1] and sum(y for *_, y in x) <= limits[2]
    return out, sequences


def test_documents(documents, nothing):
    out, sequences = pieces(documents, (256, 64, 256))
    assert len(sequences) * 256 < 1.3 * sum(r["length"] for r in out) + 4 * 256
    assert p.packed_documents(nothing).count() == 0
    again = p.packed_documents(documents.repartition(7), (256, 64, 256))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, out))


def test_segments_limit(documents):
    pieces(documents, (256, 2, 256))
    pieces(documents, (256, 9, 128))


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(i, 5 + i % 7, i % 3, "x") for i in range(50)], "name long, length long, loss_tokens long, offset string").withColumn("sequence_id", F.lit("y"))
    df = df.withColumn("map", F.create_map(F.lit("a"), F.struct("name", F.create_map(F.lit("b"), "name"))))
    out = p.pack(df, (32, 4, 6), chunk=16)
    assert out.columns == ["name", "length", "loss_tokens", "map", "sequence_id", "offset"]
    assert sorted(r["map"]["a"]["name"] for r in out.collect()) == list(range(50))
    for r in out.groupBy("sequence_id").agg(F.sum("length").alias("a"), F.count("*").alias("b"), F.sum("loss_tokens").alias("c")).collect():
        assert r["a"] <= 32 and r["b"] <= 4 and r["c"] <= 6
