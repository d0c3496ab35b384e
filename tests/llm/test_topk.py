import math

import numpy as np
import pytest

from stridewell.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in fine:
        if i % 100 == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in fine if j != i and len(v) == len(q))[:k]
            out += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 40, 8192])
def test_against_brute_force(spark, monkeypatch, block):
    rng = np.random.default_rng(block)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(0, 1200, 5)]
    rows += [(7, [0.0] * 8), (8, [0.0] * 8), (2000, [0.0] * 8), (2100, None), (2200, [1.0] * 7 + [None]), (2300, [math.nan] * 8), (2400, [math.inf] + [0.0] * 7), (None, [1.0] * 8), (2500, [1e30] * 8), (9, [-1e30] * 8), (2600, [1.0, 2.0]), (11, [2.0, 1.0]), (2700, [])]
    rows += [(3001 + i, rows[4][1]) for i in range(15)]  # ties
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 100 = 0"), block=block, query_block=4).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows)


def test_reading_stops_early():
    """A vector that leads in every list is found without reading the lists to the end."""
    rng = np.random.default_rng(0)
    v = np.floor(rng.random((4000, 4)) * 10)
    v[17] = 1000
    rows, scores, n, depth = topk.threshold_top_k(np.ones(4), v, np.argsort(-v.T, axis=1, kind="stable"), 1)
    assert rows.tolist() == [17] and scores.tolist() == [4000] and depth < 100 and n < 400


def test_few_rows_are_scored_where_few_dimensions_matter(spark):
    """Vectors whose dimensions fall off by a third, as after a rotation to principal axes: the bound stops the search; with equal ones it can't."""
    rng = np.random.default_rng(4)
    for fall, share in ((3.0, 0.2), (1.0, None)):
        rows = [(i, [float(x) for x in rng.normal(size=16) / fall ** np.arange(16)]) for i in range(3000)]
        df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(2)
        got = topk.search(df, df.where("vec_id % 100 = 0"), block=512, query_block=8, trace=True).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows)
        assert {r["n_candidates"] for r in got} == {2999}
        if share:
            assert sum(r["n_scored"] for r in got) < share * 2999 * len(got)


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk.every_hundredth(df).count() == 0


def test_columns_with_clashing_names(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(0, 300, 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    more = df.withColumns({"query_id": F.lit("x"), "rank": F.lit(1), "score": F.lit(2), "q": F.lit(3), "list": F.lit(0), "label": F.lit(None).cast("int"), "a.b": F.lit(0), "a`c": F.lit(0)})
    got = sorted(tuple(r) for r in topk.every_hundredth(more).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows)
