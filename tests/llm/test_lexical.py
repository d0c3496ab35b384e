"""Search against brute force over all documents."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stridewell.llm import lexical

SIGNS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in SIGNS.findall(text or "")]


def brute(docs, items, k=20):
    held = [(d, Counter(t), len(t)) for d, t in ((d, terms(x)) for d, x in docs) if t]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for doc, c, n in held:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


ITEMS = [(1, "the Thor, REED of onder"), (2, "the the the of"), (3, "héren HÉREN"), (4, "nothing here matches"), (5, ""), (6, None), (1, "the Thor, REED of onder"), (None, "blast ening"), (7, "new end 0")]


@pytest.mark.parametrize("small", [False, True])
def test_search_against_brute_force(spark, documents, nothing, monkeypatch, small):
    if small:  # a segment for a few documents, a text in many pieces, an item a block
        monkeypatch.setattr(lexical, "SEGMENT", 60)
        monkeypatch.setattr(lexical, "PIECE", 100)
        monkeypatch.setattr(lexical, "BLOCK", 40)
        monkeypatch.setattr(lexical, "LOTS", 2)
    docs = documents.withColumns({"item_id": F.lit(1), "score": F.lit(2), "lot": F.lit(3), "terms": F.lit("x"), "a.b": F.lit(0)})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(5))
    for k in (1, 3, 20):
        got = lexical.search(lexical.index(docs), items, k)
        want = brute([tuple(r) for r in documents.select("doc_id", "text").collect()], [x for x in ITEMS if x[1] is not None], k)
        assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == want
    assert lexical.search(lexical.index(nothing), items).count() == 0
    assert lexical.search(lexical.index(docs), items.limit(0)).count() == 0


def test_ties_and_large_groups_of_copies(spark, monkeypatch):
    """More copies than are asked for, over many segments: the smallest doc_ids win; other documents stay in their places."""
    monkeypatch.setattr(lexical, "SEGMENT", 500)
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, "a passage that many hold w3 w5") for i in range(3000, 1000, -1)] + [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(900)]
    items = [(0, "a passage that many hold"), (1, "w3 w7 w11"), (2, "w5 many W3 w3")] + [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(3, 12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(20)
    got = lexical.search(lexical.index(df), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == brute(docs, items)


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.unique(np.r_[rng.integers(0, lexical.WHOLE, 100_000), 0, 1, lexical.WHOLE - 1])
    byte = -(-x * 255 // lexical.WHOLE)
    up = lexical.UPPER[byte]
    assert byte.max() <= 255 and (up >= x).all() and (up - x <= lexical.GAP).all()
