import hashlib
import random

import pytest

from stridewell.llm import substrings as ss


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    low = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                x = tuple(w[k : k + window])
                low[x] = min(low.get(x, i), i)
    out = []
    for i, w in words:
        stay = [True] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and low[tuple(w[k : k + window])] < i:
                stay[k : k + window] = [False] * window
        kept = [x for x, s in zip(w, stay, strict=True) if s]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("heavy", [0, 64])
def test_against_brute_force(spark, documents, monkeypatch, heavy):
    monkeypatch.setattr(ss, "HEAVY", heavy)
    got = sorted((tuple(r) for r in ss.documents(documents).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in documents.collect()], 13)


def test_buckets_follow_the_data(spark, documents, monkeypatch):
    """With few super-k-mers a bucket there are hundreds of buckets, with slots to match; the rows are the same."""
    monkeypatch.setattr(ss, "PER_BUCKET", 20)
    monkeypatch.setattr(ss, "SLOTS", 64)
    got = sorted((tuple(r) for r in ss.documents(documents).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in documents.collect()], 13)


def test_hot_minimisers(spark):
    """Many documents with one passage between different words: its minimisers are hot, and its copies many."""
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(20)) + " " + passage + " " + " ".join(rng.choice("abcdefgh") for _ in range(20))) for i in range(300)]
    got = sorted((tuple(r) for r in ss.documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == brute(rows, 13)


def test_nothing(nothing):
    assert ss.documents(nothing).count() == 0


def test_sliding_min():
    import numpy as np

    x = np.random.default_rng(0).integers(0, 100, 50)
    for width in range(1, 13):
        assert ss.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(50 - width + 1)]
