import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewell.llm import quality as q
from tests.llm.conftest import prose


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = list(zip(w, w[1:], w[2:], strict=False))
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = ["", None, " \n\t", "a b c a b c", "a a a a a", "a b c", "x y", "# é |b| <c>\n# é |b| <c>\n\n\n", "a b c d a b c d a b", "l\nl\n l\nl", "\x0b\x0c\r a b   c"]


@pytest.mark.parametrize("place", [2, 20])
def test_counts(spark, monkeypatch, place):
    """With few bits for a window's place, texts take the way without hashes."""
    monkeypatch.setattr(q, "PLACE", place)
    rng = random.Random(1)
    texts = [*TEXTS, *[" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)], prose(rng, 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in q.judge(df, []).collect():
        b = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b, texts[r["doc_id"]]
        assert r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and r["kept"] == (not r["base_failed"])


def test_clashing_hashes_are_told_apart(spark, monkeypatch):
    """With one bit of hash, unequal windows clash and are compared by themselves."""
    monkeypatch.setattr(q, "PLACE", 62)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcd") for _ in range(30)) for _ in range(40)]
    for r in q.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), []).collect():
        assert r["n_repeat_words"] == brute(texts[r["doc_id"]])[4]


def test_rules_find_conjunctions():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] <= 0.5) | (x[:, 2] > 0.95)
    rules = q.learn_rules(x, bad)
    hit = np.any([q.covers(x, r) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.98 and all(len(r) <= 4 for r in rules)
    assert q.learn_rules(x[:0], bad[:0]) == [] and q.learn_rules(x, np.zeros(4000, bool)) == []
    assert q.learn_rules(x, rng.random(4000) < 0.1) == [] or np.mean([q.covers(x, r).mean() for r in q.learn_rules(x, rng.random(4000) < 0.1)]) < 0.05


def test_rules_from_few_labels():
    """Six bad rows among 80 that one statistic tells apart: a rule whose threshold stands in the middle; by chance alone there is none."""
    rng = np.random.default_rng(1)
    x = rng.random((80, 4))
    bad = np.arange(80) < 6
    x[:, 2] = np.where(bad, 0.5 + x[:, 2] / 2, 0.0)
    (rule,) = q.learn_rules(x, bad)
    assert rule == [(2, ">", x[bad, 2].min() / 2)]
    assert sum(len(q.learn_rules(rng.random((400, 10)), rng.random(400) < 0.1, s)) for s in range(40)) <= 4


def plain_learn(x, bad, tries=12, precision=0.9):
    """Covering by trying every value as a threshold, one rule of one term, on the same folds."""
    rng = np.random.default_rng(0)
    for _ in range(tries):
        grow = np.zeros(len(x), bool)
        for kind in (bad, ~bad):
            rows = rng.permutation(np.flatnonzero(kind))
            grow[rows[: len(rows) - len(rows) // 3]] = True
        best = max(((((x[grow, j] > t) & bad[grow]).sum() - ((x[grow, j] > t) & ~bad[grow]).sum()), j, t) for j in range(x.shape[1]) for t in x[grow, j])
        hit = x[:, best[1]] > best[2]
        p, n = (hit & bad & ~grow).sum(), (hit & ~bad & ~grow).sum()
        if p and (p + 1) / (p + n + 2) >= precision:
            return best[1], hit
    return None, np.zeros(len(x), bool)


def test_a_single_term_against_every_threshold():
    rng = np.random.default_rng(6)
    for j in range(5):
        x = rng.random((600, 5))
        bad = x[:, j] > 0.85
        rules = q.learn_rules(x, bad)
        k, hit = plain_learn(x, bad)
        assert k == j and rules[0][0][0] == j and (np.any([q.covers(x, r) for r in rules], axis=0) == hit).mean() > 0.98


def test_rules_on_the_driver_s_labels(spark):
    """On held-out labels, the list finds the bad documents that pass the base test and leaves good ones alone."""
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    rules = q.fit(docs, labels.where(part == 0))
    out = q.judge(docs, rules).join(labels.where(part == 1), "doc_id").where("not base_failed").collect()
    bad, good = [r for r in out if r["quality"] == 0], [r for r in out if r["quality"] == 1]
    assert rules and len(bad) >= 5 and sum(not r["kept"] for r in bad) >= 0.9 * len(bad) and sum(r["kept"] for r in good) >= 0.98 * len(good)


def test_repeated_labels_and_documents(spark):
    docs = spark.createDataFrame([(i % 50, " ".join(f"v{k}" for k in range(60 + i % 9)) + (" |" * 60 if i % 50 < 10 else "")) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 50, int(i % 50 >= 10)) for i in range(150)], "doc_id long, quality int")
    assert q.fit(docs, labels, sample=300)


def test_fit_and_judge(spark):
    rng = random.Random(3)
    junk = lambda: " | ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    fine = lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(80))
    texts = [junk() if i % 4 == 0 else fine() for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, None)], "doc_id long, text string, stats string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)] + [(None, 0, 0), (9999, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    rules = q.fit(docs, labels)
    out = {r["doc_id"]: r for r in q.judge(docs, rules).collect()}
    assert rules and all(out[i]["kept"] == (i % 4 != 0) for i in range(400)) and not out[None]["kept"]
    assert "Python" not in q.judge(docs, rules)._jdf.queryExecution().executedPlan().toString()


def test_nothing(nothing, documents):
    assert q.judge(nothing, []).count() == 0
    assert q.judge(documents.withColumn("n_words", F.lit("x")), []).count() == documents.count()
