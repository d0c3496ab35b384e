import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stridewell.llm import mixing


def water(sizes, weights=(1, 2, 3)):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return t | {s: 3 * sizes[s] for s in capped}
        capped |= set(over)


def check(df):
    rows = df.collect()
    out = mixing.mixed_documents(df).collect()
    again = mixing.mixed_documents(df.repartition(5)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again)) and len(out) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, most = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += size(r["text"])
        most[r["source"]] = max(most[r["source"]], size(r["text"]))
    want = water(sizes)
    source = {(r["doc_id"]): r["source"] for r in rows}
    taken = defaultdict(int)
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        if r["doc_id"] is not None:
            s = source[r["doc_id"]]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
            taken[s] += r["taken"]
    assert sum(r["taken"] for r in out) == pytest.approx(sum(sizes.values()), abs=1)
    return taken, want, most


def test_targets_are_met(spark):
    rng = random.Random(0)
    rows = []
    for i in range(600):
        s = "hot" if i % 3 == 0 else f"s{rng.randrange(6)}" if i % 10 else None
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 20, 60])), s))
    rows += [(1000 + i, "w " * 3, "tiny") for i in range(2)]
    taken, want, most = check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert want["tiny"] == 18
    for s, t in want.items():
        assert abs(taken[s] - t) <= most[s] + 1


def test_documents(documents, nothing):
    check(documents)
    assert mixing.mixed_documents(nothing).count() == 0
    clash = documents.withColumn("size", F.lit("x")).withColumn("target", F.lit(1)).withColumn("taken", F.lit(2))
    assert mixing.mix(clash).count() == documents.count()


def test_copies(documents):
    rows = mixing.mixed_copies(documents)
    assert rows.columns == documents.columns
    words = lambda t: len((t or "").split())
    size = Counter()
    for r in documents.collect():
        size[(r["doc_id"], r["source"])] += words(r["text"])
    got, by_source = Counter(), Counter()
    for r in rows.collect():
        got[(r["doc_id"], r["source"])] += words(r["text"])
        by_source[r["source"]] += words(r["text"])
    assert sum(got.values()) == sum(size.values()) and all(n <= 3 * size[k] for k, n in got.items())
    most = max(words(r["text"]) for r in documents.collect())
    for r in mixing.mixed_documents(documents).join(documents.select("doc_id", "source"), "doc_id").collect():
        assert abs(by_source[r["source"]] - r["target"]) <= most + 1


def test_columns_of_any_kind_and_name(spark):
    """Maps, also within others, and names that operators use or that hold a dot; repeated rows; every copy is a row of the input."""
    rows = [(i % 40, " ".join(["w"] * (3 + i % 5)), f"s{i % 3}", {"a": i % 2}, "x", [{"b": 1}], None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row1 map<string,int>, `a.b` string, words array<map<string,int>>, __copy string")
    out = mixing.mixed_copies(df)
    assert out.columns == df.columns
    plain = lambda r: repr(r.asDict(recursive=True))
    known, size = Counter(map(plain, df.collect())), lambda rs: sum(len(r["text"].split()) for r in rs)
    got = out.collect()
    assert size(got) == size(df.collect()) and sum(plain(r) not in known for r in got) <= 1
    assert all(n <= 3 * known[k] for k, n in Counter(map(plain, got)).items() if k in known)
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "size", "source_size", "target", "taken"] and mixed.count() == 60


def test_all_texts_empty(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mixed_documents(df).collect()] == [(0, 0.0, 0)] * 2
