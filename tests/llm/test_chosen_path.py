import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewell.llm import chosen_path as cp
from stridewell.llm.components import components
from stridewell.llm.shingles import shingle_set


def brute(rows, similarity=0.8):
    """doc_id -> (set_id, class_id, n_links)."""
    sets = {}
    for i, t in rows:
        s = shingle_set(t)
        if i is not None and len(s):
            key = s.tobytes()
            sets[key] = (min(i, sets[key][0]) if key in sets else i, set(s.tolist()))
    keys = list(sets)
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    links = Counter()
    for x in range(len(keys)):
        for y in range(x):
            a, b = sets[keys[x]][1], sets[keys[y]][1]
            if len(a & b) >= similarity * len(a | b):
                links[keys[x]] += 1
                links[keys[y]] += 1
                root[top(keys[x])] = top(keys[y])
    least = {}
    for k in keys:
        least[top(k)] = min(least.get(top(k), sets[k][0]), sets[k][0])
    out = Counter()
    for i, t in rows:
        s = shingle_set(t)
        k = s.tobytes()
        out[(i, None, None, 0) if i is None else (i, i, i, 0) if not len(s) else (i, sets[k][0], least[top(k)], links[k])] += 1
    return out


def families(seed, n_families=12, copies=8, changes=4):
    rng = random.Random(seed)
    rows = []
    for f in range(n_families):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(copies):
            w = list(words)
            for _ in range(rng.randrange(changes)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def check(spark, rows):
    got = Counter(tuple(r) for r in cp.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "set_id", "class_id", "n_links").collect())
    assert got == brute(rows)


def test_families(spark):
    check(spark, families(1))


def test_large_buckets_are_split_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(cp, "LEAF", 4)
    monkeypatch.setattr(cp, "BLOCK", 8)
    monkeypatch.setattr(cp, "SET_BLOCK", 8)
    check(spark, families(2, n_families=2, copies=40, changes=3))


def test_documents(spark, documents, nothing):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    check(spark, rows)
    kept = cp.deduplicated(documents)
    assert kept.columns == documents.columns
    want = {i for i, _, c, _ in brute(rows) if i is not None and i == c}
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) - {None} == want and Counter(ids)[None] == 2 and max(Counter(i for i in ids if i is not None).values()) == 1
    assert cp.join(nothing).count() == 0


def test_repeated_rows_and_ids(spark):
    """Rows that repeat three times, and doc_ids that stand for several texts, count once a text."""
    base = families(3, n_families=4, copies=5, changes=3)
    rows = [r for r in base for _ in range(3)] + [(i, base[(i * 7 + 3) % len(base)][1]) for i, _ in base[:8]] + [(5, "t u v"), (1, "t u v"), (5, "w x y z a b c")]
    check(spark, rows)
    docs = spark.createDataFrame([(1, "t u", "x", {"k": 1}), (5, "t u", "x", None), (5, "u v", "x", None), (5, "u v", "y", {"k": 2}), (5, "u v", "y", {"k": 2}), (7, "", None, None), (7, "", None, None), (8, None, None, None), (None, "t u", None, None)], "doc_id long, text string, `__id` string, `row` map<string,int>")
    kept = cp.deduplicated(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == Counter({(1, "t u"): 1, (5, "u v"): 1, (7, ""): 2, (8, None): 1, (None, "t u"): 1})
    assert all((r["__id"], r["row"]) in [("x", None), ("y", {"k": 2}), ("x", {"k": 1}), (None, None)] for r in kept.collect())
    assert cp.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_classes_of_large_groups_without_counting(spark, monkeypatch, seed):
    """Groups of several blocks: a family around one text, a chain, and families that only sketches glue, against brute force."""
    monkeypatch.setattr(cp, "SET_BLOCK", 16)
    monkeypatch.setattr(cp, "PIVOTS", 3)
    monkeypatch.setattr(cp, "ALIKE", 12)  # groups hold unlike sets too
    chain = [f"c{k}" for k in range(300)]
    rows = families(seed, n_families=3, copies=60, changes=4) + [(5000 + k, " ".join(chain[4 * k : 4 * k + 60])) for k in range(50)]
    want = {i: c for i, _, c, _ in brute(rows)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, whole = cp.classes(docs, links=False)
    assert {r["set_id"]: r["class_id"] for r in whole.collect()} == {i: want[i] for i, s, *_ in brute(rows) if i == s}
    assert sorted(r["doc_id"] for r in cp.deduplicated(docs).collect()) == sorted(set(want.values()))


def test_a_large_family_and_a_chain(spark):
    """3,000 near copies, more than a block, and a chain whose ends are unlike: class and links of every set."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(90)}" for _ in range(60)]
    rows = []
    for i in range(3000):
        w = list(words)
        w[rng.choice((0, 1, 58, 59))] = f"x{i}"
        rows.append((i, " ".join(w)))
    chain = [f"c{k}" for k in range(200)]
    rows += [(5000 + k, " ".join(chain[4 * k : 4 * k + 60])) for k in range(30)]
    sets = [shingle_set(t) for _, t in rows]
    tokens = {x: k for k, x in enumerate(np.unique(np.concatenate(sets)).tolist())}
    m = np.zeros((len(sets), len(tokens)), np.float32)
    for k, x in enumerate(sets):
        m[k, [tokens[y] for y in x.tolist()]] = 1
    both, size = m @ m.T, m.sum(1)
    links = (both >= 0.8 * (size[:, None] + size[None] - both) - 1e-4).sum(1) - 1
    got = {r["doc_id"]: r for r in cp.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [got[i]["n_links"] for i, _ in rows] == links.tolist()
    assert {got[i]["class_id"] for i in range(3000)} == {0} and {got[5000 + k]["class_id"] for k in range(30)} == {5000}


@pytest.mark.parametrize("cuts", [(160, 160), (160, 170), (160, 180)])
def test_recall_of_the_paths_that_a_join_takes(spark, monkeypatch, cuts):
    """Also where one set holds the other: 160 / 200 shingles, as when a text has a quarter appended."""
    asked = []
    monkeypatch.setattr(cp, "described", lambda docs, runs, depth, overlap, width: asked.append((runs, depth, overlap)) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        cp.join(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    rng = np.random.default_rng(5)
    n, hits = 3000, 0
    for _ in range(0, n, 300):
        pairs = [np.split(rng.integers(0, 2**63, 200, dtype=np.uint64), cuts) for _ in range(300)]
        sets = [np.r_[common, x] for common, *own in pairs for x in own]
        owner, path, _ = cp.paths(np.concatenate(sets), np.array([len(s) for s in sets]), *asked[0])[-1]
        found = [set() for _ in sets]
        for i, p in zip(owner.tolist(), path.tolist(), strict=True):
            found[i].add(p)
        hits += sum(bool(found[i] & found[i + 1]) for i in range(0, len(sets), 2))
    assert hits / n >= 0.985


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((top(a), top(b)))
        root[hi] = lo
    got = {(r["node"], r["root"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, top(x)) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_a_family_are_counted_by_its_midst(spark, monkeypatch):
    """A family of close copies, some further away, and a stranger that only some of them link to: counts as all pairs give them."""
    monkeypatch.setattr(cp, "SET_BLOCK", 12)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(90):
        words = list(base)
        for _ in range(1 if i < 60 else rng.randrange(6, 12)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(rng.choice(base) for _ in range(400)) for _ in range(10)]
    compared = []
    real = cp.compared
    monkeypatch.setattr(cp, "compared", lambda pairs, s: compared.append(pairs.count()) or real(pairs, s))
    rows = cp.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in texts]
    want = [sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert [r["n_links"] for r in sorted(rows, key=lambda r: r["doc_id"])] == want and len(set(want)) > 5
    assert compared[-1] < 90 * 8  # all pairs of blocks would take 90 * 8 rows


def test_very_long_near_copies(spark, monkeypatch):
    """Texts of 200,000 words, whose sets are blocks of their own."""
    monkeypatch.setattr(cp, "SET_BYTES", 2 << 20)
    rng = random.Random(12)
    base = [f"w{rng.randrange(50_000)}" for _ in range(200_000)]
    texts = [" ".join([*base[: 1000 * i], "new", *base[1000 * i :]]) for i in range(5)] + [" ".join(rng.choice(base) for _ in range(200_000)), "short text"]
    rows = {r["doc_id"]: (r["set_id"], r["class_id"], r["n_links"]) for r in cp.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert rows == {**{i: (i, 0, 4) for i in range(5)}, 5: (5, 5, 0), 6: (6, 6, 0)}


def test_texts_outside_groups_are_not_dealt(spark):
    """No row that is looked for is left out, and few others stay; where the bitmaps are too small for the rows, more do."""
    rows = spark.range(20_000).select("id", F.unhex(F.md5(F.col("id").cast("string"))).alias("mark"), F.lit("x").alias("text"))
    wanted = rows.where("id % 10 = 3").select("id", "mark")
    found = cp.likely(rows.unionByName(rows.limit(5)), wanted, ["id", "mark"])
    assert found.columns == rows.columns
    assert found.join(wanted, ["id", "mark"]).count() == wanted.count() + found.where("id = 3").count() - 1
    assert found.count() < 2 * wanted.count()
    assert cp.likely(rows, wanted.limit(0), ["id", "mark"]).count() == 0


def test_bitmaps_of_bounded_size_lose_no_row(spark, monkeypatch):
    monkeypatch.setattr(cp, "MOST_BITS", 4096)
    rows = spark.range(20_000).select("id")
    wanted = rows.where("id % 10 = 3")
    found = cp.likely(rows, wanted, ["id"])
    assert found.join(wanted, "id").count() == wanted.count() and found.count() < rows.count()
