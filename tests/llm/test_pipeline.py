import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as cp
from stridewell.llm import chosen_path, packing, pii, toxicity
from stridewell.llm.common import tables, written
from stridewell.llm.tokens import encoder
from tests.llm.conftest import prose
from tests.llm.test_mixing import water
from tests.llm.test_toxicity import plain_score


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents with a toxic word in every fifth, near copies, and personal data."""
    path = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(400):
        t = [f"w{rng.randrange(3000)}" for _ in range(60)]
        if i % 5 == 0:
            for w in ("worthless", "moronic"):
                t.insert(rng.randrange(60), w)
        docs.append((i, " ".join(t) + (f" mail a{i}@b.example.org" if i % 3 == 1 else ""), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(1000 + i, docs[i][1], "en", "s0", 0) for i in range(20)]
    docs += [(2000 + i, docs[i][1].replace("w1", "w2", 1), "en", "s1", 0) for i in range(20)]
    docs += [(3000, "", "en", "s2", 0), (3001, None, None, None, None), (None, prose(rng, 30), "en", "s0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    by_name = dict(cp.STAGES)
    clean = by_name["toxicity"](spark, docs, sf_dir)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {i for i, t in text.items() if "worthless" not in (t or "")}
    single = by_name["jaccard_join"](spark, clean, sf_dir)
    classes = {r["doc_id"]: r["class_id"] for r in chosen_path.join(clean).collect()}
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect() if r["doc_id"] is not None) == sorted(i for i, c in classes.items() if i is not None and i == c)
    assert {3000, 3001, None} <= {r["doc_id"] for r in single.collect()}
    hidden = by_name["pii"](spark, single, sf_dir)
    rows = hidden.collect()
    assert hidden.columns == columns and len(rows) == single.count() and not any("@" in (r["text"] or "") for r in rows) and any("<email>" in (r["text"] or "") for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    mixed = by_name["mixing"](spark, hidden, sf_dir)
    words = lambda df: df.select(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")))).first()[0]
    assert mixed.columns == columns and abs(words(mixed) - words(hidden)) <= 1
    out = by_name["packing"](spark, mixed, sf_dir)
    assert out.count() == packing.packed_documents(mixed).count()


def plain_pipeline(docs, lexicon):
    """doc_id and text after toxicity, near copies and personal data, one document after the other."""
    clean = [r for r in docs if plain_score(r["text"], lexicon) < 0.7]
    sets = {i: frozenset(zip(*(w[k:] for k in range(5)), strict=False)) or (frozenset([tuple(w)]) if w else frozenset()) for i, r in enumerate(clean) for w in [(r["text"] or "").split()]}
    order = sorted(range(len(clean)), key=lambda i: (clean[i]["doc_id"] is None, clean[i]["doc_id"] or 0))
    group = {i: i for i in sets}
    for n, i in enumerate(order):
        for j in order[:n]:
            if sets[i] and sets[j] and None not in (clean[i]["doc_id"], clean[j]["doc_id"]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                for k in group:
                    group[k] = b if group[k] == a else group[k]
    kept = {}
    for i in order:
        kept.setdefault(group[i], i)
    out = []
    for i in kept.values():
        text = clean[i]["text"]
        for kind, s, e in sorted(pii.base_spans(text or ""), key=lambda x: -x[1]):
            text = f"{text[:s]}<{pii.KINDS[kind]}>{text[e:]}"
        out.append((clean[i]["doc_id"], text, clean[i]["source"]))
    return out


def test_run_against_a_plain_version(spark, sf_dir):
    """Whole stages by brute force: what is kept, how much of each source the mix takes, and that the pieces are the mixed texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is null or doc_id % 3 < 2 or doc_id > 999")
    by_name = dict(cp.STAGES)
    want = plain_pipeline(docs.collect(), toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = docs
    for name in ("toxicity", "jaccard_join", "pii"):
        rows = written(by_name[name](spark, rows, sf_dir), name)
    assert Counter((r["doc_id"], r["text"]) for r in rows.collect()) == Counter((i, t) for i, t, _ in want)
    sizes = Counter()
    for _, t, s in want:
        sizes[s] += len((t or "").split())
    targets = water(sizes)
    mixed = written(by_name["mixing"](spark, rows, sf_dir), "mixing")
    taken, texts = Counter(), Counter(t for _, t, _ in want)
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split())
        assert r["text"] in texts or any((t or "").startswith(r["text"][:20]) for t in texts)
    assert sum(taken.values()) == sum(sizes.values()) and all(abs(taken[s] - targets[s]) <= 70 for s in sizes)
    encode = encoder()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, [*encode(r["text"]).tolist(), 1]) for r in mixed.collect())
    out = by_name["packing"](spark, mixed, sf_dir).collect()
    assert sum(r["length"] for r in out) == sum(len(x) for *_, x in ids)
    whole = Counter((r["doc_id"], r["ids_crc32"]) for r in out if r["length"] == r["doc_tokens"])
    for none, i, x in ids:
        if len(x) < 1024:
            whole[(None if none else i, zlib.crc32(np.array(x, "<u4").tobytes()))] -= 1
    assert not +whole and not -whole


def test_nulls_clashes_and_nothing(spark, sf_dir, documents):
    """Every stage on nulls in any column, blank and long texts, repeated rows, columns with the names that operators use, maps, and no rows."""
    extra = documents.withColumn("score", F.lit("x")).withColumn("row", F.create_map(F.lit("a"), F.lit(1))).withColumn("set_id", F.col("doc_id")).withColumn("a.b", F.lit(2)).withColumn("size", F.lit("s"))
    for name, stage in cp.STAGES:
        out = stage(spark, extra, sf_dir)
        rows = out.collect()
        if name != "packing":
            assert out.columns == extra.columns and all(r["score"] == "x" and r["row"] == {"a": 1} and r["a.b"] == 2 and r["size"] == "s" and r["set_id"] == r["doc_id"] for r in rows), name
        assert len(rows) == {"toxicity": documents.count(), "pii": documents.count()}.get(name, len(rows)) and rows
        empty = stage(spark, extra.limit(0), sf_dir)
        assert empty.columns == out.columns and empty.count() == 0, name


def test_run(spark, sf_dir):
    before = tables()
    a = {tuple(r) for r in cp.run(spark, sf_dir).drop("sequence_id", "offset").collect()}
    assert len(tables()) == len(before) + 1
    assert a and a == {tuple(r) for r in cp.run(spark, sf_dir).drop("sequence_id", "offset").collect()}


def test_entry():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
    assert toxicity.THRESHOLD == 0.7 and chosen_path.SIMILARITY == 0.8 and pii.KINDS == ("email", "ip", "card", "phone")
