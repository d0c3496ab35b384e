import random
import zlib

import pytest
from pyspark.sql import functions as F

from stridewell.llm import toxicity as tx

from tests.llm.conftest import prose

BAD = ["moronic", "worthless", "scum"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_the_edit_distance():
    terms = [("moronic", False), ("worthless", False), ("scum", False), ("lowei", True), ("morose", False)]
    auto = tx.Automaton(terms)
    rng = random.Random(0)
    words = [t for t, _ in terms] + ["", "x", "loweisp", "lowe", "worthles", "wrthlss", "moron", "moronics"]
    for _ in range(3000):
        w = list(rng.choice(terms)[0])
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "o", "r", "z", "é"])
        words.append("".join(w))
    for w in words:
        want = {}
        for i, (t, prefix) in enumerate(terms):
            d = distance(w, t)
            if d <= tx.allowed_edits(t, prefix):
                want[i] = d
            if prefix and w.startswith(t):
                want[i] = 0
        assert dict(auto.find(w)) == want, w


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        t = prose(rng, 40).split()
        toxic = i % 3 == 0
        if toxic:
            for w in rng.sample(BAD, 2):
                t.insert(rng.randrange(40), w)
        docs.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    docs += [(2000, "you are a worthles thing"), (2001, 'he said "you are worthless" then of the'), (2002, ""), (2003, None), (None, "reed"), (2004, "w0rthless the of"), (2004, "w0rthless the of")]
    labels += [(2003, 1, 1), (None, 1, 1), (5000, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    out = tx.scored(docs, labels).collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    right = [by[i]["predicted"] == int(i % 3 == 0) for i in range(900) if by[i]["held_out"]]
    assert len(right) > 200 and sum(right) / len(right) > 0.97
    assert by[2000]["predicted"] == by[2004]["predicted"] == 1
    assert by[2001]["score"] < 0.7 and by[2002]["predicted"] == by[2003]["predicted"] == 0


def test_labels_of_held_out_rows_change_nothing(labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r["doc_id"], r["score"]) for r in tx.scored(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_extra_columns_and_nothing(documents, nothing, labelled):
    lexicon = tx.fit(nothing, labelled[1])
    assert lexicon.terms == [] and tx.judge(nothing, lexicon).count() == 0
    d = documents.withColumn("score", F.lit("x")).withColumn("a`b", F.lit(1))
    out = tx.judge(d, lexicon)
    assert out.count() == d.count() and dict(out.dtypes)["score"] == "double" and "a`b" in out.columns


def plain_score(text, lexicon):
    """Each word against each term by itself, its surroundings cut out of the text."""
    words = (text or "").lower().split()
    hits = []
    for i, raw in enumerate(words):
        def near(w):
            out = {}
            for t, (term, prefix) in enumerate(lexicon.terms):
                if prefix:
                    if w.startswith(term):
                        out[t] = 0
                elif (d := distance(w, term)) <= tx.allowed_edits(term, prefix):
                    out[t] = d
            return out

        w = raw.strip(tx.MARKS)
        found = near(w)
        if not found and w and not w.isalpha():
            found = {t: max(1, e) for t, e in near(raw.strip(tx.MARKS.replace("$", "")).translate(tx.DISGUISE)).items()}
        around = words[max(0, i - 12) : i], words[i + 1 : i + 13]
        opens, shuts = (lambda x: x[0] in tx.QUOTES), (lambda x: x.rstrip(".,;:!?")[-1:] in tx.QUOTES)
        inside = any(opens(x) for x in [*around[0], raw]) and not any(shuts(x) and x[0] not in tx.QUOTES for x in around[0]) and any(shuts(x) for x in [raw, *around[1]])
        speech = any(x.strip(tx.MARKS) in tx.REPORTING for x in [*around[0], *around[1]])
        hits += [(t, e, inside and speech, w) for t, e in found.items()]
    one = sum(e == 0 for _, e, *_ in hits) == 1
    clean = 0.98
    weigh = lambda t, e, form: lexicon.alone.get(t, 0) if one and e == 0 else lexicon.forms[form, t] if e and (form, t) in lexicon.forms else lexicon.weights.get((t, e), 0)
    for t in {t for t, *_ in hits}:
        clean *= 1 - max(weigh(t, e, form) * (0.3 if q else 1) for x, e, q, form in hits if x == t)
    return 1 - clean


def test_whole_scores_against_a_plain_version(spark):
    lexicon = tx.Lexicon([("moronic", False), ("scum", False), ("worthless", False), ("lowei", True), ("wort", True)], {(0, 0): 0.9, (0, 1): 0.7, (1, 0): 0.95, (2, 0): 0.8, (2, 1): 0.5, (2, 2): 0.3, (3, 0): 0.6, (4, 0): 0.2}, {0: 0.75, 1: 0.5, 2: 0.9, 3: 0.4, 4: 0.1}, {("moronc", 0): 0.05, ("worthles", 2): 0.95})
    rng = random.Random(8)
    some = ["moronic", "moronc", "m0ronic!", "scum", "scums", "worthless", "worthles,", "w0rthl3ss", "loweified", "wort", "worthy", '"you', 'are"', "said", "sagte:", '"worthless"', "the", "of", "reed.", "«scum»", "$cum"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randrange(25))) for _ in range(400)] + ["", None, " \n"]
    out = tx.judge(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), lexicon).collect()
    for r in out:
        assert r["score"] == pytest.approx(plain_score(texts[r["i"]], lexicon)), texts[r["i"]]
    assert 50 < sum(r["predicted"] for r in out) < 390


def misspelt(rng, word):
    k = rng.randrange(1, len(word) - 1)
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + word[k] + word[k:], word[:k] + rng.choice("aeiou") + word[k + 1 :]])


def test_effect_of_edits_and_quotes(labelled):
    """Texts made up from held-out clean ones: terms misspelt (toxic), quoted in reported speech (clean), and an ordinary word one edit from a term (clean)."""
    docs, labels = labelled
    rng = random.Random(6)
    clean = [r["text"] for r in docs.where("doc_id < 900 and doc_id % 3 != 0").where(tx.held_out(F.col("doc_id"))).collect()]
    usual = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" moroni of "), F.col("doc_id").cast("string"))).otherwise(F.col("text")))
    lexicon = tx.fit(usual, labels)
    assert {t for t, _ in lexicon.terms} >= set(BAD)

    def put(text, *more):
        words = text.split()
        at = rng.randrange(len(words))
        return " ".join([*words[:at], *more, *words[at:]])

    made = {
        "misspelt": [put(t, misspelt(rng, "worthless"), "the", misspelt(rng, "worthless")) for t in clean],
        "plain": [put(t, rng.choice(BAD)) for t in clean],
        "quoted": [put(t, "he", "said", '"you', rng.choice(BAD), 'thing"') for t in clean],
        "ordinary": [put(t, "moroni") for t in clean],
    }
    find = tx.Matcher(lexicon.terms)
    flagged = {k: sum(tx.score(find.hits(t), lexicon) >= 0.7 for t in texts) / len(texts) for k, texts in made.items()}
    assert flagged["misspelt"] > 0.9 and flagged["plain"] > 0.95 and flagged["quoted"] < 0.05 and flagged["ordinary"] < 0.05, flagged
    lexicon.forms.clear()
    assert sum(tx.score(find.hits(t), lexicon) >= 0.7 for t in made["misspelt"]) / len(clean) > 0.9
