"""Toxicity of documents: a learned lexicon, searched by Levenshtein automata, with scores for a hit's context."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, tune

#: Labelled documents that are learned from at most, the first by a hash of doc_id.
SAMPLE = 16_000
#: Terms that a lexicon holds at most, those with the most contexts.
TERMS = 2_000
#: Words of a text around a hit that show whether it is quoted.
WINDOW = 12
THRESHOLD = 0.7
#: Marks that stand around a word but aren't of it.
MARKS = ".,;:!?\"'()[]{}<>«»“”„‘’‚…%*#&$|_-–—¡¿"
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$", "oieastas")
#: Quotation marks, and words that report speech, in English, German, French and Spanish.
QUOTES = "\"“”„«»"
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes reported stated sagte sagt schrieb nannte zitat dit disait écrit appelé citation dijo dice escribió llamó cita".split())


@dataclass
class Lexicon:
    """Terms (text, whether words that begin with it count), the share of toxic texts among those with (term, edits),
    among those whose only exact hit is one of the term, and among those with a form that isn't quite the term."""

    terms: list[tuple[str, bool]]
    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    alone: dict[int, float] = field(default_factory=dict)
    forms: dict[tuple[str, int], float] = field(default_factory=dict)


def allowed_edits(term: str, prefix: bool) -> int:
    return 0 if prefix or len(term) < 5 else 1 if len(term) < 8 else 2


class Automaton:
    """Levenshtein automata of all terms, run at once over the trie of the lexicon; states are made as words need them.

    A state is the set of (trie node, edits so far), of which the fewest edits of a node count.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.next: list[dict[str, int]] = [{}]
        self.most = [0]
        self.ends: list[list[int]] = [[]]
        self.terms = terms
        for t, (term, prefix) in enumerate(terms):
            node, edits = 0, allowed_edits(term, prefix)
            self.most[0] = max(self.most[0], edits)
            for ch in term:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.most.append(0)
                    self.ends.append([])
                node = self.next[node][ch]
                self.most[node] = max(self.most[node], edits)
            self.ends[node].append(t)
        self.alphabet = {ch for n in self.next for ch in n}
        self.states: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ended: list[list[tuple[int, int]]] = []
        self.begun: list[list[int]] = []
        self.dead = self._state({})
        self.start = self._state(self._skip({0: 0}))

    def _skip(self, active: dict[int, int]) -> dict[int, int]:
        """Letters of a term that a word leaves out."""
        todo = list(active.items())
        while todo:
            node, e = todo.pop()
            for child in self.next[node].values():
                if e + 1 <= self.most[child] and active.get(child, 99) > e + 1:
                    active[child] = e + 1
                    todo.append((child, e + 1))
        return active

    def _state(self, active: dict[int, int]) -> int:
        key = frozenset(active.items())
        if key not in self.states:
            self.states[key] = len(self.items)
            self.items.append(key)
            self.moves.append({})
            self.ended.append([(t, e) for node, e in key for t in self.ends[node] if e <= allowed_edits(*self.terms[t])])
            self.begun.append([t for node, e in key for t in self.ends[node] if e == 0 and self.terms[t][1]])
        return self.states[key]

    def _move(self, state: int, ch: str) -> int:
        active: dict[int, int] = {}
        for node, e in self.items[state]:
            for c, child in self.next[node].items():
                cost = e + (c != ch)
                if cost <= self.most[child] and active.get(child, 99) > cost:
                    active[child] = cost
            if e + 1 <= self.most[node] and active.get(node, 99) > e + 1:
                active[node] = e + 1
        to = self.moves[state][ch] = self._state(self._skip(active))
        return to

    def find(self, word: str) -> list[tuple[int, int]]:
        """(term, edits) that a word matches."""
        state, found = self.start, {}
        for ch in word:
            ch = ch if ch in self.alphabet else "\0"
            to = self.moves[state].get(ch)
            state = self._move(state, ch) if to is None else to
            if state == self.dead:
                break
            for t in self.begun[state]:
                found[t] = 0
        for t, e in self.ended[state]:
            found[t] = min(e, found.get(t, e))
        return sorted(found.items())


class Matcher:
    """Hits of a text: (place, term, edits, quoted, the word as it was matched)."""

    def __init__(self, terms: list[tuple[str, bool]], window: int = WINDOW, memory: int = 400_000):
        self.automaton, self.window, self.memory = Automaton(terms), window, memory
        self.known: dict[str, list[tuple[int, int]]] = {}

    def word(self, raw: str) -> list[tuple[int, int]]:
        plain = raw.strip(MARKS)
        hits = self.automaton.find(plain)
        if not hits and plain and not plain.isalpha() and (other := raw.strip(MARKS.replace("$", "")).translate(DISGUISE)) != plain:
            hits = [(t, max(e, 1)) for t, e in self.automaton.find(other)]
        return hits

    def hits(self, text: str | None) -> list[tuple[int, int, int, bool, str]]:
        if not text:
            return []
        words = text.lower().split()
        known = self.known
        fresh = set(words).difference(known)
        if len(known) + len(fresh) > self.memory:
            known.clear()
            fresh = set(words)
        for w in fresh:
            known[w] = self.word(w)
        marked = {w for w in set(words) if known[w]}
        if not marked:
            return []
        return [(i, t, e, self.quoted(words, i), w.strip(MARKS)) for i, w in enumerate(words) if w in marked for t, e in known[w]]

    def quoted(self, words: list[str], i: int) -> bool:
        """Within quotation marks, and speech is reported within the window."""
        before, after = words[max(0, i - self.window) : i], words[i + 1 : i + 1 + self.window]
        opened = any(w[0] in QUOTES for w in [*before, words[i]]) and not any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in before if w[0] not in QUOTES)
        closed = any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in [words[i], *after])
        return opened and closed and any(w.strip(MARKS) in REPORTING for w in [*before, *after])


def score(hits: list[tuple[int, int, int, bool, str]], lexicon: Lexicon, quoted_share: float = 0.3, base: float = 0.02) -> float:
    """1 less the product of what every distinct term leaves open; a term that is only quoted counts for quoted_share of its weight.

    A misspelt term weighs what its very form does, where labelled texts hold that; so an ordinary word that is an edit away from a term doesn't count.
    """
    best: dict[int, float] = {}
    single = sum(h[2] == 0 for h in hits) == 1
    for _, t, e, quoted, form in hits:
        weight = lexicon.alone.get(t, 0.0) if single and e == 0 else lexicon.weights.get((t, e), 0.0)
        if e:
            weight = lexicon.forms.get((form, t), weight)
        best[t] = max(best.get(t, 0.0), weight * (quoted_share if quoted else 1.0))
    left = 1.0 - base
    for w in best.values():
        left *= 1.0 - w
    return 1.0 - left


def held_out(doc_id):
    """Rows that nothing is learned from: crc32 of doc_id as text, mod 3, is 1. A null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, least: int = 8, precision: float = 0.9) -> Lexicon:
    """A lexicon from the texts of `sample` labelled rows at most, none of them held out.

    A word or a beginning of words of 4 to 8 letters becomes a term if it occurs in `least` different contexts (the next
    word) of toxic texts, and `precision` of all its contexts are in toxic texts; copies of a text bring no new contexts.
    Of beginnings that qualify, only the shortest stay, and words only if none of these begins them. Each (term, edits)
    weighs as the smoothed share of toxic texts among the sample's texts that have it, for edits only among texts without
    any exact hit; edits that no text has, a little less than the term itself. Each form with edits that those texts hold weighs by its own share,
    smoothed by that of its (term, edits) as if by two texts. Rows with null doc_id or label, and null texts, take no part. No rows: an empty lexicon.
    """
    tune(docs.sparkSession)
    picked = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("toxic", "text")
    words = F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.btrim(w, F.lit(MARKS)))
    pairs = texts.select("toxic", F.explode(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("w"), b.alias("n")))).alias("x"))
    contexts = pairs.select("toxic", "x.w", F.xxhash64("x.n").alias("n")).where(F.length("w") >= 3).distinct()
    t = F.sum(F.col("toxic").cast("long"))
    counts = contexts.groupBy("w").agg(t.alias("t"), F.count("*").alias("n"))
    # a beginning needs toxic contexts of its own, so words without any only matter as beginnings of others
    prefixes = counts.select(F.explode(F.transform(F.sequence(F.lit(4), F.least(F.lit(8), F.greatest(F.lit(4), F.length("w")))), lambda k: F.struct(F.left(F.col("w"), k).alias("p"), k.alias("k")))).alias("x"), "t", "n", "w").where(F.length("w") >= F.col("x.k"))
    fine = lambda df: df.where((F.col("t") >= least) & (F.col("t") >= precision * F.col("n")))
    begin = fine(prefixes.groupBy(F.col("x.p").alias("w")).agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.count("*").alias("kinds"))).where("kinds >= 4").withColumn("prefix", F.lit(True)).drop("kinds")
    whole = fine(counts).withColumn("prefix", F.lit(False))
    rows = begin.unionByName(whole).orderBy(F.desc("t"), "w", "prefix").limit(terms).collect()
    shortest: set[str] = set()
    for p in sorted((r["w"] for r in rows if r["prefix"]), key=len):
        if not any(p[:k] in shortest for k in range(1, len(p))):
            shortest.add(p)
    own = sorted({r["w"] for r in rows if not r["prefix"] and not any(r["w"][:k] in shortest for k in range(1, len(r["w"]) + 1))})
    lexicon = Lexicon([(w, False) for w in own] + [(w, True) for w in sorted(shortest)])
    if not lexicon.terms:
        return lexicon
    listed = lexicon.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Matcher(listed)
        for b in batches:
            out = []
            for x, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hits = find.hits(text)
                exact = [h[1] for h in hits if h[2] == 0]
                out += [(x, t, e, int(len(exact) == 1), form) for t, e, form in ({(t, 0, "") for t in exact} or {(h[1], h[2], h[4]) for h in hits})]
            yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in out], pa.int64()) for k in range(4)], pa.array([r[4] for r in out], pa.string())], ["toxic", "term", "edits", "alone", "form"])

    n, toxic, alone = F.count("*").alias("n"), F.sum("toxic").alias("t"), F.col("alone")
    seen = texts.select(F.col("toxic").cast("long"), "text").mapInArrow(run, "toxic long, term long, edits long, alone long, form string").groupBy("term", "edits", "form").agg(n, toxic, F.sum(alone).alias("n1"), F.sum(alone * F.col("toxic")).alias("t1")).collect()
    sums: dict[tuple[int, int], tuple[int, int]] = {}
    for r in seen:
        t, n = sums.get((r["term"], r["edits"]), (0, 0))
        sums[r["term"], r["edits"]] = t + r["t"], n + r["n"]
    for key, (t, n) in sums.items():
        lexicon.weights[key] = (t + 0.1) / (n + 0.2)
    for r in seen:
        share = lexicon.weights[r["term"], r["edits"]]
        if r["edits"] == 0:
            lexicon.alone[r["term"]] = (r["t1"] + share) / (r["n1"] + 1)
        else:
            lexicon.forms[r["form"], r["term"]] = (r["t"] + 2 * share) / (r["n"] + 2)
    for i, (term, prefix) in enumerate(listed):
        for e in range(1, allowed_edits(term, prefix) + 1):
            lexicon.weights.setdefault((i, e), lexicon.weights.get((i, 0), 0.9) * 0.8)
    return lexicon


def judge(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """All columns of docs and score, predicted (1 from threshold on) and n_hits, in one map; earlier columns of these names are replaced.

    A null or empty text scores the base share. The score depends on the text alone; repeated rows score alike. An
    empty table gives an empty result.
    """
    tune(docs.sparkSession)
    docs = docs.drop("score", "predicted", "n_hits")
    at = docs.columns.index("text")
    names, plain = docs.columns, by_place(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Matcher(lexicon.terms, window)
        for b in batches:
            hits = [find.hits(t) for t in b.column(at).to_pylist()]
            scores = [score(h, lexicon) for h in hits]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([len(h) for h in hits], pa.int64())], [*b.schema.names, "score", "predicted", "n_hits"])

    fields = [*plain.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_hits", T.LongType())]
    return plain.mapInArrow(run, T.StructType(fields)).toDF(*names, "score", "predicted", "n_hits")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and n_hits of each document; see `fit` and `judge` for nulls, repeats, other columns and empty tables."""
    out = judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_hits")


def accepted(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns of whatever names. Null and empty texts stay; repeated rows fare alike."""
    titles, places = docs.columns, by_place(docs)
    rows = places.select(F.struct(*places.columns).alias("row"), F.col(f"c{titles.index('text')}").cast("string").alias("text"))
    return judge(rows, lexicon, threshold).where("predicted = 0").select("row.*").toDF(*titles)
