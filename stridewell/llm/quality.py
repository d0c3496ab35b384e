"""Quality rules: exact statistics of whole texts and a learned decision list, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import reduce
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD

#: Labelled documents that a decision list is learned from at most, the first by a hash of doc_id.
SAMPLE = 20_000
#: Bits of a window's place among the sorted window hashes; longer texts take the way without hashes.
PLACE = 20
FEATURES = ("n_words", "mean_word", "symbols", "pipes", "shouts", "capitals", "digits", "dup_lines", "repeats", "distinct")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count_covered(starts: Column) -> Column:
    """Words in the union of the 3-word windows that begin at the sorted places."""

    def add(state: Column, s: Column) -> Column:
        fresh = F.least(F.lit(3), s + 3 - state["end"])
        return F.struct((state["n"] + fresh).cast("int").alias("n"), (s + 3).cast("int").alias("end"))

    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")), add, lambda s: s["n"])


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the array of words holds twice or more.

    Where the upper bits of a 64-bit hash tell all windows apart there are none. Else windows are sorted by these bits
    and their place, and equal neighbours are compared word by word. If unequal windows share those bits, or a text is too long for the place's bits, the windows themselves are sorted.
    """
    low = F.lit((1 << PLACE) - 1).cast("long")

    def by_hash(w: Column) -> Column:
        upper = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(low)))

        def twice(s: Column) -> Column:
            """Each sorted code that shares its upper bits with a neighbour, with whether the windows are the same."""
            up = F.filter(s, lambda x, i: ((F.get(s, i + 1).bitwiseXOR(x) <= low) & (F.get(s, i + 1).bitwiseXOR(x) >= 0)) | ((F.get(s, i - 1).bitwiseXOR(x) <= low) & (F.get(s, i - 1).bitwiseXOR(x) >= 0)))
            return up

        def shared(h: Column) -> Column:
            coded = F.transform(h, lambda x, i: x.bitwiseOR(i.cast("long")))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.array().cast("array<bigint>")).otherwise(let(F.sort_array(coded), twice))

        return let(upper, shared)

    def same(w: Column, a: Column, b: Column) -> Column:
        return reduce(lambda x, y: x & y, [F.get(w, a + k) == F.get(w, b + k) for k in range(3)])

    def counted(w: Column) -> Column:
        def of(codes: Column) -> Column:
            clash = F.exists(F.sequence(F.lit(1), F.size(codes) - 1), lambda k: (F.get(codes, k).bitwiseXOR(F.get(codes, k - 1)).between(0, low)) & ~same(w, F.get(codes, k).bitwiseAND(low).cast("int"), F.get(codes, k - 1).bitwiseAND(low).cast("int")))
            starts = F.array_sort(F.transform(codes, lambda c: c.bitwiseAND(low).cast("int")))
            return F.when(F.size(codes) == 0, F.lit(0)).when(clash, by_window(w)).otherwise(_count_covered(starts))

        return let(by_hash(w), of)

    def by_window(w: Column) -> Column:
        triples = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.struct(x.alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("int").alias("i")))
        key = lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["c"].alias("c"))
        starts = lambda s: F.array_sort(F.transform(F.filter(s, lambda t, k: F.coalesce(key(t) == key(F.get(s, k + 1)), F.lit(False)) | F.coalesce(key(t) == key(F.get(s, k - 1)), F.lit(False))), lambda t: t["i"]))
        return let(F.sort_array(triples), lambda s: _count_covered(starts(s)))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).when(F.size(w) > (1 << PLACE), by_window(w)).otherwise(counted(w)))


def word_stats(docs: DataFrame, features: Collection[str] = FEATURES) -> DataFrame:
    """All columns of docs and `stats`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what else `features` ask for.

    A null or empty text counts 0 throughout. An earlier column named stats is replaced. One map over whole texts; no shuffle.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def of(w: Column) -> Column:
        joined = F.array_join(w, "")
        n = lambda p: F.regexp_count(joined, F.lit(p))
        more = {"pipes": ("n_pipes", n(r"\|")), "shouts": ("n_shouts", n(r"!")), "capitals": ("n_capitals", n(r"\p{Lu}")), "digits": ("n_digits", n(r"[0-9]")), "distinct": ("n_distinct", F.size(F.array_distinct(w)))}
        whole = {"n_words": F.size(w), "word_chars": F.length(joined), "n_symbols": n(r"[#*$%&|<>]"), "n_repeat_words": repeat_words(w)} | dict(more[f] for f in more if f in features)
        return F.struct(*[v.cast("long").alias(k) for k, v in whole.items()], let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"))

    return docs.drop("stats").withColumn("stats", let(words, of))


def _feature(stats: Column, name: str) -> Column:
    s, n = (lambda k: stats[k].cast("double")), F.greatest(stats["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(stats["word_chars"], F.lit(1)).cast("double")
    return {
        "n_words": lambda: s("n_words"),
        "mean_word": lambda: s("word_chars") / n,
        "symbols": lambda: s("n_symbols") / n,
        "pipes": lambda: s("n_pipes") / n,
        "shouts": lambda: s("n_shouts") / n,
        "capitals": lambda: s("n_capitals") / chars,
        "digits": lambda: s("n_digits") / chars,
        "dup_lines": lambda: stats["lines"]["dup"].cast("double") / F.greatest(stats["lines"]["n"], F.lit(1)),
        "repeats": lambda: s("n_repeat_words") / n,
        "distinct": lambda: s("n_distinct") / n,
    }[name]()


def learn_rules(x: np.ndarray, bad: np.ndarray, seed: int = 0, max_rules: int = 24, max_terms: int = 4, precision: float = 0.9, bins: int = 64, tries: int = 12, chance: float = 0.05) -> list[list[tuple[int, str, float]]]:
    """Sequential covering: rules (feature, <= or >, threshold), each a conjunction that says "bad", in the order to try them.

    A rule is grown term by term by information gain on two thirds of the rows that no rule has covered, bad and good
    ones dealt apart, then its last terms are pruned while that raises (p - n) / (p + n) on the other third. There it
    must be right with `precision`, by Laplace's estimate as far as so few rows allow, and its hits must be likelier than
    by chance: a rule that covers as many rows at random has as many bad ones with a probability of at most `chance`, divided by the number of tries.
    A rule that fails is grown again from other rows, without its first term, `tries` times in all; then learning
    stops. A threshold stands in the middle between the last value it leaves out and the first that it covers. What no
    rule covers is good. Fewer than two bad rows, or no rows: no rules.
    """
    rng = np.random.default_rng(seed)
    rules: list[list[tuple[int, str, float]]] = []
    if not len(x):
        return rules
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    # thresholds also stand between the values of bad and good rows that are rare
    cuts = [np.unique(np.r_[c, np.quantile(x[bad, j], np.linspace(0, 1, bins + 1)) if bad.any() else []]) for j, c in enumerate(cuts)]
    alive = np.ones(len(x), bool)
    while len(rules) < max_rules:
        failed: set[tuple[int, str]] = set()
        for t in range(tries):
            grow = np.zeros(len(x), bool)
            for kind in (bad, ~bad):
                rows = rng.permutation(np.flatnonzero(alive & kind))
                grow[rows[: len(rows) - len(rows) // 3 - (len(rows) == 2)]] = True
            prune = alive & ~grow
            if not (grow & bad).any() or not (prune & bad).any():
                return rules
            rule = _grown(x, bad, grow, cuts, max_terms, failed)
            if not rule:
                failed = set()
                continue
            rule = _pruned(x, bad, prune, rule)
            c = covers(x, rule) & prune
            p, n = int((c & bad).sum()), int((c & ~bad).sum())
            right = p and (p + 1) / (p + n + 2) >= min(precision, (p + 1) / (p + 2)) and _tail(p, p + n, (prune & bad).sum() / prune.sum()) <= chance / (t + 1)
            if right:
                rules.append(_centred(x, alive, rule))
                alive &= ~covers(x, rules[-1])
                break
            failed.add(rule[0][:2])
        else:
            break
    return rules


def _tail(hits: int, n: int, rate: float) -> float:
    """Probability of at least `hits` of n at this rate; of 200 rows or more, only whether they exceed it (0) or not (1)."""
    return sum(comb(n, k) * rate**k * (1 - rate) ** (n - k) for k in range(hits, n + 1)) if n < 200 else float(hits / n <= rate)


def _grown(x: np.ndarray, bad: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], max_terms: int, failed: set[tuple[int, str]]) -> list[tuple[int, str, float]]:
    """Terms of the largest information gain on these rows, one after the other; none of `failed` comes first."""
    rule: list[tuple[int, str, float]] = []
    inside = rows.copy()
    while len(rule) < max_terms and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best = (1e-9, None)
        for j in range(x.shape[1]):
            at = np.searchsorted(cuts[j], x[inside, j], side="left")  # x <= cuts[k] iff at <= k
            p = np.cumsum(np.bincount(at[bad[inside]], minlength=len(cuts[j]) + 1))[:-1]
            n = np.cumsum(np.bincount(at[~bad[inside]], minlength=len(cuts[j]) + 1))[:-1]
            for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                if not rule and (j, op) in failed:
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2((pp + 1e-9) / (pp + nn + 1e-9)) - np.log2(p0 / (p0 + n0))), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, op, float(cuts[j][k])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= covers(x, rule[-1:])
    return rule


def _pruned(x: np.ndarray, bad: np.ndarray, rows: np.ndarray, rule: list[tuple[int, str, float]]) -> list[tuple[int, str, float]]:
    def worth(terms: list[tuple[int, str, float]]) -> float:
        c = covers(x, terms) & rows
        p, n = (c & bad).sum(), (c & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def _centred(x: np.ndarray, rows: np.ndarray, rule: list[tuple[int, str, float]]) -> list[tuple[int, str, float]]:
    out = []
    for k, (j, op, cut) in enumerate(rule):
        inside = rows & covers(x, rule[:k] + rule[k + 1 :])
        v = x[inside, j]
        below, above = v[v <= cut], v[v > cut]
        out.append((j, op, float((below.max() + above.min()) / 2) if len(below) and len(above) else cut))
    return out


def covers(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, op, cut in rule:
        out &= (x[:, j] <= cut) if op == "<=" else (x[:, j] > cut)
    return out


def rules_column(rules: list[list[tuple[int, str, float]]], stats: Column) -> Column:
    """The number of the first rule that covers a document, from 1; 0 if none does: an ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules):
        test = reduce(lambda a, b: a & b, [(f <= cut) if op == "<=" else (f > cut) for j, op, cut in rule for f in [_feature(stats, FEATURES[j])]])
        out = F.when(test, i + 1) if out is None else out.when(test, i + 1)
    return F.lit(0) if out is None else out.otherwise(0)


def _base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 0) -> list[list[tuple[int, str, float]]]:
    """Rules learned from the statistics of `sample` labelled documents at most that pass the base test, as what fails it needs no rule.

    Of more labels or documents, those with the smallest hashes count. Labels with null doc_id or quality take no part;
    repeated labels and documents count as often as they occur.
    """
    picked = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "quality").limit(sample)
    stats = word_stats(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    named = stats.select("quality", _base_failed(F.col("stats")).alias("failed"), F.array(*[_feature(F.col("stats"), f) for f in FEATURES]).alias("x"))
    # a filter on the statistics would have them worked out twice
    rows = [r for r in named.orderBy(F.xxhash64("x", "quality"), "x", "quality").limit(sample).collect() if not r["failed"]]
    if not rows:
        return []
    return learn_rules(np.array([r["x"] for r in rows]), np.array([r["quality"] == 0 for r in rows]), seed)


def judge(docs: DataFrame, rules: list[list[tuple[int, str, float]]]) -> DataFrame:
    """doc_id, the base counts, base_failed, rule (0: none) and kept of each document; of further counts, those that the rules ask for.

    A null text counts as empty and fails the base test; repeated rows and null doc_ids are documents of their own;
    other columns, of whatever names, are ignored; an empty table gives an empty result.
    """
    s = F.col("stats")
    base = _base_failed(s)
    out = word_stats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), {FEATURES[j] for rule in rules for j, *_ in rule}).select("doc_id", "stats")
    return out.select(
        "doc_id", *[s[k].alias(k) for k in ("n_words", "word_chars", "n_symbols")], s["lines"]["dup"].alias("n_dup_lines"), s["n_repeat_words"].alias("n_repeat_words"),
        base.alias("base_failed"), rules_column(rules, s).alias("rule"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
