"""Personal data in texts: fixed patterns, and a skip-chain conditional random field that adds what they miss."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, tune

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Documents that the field is trained on at most: those with a digit or an @ and the smallest hashes of their text.
SAMPLE = 8_000
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What stands for an @ in a disguised address, and what marks a token: a digit or an @ of any width, or one of these.
AT = re.compile(r"\s?(?:[@\uff20]|[\[({<]at[\])}>])\s?", re.I)
MARKED = re.compile(r"[\d@\uff20]|[\[({<]at[\])}>]", re.I)
TOKEN = re.compile(r"\S+\s(?:[@\uff20]|[\[({<]at[\])}>])\s\S+|\S+", re.I)
#: Kinds of links between distant tokens of a document.
SIMILAR = ("same content", "one digit apart", "same domain", "same cue and shape")
EDGE = ",.;:!?\"'()<>[]{}"
#: Words that announce personal data.
CUES = {
    "email": frozenset("mail email e-mail contact correo courriel".split()),
    "ip": frozenset("ip host server address adresse".split()),
    "card": frozenset("card visa mastercard amex credit karte carte tarjeta".split()),
    "phone": frozenset("phone tel tel. telephone call fax mobile telefon téléphone teléfono".split()),
}
Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """What the patterns find, leftmost and without overlap for each kind, in the order of kind and start; linear in the text."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1, start):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not re.search("[0-9]", text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub("[ -]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


@dataclass
class Tokens:
    """Marked tokens of a text: those with a digit, an @ or what stands for one. All others are of no kind and cut the chain."""

    spans: list[tuple[int, int]]
    features: np.ndarray  # of each token, bits
    label: np.ndarray  # of the patterns' kinds, else 0
    chain: np.ndarray  # pairs of neighbours
    skips: list[np.ndarray]  # for each of SIMILAR, pairs of tokens, each with one token that it is like

    @property
    def skip(self) -> np.ndarray:
        """Pairs of the same content."""
        return self.skips[0]


def plain(word: str) -> str:
    """A token in plain characters: digits and signs of normal width, an @ for what stands for one, no brackets around dots."""
    word = word if word.isascii() else unicodedata.normalize("NFKC", word)
    return AT.sub("@", word).replace("[.]", ".")


FEATURES = ("always", "at sign", "1-3 digits", "4-6 digits", "7-8 digits", "9-12 digits", "13-19 digits", "20 digits or more", "letters", "three dots", "plus", "bracket", "hyphen", "equals or quote", "check digit", "number before", "number after", "disguised", "address", "small parts", "long part", *(f"cue {k}" for k in KINDS))


def same_content(words: list[str], joined: set[tuple[int, int]], number: list[bool], label: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of tokens with the same content: equal addresses, and numbers, also in groups, whose last 7 digits or more are equal.

    Neighbouring number tokens of one label make a run of digits, and each of its tokens may be where a number ends.
    Numbers are matched backwards from there, digit by digit, up to 19, so that a country code or another grouping
    doesn't part them. All go with one that the patterns have found, else with the first: evidence takes two steps at most.
    """
    parts: list[tuple[list[str], list[int], list[int]]] = []  # digits, tokens, end of each token's digits
    for i, w in enumerate(words):
        if number[i] and (d := "".join(c for c in w if c in "0123456789")):
            if not (parts and parts[-1][1][-1] == i - 1 and (i - 1, i) in joined and label[i - 1] == label[i]):
                parts.append(([], [], []))
            text, tokens, ends = parts[-1]
            text.append(d)
            tokens.append(i)
            ends.append((ends[-1] if ends else 0) + len(d))
    runs = [("".join(text), tokens, ends) for text, tokens, ends in parts]
    hub: dict[str, tuple[int, int]] = {}
    pairs: set[tuple[int, int]] = set()
    for known, whole in ((True, True), (True, False), (False, True), (False, False)):
        for r, (text, tokens, ends) in enumerate(runs):
            if (label[tokens[0]] > 0) == known:
                for k in range(len(ends) - 1, -1, -1) if not whole else (len(ends) - 1,):
                    if (e := ends[k]) >= 7:
                        hub.setdefault(text[e - 7 : e], (r, k))
    for r, (text, tokens, ends) in enumerate(runs):
        for k, e in enumerate(ends):
            if e < 7 or (at := hub[text[e - 7 : e]])[0] == r:
                continue
            other, others, stops = runs[at[0]]
            stop, j, n = stops[at[1]], at[1], 7
            while n < min(19, e, stop) and text[e - n - 1] == other[stop - n - 1]:
                n += 1
            i = k
            while i >= 0 and j >= 0 and max(e - ends[i], stop - stops[j]) < n:
                pairs.add((min(tokens[i], others[j]), max(tokens[i], others[j])))
                left, right = e - (ends[i - 1] if i else 0), stop - (stops[j - 1] if j else 0)
                i, j = i - (left <= right), j - (right <= left)
    address: dict[str, int] = {}
    mails = [(w.strip(EDGE).lower(), i) for i, w in enumerate(words) if "@" in w]
    for known in (True, False):
        for same, i in mails:
            if (label[i] > 0) == known:
                address.setdefault(same, i)
    pairs |= {(min(i, address[same]), max(i, address[same])) for same, i in mails if same and address[same] != i}
    return sorted(pairs)


def similar(words: list[str], joined: set[tuple[int, int]], number: list[bool], label: np.ndarray, cue: list[int]) -> list[list[tuple[int, int]]]:
    """Pairs of tokens that are one digit apart (numbers of 9 digits or more, also in groups), addresses at one domain, and tokens
    of one shape after cues of one kind. Each goes with one that the patterns have found, else with the first."""
    keyed: list[list[tuple[object, int]]] = [[], [], []]
    i = 0
    while i < len(words):
        j = i + 1
        while number[i] and j < len(words) and number[j] and (j - 1, j) in joined and label[j - 1] == label[j]:
            j += 1
        if number[i]:
            digits = "".join(c for w in words[i:j] for c in w if c.isdigit())
            if 9 <= len(digits) <= 19:
                keyed[0] += [((k, digits[:k], digits[k + 1 :]), j - 1) for k in range(len(digits))]
        i = j
    for i, w in enumerate(words):
        if "@" in w and "." in (domain := w.strip(EDGE).lower().rpartition("@")[2]):
            keyed[1].append((domain, i))
        if cue[i] >= 0:
            keyed[2].append(((cue[i], re.sub(r"[^\W\d]+", "a", re.sub(r"\d", "9", w.strip(EDGE)))), i))
    out = []
    for rows in keyed:
        hub: dict[object, int] = {}
        for known in (True, False):
            for key, i in rows:
                if (label[i] > 0) == known:
                    hub.setdefault(key, i)
        out.append(sorted({(min(i, hub[key]), max(i, hub[key])) for key, i in rows if hub[key] != i}))
    return out


def tokens_of(text: str, base: list[Span]) -> Tokens:
    words: list[str] = []
    raw: list[str] = []
    spans: list[tuple[int, int]] = []
    places: list[int] = []
    cues: list[list[str]] = []
    recent: list[str] = []
    for i, m in enumerate(TOKEN.finditer(text)):
        w = m[0]
        if MARKED.search(w):
            spans.append(m.span())
            raw.append(w)
            words.append(plain(w))
            places.append(i)
            cues.append([x.strip(",.:;!?\"'").lower() for x in recent[-3:]])
        recent = [*recent[-2:], w]
    n = len(words)
    f = np.zeros((n, len(FEATURES)), bool)
    number = [not any(c.isalpha() for c in w) and "@" not in w for w in words]
    chain = []
    for i, w in enumerate(words):
        digits = "".join(c for c in w if c in "0123456789")
        k = len(digits)
        f[i, 0] = True
        f[i, 1] = "@" in w
        f[i, 2 + int(np.searchsorted([4, 7, 9, 13, 20], k, side="right"))] = k > 0
        f[i, 8] = any(c.isalpha() for c in w)
        f[i, 9] = w.strip(",.;:!?").count(".") == 3
        f[i, 10], f[i, 11], f[i, 12] = "+" in w, "(" in w, "-" in w
        f[i, 13] = any(c in w for c in "=\"'")
        f[i, 14] = 13 <= k <= 19 and luhn(digits)
        if i and places[i] == places[i - 1] + 1:
            chain.append((i - 1, i))
            f[i, 15], f[i - 1, 16] = number[i - 1], number[i]
        f[i, 17] = w != raw[i]
        bare = w.strip(EDGE)
        parts = re.split("[.,]", bare) if not f[i, 1] else []
        f[i, 18] = bool(ADDRESS.fullmatch(bare))
        f[i, 19] = len(parts) == 4 and all(p.isdigit() and _small(p) for p in parts)
        f[i, 20] = len(parts) == 4 and all(p.isdigit() for p in parts) and not f[i, 19]
        for j, kind in enumerate(KINDS):
            f[i, 21 + j] = any(c in CUES[kind] for c in cues[i])
    label = _labelled(spans, base)
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    joined = set(chain)
    cue = [int(np.argmax(row)) if row.any() else -1 for row in f[:, 21:]]
    return Tokens(spans, f, label, pairs(chain), [pairs(x) for x in (same_content(words, joined, number, label), *similar(words, joined, number, label, cue))])


def _labelled(spans: list[tuple[int, int]], found: list[Span]) -> np.ndarray:
    """For each token 1 + the first kind of those that cover it, else 0."""
    label = np.zeros(len(spans), np.int64)
    starts = np.array([s for s, _ in spans], np.int64)
    for kind, s, e in reversed(sorted(found)):
        a = max(0, int(np.searchsorted(starts, s, side="right")) - 1) if len(spans) else 0
        while a < len(spans) and spans[a][0] < e:
            if spans[a][1] > s:
                label[a] = kind + 1
            a += 1
    return label


@dataclass
class Field:
    node: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray  # for each of SIMILAR, of two that are both of no kind, and of two of one kind

    def without_skips(self) -> Field:
        return Field(self.node, self.chain, np.zeros_like(self.skip))


def marginals(f: Field, t: Tokens, rounds: int = 1000, damping: float = 0.5, settled: float = 1e-7) -> np.ndarray:
    """Label probabilities of each token by loopy sum-product message passing; the patterns' tokens are held at their labels.

    Messages pass until none changes by more than `settled`, or for `rounds` where loops keep them from settling.
    """
    unary = t.features @ f.node
    held = t.label > 0
    unary[held] = -30.0
    unary[held, t.label[held]] = 0.0
    pairs = np.concatenate([t.chain, *t.skips])
    if len(pairs):
        k = len(LABELS)
        pot = np.concatenate([np.broadcast_to(f.chain, (len(t.chain), k, k)), *(np.broadcast_to(np.diag([w[0], *[w[1]] * (k - 1)]), (len(x), k, k)) for w, x in zip(f.skip, t.skips, strict=True))])
        src, dst = np.r_[pairs[:, 0], pairs[:, 1]], np.r_[pairs[:, 1], pairs[:, 0]]
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.r_[len(pairs) : 2 * len(pairs), : len(pairs)]
        message = np.zeros((len(src), k))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, dst, message)
            out = (belief[src] - message[back])[:, :, None] + pot
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            change = (1 - damping) * (new - message)
            message += change
            if np.abs(change).max() <= settled:
                break
        np.add.at(unary, dst, message)
    p = np.exp(unary - unary.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[Span], field: Field, certain: float = 0.9) -> list[Span]:
    """Spans of tokens that the field gives a kind with probability `certain` and no pattern covers; neighbours of one kind make one span.

    A span is left out where it couldn't be of its kind: an address without @ and dot, an ip without four small parts,
    a card without 13 to 19 digits and their check digit, a phone without 9 to 15 digits.
    """
    t = tokens_of(text, base)
    if not len(t.label):
        return []
    p = marginals(field, t)
    best = np.where((p.max(1) >= certain) & (t.label == 0), p.argmax(1), 0)
    joined = {(a, b) for a, b in t.chain.tolist()}
    out: list[Span] = []
    i = 0
    while i < len(best):
        j = i
        while best[i] and (j, j + 1) in joined and best[j + 1] == best[i]:
            j += 1
        if best[i]:
            s, e = t.spans[i][0], t.spans[j][1]
            while s < e and text[s] in ",.;:!?\"'<[{":
                s += 1
            while e > s and text[e - 1] in ",.;:!?\"'>]}*#$%&|":
                e -= 1
            part, kind = plain(text[s:e]), int(best[i]) - 1
            digits = re.sub("[^0-9]", "", part)
            fine = (kind == 0 and ADDRESS.fullmatch(part)) or (kind == 1 and len(x := re.split("[.,]", part)) == 4 and all(y.isdigit() and _small(y) for y in x)) or (kind == 2 and 13 <= len(digits) <= 19 and luhn(digits)) or (kind == 3 and 9 <= len(digits) <= 15)
            if fine and not any(s < b and a < e for _, a, b in base):
                out.append((kind, s, e))
        i = j + 1
    return out


def disguised(kind: int, value: str, rng: np.random.Generator) -> tuple[str, int]:
    """A form of a value that the patterns miss, and how long the part is that is personal."""
    digits = re.sub("[^0-9]", "", value)
    wide = lambda x: "".join(chr(ord(c) + 0xFEE0) if c in "0123456789+@" else c for c in x)
    if kind == 0:
        out = value.replace("@", str(rng.choice(["[at]", "(at)", " [at] ", " (at) ", " @ ", "\uff20"])))
    elif kind == 1:
        out = wide(value) if rng.random() < 0.4 else value.replace(".", str(rng.choice([",", "[.]"])))
    elif kind == 2:
        out = wide(value) if rng.random() < 0.4 else str(rng.choice([".", "/"])).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    else:
        forms = [value.lstrip("+"), f"00{digits}", digits, value.lstrip("+0123456789 ") or digits, f"0{digits[-9:]}", wide(value), *(sign.join((digits[-10:-7], digits[-7:-4], digits[-4:])) for sign in " .-")]
        out = forms[int(rng.integers(len(forms)))]
        if rng.random() < 0.2:  # runs into a number, so that the patterns find it too long
            return f"{value} {'.'.join(map(str, rng.integers(100, 256, 4)))}", len(value)
    return out, len(out)


def _harmless(rng: np.random.Generator) -> str:
    """A token with digits or an @ that is no personal data."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    forms = [n(int(rng.integers(1, 18))), n(int(rng.integers(8, 14))), f"20{n(2)}-0{rng.integers(1, 10)}-1{n(1)} 1{n(1)}:3{n(1)}:2{n(1)}", f"{n(1)}.{n(1)}.{n(2)}", f"{n(1)}.{n(1)}.{n(3)}.{n(4)}.{n(1)}", f"@user{n(2)}", f"{n(3)},{n(3)}.{n(2)}", f"no. {n(6)}-{n(4)}", f"{n(4)}/{n(4)}", f"{n(3)}.{n(3)}.{n(3)}.{n(3)}", f"id={n(6)}af{n(5)}c{n(2)}", f"5 @ {n(2)}.{n(2)}"]
    return forms[int(rng.integers(len(forms)))]


def augmented(text: str, rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with disguised mentions of its personal data, beside the plain ones or in their place, and with harmless numbers; and all spans of personal data in it."""
    base = sorted(base_spans(text), key=lambda x: x[1:])
    edits: list[tuple[int, int, str, int, int, int]] = []  # start, end, new text, kind, start and end in it
    gaps = [0, *(m.end() for m in re.finditer(r"\s+", text)), len(text)]

    def put(value: str, kind: int, size: int) -> None:
        at = gaps[int(rng.integers(len(gaps)))]
        cue = f"{sorted(CUES[KINDS[kind]])[int(rng.integers(len(CUES[KINDS[kind]])))]} " if kind >= 0 and rng.random() < 0.4 else ""
        edits.append((at, at, f" {cue}{value} ", kind, 1 + len(cue), 1 + len(cue) + size))

    chosen = set(rng.permutation(len(base))[:4].tolist())
    end = 0
    for i, (kind, s, e) in enumerate(base):
        replaced = i in chosen and s >= end and rng.random() < 0.3
        if replaced:
            value, size = disguised(kind, text[s:e], rng)
            edits.append((s, e, value, kind, 0, size))
            end = e
        if i in chosen and (not replaced or rng.random() < 0.3):
            put(*(lambda v: (v[0], kind, v[1]))(disguised(kind, text[s:e], rng)))
    for _ in range(int(rng.integers(1, 4))):
        value = _harmless(rng)
        for _ in range(1 + (rng.random() < 0.4)):
            put(value, -1, 0)
    out, gold, at, size = [], [], 0, 0
    kept = [(s, s, None, kind, 0, e - s) for i, (kind, s, e) in enumerate(base)]
    gone = [(s, e) for s, e, *_ in edits if e > s]
    for s, e, new, kind, a, b in sorted([*edits, *kept], key=lambda x: (x[0], x[2] is None or x[1] > x[0], x[1])):
        if new is None:
            if not any(x <= s and s + b <= y for x, y in gone):
                gold.append((kind, size + s - at, size + s - at + b))
            continue
        if s < at:
            continue
        if any(k >= 0 and x < size + s - at < y for k, x, y in gold):  # within another's span
            continue
        out += [text[at:s], new]
        size += s - at
        if kind >= 0:
            gold.append((kind, size + a, size + b))
        size += len(new)
        at = e
    out.append(text[at:])
    return "".join(out), gold


def fit(docs: DataFrame, sample: int = SAMPLE, versions: int = 4) -> Field:
    """Trains the field on `sample` documents at most, with a digit or an @ in them; nodes, chain and skip links together.

    Each document is `augmented`, in several versions: some of what the patterns find is repeated or replaced in a form that they miss, and
    harmless numbers are put in, also twice. The tokens that the patterns still find are evidence, as they are when
    the field is used; the field learns to tell the others' labels, by pseudo-likelihood: each token's label given its
    features and the true labels of its neighbours and of the tokens that it is like. Only counts of distinct cases come
    to the driver, no more than the versions of the sample have tokens. No such documents: a field that adds nothing.
    """
    tune(docs.sparkSession)
    picked = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    hashes = picked.select("h").distinct().orderBy("h").limit(sample)
    texts = picked.join(F.broadcast(hashes), "h").groupBy("h").agg(F.min("text").alias("text")).select("text", "h")
    k, kinds = len(LABELS), len(SIMILAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, int]] = []
            for text, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rng = np.random.default_rng(h % 2**63)
                for _ in range(versions):
                    new, gold = augmented(text, rng)
                    base = base_spans(new)
                    t = tokens_of(new, base)
                    truth = np.where(t.label > 0, t.label, _labelled(t.spans, gold))
                    left, right = np.full(len(truth), k), np.full(len(truth), k)
                    if len(t.chain):
                        left[t.chain[:, 1]], right[t.chain[:, 0]] = truth[t.chain[:, 0]], truth[t.chain[:, 1]]
                    like = np.zeros((len(truth), kinds, k), np.int64)
                    for x, pairs in enumerate(t.skips):
                        np.add.at(like, (pairs[:, 0], x, truth[pairs[:, 1]]), 1)
                        np.add.at(like, (pairs[:, 1], x, truth[pairs[:, 0]]), 1)
                    for i in np.flatnonzero(t.label == 0):
                        out.append((" ".join(map(str, [*t.features[i].astype(int), left[i], right[i], *like[i].ravel()])), int(truth[i])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64())], ["seen", "label"])

    rows = texts.mapInArrow(run, "seen string, label long").groupBy("seen", "label").count().orderBy("seen", "label").collect()
    if not rows:
        return Field(np.r_[9.0, np.zeros(k - 1)] * np.eye(len(FEATURES))[:, :1], np.zeros((k, k)), np.zeros((kinds, 2)))
    seen = np.array([[int(x) for x in r["seen"].split()] for r in rows])
    return _trained(seen, np.array([r["label"] for r in rows]), np.array([r["count"] for r in rows], float))


def _trained(seen: np.ndarray, label: np.ndarray, n: np.ndarray, steps: int = 1200, rate: float = 0.05, decay: float = 2e-5) -> Field:
    """The field of the largest penalised pseudo-likelihood of cases (features, labels of neighbours, label counts of similar tokens), by Adam."""
    k, kinds, width = len(LABELS), len(SIMILAR), len(FEATURES)
    x = seen[:, :width].astype(float)
    left, right = (np.eye(k + 1)[seen[:, width + j]][:, :k] for j in (0, 1))
    like = seen[:, width + 2 :].reshape(-1, kinds, k).astype(float)
    y = np.eye(k)[label]
    sizes = [width * k, k * k, kinds * 2]
    cut = np.cumsum(sizes)[:2]
    w = np.zeros(sum(sizes))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        node, chain, skip = (v.reshape(s) for v, s in zip(np.split(w, cut), ((width, k), (k, k), (kinds, 2)), strict=True))
        z = x @ node + left @ chain + right @ chain.T
        z[:, :1] += like[:, :, 0] @ skip[:, :1]
        z[:, 1:] += np.einsum("rtc,t->rc", like[:, :, 1:], skip[:, 1])
        q = np.exp(z - z.max(1, keepdims=True))
        q = (q / q.sum(1, keepdims=True) - y) * n[:, None] / n.sum()
        pull = np.stack([np.einsum("rt,r->t", like[:, :, 0], q[:, 0]), np.einsum("rtc,rc->t", like[:, :, 1:], q[:, 1:])], 1)
        g = np.concatenate([(x.T @ q).ravel(), (left.T @ q + q.T @ right).ravel(), pull.ravel()]) + decay * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    node, chain, skip = (v.reshape(s) for v, s in zip(np.split(w, cut), ((width, k), (k, k), (kinds, 2)), strict=True))
    return Field(node, chain, skip)


def find(docs: DataFrame, field: Field, certain: float = 0.9, redact: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans and n_added of each whole text, in one map.

    With redact: all columns of docs instead, every span of the text replaced by its kind in angle brackets; where spans
    overlap, the one that starts first, then the longer one, and what of another lies beyond it by that one's kind. A null text counts as empty (and stays null); an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    source = by_place(docs) if redact else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    at = docs.columns.index("text") if redact else 1

    def spans(text: str | None) -> tuple[list[Span], list[Span]]:
        if not text or not MARKED.search(text):
            return [], []
        base = base_spans(text)
        return base, added_spans(text, base, field, certain)

    def redacted(text: str | None) -> str | None:
        base, more = spans(text)
        out, end = [], 0
        for s, e, kind in sorted(((s, -e, k) for k, s, e in [*base, *more])):
            if -e > end:
                out += [text[end : max(s, end)], f"<{KINDS[kind]}>"]
                end = -e
        return text if not out else "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            if redact:
                yield pa.RecordBatch.from_arrays([pa.array([redacted(t) for t in texts], pa.string()) if i == at else c for i, c in enumerate(b.columns)], b.schema.names)
                continue
            found = [spans(t) for t in texts]
            counts = [[sum(k == kind for k, *_ in base) for base, _ in found] for kind in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(said(base).encode()).hexdigest() for base, _ in found]), pa.array([said([*base, *more]) for base, more in found], pa.string()), pa.array([len(more) for _, more in found], pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    out = source.mapInArrow(run, source.schema if redact else "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return out.toDF(*docs.columns) if redact else out


def documents(docs: DataFrame) -> DataFrame:
    """What `find` tells of every document, by a field that `fit` trains on some of them.

    A null or empty text has no spans; a null doc_id stays null; repeated rows are found alike; other columns are ignored; an empty table gives
    an empty result. Tokens without a digit or an @-like sign are never looked at ("ann dot b at x dot org" stays).
    """
    return find(docs, fit(docs))
