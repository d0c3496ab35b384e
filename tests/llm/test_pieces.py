"""Ids and texts are the library's."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from stridewell.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def strange(rng, known):
    some = ["▁", " ", "a", "e", "\n", "\t", "\0", "é", "漢", "😀", "the", "́", "﻿", "th", "er", "=", "--", "</s>", "<0x41>", "<unk>", "١", "\r\n", "．"]
    kind = rng.random()
    if kind < 0.5:
        return "".join(rng.choice(known) if rng.random() < 0.6 else rng.choice(some) for _ in range(rng.randrange(12)))
    if kind < 0.8:
        return "".join(rng.choice(some) for _ in range(rng.randrange(30)))
    if kind < 0.9:
        return " " * rng.randrange(80) + rng.choice(known) + " " * rng.randrange(40)
    return "".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD7FF), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(rng.randrange(20)))


@pytest.mark.parametrize("small", [False, True])
def test_ids_and_texts_are_the_librarys(library, monkeypatch, small):
    if small:  # tables and slices that fill up all the time
        for name, value in (("SLICE", 40), ("WORDS", 20), ("PAIRS", 50), ("LONGEST", 4)):
            monkeypatch.setattr(pieces, name, value)
    coder = pieces.Coder(MODEL)
    rng = random.Random(5)
    known = list(coder.v.rank)
    texts = [strange(rng, known) for _ in range(4000)]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_eos=True), repr(text)
        assert coder.decode(ids) == library.decode(ids.tolist()), repr(text)
    assert [x.tolist() for x in coder.encode([None, ""])] == [[2], [2]] and coder.decode(np.array([2])) == ""
    assert pieces.Coder(MODEL, end=False).encode([None, "a"])[1].tolist() == library.encode("a")


def test_compatible_pairs_are_those_that_stay(library):
    v, rng = pieces.Vocabulary(MODEL), random.Random(6)
    short = [i for i, p in enumerate(v.pieces) if p and p in v.rank]
    for _ in range(3000):
        a, b = rng.choice(short), rng.choice(short)
        parts = list(v.pieces[a] + v.pieces[b])
        while len(parts) > 1:
            ranks = [v.rank.get(x + y, v.never) for x, y in zip(parts, parts[1:], strict=False)]
            if min(ranks) == v.never:
                break
            i = ranks.index(min(ranks))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert v.compatible(a, b) == (parts == [v.pieces[a], v.pieces[b]]), (v.pieces[a], v.pieces[b])


def test_a_text_without_spaces_and_a_long_one(library):
    coder, rng = pieces.Coder(MODEL), random.Random(7)
    known = [p.replace("▁", "") for p in coder.v.rank]
    for text in ("".join(rng.choice(known) for _ in range(30_000)), " ".join(rng.choice(known) for _ in range(300_000)), " " * 5000, "\n" * 5000, "a" * 20_000):
        (ids,) = coder.encode([text])
        assert ids.tolist() == library.encode(text, add_eos=True)
        assert coder.decode(ids) == library.decode(ids.tolist())


def test_query(spark, documents, nothing, library):
    docs = documents.withColumns({"ids": F.lit(1), "decoded": F.lit("x"), "n_tokens": F.lit(2), "a.b": F.lit(3)})
    rows = pieces.digests(pieces.encode(docs)).collect()
    want = []
    for doc, text in documents.select("doc_id", "text").collect():
        ids = library.encode(text or "", add_eos=True)
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert pieces.digests(pieces.encode(nothing)).collect() == []
