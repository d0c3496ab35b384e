import glob
import os
import tempfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stridewell.llm import token_output as to
from stridewell.llm.tokens import encoder

SEQ = 16


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
@pytest.mark.parametrize("key", [0, 99])
def test_permutation(n, key):
    p = to.permuted(np.arange(n), n, key)
    assert sorted(p) == list(range(n))
    if n == 1000:
        assert (p != to.permuted(np.arange(n), n, key + 1)).mean() > 0.9 and abs(np.corrcoef(p, np.arange(n))[0, 1]) < 0.1


def test_ids_are_those_of_the_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoder()
    for text in ["", "a b  c\n\n d", "<|endoftext|> x", "naïve ß 12345  ", "a" * 5000, "héren'll  \t!!"]:
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def stored(path, said):
    """slot -> ids, from the bytes alone."""
    out = {}
    for f in sorted(glob.glob(f"{path}/part-*")):
        data, shard = open(f, "rb").read(), int(f.rpartition("part-")[2][:5])
        assert len(data) % said["stride"] == 0
        for i in range(len(data) // said["stride"]):
            out[shard * said["per_shard"] + i] = np.frombuffer(data, "<u2", said["seq_len"], i * said["stride"]).tolist()
    return out


@pytest.mark.parametrize("chunk", [1, 50, 1 << 19])
def test_round_trip(spark, documents, monkeypatch, chunk):
    """Chunks of one document, of some sequences, and of a whole partition."""
    monkeypatch.setattr(to, "CHUNK", chunk)
    path = tempfile.mkdtemp() + "/shards"
    said = to.write_shards(documents, path, key=5, seq_len=SEQ, shard_bytes=40 * (2 * SEQ + 1))
    slots = stored(path, said)
    n = said["n_sequences"]
    assert sorted(slots) == list(range(n)) and said["n_shards"] > 1
    place = to.permuted(np.arange(n), n, 5)
    stream = [x for i in range(n) for x in slots[int(place[i])]]
    encode = encoder()
    docs = Counter(tuple(encode(r["text"]).tolist()) for r in documents.collect())
    found, held = Counter(), []
    for x in stream[: said["n_tokens"]]:
        if x == 50256:
            found[tuple(held)] += 1
            held = []
        else:
            held.append(x)
    assert found == docs and set(stream[said["n_tokens"] :]) <= {50256}
    rows = to.read_shards(spark, path, said).collect()
    assert {r["slot"]: r["ids_crc32"] for r in rows} == {k: zlib.crc32(np.array(v, "<u2").tobytes()) for k, v in slots.items()}


def test_ids_beyond_16_bits_raise(spark, documents):
    with pytest.raises(Exception, match="65,535"):
        to.write_shards(documents, tempfile.mkdtemp() + "/shards", end_id=70_000)


def test_nothing(spark, nothing):
    path = tempfile.mkdtemp() + "/shards"
    said = to.write_shards(nothing, path)
    assert said["n_sequences"] == 0 and to.read_shards(spark, path, said).count() == 0


def test_shards_are_read_from_a_slot_in_bounded_pieces(spark, documents, tmp_path):
    """Shards of many read buffers, from any slot on, and what was written is removed."""
    from stridewell.llm.common import scratch, tables

    path = str(tmp_path / "shards")
    layout = to.write_shards(documents, path, key=3, seq_len=16, shard_bytes=4000)
    assert layout["n_shards"] > 5 and layout["per_shard"] > 100
    whole = {r["slot"]: tuple(r) for r in to.read_shards(spark, path, layout).collect()}
    assert sorted(whole) == list(range(layout["n_sequences"])) and all(r[1] == s // layout["per_shard"] for s, r in whole.items())
    for start in (0, 1, layout["per_shard"] - 1, layout["per_shard"], 2 * layout["per_shard"] + 7, layout["n_sequences"] - 1, layout["n_sequences"]):
        rows = to.read_shards(spark, path, layout, start, read_bytes=200)
        assert sorted(map(tuple, rows.collect())) == [whole[s] for s in range(start, layout["n_sequences"])]
    before = tables()
    with scratch(spark):
        assert to.documents_in_order(documents).count() > 0
        left = [t for t in tables() if t not in before]
        assert len(left) == 1 and os.path.isdir(left[0].removeprefix("file:"))
    assert tables() == before and not os.path.exists(left[0].removeprefix("file:"))
