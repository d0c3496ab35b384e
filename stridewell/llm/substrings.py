"""Removal of passages that repeat across documents, by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import partitions, tune, written
from .shingles import mix

#: Words of a window and of a minimiser.
WINDOW, MINIMISER = 13, 4
#: Bytes of texts that are worked on at once, and of packed strings that a task holds before it sends them.
CHUNK, FLUSH = 1 << 19, 8 << 20
#: Digests of whole texts that a task remembers.
TEXTS = 1 << 17
#: Super-k-mers of a bucket on average at most, of which a worker holds one at a time; and the slots that minimisers are counted by.
PER_BUCKET, SLOTS = 400_000, 1 << 20
#: A string with more places than this in what a task sends has them looked up by a join, not by its bucket.
HEAVY = 64
RADIX = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX ** i and its inverse modulo 2 ** 64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 19)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(r))], dtype=np.uint64) for r in (RADIX, pow(RADIX, -1, 1 << 64))]
    return _powers[0], _powers[1]


class Words:
    """Words of a buffer in which each word is followed by one space, and hashes of runs of them."""

    def __init__(self, buffer: np.ndarray):
        self.buffer = buffer
        self.ends = np.flatnonzero(buffer == 32)
        self.starts = np.r_[0, self.ends[:-1] + 1] if len(self.ends) else self.ends
        up, self.down = powers(len(buffer) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.uint64(0), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: len(buffer)], dtype=np.uint64)]

    def runs(self, width: int) -> np.ndarray:
        """Hashes of the runs of `width` words, by where they start."""
        n = len(self.starts) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[self.ends[width - 1 :]] - self.sums[self.starts[:n]]) * self.down[self.starts[:n]])


def texts_words(texts: list[bytes | None]) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of texts, the text of each word and the first word of each text."""
    lengths = np.array([len(t or b"") + 1 for t in texts])
    raw = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    space = SPACE[raw]
    before = np.r_[True, space[:-1]]
    text = np.searchsorted(np.cumsum(lengths), np.flatnonzero(~space & before), side="right")
    buffer = raw[~(space & before)].copy()
    buffer[SPACE[buffer]] = 32
    return Words(buffer), text, np.searchsorted(text, np.arange(len(texts)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def super_k_mers(words: Words, text: np.ndarray, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, by first word, and mixed minimiser of each run of windows of a text that share a minimiser."""
    n = len(text) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    low = sliding_min(words.runs(minimiser), window - minimiser + 1)
    whole = text[:n] == text[window - 1 :]
    goes_on = whole[1:] & whole[:-1] & (low[1:] == low[:-1])
    first = np.flatnonzero(whole & ~np.r_[False, goes_on])
    last = np.flatnonzero(whole & ~np.r_[goes_on, False])
    return first, last, mix(low[first])


def chunked(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[list[list], list[bytes]]]:
    """The other columns and the texts of so many rows that their texts take about CHUNK bytes."""
    for b in batches:
        texts = b.column(text_at).cast(pa.binary()).to_pylist()
        others = [c.to_pylist() for i, c in enumerate(b.columns) if i != text_at]
        first = size = 0
        for i, t in enumerate(texts):
            size += len(t or b"")
            if size >= CHUNK or i + 1 == len(texts):
                yield [c[first : i + 1] for c in others], texts[first : i + 1]
                first, size = i + 1, 0


def packed(strings: list[bytes], lengths: np.ndarray, counts: np.ndarray, least: np.ndarray, docs: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> bytes:
    """A bucket's super-k-mers as one compressed string: words of each, places, least doc_id, and document and first word of each place."""
    body = b" ".join(strings) + b" "
    parts = [lengths.astype("<i4"), counts.astype("<i4"), least.astype("<i8"), np.diff(docs, prepend=0).astype("<i8"), np.diff(keys, prepend=0).astype("<i8"), starts.astype("<i4")]
    head = np.array([len(strings), len(docs), len(body)], "<i8")
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *(p.tobytes() for p in parts), body]))


def unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m, size = np.frombuffer(raw, "<i8", 3)
    at, out = 24, []
    for kind, k in (("<i4", n), ("<i4", n), ("<i8", n), ("<i8", m), ("<i8", m), ("<i4", m)):
        out.append(np.frombuffer(raw, kind, int(k), at))
        at += out[-1].nbytes
    out[3], out[4] = np.cumsum(out[3]), np.cumsum(out[4])
    return (*out, np.frombuffer(raw, np.uint8, int(size), at))


def flagged_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


SPANS = ["doc_id", "key", "first", "end"]
FOUND = "kind int, doc_id long, key long, first int, end int, string binary, places binary"


def found_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", *SPANS, "string", "places"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """doc_id, key, first and end (words, end exclusive) of what windows cover that also start in a document with a smaller doc_id.

    docs: doc_id and key (both long, not null; together they name a row) and text. Spans may touch or overlap.

    1. Super-k-mers are counted by slots of their minimiser, and each task reports those with more than a slot's share
    of its own. Their number also says how many buckets there are, so that a bucket's size doesn't grow with the input.
    A slot whose reported counts are more than a bucket's share of all is hot; its windows go to buckets by their own hash instead. 2. Each task takes a text only once, with its least doc_id,
    as its other copies go whole; it merges equal super-k-mers and packs those of a bucket, with the places where they
    stand, into one string. 3. A bucket sorts the hashes of its windows, compares neighbours
    word by word, and so has the least doc_id of each window. Places of strings that stand in more than HEAVY places of
    what a task sends don't go to buckets, but as one table to a join with what the buckets find about these strings.
    """
    spark = docs.sparkSession
    tune(spark)
    n = partitions(spark)
    least_buckets = 8 * n
    slots = max(SLOTS, 1 << (16 * least_buckets - 1).bit_length())
    source = docs.where("doc_id is not null and text is not null").select("doc_id", "key", F.col("text").cast("string").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for _, texts in chunked(batches, 0):
            words, text, _ = texts_words(texts)
            first, last, low = super_k_mers(words, text, window, minimiser)
            with np.errstate(over="ignore"):
                one = mix((words.sums[words.ends[last + window - 1]] - words.sums[words.starts[first]]) * words.down[words.starts[first]]) if len(first) else first
            _, at = np.unique(one, return_index=True)
            np.add.at(total, (low[at] & np.uint64(slots - 1)).astype(np.int64), 1)
        there = np.flatnonzero(total > max(16, total.sum() / slots))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, there]), pa.array(np.r_[total.sum(), total[there]])], ["slot", "n"])

    sizes = source.select("text").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    sizes = written(sizes, "slots")
    everything = sizes.where("slot = -1").agg(F.sum("n")).first()[0] or 0
    buckets = max(least_buckets, -(-everything // PER_BUCKET))
    #: no more numbers than there are buckets
    hot = np.array(sorted(r["slot"] for r in sizes.where((F.col("slot") >= 0) & (F.col("n") > max(everything / buckets, 16 * everything / slots))).collect()), np.int64)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, int] = {}
        places: list[tuple[np.ndarray, ...]] = []
        least_of: dict[bytes, int] = {}  # whole texts that the task has had, by digest
        size = sent_tables = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal table, places, size, sent_tables
            strings = list(table)
            number, bucket, length, doc, key, start = (np.concatenate(x) for x in zip(*places, strict=True))
            order = np.argsort(number, kind="stable")
            number, bucket, length, doc, key, start = (x[order] for x in (number, bucket, length, doc, key, start))
            at = np.searchsorted(number, np.arange(len(strings) + 1))
            counts, least = np.diff(at), np.minimum.reduceat(doc, at[:-1])
            bucket, length = bucket[at[:-1]], length[at[:-1]]
            by = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
            out, held = [], 0
            for b in np.flatnonzero(np.diff(cut)):
                own = by[cut[b] : cut[b + 1]]
                light = counts[own] <= HEAVY
                rows = np.concatenate([np.arange(at[s], at[s + 1]) for s in own[light]]) if light.any() else np.empty(0, np.int64)
                out.append((int(b), 0, None, packed([strings[s] for s in own], length[own], np.where(light, counts[own], 0), least[own], doc[rows], key[rows], start[rows])))
                held += len(out[-1][3])
                if held > 4 << 20:
                    yield made(out)
                    out, held = [], 0
            heavy = np.flatnonzero(counts > HEAVY)
            if len(heavy):
                sent_tables += 1
                name = TaskContext.get().partitionId().to_bytes(8, "little") + sent_tables.to_bytes(8, "little")
                rows = np.concatenate([np.arange(at[s], at[s + 1]) for s in heavy])
                blob = zstandard.compress(np.stack([np.repeat(np.arange(len(heavy)), counts[heavy]), doc[rows], key[rows], start[rows]]).astype("<i8").tobytes())
                out.append((sent_tables % buckets, 1, name, blob))
                out += [(int(s) % buckets, 3, xxh3_128_digest(strings[s]), name + k.to_bytes(8, "little")) for k, s in enumerate(heavy)]
            if out:
                yield made(out)
            table, places, size = {}, [], 0

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], ["bucket", "kind", "string", "packed"])

        for (ids, keys), texts in chunked(batches, 2):
            fresh, copies = [], []
            for i, (doc, whole) in enumerate(zip(ids, texts, strict=True)):
                name = xxh3_128_digest(whole)
                if (known := least_of.get(name)) is not None and known <= doc:
                    if known < doc and (n_words := len(whole.split())) >= window:
                        copies.append((doc, keys[i], n_words))
                    continue
                if len(least_of) >= TEXTS:
                    least_of.clear()
                least_of[name] = doc
                fresh.append(i)
            if copies:
                blob = zstandard.compress(np.array(copies, "<i8").T.tobytes())
                yield made([(copies[0][0] % buckets, 2, None, blob)])
            ids, keys, texts = ([x[i] for i in fresh] for x in (ids, keys, texts))
            if not texts:
                continue
            words, text, begin = texts_words(texts)
            first, last, low = super_k_mers(words, text, window, minimiser)
            if not len(first):
                continue
            slot = (low & np.uint64(slots - 1)).astype(np.int64)
            bucket = (low % np.uint64(buckets)).astype(np.int64)
            if len(hot) and (spread := np.isin(slot, hot)).any():
                single = np.concatenate([np.arange(a, z + 1) for a, z in zip(first[spread], last[spread], strict=True)])
                own = (mix(words.runs(window)[single]) % np.uint64(buckets)).astype(np.int64)
                first, last, bucket = (np.concatenate(x) for x in ((first[~spread], single), (last[~spread], single), (bucket[~spread], own)))
            buffer = words.buffer.tobytes()
            strings = [buffer[a:z] for a, z in zip(words.starts[first].tolist(), words.ends[last + window - 1].tolist(), strict=True)]
            before = len(table)
            number = np.array([table.setdefault(s, len(table)) for s in strings], np.int64)
            size += 16 * len(strings) + (sum(map(len, strings)) if len(table) > before else 0)
            owner = text[first]
            places.append((number, bucket, last - first + window, np.array(ids, np.int64)[owner], np.array(keys, np.int64)[owner], first - begin[owner]))
            if size >= FLUSH:
                yield from flush()
        if places:
            yield from flush()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at = -1
        for b in batches:
            through: list[tuple] = []
            for bucket, kind, string, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != at and held:
                    yield from of_bucket(held, window)
                    held = []
                at = bucket
                if kind == 2:
                    through += [(0, *x, None, None) for d, k, n in np.frombuffer(zstandard.decompress(blob), "<i8").reshape(3, -1).T.tolist() for x in [(d, k, 0, n)]]
                elif kind:
                    through.append((kind, None, None, None, None, string, blob))
                else:
                    held.append(blob)
            if through:
                yield found_batch(through)
        if held:
            yield from of_bucket(held, window)

    strings = source.mapInArrow(sent, "bucket long, kind int, string binary, packed binary")
    dealt = strings.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket")
    found = written(dealt.mapInArrow(judged, FOUND), "repeats")
    light = found.where("kind = 0").select(*SPANS)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                number, doc, key, start = np.frombuffer(zstandard.decompress(blob), "<i8").reshape(4, -1)
                low = {int.from_bytes(m["member"][16:], "little"): np.frombuffer(m["least"], "<i8") for m in members}
                spans = [(d, k, s + x, s + z + window - 1) for n, d, k, s in zip(number.tolist(), doc.tolist(), key.tolist(), start.tolist(), strict=True) for x, z in flagged_runs(low[n] < d)]
                merged: list[list[int]] = []
                for d, k, x, z in sorted(spans):
                    if merged and merged[-1][:2] == [d, k] and x <= merged[-1][3]:
                        merged[-1][3] = max(z, merged[-1][3])
                    else:
                        merged.append([d, k, x, z])
                yield found_batch([(0, *m, None, None) for m in merged])

    least = found.where("kind = 2").select("string", F.col("places").alias("least"))
    members = found.where("kind = 3").select("string", F.col("places").alias("member")).join(least, "string")
    members = members.groupBy(F.substring("member", 1, 16).alias("string")).agg(F.collect_list(F.struct("member", "least")).alias("members"))
    heavy = found.where("kind = 1").select("string", "places").join(members, "string")
    return light.unionByName(heavy.select("places", "members").mapInArrow(looked_up, FOUND).select(*SPANS))


def of_bucket(blobs: list[bytes], window: int) -> Iterator[pa.RecordBatch]:
    """Spans of the places of a bucket's strings (kind 0), and the windows' least doc_ids of strings whose places are elsewhere (kind 2)."""
    length, counts, least, doc, key, start, buffer = (np.concatenate(x) for x in zip(*map(unpacked, blobs), strict=True))
    ends = np.flatnonzero(buffer == 32)
    starts = np.r_[0, ends[:-1] + 1]
    string = np.repeat(np.arange(len(length)), length)
    n = len(string) - window + 1
    at = np.flatnonzero(string[:n] == string[window - 1 :])
    hashes = np.empty(len(at), np.uint64)
    #: windows don't cross strings, so they are hashed some strings at a time
    word = np.r_[0, np.cumsum(length)]
    i = done = 0
    while i < len(length):
        j = max(i + 1, int(np.searchsorted(ends[word[1:] - 1], starts[word[i]] + CHUNK)))
        part = string[word[i] : word[j]]
        own = np.flatnonzero(part[: len(part) - window + 1] == part[window - 1 :])
        hashes[done : done + len(own)] = Words(buffer[starts[word[i]] : ends[word[j] - 1] + 1]).runs(window)[own]
        i, done = j, done + len(own)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    raw = buffer.tobytes()
    a, z = starts[at][order], ends[at + window - 1][order]
    pairs = np.flatnonzero(same)
    #: equal hashes are compared word by word
    equal = [raw[i:j] == raw[k:m] for i, j, k, m in zip(a[pairs].tolist(), z[pairs].tolist(), a[pairs + 1].tolist(), z[pairs + 1].tolist(), strict=True)]
    if not all(equal):
        order = order[sorted(range(len(order)), key=lambda i: (int(hashes[order[i]]), raw[a[i] : z[i]]))]
        a, z = starts[at][order], ends[at + window - 1][order]
        same = np.array([raw[a[i] : z[i]] == raw[a[i + 1] : z[i + 1]] for i in range(len(order) - 1)], bool)
    group = np.r_[0, np.cumsum(~same)]
    heads = np.flatnonzero(np.r_[True, ~same])
    low = np.empty(len(at), np.int64)
    low[order] = np.minimum.reduceat(least[string[at]][order], heads)[group]
    begin = np.searchsorted(string[at], np.arange(len(length) + 1))
    lowest, highest = np.minimum.reduceat(low, begin[:-1]), np.maximum.reduceat(low, begin[:-1])
    owner = np.repeat(np.arange(len(length)), counts)
    whole = highest[owner] < doc
    columns = [doc[whole], key[whole], start[whole], start[whole] + length[owner[whole]]]
    for i in range(0, int(whole.sum()), 10_000):
        part = [c[i : i + 10_000] for c in columns]
        k = len(part[0])
        nothing = pa.nulls(k, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array(part[0]), pa.array(part[1]), pa.array(part[2].astype(np.int32)), pa.array(part[3].astype(np.int32)), nothing, nothing], ["kind", *SPANS, "string", "places"])
    out = []
    for i in np.flatnonzero(~whole & (lowest[owner] < doc)):
        s = owner[i]
        out += [(0, int(doc[i]), int(key[i]), int(start[i] + x), int(start[i] + y + window - 1), None, None) for x, y in flagged_runs(low[begin[s] : begin[s + 1]] < doc[i])]
    first_word = np.cumsum(length) - length
    sent: set[bytes] = set()
    for s in np.flatnonzero(counts == 0):
        name = xxh3_128_digest(raw[starts[first_word[s]] : ends[first_word[s] + length[s] - 1]])
        if name not in sent:
            sent.add(name)
            out.append((2, None, None, None, None, name, low[begin[s] : begin[s + 1]].astype("<i8").tobytes()))
    if out:
        yield found_batch(out)


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each row of docs.

    A word goes if a window of `window` consecutive words covers it whose sequence also starts in a row with a smaller
    doc_id; windows are those of the input. So of exact copies the one with the smallest doc_id stays; repeats within a
    document stay, as do those among rows of one doc_id. A null doc_id is smaller and larger than none: such rows stay whole and cause no
    removal. A null or empty text has no words. Other columns are ignored; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    spans = repeated_spans(rows, window, minimiser)
    both = rows.select("doc_id", "key", F.lit(1).alias("kind"), F.lit(0).alias("first"), F.lit(0).alias("end"), "text").unionByName(spans.withColumn("kind", F.lit(0)).withColumn("text", F.lit(None).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for b in batches:
            out: list[tuple] = []
            ids, keys, kinds, first, end = (b.column(i).to_pylist() for i in range(5))
            texts = b.column(5).cast(pa.binary())
            for i, (doc, key, kind) in enumerate(zip(ids, keys, kinds, strict=True)):
                if (doc, key) != name:
                    name, held = (doc, key), []
                if not kind:
                    held.append((first[i], end[i]))
                    continue
                words = (texts[i].as_py() or b"").split()
                n = len(words)
                if held:
                    stay = np.ones(n, bool)
                    for x, y in held:
                        stay[x:y] = False
                    words = [words[k] for k in np.flatnonzero(stay)]
                out.append((doc, n, n - len(words), b" ".join(words)))
            for i in range(0, len(out), 500):
                c = list(zip(*out[i : i + 500], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    dealt = both.repartition(partitions(docs.sparkSession), "doc_id", "key").sortWithinPartitions("doc_id", "key", "kind")
    return dealt.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def documents(docs: DataFrame) -> DataFrame:
    """n_words, n_removed and the digest of the words that `remove_repeats` keeps of every document; nulls, repeated rows, other columns and empty tables are as there."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
