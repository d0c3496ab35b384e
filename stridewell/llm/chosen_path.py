"""Join of documents on the Jaccard similarity of their word shingles, by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import by_place, partitions, row_hash, tune, written
from .components import components
from .shingles import mix, shingle_set

WIDTH, SIMILARITY, RECALL = 5, 0.8, 0.99
#: Levels of paths: a bucket of more than LEAF sets is split further, down to this many shared shingles.
DEPTH = 3
LEAF = 256
#: Sets of a block of a larger bucket or component, and bytes of the sets of a block of a component; a task holds two blocks at most.
BLOCK, SET_BLOCK, SET_BYTES = 1024, 2048, 24 << 20
#: Sets and shingles that are laid side by side at a time when two blocks are compared.
SLICE, CELLS = 512, 1 << 19
#: Minhashes of a sketch, and the number of equal ones from which a pair is compared in full: a pair at the similarity falls short once in about 30,000.
SKETCH, ALIKE = 64, 38
#: Sets of a large group that are compared with all others first, where only classes are asked for.
PIVOTS = 64
#: Bits for each row that is looked for, and in all (8 MB), of the bitmaps by which texts are left out before they are dealt.
BITS, MOST_BITS = 32, 1 << 26
SEED = np.uint64(0xD6E8FEB86659FD93)


def runs_for(similarity: float = SIMILARITY, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs until a pair at the similarity shares a path of full depth in one of them with probability `recall`.

    The shared paths of such a pair branch like a process with one child on average, or more: it lives on for d levels with p(d) = 1 - exp(-p(d-1)).
    """
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def paths(flat: np.ndarray, sizes: np.ndarray, runs: int, depth: int, overlap: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level (set, path, path one level up) of the paths of sets of shingles, laid end to end in flat.

    A path goes on with each shingle of its set whose hash, keyed by the path, is among the smallest share
    1 / (overlap * size): two sets of that overlap |x & y| / max(|x|, |y|) share one child of a shared path on average.
    """
    starts = np.cumsum(sizes) - sizes
    limit = np.minimum(2.0**64 / np.maximum(1.0, overlap * sizes), 2.0**64 - 2049).astype(np.uint64)
    found: list[list[tuple]] = [[] for _ in range(depth)]
    for run in range(runs):
        owner = np.arange(len(sizes))
        path = np.full(len(sizes), mix(np.array([SEED * np.uint64(1)]) + np.uint64(run + 1))[0])
        for level in range(depth):
            n = sizes[owner]
            at = np.repeat(starts[owner] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            node = np.repeat(np.arange(len(owner)), n)
            h = mix(flat[at] ^ path[node])
            hit = np.flatnonzero(h < limit[owner][node])
            up = path[node[hit]]
            owner, path = owner[node[hit]], mix(h[hit] ^ (up >> np.uint64(1)) ^ np.uint64(level + 1))
            found[level].append((owner, path, up))
            if not len(owner):
                break
    return [tuple(np.concatenate([x[k] for x in level]) if level else np.empty(0, np.uint64) for k in range(3)) for level in found]


def sketches(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """8 bits of SKETCH minhashes of each set; no set may be empty."""
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), SKETCH), np.uint8)
    with np.errstate(over="ignore"):
        for k in range(SKETCH):
            h = (flat ^ (SEED * np.uint64(2 * k + 1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            out[:, k] = np.minimum.reduceat(h * np.uint64(0xD6E8FEB86659FD93), starts) >> np.uint64(20) & np.uint64(0xFF)
    return out


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and mark, a digest of the text: rows that agree in doc_id and mark are one document."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("mark"))


def described(docs: DataFrame, runs: int, depth: int, overlap: float, width: int) -> DataFrame:
    """doc_id, mark (of the text), key (of the shingle set; null without words), size (of the set), sketch and the paths of each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 500) for i in range(0, big.num_rows, 500)):
                sets = [shingle_set(t, width) for t in b.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                sizes = np.array([len(sets[i]) for i in full], np.int64)
                columns: dict = {"doc_id": b.column(0), "mark": b.column(2), "key": pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())}
                place = np.full(len(sets), -1)
                place[full] = np.arange(len(full))
                flat = np.concatenate([sets[i] for i in full]) if full else np.empty(0, np.uint64)
                marks = sketches(flat, sizes) if full else []
                columns["size"] = pa.array([len(s) for s in sets], pa.int64())
                columns["sketch"] = pa.array([marks[p].tobytes() if p >= 0 else None for p in place], pa.binary())
                levels = paths(flat, sizes, runs, depth, overlap) if full else [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))] * depth
                for k, (owner, path, up) in enumerate(levels):
                    owner = np.array(full, np.int64)[owner.astype(np.int64)] if len(owner) else np.empty(0, np.int64)
                    order = np.argsort(owner, kind="stable")
                    offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(sets)))].astype(np.int32)
                    for name, x in ((f"path{k}", path), (f"up{k}", up)):
                        columns[name] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x[order].view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, mark binary, key binary, size long, sketch binary, " + ", ".join(f"path{k} array<long>, up{k} array<long>" for k in range(depth))
    return texts_of(docs).mapInArrow(run, schema)


def likely(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose columns are among those of wanted, and few others (one in BITS, of more than MOST_BITS / BITS wanted rows more): what a join would drop isn't dealt.

    A bit for each hash of the wanted rows, in bitmaps that every task gets.
    """
    bits = min(MOST_BITS, BITS * max(1024, wanted.count()))
    place = F.pmod(F.xxhash64(*on), F.lit(bits)) + 1
    maps = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    at = F.bitmap_bit_position("place").cast("int")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("place", place).withColumn("bucket", F.bitmap_bucket_number("place")).join(F.broadcast(maps), "bucket")
    return found.where(F.getbit(byte, at % 8) == 1).select(*rows.columns)


def blocked(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Adds group, block and other: rows of a key with several blocks (column blocks) go to each pair of these that theirs is of."""
    n = F.col("blocks").cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(member, key), n).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("group", F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other")))


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of each group, of batches sorted by their first column."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each member's component, of links a-b among 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join the members of a bucket whose sketches are alike: one for each member at most."""
    out: list[tuple[int, int]] = []
    for rows in groups(batches):
        ids = np.array([r[1] for r in rows])
        m = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
        order = np.argsort(ids, kind="stable")
        ids, m = ids[order], m[order]
        left, right = [], []
        for s in range(0, len(ids), 128):
            equal = np.zeros((len(m[s : s + 128]), len(m)), np.uint8)
            for k in range(m.shape[1]):
                equal += m[s : s + 128, k, None] == m[None, :, k]
            i, j = np.nonzero(equal >= ALIKE)
            left.append(i[i + s < j] + s)
            right.append(j[i + s < j])
        root = stars(len(ids), np.concatenate(left), np.concatenate(right))
        out += [(int(ids[i]), int(ids[r])) for i, r in enumerate(root) if i != r]
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
            out = []
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def slices(sizes: np.ndarray, low: int, high: int) -> list[slice]:
    """Runs of sets low..high-1, each of SLICE sets and CELLS shingles at most, or one larger set."""
    out, at, held = [], low, 0
    for i in range(low, high):
        if i > at and (i - at >= SLICE or held + sizes[i] > CELLS):
            out.append(slice(at, i))
            at, held = i, 0
        held += int(sizes[i])
    return [*out, slice(at, high)] if high > at else out


def shared(sets: list[np.ndarray], rows: slice, columns: slice) -> np.ndarray:
    """Sizes of the intersections of sets[rows] with sets[columns], by products of 0/1 matrices."""
    parts = [sets[i] for s in (rows, columns) for i in range(s.start, s.stop)]
    sizes = [len(p) for p in parts]
    tokens, which, often = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(parts)), sizes)
    n = rows.stop - rows.start
    number = np.cumsum(often > 1) - 1  # tokens of a single set are shared by none
    keep = (often > 1)[which]
    which, member = number[which[keep]], member[keep]
    out = np.zeros((n, len(parts) - n), np.float32)
    order = np.argsort(which, kind="stable")
    which, member = which[order], member[order]
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        a, b = np.searchsorted(which, [first, first + 4096])
        m = np.zeros((len(parts), 4096), np.float32)
        m[member[a:b], which[a:b] - first] = 1
        out += m[:n] @ m[n:].T
    return out


def verified(similarity: float):
    """what, a, b: 0, member and its links; or 1 and links that join the members of a component.

    Rows of a group either are of one block (block = other), or of two, which are compared with each other. Of rows whose
    `other` is negative the links aren't counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            rows.sort(key=lambda r: (r[2], r[1]))
            across = rows[0][2] != rows[0][3]
            ids, counts = np.array([r[1] for r in rows]), np.array([r[3] >= 0 for r in rows])
            sets = [np.frombuffer(r[4], np.uint64) for r in rows]
            sizes = np.array([len(s) for s in sets])
            cut = sum(r[2] == rows[0][2] for r in rows) if across else len(rows)
            count = np.zeros(len(rows), np.int64)
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for x in slices(sizes, 0, cut):
                for y in slices(sizes, cut, len(rows)) if across else slices(sizes, 0, len(rows)):
                    if not across and y.start < x.start:
                        continue
                    common = shared(sets, x, y)
                    p, q = np.nonzero(common >= similarity * (sizes[x, None] + sizes[None, y] - common) - 1e-4)
                    p, q = p + x.start, q + y.start
                    new = (p < q) & (ids[p] != ids[q])
                    p, q = p[new], q[new]
                    count += np.bincount(p, minlength=len(rows)) + np.bincount(q, minlength=len(rows)) * counts
                    left.append(p)
                    right.append(q)
            by_id = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[by_id] = np.arange(len(ids))
            root = stars(len(ids), rank[np.concatenate(left)], rank[np.concatenate(right)])
            out = [(0, int(i), int(c)) for i, c in zip(ids, count, strict=True) if c] + [(1, int(ids[by_id[k]]), int(ids[by_id[r]])) for k, r in enumerate(root) if k != r]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["what", "a", "b"])

    return run


def compared(pairs: DataFrame, similarity: float) -> DataFrame:
    """What `verified` finds in rows (group, node, block, other, tokens), written."""
    n = partitions(pairs.sparkSession)
    return written(pairs.select("group", "node", "block", "other", "tokens").repartition(n, "group").sortWithinPartitions("group", "node").mapInArrow(verified(similarity), "what long, a long, b long"), "checked")


def blocks_of(n: Column, size: Column) -> Column:
    """Blocks of a group of n sets of so many bytes."""
    return F.greatest(F.ceil(n / SET_BLOCK), F.ceil(size / SET_BYTES))


def linked(with_sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the sets of each class, without their number, of groups of sets (node, root, n, blocks, tokens).

    A group of several blocks is compared block by block, each of which also gets the group's PIVOTS (no more than a block's sets). What these
    comparisons join most is the group's main part; its sets need no comparison with each other any more, and only the
    rest is compared with all blocks. So a family of near copies, however large, is passed twice.
    """
    with_sets = written(with_sets, "grouped")
    blocks = F.col("blocks").cast("int")
    one = with_sets.withColumn("block", F.pmod(F.xxhash64("node", "root"), blocks).cast("int"))
    order = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("node", F.lit(1)), "node"))
    few = F.least(F.lit(PIVOTS), F.ceil(F.col("n") / blocks))
    pivots = with_sets.where(blocks > 1).withColumn("place", order).where(F.col("place") <= few).drop("place")
    pivots = pivots.withColumn("own", F.pmod(F.xxhash64("node", "root"), blocks).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).where(F.col("own") != F.col("block")).drop("own")
    first = compared(one.unionByName(pivots).withColumn("other", F.col("block")).withColumn("group", F.xxhash64("root", "block")), similarity).where("what = 1").select("a", "b")
    part = components(first).withColumnRenamed("root", "part")
    large = one.where(blocks > 1).withColumn("bytes", F.octet_length("tokens")).drop("tokens").join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
    most = large.groupBy("root", "part").agg(F.count("*").alias("size")).groupBy("root").agg(F.max_by("part", F.struct("size", "part")).alias("main"))
    rest = written(large.join(most, "root").where(F.col("part") != F.col("main")).select("node", "root", "bytes"), "rest")
    if rest.isEmpty():
        return first
    count = rest.groupBy("root").agg(blocks_of(F.count("*"), F.sum("bytes")).cast("int").alias("parts"))
    at = F.pmod(F.xxhash64("node", "root", F.lit(2)), F.col("parts")).cast("int")
    a = with_sets.join(rest.select("node"), "node", "left_semi").join(count, "root").select("root", "node", "tokens", at.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"), F.lit(0).alias("block"), F.lit(1).alias("other"))
    b = one.join(count, "root").select("root", "node", "tokens", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("block"), F.lit(0).alias("other"))
    second = compared(a.unionByName(b).withColumn("group", F.xxhash64("root", "i", "j")), similarity)
    return first.unionByName(second.where("what = 1").select("a", "b"))


def counted(with_sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join the sets of each class, and the number of links of each set (set, n_links), of groups as `linked` takes them.

    All pairs of a group of one block are compared. In a larger one, a set in the midst (of some pivots the one with most others
    close by) has a ball around it: the sets whose distance to it is half of what a link allows, all of which are links of each other by the triangle inequality.
    Where the ball is most of the group, only the rest is compared, with all; otherwise all pairs of blocks are.
    """
    with_sets = written(with_sets, "grouped")
    blocks, tight = F.col("blocks").cast("int"), (1 + similarity) / 2
    large = with_sets.where(blocks > 1).withColumn("block", F.pmod(F.xxhash64("node", "root"), blocks).cast("int"))
    order = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("node", F.lit(1)), "node"))
    few = F.least(F.lit(PIVOTS), F.ceil(F.col("n") / blocks))
    pivots = large.withColumn("place", order).where(F.col("place") <= few)
    same = pivots.withColumn("group", F.col("root")).withColumn("block", F.lit(0)).withColumn("other", F.lit(0))
    close = compared(same, tight).where("what = 0").select(F.col("a").alias("node"), F.col("b").alias("close"))
    centre = written(pivots.join(close, "node").groupBy("root").agg(F.max_by(F.struct("node", "n", "blocks", "tokens"), F.struct("close", "node")).alias("c")).select("root", "c.*"), "centres")
    ends = lambda block, other: [F.lit(block).alias("block"), F.lit(other).alias("other")]
    midst = centre.withColumn("at", F.explode(F.sequence(F.lit(0), blocks - 1))).select("root", "node", "tokens", "at", *ends(0, 1))
    others = large.join(centre.select("root"), "root", "left_semi").select("root", "node", "tokens", F.col("block").alias("at"), *ends(1, 0))
    inside = compared(midst.unionByName(others).withColumn("group", F.xxhash64("root", "at", F.lit(7))), tight).where("what = 0").select(F.col("a").alias("node")).distinct()
    ball = inside.join(large.select("node", "root", "n"), "node")
    most = ball.groupBy("root").agg(F.count("*").alias("size"), F.first("n").alias("of")).where(2 * F.col("size") > F.col("of")).select("root", "size")
    ball = written(ball.join(most, "root").join(centre.select("root", F.col("node").alias("centre")), "root").select("node", "root", "size", "centre"), "balls")
    rest = large.join(ball.select("root").distinct(), "root", "left_semi").join(ball.select("node"), "node", "left_anti").select("node", "root", "blocks", "block", "tokens")
    parts = rest.groupBy("root").agg(blocks_of(F.count("*"), F.sum(F.octet_length("tokens"))).cast("int").alias("parts"))
    at = F.pmod(F.xxhash64("node", "root", F.lit(2)), F.col("parts")).cast("int")
    a = rest.join(parts, "root").select("root", "node", "tokens", at.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"), *ends(0, 1))
    counts = F.when(F.col("size").isNull(), -1).otherwise(0)
    b = large.join(parts, "root").join(ball.select("node", "size"), "node", "left").select("root", "node", "tokens", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("block"), counts.alias("other"))
    whole = with_sets.join(ball.select("root").distinct(), "root", "left_anti")
    pairs = a.unionByName(b).withColumn("group", F.xxhash64("root", "i", "j", F.lit(3))).select("group", "node", "block", "other", "tokens").unionByName(blocked(whole, "root", "node").select("group", "node", "block", "other", "tokens"))
    checked = compared(pairs, similarity)
    links = checked.where("what = 1").select("a", "b").unionByName(ball.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")))
    number = checked.where("what = 0").select("a", "b").unionByName(ball.select(F.col("node").alias("a"), (F.col("size") - 1).alias("b")))
    return links, number.groupBy(F.col("a").alias("set")).agg(F.sum("b").alias("n_links"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, width: int = WIDTH, depth: int = DEPTH, links: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows' doc_id, mark and key of their set; and for each set its key, set_id and mark (of its least document), class_id, first (whether it is its class's) and n_links (0 unless links)."""
    spark = docs.sparkSession
    tune(spark)
    n = partitions(spark)
    overlap = similarity  # the least |x & y| / max(|x|, |y|) of a pair at the similarity: one set holds the other
    runs = runs_for(similarity, recall, depth)
    all_sets = written(described(docs, runs, depth, overlap, width), "sets")
    named = all_sets.where("doc_id is not null and key is not null")
    rest = F.struct("size", "sketch", *[f"{x}{k}" for k in range(depth) for x in ("path", "up")])
    sets = named.groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("who"), F.first(rest).alias("x")).select("who.*", "key", "x.*")
    # the same doc_id may stand for several texts; sets go by a number of their own
    sets = written(sets.withColumnRenamed("doc_id", "id").withColumn("set", F.xxhash64("key")), "distinct")

    leaves = large = None
    for k in range(depth):
        rows = sets.select("set", F.explode(F.arrays_zip(F.col(f"path{k}").alias("path"), F.col(f"up{k}").alias("up"))).alias("p")).select("set", "p.path", "p.up")
        if large is not None:
            rows = written(rows.join(large.select(F.col("path").alias("up")), "up", "left_semi"), "paths")
        counts = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        large = counts.where(F.col("n") > LEAF)
        here = rows.select("set", "path").join(counts if k == depth - 1 else counts.where(F.col("n") <= LEAF), "path")
        leaves = here if leaves is None else leaves.unionByName(here)
    # most paths are of one set only: sketches come to those that are shared
    leaves = leaves.join(sets.select("set", "sketch"), "set")
    buckets = blocked(leaves.withColumn("blocks", F.ceil(F.col("n") / BLOCK)), "path", "set").select("group", "set", "sketch")
    candidates = buckets.repartition(n, "group").sortWithinPartitions("group").mapInArrow(alike, "a long, b long")
    near = components(candidates)

    chosen = near.join(sets.select(F.col("set").alias("node"), "id", "mark", "size"), "node")
    size = chosen.groupBy("root").agg(F.count("*").alias("n"), blocks_of(F.count("*"), 8 * F.sum("size")).alias("blocks"))
    chosen = written(chosen.join(size, "root"), "chosen")
    # equal rows bring a set once
    texts = likely(texts_of(docs).withColumnRenamed("doc_id", "id"), chosen, ["id", "mark"]).join(chosen, ["id", "mark"]).dropDuplicates(["id", "mark"]).select("text", "node", "root", "n", "blocks")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 500) for i in range(0, big.num_rows, 500)):
                x = [shingle_set(t, width).tobytes() for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(x, pa.binary())], ["node", "root", "n", "blocks", "tokens"])

    with_sets = texts.mapInArrow(sets_of, "node long, root long, n long, blocks long, tokens binary")
    if links:
        found, number = counted(with_sets, similarity)
    else:
        found, number = linked(with_sets, similarity), spark.createDataFrame([], "set long, n_links long")
    member = components(found)
    ids = sets.select("set", "key", "mark", F.col("id").alias("set_id"))
    whole = ids.join(member.withColumnRenamed("node", "set"), "set", "left").join(number, "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = whole.groupBy("root").agg(F.min(F.struct("set_id", "key")).alias("least"))
    whole = whole.join(least, "root").select("key", "mark", "set_id", F.col("least.set_id").alias("class_id"), (F.col("key") == F.col("least.key")).alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return all_sets.select("doc_id", "mark", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")), whole


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """doc_id, set_id, class_id and n_links of each document.

    set_id is the least doc_id with the same set of shingles of `width` words (a shorter text: all its words); n_links
    is the number of other sets with a Jaccard similarity of at least `similarity`; class_id is the least doc_id of the
    documents that such links join. Pairs are found with probability `recall` or more and checked on their whole sets,
    and all pairs of a group that links join are compared, so that a link that no path has found still counts.

    A document without words, or with a null text, is a class of its own; a null doc_id has no set, class or links.
    Repeated rows have the same set, class and links, and count as one set; rows that share a doc_id but not a text go by
    their texts. Other columns are ignored; an empty table gives an empty result.

    1. Each text becomes its shingle set, a sketch and the paths of each run; equal sets become one. 2. Paths are
    counted; buckets of more than LEAF sets are split by the next level of paths, whose rows are worked out once and
    written. In a bucket, sets with like sketches are joined by one link each; larger buckets at the last level are taken
    by pairs of blocks. 3. Components of these links are the groups whose sets are compared in full, again by pairs of
    blocks if there are many: a set is copied once for each block (SET_BLOCK sets, or SET_BYTES bytes) of its group, which only larger groups
    feel, and a task holds two blocks, however long the texts are. Of a large family of close copies only what isn't close to its midst is compared. 4. Components of the links that hold.
    """
    rows, whole = classes(docs, similarity, recall, width, depth)
    out = rows.select("doc_id", "key").join(whole, "key", "left")
    known = F.col("set_id").isNotNull()
    return out.select("doc_id", *[F.when(known, F.col(c)).otherwise(F.col("doc_id")).alias(c) for c in ("set_id", "class_id")], F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """One row of docs for each class, with all columns of whatever names: of its least doc_id, the least set.

    Rows go by doc_id and text, so that a copy goes even where its doc_id also stands for another text. Of several
    rows with the doc_id and text that stay, one with the least hash of all columns stays. Rows without words or
    without a doc_id all stay; an empty table gives an empty result.
    """
    rows, whole = classes(docs, links=False, **settings)
    titles, places = docs.columns, by_place(docs)
    place = {c: F.col(f"c{titles.index(c)}") for c in ("doc_id", "text")}
    text = place["text"].cast("string")
    named = places.select(F.struct(*places.columns).alias("row"), place["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("mark"))
    often = rows.where("key is not null").groupBy("doc_id", "mark").agg(F.count("*").alias("rows"))
    stay = whole.where("first").select(F.col("set_id").alias("doc_id"), "mark").join(often, ["doc_id", "mark"])
    wordless = rows.where("key is null and doc_id is not null").select("doc_id", F.coalesce("mark", F.lit(b"")).alias("mark"), F.lit(1).cast("long").alias("rows")).distinct()
    found = named.join(stay.unionByName(wordless), ["doc_id", "mark"])
    once = found.where("rows = 1").select("row")
    repeated = found.where("rows > 1").groupBy("doc_id", "mark").agg(F.min_by("row", row_hash(places, "row.")).alias("row")).select("row")
    return once.unionByName(repeated).unionByName(named.where("doc_id is null").select("row")).select("row.*").toDF(*titles)
