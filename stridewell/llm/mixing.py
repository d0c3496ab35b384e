"""Mixing of sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, by_place, partitions, row_hash, word_count

#: Weights of the sources in the order of their names, repeated as often as needed.
WEIGHTS = (1.0, 2.0, 3.0)
#: A document is taken at most so many times.
EPOCHS = 3


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, share: float = 1.0) -> DataFrame:
    """One row a source with `target`, from rows (has_source, source, source_size).

    All sources share `share` of the summed sizes by weight; a target stops at epochs * source_size and the excess is
    shared by weight among the rest. With cap = epochs * size, that is target = least(cap, level * weight), where level
    is the largest of (total - caps of the sources with a smaller cap / weight) / (weights of the others).
    """
    named = W.orderBy(F.col("has_source").desc(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", F.col("has_source").desc(), "source").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.max(F.col("left") / F.col("rest")).over(everything))
    return s.withColumn("target", F.least("cap", F.col("level") * F.col("weight"))).select("has_source", "source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, buckets: int | None = None, size: Column | None = None) -> DataFrame:
    """All columns of docs and size, source_size, target and taken; earlier columns of those four names are replaced.

    Each source's documents are shuffled by a hash of the whole row; the finish time of a document's e-th copy is the
    cumulative size up to it (e whole passes included) divided by the source's target. Copies that start before time 1
    are put in the order of finish time, by ranges of time and then within each range, and taken until the total budget,
    the sum of the targets, is spent; the last one is taken in part. So a source is off its target by less than one
    document. Prefix sums run over (source, hash range) and over time ranges: two small tables of sums carry what
    passes from one range to the next, so that a source with a third of all rows is spread over all tasks.

    size: words of `text` if not given; null counts as 0. A null source is a source of its own, after all others. A
    document of size 0 has taken 0. Repeated rows are documents of their own. An empty input gives an empty result.
    Reruns agree: the order depends on the rows alone.
    """
    buckets = buckets or partitions(docs.sparkSession)
    docs = docs.withColumn("size", size if size is not None else word_count(F.col("text"))).drop("source_size", "target", "taken")
    titles, places = docs.columns, by_place(docs)
    at = {c: F.col(f"c{titles.index(c)}") for c in ("source", "size")}
    others = [c for c, title in zip(places.columns, titles, strict=True) if title != "size"]
    sized = places.select(
        F.struct(*others).alias("row"),
        at["source"].isNotNull().alias("has_source"),
        F.coalesce(at["source"].cast("string"), F.lit("")).alias("source"),
        F.coalesce(at["size"].cast("long"), F.lit(0)).alias("size"),
        row_hash(places.select(*others)).alias("h"),
    ).withColumn("bucket", F.pmod(F.shiftright("h", 17), F.lit(buckets)))
    return _mixed(sized, weights, epochs, buckets).select("row.*", "size", "source_size", "target", "taken").toDF(*[t for t in titles if t != "size"], "size", "source_size", "target", "taken")


def _mixed(sized: DataFrame, weights: tuple[float, ...], epochs: int, buckets: int) -> DataFrame:
    """sized: row, has_source, source, size, h, bucket."""
    key = ["has_source", "source", "bucket"]
    sums = sized.groupBy(*key).agg(F.sum("size").alias("bucket_size"))
    sources = targets(sums.groupBy("has_source", "source").agg(F.sum("bucket_size").alias("source_size")), weights, epochs)
    before = W.partitionBy("has_source", "source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ranges = sums.join(sources, ["has_source", "source"]).withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    order = W.partitionBy(*key).orderBy("h", "size")
    placed = sized.withColumn("at", F.row_number().over(order)).withColumn("cum", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.join(ranges.drop("bucket_size"), key).withColumn("cum", F.col("cum") + F.col("before"))
    copies = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    end = F.col("epoch") * F.col("source_size") + F.col("cum")
    copies = copies.withColumn("finish", F.when(F.col("target") > 0, end / F.col("target")).otherwise(F.lit(0.0)))
    #: A copy that starts at time 1 or later has no part in the mix; the first copy stays as the document's row.
    copies = copies.withColumn("words", F.when((F.col("target") > 0) & (end - F.col("size") < F.col("target")), F.col("size")).otherwise(F.lit(0)))
    copies = copies.where((F.col("words") > 0) | (F.col("epoch") == 0))
    when = F.when(F.col("words") == 0, F.pmod("h", F.lit(buckets))).otherwise(F.floor(F.least(F.col("finish"), F.lit(2.0)) * buckets))
    copies = copies.withColumn("span", when.cast("long"))
    spans = copies.groupBy("span").agg(F.sum("words").alias("span_words"))
    ahead = spans.withColumn("ahead", F.coalesce(F.sum("span_words").over(W.orderBy("span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("span_words")
    budget = sources.agg(F.round(F.sum("target")).cast("long").alias("budget")).withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(2 * buckets))))
    inside = W.partitionBy("span").orderBy("finish", "has_source", "source", "bucket", "at", "epoch").rowsBetween(W.unboundedPreceding, 0)
    ordered = copies.withColumn("upto", F.sum("words").over(inside)).join(ahead.join(budget, "span").withColumnRenamed("span", "span"), "span")
    spent = F.col("ahead") + F.col("upto") - F.col("words")
    ordered = ordered.withColumn("part", F.greatest(F.lit(0), F.least(F.col("words"), F.col("budget") - spent)))
    return ordered.groupBy(*key, "at").agg(F.first("row").alias("row"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("part").cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document; texts don't travel.

    A null text has size 0, a null source is a source; repeated rows are documents of their own; other columns are ignored; an empty table gives an empty result.
    """
    slim = docs.select("doc_id", "source", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), word_count(F.col("text")).alias("size"))
    return mix(slim, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_copies(docs: DataFrame, **settings) -> DataFrame:
    """Rows of docs as often as the mix takes them, all columns of whatever names and kinds; a part of a row keeps its first words, joined by one space.

    Only hashes and sizes are mixed; each different row then joins its copies, by two hashes of the row (128 bits).
    A null text or source is as in `mix`; a row without words is never taken; an empty input gives an empty result.
    """
    titles, places = docs.columns, by_place(docs)
    text = F.col(f"c{titles.index('text')}")
    keys = [row_hash(places, seed=k).alias(f"row{k + 1}") for k in range(2)]
    slim = places.select(F.col(f"c{titles.index('source')}").alias("source"), *keys, word_count(text).alias("words"))
    taken = mix(slim, size=F.col("words"), **settings).where("taken > 0").select("row1", "row2", "words", "taken")
    copies = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("words")))))
    rows = places.groupBy(*keys).agg(F.first(F.struct(*places.columns)).alias("row"))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("words")
    out = rows.join(copies.select("row1", "row2", F.when(left < F.col("words"), left.cast("int")).alias("left")), ["row1", "row2"]).select("row.*", "left")
    cut = F.array_join(F.slice(F.array_remove(F.split(text, SPACES), ""), F.lit(1), F.col("left")), " ")
    kept = F.when(F.col("left").isNotNull(), cut).otherwise(text)
    return out.select(*[kept.alias(c) if t == "text" else F.col(c) for c, t in zip(places.columns, titles, strict=True)]).toDF(*titles)
