"""Connected components of links, by alternating stars of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, tables, written


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node and root (the smallest node of its component) of each node of links (a, b), both long and not null.

    Each round links the larger neighbours of a node, then its smaller ones, to the smallest; the links of a round are
    written to the shared folder and removed after the next. Nodes with many links are aggregated before they are shuffled, and joined in a way
    that Spark can split. Ends when a round changes nothing, which takes about the logarithm of the longest path.
    """
    a, b = F.col("a"), F.col("b")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    spark = links.sparkSession
    before = tables()
    now = written(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    was = state(now)
    for _ in range(rounds):
        if not was[0]:
            break
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        far = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = far.groupBy("a").agg(F.min("b").alias("m"))
        near = far.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        old = [t for t in tables() if t not in before]
        now = written(near.distinct(), "links")
        removed(spark, old)
        if (new := state(now)) == was:
            break
        was = new
    else:
        raise RuntimeError(f"components haven't settled in {rounds} rounds")
    return now.select(a.alias("node"), b.alias("root")).unionByName(now.select(b.alias("node"), b.alias("root")).distinct())
