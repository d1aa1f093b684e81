"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placard.session import written


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``id`` and ``root`` (the smallest id of its component) of every node of ``links(a, b)``.

    Each round hangs larger neighbours on the smallest one and then smaller ones on theirs, so paths shrink to stars in
    a number of rounds that grows with the logarithm of their length. Minima are partly aggregated before each
    shuffle and the joins may be split by the engine where a node has very many links. Links from a node to itself
    and nulls are ignored; no links give no rows.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "links")
    for _ in range(most_rounds):
        if not _unsettled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        edges = written(hung.filter("u > v").distinct(), "stars")
    else:
        raise RuntimeError("the components did not settle")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _unsettled(edges: DataFrame) -> bool:
    """Whether a node hangs on two others, or on one that hangs on another."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return bool(ends.groupBy("x").agg(F.sum("up").alias("ups"), F.max("down").alias("down")).filter("ups > 1 OR ups > 0 AND down > 0").take(1))
