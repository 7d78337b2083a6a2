"""Connected components by alternating large-star and small-star (Kiveris et al., 2014) on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links lead from a larger id a to a smaller id b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, tables: Tables, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links(a, b); a component is named by its smallest node.

    Self links and null ends are ignored, repeated links count once, an empty table gives an empty one. Each round is
    written to the shared folder; nothing but two counts reaches the driver.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = tables.write(now, "links")
    for _ in range(rounds):
        now = tables.write(_small_star(_large_star(now)), "stars")
        roots = now.select(F.col("b").alias("a")).distinct()
        chained = now.join(roots, "a", "left_semi").select(F.lit(1).alias("x")).limit(1)
        doubled = now.groupBy("a").count().where("count > 1").select(F.lit(1).alias("x")).limit(1)
        if not chained.union(doubled).take(1):
            break
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
