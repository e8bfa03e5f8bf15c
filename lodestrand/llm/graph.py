"""Connected components of links between numbers, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node that a link (u, v) names.

    Large-star and small-star steps alternate until every node has one link,
    to a node that is no one's child: each is a grouped minimum with partial
    sums and a join that Spark may split, so no node's neighbours are gathered,
    however many they are.  The result of each turn is written to the shared
    folder, so lineage stays short, and the one before it removed.  A link with
    a null end is none, and without links there is no row.
    """
    edges = edges.where("u <> v")  # nor is one with a null end
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct().persist()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, now = now, written(small, "stars")
        large.unpersist()
        discard(before)
    own = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)


def _are_stars(links: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    ends = links.groupBy("u").agg(F.count("*").alias("n")).select(F.col("u").alias("node"), F.col("n").alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("v").alias("node"), F.lit(0).cast("long").alias("up"), F.lit(1).alias("down")).distinct())
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()
