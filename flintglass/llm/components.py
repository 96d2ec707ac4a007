"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flintglass.llm.store import Scratch


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Links neighbours to the least of a node and its neighbours: larger ones only, or the node and smaller ones only.

    The minima are written first: Spark splits the rows of a node with many neighbours only in joins of tables, not of aggregates.
    """
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = scratch.keep(out.filter("a <> b").distinct())
    scratch.drop(least)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component: the least node reachable, for each node of edges a, b (longs) that isn't the least itself.

    Minima are combined before the shuffle, and adaptive execution splits the joins' rows of a node with many
    neighbours (in tasks of spark.sql.adaptive.advisoryPartitionSizeInBytes). Each step is written to the shared folder.
    """
    digest = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = digest(now)
    while before[0]:
        large = _star(now, True, scratch)
        then = _star(large, False, scratch)
        after = digest(then)
        scratch.drop(now, large)
        now = then
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
