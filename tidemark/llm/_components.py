"""Connected components of an edge table, by passing the least label along and jumping over known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import Scratch, stage


def _sum(edges: DataFrame) -> tuple:
    """Number and sum of hashes of an edge table, to tell whether a round changed it."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node that links reach. Hot nodes only meet sums.

    Large-star and small-star in turns until the edges are stars: every node's higher neighbours go to its least one,
    then its lower ones and itself. A node's neighbours are never gathered, only their least is, so that a node with
    very many does not fill a task.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.stage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    told = _sum(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: from each node, every higher neighbour is tied to the least one of all
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: the lower neighbours of a node, and itself, are tied to the least of them
        small = large.join(lower, "a")
        after = scratch.stage(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        told, before = _sum(after), told
        now = after
        if told == before:
            break
    out = stage(now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), "components")
    scratch.clear()
    return out
