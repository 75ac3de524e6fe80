"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import Workspace, forget_shuffles
from corpuslab.session import staged


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``, named by its least node.

    Alternating large-star and small-star steps: each node's neighbours move to the least of
    them, first those above it, then those below. Nothing is gathered per node, only minima
    are joined back, so a hub with any number of edges is a skewed join that adaptive
    execution splits. Ends when all edges are stars, which a round would not change (about the log of
    the diameter). Both steps are written, and what a round shuffled and sent along is let go with its
    tables: the driver would otherwise hold the plans and broadcasts of all rounds.
    """
    spark = edges.sparkSession
    work = Workspace(spark)
    current = work.staged(_directed(edges), "edges")
    while not _only_stars(current):
        earlier, work = work, Workspace(spark)
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        larger = both.where(F.col("b") > F.col("a")).join(least, "a")
        starred = work.staged(
            _directed(larger.select(F.col("b").alias("a"), F.col("m").alias("b"))), "starred")
        low = starred.groupBy("a").agg(F.min("b").alias("m"))
        smaller = starred.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = work.staged(
            _directed(smaller.union(low.select("a", F.col("m").alias("b")))), "edges")
        earlier.clear()
        forget_shuffles(spark)
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select("b").distinct().select(
        F.col("b").alias("node"), F.col("b").alias("component"))
    out = staged(members.union(roots), "components")
    work.clear()
    return out


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one, which has none itself."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(
        "up > 1 or (up = 1 and down = 1)").isEmpty()


def _directed(edges: DataFrame) -> DataFrame:
    """Every edge once, from the larger node to the smaller."""
    return edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
