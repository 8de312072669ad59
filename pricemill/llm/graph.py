"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Rounds after which the input is taken to be broken; a round at least halves what is left of a path.
MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the least node of its component.

    Alternating large-star and small-star steps; each is one grouped minimum (combined before the
    shuffle) and one join, so a node with very many edges never stands alone in a task. Only the
    digest of the edge set comes to the driver, to see whether a round changed anything.
    """
    edges = stored(_canonical(edges), "edges")
    before = _digest(edges)
    for _ in range(MOST_ROUNDS):
        for step in (_large_star, _small_star):
            edges = step(edges)
        after = _digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _digest(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _canonical(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger end a to its smaller end b."""
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ends.where("a <> b").distinct()


def _moved(edges: DataFrame, arcs: DataFrame, least: DataFrame, more: bool) -> DataFrame:
    """Each arc (a, b) as (b, least of a), stored in place of edges. The minima are a table by then, so that
    Spark can split the arcs of a node that has very many."""
    least = stored(least, "least")
    out = arcs.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if more:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    out = stored(_canonical(out), "edges")
    discard(edges, least)
    return out


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _moved(edges, both.where("b > a"), least, False)


def _small_star(edges: DataFrame) -> DataFrame:
    return _moved(edges, edges, edges.groupBy("a").agg(F.min("b").alias("m")), True)
