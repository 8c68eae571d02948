"""Connected components of an edge table by alternating star contractions, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsieve.sources.workspace import Workspace


def components(edges: DataFrame, ws: Workspace, rounds: int = 64) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge table with long columns a and b.

    Each round links the larger neighbours of a node, and then its smaller ones, to its smallest neighbour. No neighbour
    list is ever gathered: both steps are a grouped minimum and a join, so a node with very many neighbours is
    pre-aggregated and its join can be split. Rounds are written as tables, which cuts the lineage.
    """
    state = ws.table(_canonical(edges.select("a", "b")), "edges")
    seen = _state(state)
    for _ in range(rounds):
        state = ws.table(_canonical(_small(_canonical(_large(state)))), "edges")
        now = _state(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _canonical(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node a to the smaller node b."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node, linked to the least of its neighbours and itself."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).union(least.select("a", "m")).toDF("a", "b")
