"""Connected components of an edge table by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each round is
two aggregations and two joins on the node; the number of rounds grows with the
logarithm of the longest chain. Each round is written to the shared folder, which cuts
the lineage and survives the loss of executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclake.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node."""
    current = materialise(edges.where(F.col(left) != F.col(right)).select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct(), "edges")
    seen = _fingerprint(current)
    for _ in range(max_rounds):
        current = materialise(_small_star(_large_star(current)), "edges")
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def extend_components(known: DataFrame, edges: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, component)`` after a batch of edges joins ``known`` components; earlier edges are not needed again.

    Each end of a new edge stands for its component, or for itself if it is new: components of that much smaller graph say which of the
    known ones merge. As a component is named by its smallest node, the result equals one run over all edges ever given. A component
    no new edge touches keeps its rows as they are.
    """
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct()
    for end in ("a", "b"):
        at = known.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        ends = ends.join(at, F.col(end) == F.col("_node"), "left").withColumn(f"_{end}", F.coalesce("_component", end)).drop("_node", "_component")
    ends = materialise(ends, "ends")
    merged = materialise(connected_components(ends, "_a", "_b"), "merged")
    moves = merged.select(F.col("node").alias("_from"), F.col("component").alias("_to"))
    kept = known.join(moves, known["component"] == F.col("_from"), "left").select("node", F.coalesce("_to", "component").alias("component"))
    # A new node stands for itself; one whose ends were known under one component already adds nothing.
    new = ends.select("a").unionAll(ends.select("b")).distinct().join(known.select(F.col("node").alias("a")), "a", "left_anti")
    added = new.join(moves, F.col("a") == F.col("_from"), "left").select(F.col("a").alias("node"), F.coalesce("_to", "a").alias("component"))
    return kept.unionByName(added)
