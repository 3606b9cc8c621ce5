"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_within(rows: DataFrame, keys: Sequence[str], id_col: str, values: Sequence[str], chunk: int = 1000,
                 drop: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows that agree on ``keys``, as columns ``<c>_l``/``<c>_r`` with the smaller id on the left.

    ``drop`` names the keys to leave out of the result (``values`` may repeat them).

    A group larger than ``chunk`` is cut into chunks and its pairs into a triangle of
    chunk x chunk cells, each joined on its own, so no task meets more than
    ``chunk`` x ``chunk`` pairs of one group. Every pair falls into exactly one cell.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > chunk)
    parts = F.coalesce(F.ceil(F.col("_size") / chunk), F.lit(1)).cast("int")
    cut = (
        rows.join(sizes, list(keys), "left")
        .withColumn("_parts", parts)
        .withColumn("_part", F.pmod(F.xxhash64(id_col), F.col("_parts")).cast("int"))
    )
    carried = [id_col, *values]
    left = cut.select(*keys, *[F.col(c).alias(f"{c}_l") for c in carried], F.col("_part").alias("_i"),
                      F.explode(F.sequence("_part", F.col("_parts") - 1)).alias("_j"))
    right = cut.select(*keys, *[F.col(c).alias(f"{c}_r") for c in carried], F.col("_part").alias("_j"),
                       F.explode(F.sequence(F.lit(0), "_part")).alias("_i"))
    joined = left.join(right, [*keys, "_i", "_j"]).where(
        (F.col("_i") != F.col("_j")) | (F.col(f"{id_col}_l") < F.col(f"{id_col}_r")))
    swap = F.col(f"{id_col}_l") > F.col(f"{id_col}_r")
    ordered = [
        F.when(swap, F.col(f"{c}_{b}")).otherwise(F.col(f"{c}_{a}")).alias(f"{c}_{a}")
        for c in carried for a, b in (("l", "r"), ("r", "l"))
    ]
    return joined.select(*[k for k in keys if k not in drop], *ordered)


def join_in_cells(left: DataFrame, right: DataFrame, keys: Sequence[str], chunk: int = 10000) -> DataFrame:
    """Inner equi-join in which hot keys are cut on both sides.

    A key with more than ``chunk`` rows on a side is cut into chunks there, and the rows
    of the other side visit every chunk: each cell holds at most ``chunk`` rows of either
    side. Other keys pass through one cell. Every matching pair is formed exactly once.

    Rows are placed by a hash of their values, which a repeated task reproduces; fold
    equal rows with ``counted_copies`` first so that copies do not share one chunk.
    """

    def parts(side: DataFrame, name: str) -> DataFrame:
        sizes = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk)
        return sizes.select(*keys, F.ceil(F.col("_n") / chunk).cast("int").alias(name))

    # One small aggregation tells whether anything is hot; mostly nothing is, and a plain join will do.
    cuts = parts(left, "_cut_l").join(parts(right, "_cut_r"), list(keys), "full_outer").na.fill(1, ["_cut_l", "_cut_r"])
    if cuts.isEmpty():
        return left.join(right, list(keys))

    def dealt(side: DataFrame, own: str, own_cell: str, other: str, other_cell: str) -> DataFrame:
        known = side.join(cuts, list(keys), "left").na.fill(1, ["_cut_l", "_cut_r"])
        place = F.pmod(F.xxhash64(*side.columns), F.col(own)).cast("int")
        visits = F.sequence(F.lit(0), F.col(other) - 1)
        return known.select(*side.columns, place.alias(own_cell), F.explode(visits).alias(other_cell))

    a = dealt(left, "_cut_l", "_i", "_cut_r", "_j")
    b = dealt(right, "_cut_r", "_j", "_cut_l", "_i")
    return a.join(b, [*keys, "_i", "_j"]).drop("_i", "_j")


def counted_copies(df: DataFrame, at_most: int = 10000) -> DataFrame:
    """Distinct rows with ``_copies``; a row with more than ``at_most`` copies is repeated with a part of them each."""
    folded = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_all"))
    last = F.ceil(F.col("_all") / at_most) - 1
    cut = folded.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    copies = F.least(F.lit(at_most).cast("long"), F.col("_all") - F.col("_part") * at_most)
    return cut.withColumn("_copies", copies).drop("_all")


def unfold_copies(df: DataFrame) -> DataFrame:
    """The inverse of ``counted_copies``."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copy", "_copies", "_part")
