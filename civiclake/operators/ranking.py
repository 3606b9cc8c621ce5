"""A rank over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civiclake.session import materialise


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with ``name``, 1 for the first row in ``order``; give an order without ties if the numbers must not depend on chance.

    Rows are dealt to ranges of the order and written with their range; each range numbers its own rows and adds the number of rows in
    the ranges before it, which are counted from that written table: one small row per range.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    placed = materialise(ranged, "ranges")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not rows
    offsets = sizes.select(F.col("_range"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.withColumn("_own", own).join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")
