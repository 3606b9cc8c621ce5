"""Facts with the dimension version that was valid on their date, by one sorted pass instead of a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def at_event_time(facts: DataFrame, dimension: DataFrame, key: str, event_date: str, start: str = "start_date", end: str = "end_date",
                  hot_rows: int = 1_000_000, slice_days: int = 30) -> DataFrame:
    """Each fact with the columns of the version of its key valid on its date (start inclusive, end exclusive), or with NULLs.

    Facts and versions of a key are sorted together by time, and each fact takes the last version before it: no fact meets
    more than one version. Versions of a key must not overlap, as in a type-2 history. A key with more than ``hot_rows`` facts is cut
    into slices of ``slice_days``; its versions are put into every slice between their start and end that has facts to come. Facts without
    key or date match nothing and stay out of the sort.
    """
    carried = [c for c in dimension.columns if c != key]
    kinds = {f.name: f.dataType for f in dimension.schema}
    fact = F.struct(*[F.col(c) for c in facts.columns])
    slices = F.floor(F.unix_date(F.col(event_date).cast("date")) / slice_days)
    hot = facts.where(F.col(event_date).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(slices).alias("_first"), F.max(slices).alias("_last")).where(
        (F.col("_n") > hot_rows) & F.col("_key").isNotNull()).drop("_n")

    known = facts.where(F.col(key).isNotNull() & F.col(event_date).isNotNull())
    dated = known.select(F.col(key).alias("_key"), fact.alias("_fact"), F.col(event_date).cast("timestamp").alias("_time"), slices.alias("_slice"))
    dated = dated.join(hot.select("_key", F.lit(True).alias("_hot")), "_key", "left").withColumn(
        "_slice", F.when(F.col("_hot"), F.col("_slice")).otherwise(F.lit(0))).drop("_hot")
    versions = dimension.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.struct(*carried).alias("_version"), F.col(start).cast("timestamp").alias("_time"),
        F.floor(F.unix_date(F.col(start).cast("date")) / slice_days).alias("_from"), F.floor(F.unix_date(F.col(end).cast("date")) / slice_days).alias("_to"))
    low, high = F.greatest("_from", "_first"), F.least(F.coalesce("_to", "_last"), "_last")
    reach = F.when(F.col("_last").isNull(), F.array(F.lit(0).cast("long"))).when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))
    versions = versions.join(hot, "_key", "left").withColumn("_slice", F.explode(reach)).select("_key", "_version", "_time", "_slice")
    both = dated.unionByName(versions, allowMissingColumns=True)
    # On one date a version comes before the facts, and of versions that begin together the one that ends last.
    order = ["_time", F.col("_fact").isNotNull(), F.col(f"_version.{end}").asc_nulls_last()]
    past = Window.partitionBy("_key", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_at", F.last("_version", ignorenulls=True).over(past)).where(F.col("_fact").isNotNull())
    valid = F.col(f"_at.{end}").isNull() | (F.col("_time") < F.col(f"_at.{end}").cast("timestamp"))
    matched = found.select("_fact.*", *[F.when(valid, F.col(f"_at.{c}")).alias(c) for c in carried])
    others = facts.where(F.col(key).isNull() | F.col(event_date).isNull())
    return matched.unionByName(others.select(*facts.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in carried]))
