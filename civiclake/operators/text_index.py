"""Substring search by trigram postings: only entries that hold all trigrams of the text sought are read and verified."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclake.functions.text import contains_folded

GRAM = 3


def _grams(text: Column) -> Column:
    """The different overlapping trigrams of a text in lower case, found in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def write_postings(entries: DataFrame, id_col: str, fields: Sequence[str], path: str, buckets: int = 64) -> None:
    """``gram, id`` of all ``fields``, in folders by a hash of the gram: a search opens only the folders of its own grams."""
    grams = F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(_grams(F.col(c)), F.array().cast("array<string>")) for c in fields]))))
    postings = entries.select(grams.alias("gram"), F.col(id_col).alias("id"))
    postings.withColumn("bucket", _bucket(F.col("gram"), buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def candidates(spark: SparkSession, path: str, needle: str, buckets: int = 64) -> DataFrame:
    """``id`` of the entries that hold every trigram of ``needle`` somewhere. A gram's postings are counted where they lie before any is sent."""
    sought = sorted({needle[i:i + GRAM] for i in range(len(needle) - GRAM + 1)})
    numbers = spark.range(1).select(F.array(*[_bucket(F.lit(g), buckets) for g in sought])).first()[0]
    postings = spark.read.parquet(path).where(F.col("bucket").isin(sorted(set(numbers))) & F.col("gram").isin(sought))
    return postings.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(sought)).select("id")


def indexed_search(entries: DataFrame, path: str, text: str, id_col: str, fields: Sequence[str], buckets: int = 64) -> DataFrame:
    """Entries with ``text`` in one of ``fields``, as a scan would find them: case and outer blanks ignored, an empty search returns all.

    A text of under three characters has no trigram and is looked for by a scan.
    """
    needle = text.strip().lower()
    if not needle:
        return entries
    holds = reduce(lambda a, b: a | b, [F.coalesce(contains_folded(c, needle), F.lit(False)) for c in fields])
    if len(needle) < GRAM:
        return entries.where(holds)
    found = candidates(entries.sparkSession, path, needle, buckets).withColumnRenamed("id", "_id")
    return entries.join(found, F.col(id_col) == F.col("_id"), "left_semi").where(holds)
