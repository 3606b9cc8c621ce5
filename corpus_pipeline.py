"""From raw documents to packed token rows: five stages, each written as Parquet and read again by the next.

Quality rules drop what they reject, the Jaccard join keeps one document of each group of near copies, decontamination drops
documents that hold a benchmark item, mixing repeats sources towards their weights (every document at least once) and packing
writes token ids. All but the last return the columns of ``documents``; rows that a stage keeps are not altered.
An empty input stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from civiclake.llm import decontaminate, jaccard_join, mixing, packing, quality_rules
from civiclake.llm.queries import VOCABULARY
from civiclake.llm.registry import table
from civiclake.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    judged, _ = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    return judged.where("_kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return jaccard_join.one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage within 20 % word edits of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for."""
    read, _ = mixing.mix_sources(docs)
    return read.select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of 2,048 token ids."""
    return packing.pack(docs, VOCABULARY)


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixture), ("packing", packed)]
#: The join, the learned rules and the vocabulary are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
