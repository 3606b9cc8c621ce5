"""Layer tables on parquet: append, evolving schema, bucketed merge, views and stage logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from civiclake.operators.current import upsert
from civiclake.session import materialise
from civiclake.sources.buckets import BUCKETS, BucketedTable


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Add rows to a bronze path; partition by ingest date so later reads can skip old days."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """All appended files under the union of their schemas."""
    return spark.read.option("mergeSchema", True).parquet(path)


def ensure_layers(spark: SparkSession, root: str, layers: Sequence[str] = ("bronze", "silver", "gold")) -> None:
    for layer in layers:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer} LOCATION '{root}/{layer}'")


def create_or_merge(spark: SparkSession, table: str, source: DataFrame, keys: Sequence[str], root: str, buckets: int = BUCKETS) -> list[int]:
    """Create ``table`` from ``source``, or merge ``source`` into it by key; returns the buckets written.

    The rows lie in hash buckets under ``root`` and a merge rewrites only those its keys fall in. ``table`` is a view over
    the files in use, replaced in one step once they are complete, so readers see the state before or after.
    """
    store = BucketedTable(spark, root, keys, buckets)
    written = store.merge(source)
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS {store.as_sql()}")
    return written


def merge_partitions(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], partition: str) -> None:
    """Merge ``source`` by key into a partitioned path, rewriting only the partitions it touches.

    Touched are the partitions of the source rows and those that hold their keys now, so a row whose partition changes
    leaves the old one; only keys and partitions of the target are read to find them. They are replaced in one commit.
    A partition that loses its last row is deleted after it, since overwriting by partition leaves such a one alone.
    """
    target = spark.read.parquet(path)
    now = target.select(partition, *keys).join(source.select(*keys), list(keys), "left_semi").select(partition)
    touched = materialise(source.select(partition).unionByName(now).distinct(), "touched")
    affected = target.join(touched, partition, "left_semi")
    merged = materialise(upsert(affected, source, keys), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    emptied = touched.join(merged.select(partition).distinct(), touched[partition].eqNullSafe(merged[partition]), "left_anti")
    folders = spark.sparkContext._jvm.org.apache.hadoop.fs
    for row in emptied.collect():  # partitions, not rows
        value = "__HIVE_DEFAULT_PARTITION__" if row[0] is None else str(row[0])
        folder = folders.Path(f"{path}/{partition}={value}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def publish_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


class StageLog:
    """Row counts per pipeline stage, gathered while the stages run instead of by extra jobs."""

    def __init__(self) -> None:
        self._stages: list[tuple[str, Observation]] = []

    def watch(self, stage: str, df: DataFrame, stamp: str | None = None) -> DataFrame:
        seen = Observation(f"stage_{len(self._stages)}_{stage}")
        self._stages.append((stage, seen))
        newest = [] if stamp is None else [F.max(stamp).cast("string").alias("newest")]
        return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *newest)

    def entries(self) -> list[tuple[str, int, str | None]]:
        """``(stage, rows, newest record)``; available once the job that ran the stages is done."""
        return [(name, seen.get["n_rows"], seen.get.get("newest")) for name, seen in self._stages]
