"""Incremental processing with Structured Streaming: landing, counting, upserting, quarantine."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from civiclake.operators.current import latest_per_key
from civiclake.operators.quality import Suite
from civiclake.session import materialise
from civiclake.sources.buckets import BUCKETS, BucketedTable


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None,
                name_filter: str | None = None) -> DataFrame:
    """Parquet files arriving in a folder (or matching a glob), each read once."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if name_filter is not None:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(folder)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
          partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Write everything available now and stop; the checkpoint takes the place of a control table."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def each_batch(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    query = (
        stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def windowed_counts(stream: DataFrame, stamp: str, by: Sequence[str], window: str = "1 day", late: str = "1 day",
                    **measures: Column) -> DataFrame:
    """Counts per event-time window; rows later than ``late`` no longer change closed windows."""
    timed = stream.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late)
    counted = timed.groupBy(F.window(stamp, window), *by).agg(F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in measures.items()])
    return counted.select(F.col("window.start").cast("date").alias("day"), *by, "n", *measures)


class ChangeLog:
    """Changed rows of a keyed aggregate, one folder per micro-batch; a replayed batch rewrites its own folder.

    ``read`` gives the newest row of each key, so windows that are still open are in the result as well.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str]) -> None:
        self.spark, self.root, self.keys = spark, root, list(keys)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")

    def read(self) -> DataFrame:
        return latest_per_key(self.spark.read.parquet(self.root), self.keys, ["batch"]).drop("batch")


class VersionedState:
    """The newest row of each key, in hash buckets under ``root``: a micro-batch rewrites only the buckets its keys fall in.

    Batch ``n`` is commit ``n`` and always starts from the commit before it, so a replayed batch gives the same state.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], newest_by: Sequence[str],
                 ties: Sequence[str | Column] = (), buckets: int = BUCKETS) -> None:
        self.table = BucketedTable(spark, root, keys, buckets)
        self.keys, self.newest_by, self.ties = list(keys), list(newest_by), list(ties)
        self.last: int | None = None

    def newest(self) -> int | None:
        """The newest complete commit in storage: what a restarted process goes on from."""
        return max(self.table.commits(), default=None)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        self.table.merge(batch, lambda old, new: latest_per_key(old.unionByName(new), self.keys, self.newest_by, self.ties), batch_id)
        self.last = batch_id

    def read(self) -> DataFrame:
        return self.table.read(None if self.last is None else self.table.commit(self.last + 1))


def quarantine_sink(suite: Suite, clean: str, held: str) -> Callable[[DataFrame, int], None]:
    """Splits each micro-batch into rows that pass and rows to hold, under the batch's own folders."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The rules are evaluated once; both sinks read what came of it.
        marked = materialise(suite.flagged(batch), "flagged")
        marked.where(F.size("_dq_failed") == 0).drop("_dq_failed").write.mode("overwrite").parquet(f"{clean}/batch={batch_id}")
        marked.where(F.size("_dq_failed") > 0).write.mode("overwrite").parquet(f"{held}/batch={batch_id}")

    return handle
