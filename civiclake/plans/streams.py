"""Streaming queries over the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiclake.functions.measures import money
from civiclake.plans.quality import RULES_SQL, suite
from civiclake.plans.registry import query
from civiclake.session import scratch_path
from civiclake.sources.domain import read, table
from civiclake.streaming import feeds


def _stream(spark, sf_dir, name):
    schema = read(spark, sf_dir, name).schema
    # The glob takes the table whether it is one file or a folder of part files.
    return feeds.file_stream(spark, f"{sf_dir.rstrip('/')}/{name}.parque[t]", schema)


@query("stream_ingest", "select event_id, user_id, event_type, value, 'events' as _source_system from events")
def stream_ingest(spark, sf_dir):
    """Events landed once each, with checkpointed progress."""
    out, marks = scratch_path(spark, "landed"), scratch_path(spark, "progress")
    stream = _stream(spark, sf_dir, "events").withColumn("_source_system", F.lit("events"))
    feeds.drain(stream, out, marks)
    return spark.read.parquet(out).select("event_id", "user_id", "event_type", "value", "_source_system")


@query("stream_daily_counts", """
    select cast(ts as date) as day, event_type, count(*) as n,
      cast(sum(cast(value as decimal(18,2))) as double) as total_value from events
    group by 1, 2""")
def stream_daily_counts(spark, sf_dir):
    """Daily counts per type, also of days whose window is still open."""
    log = feeds.ChangeLog(spark, scratch_path(spark, "daily"), ["day", "event_type"])
    counts = feeds.windowed_counts(_stream(spark, sf_dir, "events"), "ts", ["event_type"], total_value=money("value"))
    feeds.each_batch(counts, scratch_path(spark, "progress"), log.apply, mode="update")
    return log.read().withColumn("total_value", F.col("total_value").cast("double"))


@query("stream_upsert", """
    select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id
      order by ts desc, event_id desc) as rn from events) where rn = 1""")
def stream_upsert(spark, sf_dir):
    """Latest event per user, merged batch by batch from several arriving files."""
    landed = scratch_path(spark, "arrivals")
    read(spark, sf_dir, "events").repartition(4, "event_id").write.parquet(landed)
    stream = feeds.file_stream(spark, landed, spark.read.parquet(landed).schema, files_per_batch=1)
    state = feeds.VersionedState(spark, scratch_path(spark, "state"), ["user_id"], ["ts"], [F.col("event_id").desc()], buckets=8)
    feeds.each_batch(stream, scratch_path(spark, "progress"), state.apply)
    return state.read().select("user_id", "event_id", "event_type", "value")


@query("stream_dq_quarantine", f"""
    with {RULES_SQL}, broken as (select account_ref, string_agg(rule_id, ',' order by rule_id) as rules
      from long where not ok and severity = 'fail' group by 1)
    select account_ref, coalesce(rules, '') as rules from accounts left join broken using (account_ref)""")
def stream_dq_quarantine(spark, sf_dir):
    """Accounts scored per micro-batch: what was let through (no rules) and what was held back."""
    landed, clean, held = (scratch_path(spark, n) for n in ("arrivals", "clean", "held"))
    table(spark, sf_dir, "accounts").repartition(3, "account_ref").write.parquet(landed)
    stream = feeds.file_stream(spark, landed, spark.read.parquet(landed).schema, files_per_batch=1)
    feeds.each_batch(stream, scratch_path(spark, "progress"), feeds.quarantine_sink(suite(spark, sf_dir), clean, held))
    back = spark.read.parquet(held).select("account_ref", F.array_join("_dq_failed", ",").alias("rules"))
    return back.unionByName(spark.read.parquet(clean).select("account_ref", F.lit("").alias("rules")))
