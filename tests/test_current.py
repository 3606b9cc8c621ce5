"""Dedupe, upsert, history, increments and retention."""

import datetime as dt

import pytest
from small import rows
from pyspark.sql import functions as F

from civiclake.operators import current
from civiclake.operators.skew import counted_copies, join_in_cells, unfold_copies

DAY = "2024-05-01"


def history(spark):
    d = dt.date(2024, 1, 1)
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [("a", "y", d, None, True, t), ("b", "q", d, None, True, t), ("d", "w", d, None, True, t),
         ("a", "old", dt.date(2023, 1, 1), d, False, t)],
        "k string, v string, start_date date, end_date date, is_current boolean, _updated_at timestamp")


def source(spark):
    return spark.createDataFrame([("a", "x"), ("b", None), ("c", "z")], "k string, v string")


def short(df):
    return rows(df.select("k", "v", "is_current", F.col("start_date").cast("string"), F.col("end_date").cast("string")))


def test_history_closes_reopens_and_adds(spark):
    after = current.scd2(history(spark), source(spark), ["k"], ["v"], DAY)
    assert short(after) == sorted([
        ("a", "old", False, "2023-01-01", "2024-01-01"), ("a", "y", False, "2024-01-01", DAY), ("a", "x", True, DAY, None),
        ("b", "q", False, "2024-01-01", DAY), ("b", None, True, DAY, None), ("c", "z", True, DAY, None),
        ("d", "w", True, "2024-01-01", None)], key=repr)
    counts = current.scd2_counts(history(spark), after, ["k"], DAY).first()
    assert (counts["opened"], counts["new_keys"], counts["closed"]) == (3, 1, 2)


def test_history_rerun_changes_nothing_and_keeps_one_current(spark):
    once = current.scd2(history(spark), source(spark), ["k"], ["v"], DAY)
    twice = current.scd2(once, source(spark), ["k"], ["v"], "2024-06-01")
    assert short(once) == short(twice)
    assert twice.where("is_current").groupBy("k").count().where("count > 1").count() == 0


def test_history_without_null_safety_misses_changes_to_null(spark):
    after = current.scd2(history(spark), source(spark), ["k"], ["v"], DAY, null_safe=False)
    assert after.where("k = 'b'").count() == 1


def test_history_refuses_duplicate_keys(spark):
    twice = source(spark).unionByName(source(spark))
    with pytest.raises(Exception, match="duplicate merge key"):
        current.scd2(history(spark), twice, ["k"], ["v"], DAY).collect()


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 20), ("c", 30)], "k string, v int")
    once = current.upsert(target, new, ["k"])
    assert rows(once) == [("a", 1), ("b", 20), ("c", 30)]
    assert rows(current.upsert(once, new, ["k"])) == rows(once)


def test_upsert_refuses_duplicate_source_keys(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="duplicate merge key"):
        current.upsert(target, spark.createDataFrame([(1, "b"), (1, "c"), (2, "d")], "k int, v string"), ["k"]).collect()
    only_keys = spark.createDataFrame([(1,), (2,)], "k int")
    assert rows(current.upsert(only_keys, spark.createDataFrame([(2,), (3,)], "k int"), ["k"])) == [(1,), (2,), (3,)]


def test_latest_keeps_one_row_per_key_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    newest = current.latest_per_key(df, ["k"], ["t"])
    assert rows(newest) == [(0, 999), (1, 997), (2, 998)]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_increment(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 3)], "k string, m int")
    assert current.increment(df, "m", None).count() == 4
    assert rows(current.increment(df, "m", 2, ["k"])) == [("b", 3), ("c", 3)]
    assert current.increment(df, "m", 9).count() == 0
    control = spark.createDataFrame([("p", 2), ("q", 7)], "pipeline_name string, watermark_value int")
    assert rows(current.advance(control, "p", df, "m")) == [("p", 3), ("q", 7)]
    assert rows(current.advance(control, "p", df.where("m > 9"), "m")) == [("p", 2), ("q", 7)]
    assert rows(current.advance(control.where("pipeline_name = 'q'"), "p", df, "m")) == [("p", 3), ("q", 7)]
    assert current.watermark_of(control, "none") is None


def test_increment_equals_full_load(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 4), ("d", 4)], "k string, m int")
    first = current.latest_per_key(df.where("m <= 3"), ["k"], ["m"])
    mark = first.agg(F.max("m")).first()[0]
    merged = current.upsert(first, current.increment(df, "m", mark, ["k"]), ["k"])
    assert rows(merged) == rows(current.latest_per_key(df, ["k"], ["m"]))


def test_retention(spark):
    df = spark.createDataFrame(
        [(1, "2020-02-29", 1), (2, "2023-06-01", 1), (3, "1990-01-01", None), (4, None, 1)], "id int, d string, y int"
    ).withColumn("d", F.col("d").cast("date"))
    today = F.lit("2024-02-29").cast("date")
    assert [r[0] for r in rows(current.purge(df, "d", "y", today).select("id"))] == [2, 3, 4]
    audit = current.purge_audit(df, "d", "y", today, []).first()
    assert (audit["purged"], audit["kept"]) == (1, 3)


def test_as_of(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 9, "z")], "k string, at int, v string")
    assert rows(current.as_of(df, ["k"], F.lit(4), "at")) == [("a", 1, "x")]


def test_join_in_cells_equals_a_join(spark):
    left = spark.range(120).select(F.when(F.col("id") < 90, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(60).select(F.when(F.col("id") < 40, 0).otherwise(F.col("id") + 50).alias("k"), F.col("id").alias("b"))
    assert rows(join_in_cells(left, right, ["k"], chunk=7)) == rows(left.join(right, "k").select("k", "a", "b"))


def test_copies_fold_and_unfold(spark):
    df = spark.createDataFrame([("a",)] * 25 + [("b",)], "v string")
    folded = counted_copies(df, at_most=10)
    assert rows(folded.select("v", "_copies")) == [("a", 10), ("a", 10), ("a", 5), ("b", 1)]
    assert rows(unfold_copies(folded)) == rows(df)
