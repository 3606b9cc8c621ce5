"""Files, layer tables, database options, streams and governance."""

import datetime as dt
import os

import pytest
from small import rows
from pyspark.sql import functions as F

from civiclake.operators import governance
from civiclake.operators.quality import accepted, record_drift
from civiclake.operators.text_index import candidates, indexed_search, write_postings
from civiclake.operators.point_in_time import at_event_time
from civiclake.session import scratch_path
from civiclake.sources import files, jdbc, lake
from civiclake.sources.buckets import BucketedTable
from civiclake.sources.history import History
from civiclake.streaming import feeds


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(
        b'Account Ref, Annual  Charge ,Name\r\n CT1 ,12.5,"Smith, J"\r\nCT2,-4,\r\n\r\nCT3,7\r\n')
    df = files.read_csv(spark, str(tmp_path / "a.csv"), ["annual_charge"])
    assert df.columns == ["account_ref", "annual_charge", "name"]
    assert rows(df) == [("CT1", 12.5, "Smith, J"), ("CT2", None, None), ("CT3", 7.0, None)]
    assert files.read_csv(spark, str(tmp_path / "a.csv"), None).schema["annual_charge"].dataType.simpleString() == "string"
    (tmp_path / "b.csv").write_text("A,B\n1,x\n2.5,y\n")
    assert rows(files.read_csv(spark, str(tmp_path / "b.csv"), None)) == [(1.0, "x"), (2.5, "y")]
    (tmp_path / "c.csv").write_text("A,B\n")
    assert files.read_csv(spark, str(tmp_path / "c.csv"), None).count() == 0


def test_geojson_collection(spark, tmp_path):
    (tmp_path / "w.geojson").write_text("""{"type": "FeatureCollection", "features": [
      {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 54.9]}, "properties": {"ward": "A"}},
      {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.6, 54.8]}, "properties": {"ward": "B"}}]}""")
    df = files.read_geojson(spark, str(tmp_path), "ward: string", collection=True)
    assert rows(df) == [("A", "Point", [1.5, 54.9]), ("B", "Point", [1.6, 54.8])]


def test_json_keeps_unreadable_lines(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"a": 1}\n{"a": "x"\n{"b": 2}\n')
    got = rows(files.read_json(spark, str(tmp_path), "a int").cache().select("a", F.col("_corrupt_record").isNotNull()))
    assert got == sorted([(1, False), (None, True), (None, False)], key=repr)


def test_database_options():
    db = jdbc.Database("jdbc:any:x", {"driver": "d", "fetchsize": "1000"})
    assert db.table_options("t", "id", 0, 100, 8) == {
        "url": "jdbc:any:x", "driver": "d", "fetchsize": "1000", "dbtable": "t", "partitionColumn": "id", "lowerBound": "0",
        "upperBound": "100", "numPartitions": "8"}
    assert jdbc.increment_query("t", "m", None) == "SELECT * FROM t"
    assert jdbc.increment_query("t", "m", dt.date(2024, 1, 2), "a, b") == "SELECT a, b FROM t WHERE m >= DATE '2024-01-02'"
    assert jdbc.sql_literal("O'Neil") == "'O''Neil'" and jdbc.sql_literal(3) == "3"
    assert jdbc.sql_literal(dt.datetime(2024, 1, 2, 3, 4, 5)).startswith("TIMESTAMP '2024-01-02 03:04:05")
    with pytest.raises(TypeError):
        jdbc.sql_literal(None)


def test_layer_table_is_created_then_merged(spark):
    root = scratch_path(spark, "layers")
    lake.ensure_layers(spark, root)
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("y", 20), ("z", 30)], "k string, v int")
    lake.create_or_merge(spark, "silver.t", a, ["k"], f"{root}/silver/t")
    lake.create_or_merge(spark, "silver.t", b, ["k"], f"{root}/silver/t")
    lake.create_or_merge(spark, "silver.t", b, ["k"], f"{root}/silver/t")
    assert rows(spark.table("silver.t")) == [("x", 1), ("y", 20), ("z", 30)]


def files_under(root):
    """Content of every data file by its path."""
    return {os.path.join(d, f): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_a_merge_rewrites_only_the_buckets_of_its_keys(spark):
    root = scratch_path(spark, "buckets")
    store = BucketedTable(spark, root, ["k"], 16)
    everything = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    assert store.merge(everything) == list(range(16))
    before, first = files_under(root), store.commit()
    source = spark.createDataFrame([(3, "new"), (5000, "new")], "k int, v string")  # keys of another width
    touched = store.merge(source)
    assert 1 <= len(touched) <= 2 and touched == sorted({r[0] for r in source.select(store.bucket(first.schema, 16)).collect()})
    after, second = files_under(root), store.commit()
    assert {p: after[p] for p in before} == before
    assert {b: v[:2] for b, (v, _) in second.at.items()} == {b: f"v{int(b in touched)}" for b in range(16)}
    untouched = [b for b in range(16) if b not in touched]
    assert set(store.paths(second, untouched)) == set(store.paths(first, untouched))
    assert rows(store.read()) == sorted([(k, "new" if k in (3, 5000) else "old") for k in [*range(1000), 5000]], key=repr)
    assert rows(store.read(first)) == rows(everything)  # the commit before can still be read
    assert store.merge(source.limit(0)) == [] and store.read().count() == 1001
    with pytest.raises(Exception, match="duplicate merge key"):
        store.merge(source.union(source))
    assert store.commits() == [0, 1, 2] and store.read().count() == 1001
    gone = store.vacuum()
    assert {p.rpartition("/")[2] for p in gone if "data/v0" in p} == {f"bucket={b}" for b in touched}
    assert store.commits() == [2] and store.read().count() == 1001
    store.merge(source)
    assert store.commits() == [2, 3] and store.read().count() == 1001


def test_merged_columns_may_be_added(spark):
    root = scratch_path(spark, "buckets")
    lake.create_or_merge(spark, "widening", spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), ["k"], root, 4)
    lake.create_or_merge(spark, "widening", spark.createDataFrame([(2, "c", 7)], "k long, v string, w int"), ["k"], root, 4)
    assert rows(spark.table("widening")) == [(1, "a", None), (2, "c", 7)]
    lake.create_or_merge(spark, "widening", spark.createDataFrame([(1, "d")], "k long, v string"), ["k"], root, 4)
    assert rows(spark.table("widening")) == [(1, "d", None), (2, "c", 7)]
    lake.create_or_merge(spark, "nothing", spark.createDataFrame([], "k long, v string"), ["k"], scratch_path(spark, "buckets"))
    assert spark.table("nothing").count() == 0


def test_partition_merge_leaves_other_partitions_alone(spark):
    path = scratch_path(spark, "parts")
    lake.append(spark.createDataFrame([("a", 1, 2020), ("b", 1, 2021), ("c", 1, 2021)], "k string, v int, y int"), path, ["y"])
    before = {r[0] for r in spark.read.parquet(path).where("y = 2020").select("_metadata.file_name").collect()}
    lake.merge_partitions(spark, path, spark.createDataFrame([("b", 9, 2021), ("d", 9, 2022)], "k string, v int, y int"), ["k"], "y")
    assert rows(spark.read.parquet(path).select("k", "v", "y")) == [("a", 1, 2020), ("b", 9, 2021), ("c", 1, 2021), ("d", 9, 2022)]
    assert {r[0] for r in spark.read.parquet(path).where("y = 2020").select("_metadata.file_name").collect()} == before


def test_a_key_that_changes_its_partition_leaves_the_old_one(spark):
    path = scratch_path(spark, "moving")
    spark.createDataFrame([("a", 1, 2020), ("b", 2, 2021), ("c", 3, 2021)], "k string, v int, y int").write.partitionBy("y").parquet(path)
    lake.merge_partitions(spark, path, spark.createDataFrame([("a", 9, 2021), ("b", 8, 2022)], "k string, v int, y int"), ["k"], "y")
    assert rows(spark.read.parquet(path).select("k", "v", "y")) == [("a", 9, 2021), ("b", 8, 2022), ("c", 3, 2021)]


def test_stage_log_counts_without_extra_jobs(spark):
    log = lake.StageLog()
    df = log.watch("in", spark.range(10).withColumn("at", F.lit("2024-01-01")), "at")
    out = log.watch("out", df.where("id > 3"))
    out.collect()
    assert log.entries() == [("in", 10, "2024-01-01"), ("out", 6, None)]


def test_streamed_state_equals_batch(spark):
    folder = scratch_path(spark, "in")
    df = spark.range(200).select((F.col("id") % 17).alias("k"), F.col("id").alias("t"))
    df.repartition(4).write.parquet(folder)
    state = feeds.VersionedState(spark, scratch_path(spark, "state"), ["k"], ["t"])
    checkpoint = scratch_path(spark, "cp")
    stream = feeds.file_stream(spark, folder, df.schema, files_per_batch=1)
    feeds.each_batch(stream, checkpoint, state.apply)
    want = rows(df.groupBy("k").agg(F.max("t")))
    assert rows(state.read()) == want
    state.apply(spark.read.parquet(folder), state.last)  # a replayed batch changes nothing
    assert rows(state.read()) == want


def test_streamed_state_leaves_other_buckets_alone(spark):
    state = feeds.VersionedState(spark, scratch_path(spark, "state"), ["k"], ["t"], buckets=8)
    state.apply(spark.range(500).select(F.col("id").alias("k"), F.lit(1).alias("t")), 0)
    before = files_under(state.table.root)
    state.apply(spark.createDataFrame([(7, 2), (8, 0)], "k long, t int"), 1)
    after = files_under(state.table.root)
    assert {p: after[p] for p in before} == before and len(after) - len(before) <= 3
    assert {r["k"]: r["t"] for r in state.read().collect() if r["k"] in (7, 8, 9)} == {7: 2, 8: 1, 9: 1}
    state.apply(spark.createDataFrame([(7, 9)], "k long, t int"), 1)  # the batch again, now with other rows
    assert {r["k"]: r["t"] for r in state.read().collect() if r["k"] in (7, 8)} == {7: 9, 8: 1}


def test_state_is_found_after_a_restart(spark):
    root = scratch_path(spark, "state")
    batch = spark.createDataFrame([("a", 1, "x")], "k string, t int, v string")
    first = feeds.VersionedState(spark, root, ["k"], ["t"])
    with pytest.raises(ValueError, match="no version"):
        first.read()
    first.apply(batch, 0)
    first.apply(batch.withColumn("t", F.col("t") + 1), 1)
    assert rows(feeds.VersionedState(spark, root, ["k"], ["t"]).read()) == [("a", 2, "x")]


def test_open_windows_are_in_the_log(spark):
    log = feeds.ChangeLog(spark, scratch_path(spark, "log"), ["k"])
    log.apply(spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int"), 0)
    log.apply(spark.createDataFrame([("a", 3)], "k string, n int"), 1)
    log.apply(spark.createDataFrame([("a", 3)], "k string, n int"), 1)
    assert rows(log.read()) == [("a", 3), ("b", 1)]


def test_stream_resumes_where_it_stopped(spark):
    folder, out, cp = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    spark.range(5).write.parquet(folder)
    stream = feeds.file_stream(spark, folder, "id bigint")
    feeds.drain(stream, out, cp)
    spark.range(5, 8).write.mode("append").parquet(folder)
    feeds.drain(feeds.file_stream(spark, folder, "id bigint"), out, cp)
    assert [r[0] for r in rows(spark.read.parquet(out))] == list(range(8))


CATALOGUE = "id string, name string, owner string, classification string, description string, lineage array<string>, columns array<struct<name:string,type:string,description:string,pii:boolean>>"


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame([
        ("tax", "Accounts", "Revenues", "official", "Liability and payments", ["source", "bronze", "silver"],
         [("liable_name", "VARCHAR(100)", "Full name of the LIABLE party", True), ("ward_code", "VARCHAR(9)", "ward", False)]),
        ("care", "Referrals", "Adult care", "sensitive", "Contacts", ["one"], [("hash", "VARCHAR(64)", None, True)]),
        ("empty", "Nothing", "Nobody", "public", "none", [], []),
    ], CATALOGUE)


def test_catalogue(catalogue):
    ids = lambda df: [r[0] for r in rows(df.select("id"))]
    assert ids(governance.search(catalogue, " liable ")) == ["tax"]
    assert ids(governance.search(catalogue, "SENSITIVE")) == ["care"]
    assert ids(governance.search(catalogue, "varchar")) == [] and ids(governance.search(catalogue, "bronze")) == []
    assert len(ids(governance.search(catalogue, "  "))) == 3
    flat = governance.search_flat(catalogue.drop("columns"), governance.dictionary(catalogue), "ward")
    assert ids(flat) == ["tax"]
    assert rows(governance.pii_register(catalogue)) == [("care", "sensitive", "hash"), ("tax", "official", "liable_name")]
    assert rows(governance.lineage_edges(catalogue, "lineage", "id")) == [
        ("tax", 0, "source", "bronze"), ("tax", 1, "bronze", "silver")]


def test_masking_profile_and_access(spark):
    df = spark.createDataFrame([("Ann Lee", "NE8", 1), ("Bo", None, 2)], "name string, ward string, n int")
    got = governance.masked(df, {"name": "mask", "ward": "null", "n": "hash"}).orderBy("name").collect()
    assert got[0]["name"] == "Xx" and got[1]["name"] == "Xxx Xxx" and got[0]["ward"] is None and len(got[0]["n"]) == 64
    prof = {r["column_name"]: r for r in governance.profile(df, distinct="exact").collect()}
    assert (prof["ward"]["n_null"], prof["n"]["greatest"], prof["name"]["n_distinct"]) == (1, "2", 2)
    rights = spark.createDataFrame([("east", "NE8"), ("east", "NE8")], "role string, ward string")
    assert rows(governance.secure_view(df, rights, "east", "ward", ["n"])) == [(1,)]
    assert governance.secure_view(df, rights, "west", "ward", ["n"]).count() == 0


def test_profiles_of_parts_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("k"), F.when(F.col("id") % 4 != 0, F.repeat(F.lit("x"), F.col("id").cast("int") % 90)).alias("t"), F.lit(None).cast("int").alias("none"))
    parts = governance.partial_profiles(df, F.pmod(F.col("k"), F.lit(7))).cache()
    assert parts.count() == 21
    whole = {r["column_name"]: r for r in governance.merged_profile(parts).collect()}
    exact = {r["column_name"]: r["n_distinct"] for r in governance.distinct_counts(df).collect()}
    assert exact == {"k": 5000, "t": len({i % 90 for i in range(20_000) if i % 4}), "none": 0}
    assert all(abs(whole[c]["n_distinct"] - n) <= max(2, 0.05 * n) for c, n in exact.items())
    assert (whole["t"]["n_rows"], whole["t"]["n_null"], whole["none"]["n_null"]) == (20_000, 5000, 20_000)
    assert whole["t"]["quartiles"] is None and whole["none"]["quartiles"] is None
    assert all(abs(q - 5000 * share) < 150 for q, share in zip(whole["k"]["quartiles"], (0.25, 0.5, 0.75)))
    some = governance.merged_profile(parts.where("part < 3")).where("column_name = 'k'").first()
    assert abs(some["n_distinct"] - 5000 * 3 / 7) < 150


def test_open_data_can_withhold_small_groups(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "w string, done boolean")
    assert rows(governance.open_data(df, ["w"], F.col("done"))) == [("a", 2, 50.0), ("b", 1, 100.0)]
    assert rows(governance.open_data(df, ["w"], F.col("done"), 2)) == [("a", 2, 50.0)]


def test_point_in_time_join(spark):
    d = dt.date
    dim = spark.createDataFrame([("k", "old", d(2020, 1, 1), d(2021, 1, 1)), ("k", "new", d(2021, 1, 1), None)],
                                "key string, v string, start_date date, end_date date")
    facts = spark.createDataFrame([("k", d(2020, 6, 1)), ("k", d(2021, 1, 1)), ("k", d(2019, 1, 1))], "key string, on date")
    assert rows(at_event_time(facts, dim, "key", "on").select("on", "v")) == [
        (d(2019, 1, 1), None), (d(2020, 6, 1), "old"), (d(2021, 1, 1), "new")]


def test_point_in_time_join_of_hot_keys(spark):
    """Hot keys are cut by time: versions reach every slice they are valid in, whatever the slices are."""
    start = dt.date(2020, 1, 1)
    days = lambda n: start + dt.timedelta(days=n)
    versions = [("hot", i, days(10 * i), days(10 * i + (10 if i % 7 else 6))) for i in range(1, 60)] + [("hot", 60, days(600), None), ("few", 1, days(5), None), (None, 9, days(0), None)]
    facts = [(i, "hot" if i % 3 else ["few", "none", None][i % 9 // 3], days(i % 900) if i % 50 else None) for i in range(2000)]
    dim = spark.createDataFrame(versions, "key string, v int, start_date date, end_date date")
    df = spark.createDataFrame(facts, "n int, key string, on date")

    def valid(key, on):
        return next((v for k, v, a, b in versions if key is not None and on is not None and k == key and a <= on and (b is None or on < b)), None)

    want = {n: valid(key, on) for n, key, on in facts}
    for hot_rows, slice_days in ((1_000_000, 30), (100, 30), (100, 1)):
        got = at_event_time(df, dim, "key", "on", hot_rows=hot_rows, slice_days=slice_days)
        assert got.columns == ["n", "key", "on", "v", "start_date", "end_date"]
        assert {r["n"]: r["v"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_as_of_opens_only_the_days_since_the_snapshot(spark):
    history = History(spark, scratch_path(spark, "history"), ["k"], "at", ["v"])
    rows_ = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * k + 5 * i), i) for k in range(6) for i in range(100)]
    df = spark.createDataFrame(rows_, "k int, at timestamp_ntz, v int")
    history.append(df)
    moments = [dt.datetime(2024, 1, 3, 5), dt.datetime(2024, 1, 12), dt.datetime(2024, 1, 12, 23, 59), dt.datetime(2023, 1, 1)]

    def want(m):
        newest = {}
        for k, at, v in sorted((r for r in rows_ if r[1] <= m), key=lambda r: r[1]):
            newest[k] = (k, at, v)
        return sorted(newest.values(), key=repr)

    without = [rows(history.as_of(m).select("k", "at", "v")) for m in moments]
    for day in (4, 9, 12):
        history.snapshot(dt.date(2024, 1, day))
    assert history.snapshots() == [dt.date(2024, 1, d) for d in (4, 9, 12)]
    assert without == [rows(history.as_of(m).select("k", "at", "v")) for m in moments] == [want(m) for m in moments]
    plan = history.as_of(moments[1])._jdf.queryExecution().executedPlan().toString()
    assert "landed" in plan and "2024-01-12" in plan and "2024-01-09" in plan and "PartitionFilters: [isnotnull(landed" in plan
    later, snapshot = history._since(dt.date(2024, 1, 12), inclusive=False)
    assert {str(r[0]) for r in later.select("landed").distinct().collect()} == {"2024-01-10", "2024-01-11", "2024-01-12"}
    assert all("on=2024-01-09" in f for f in snapshot.inputFiles())


def test_indexed_search_finds_what_a_scan_finds(spark):
    texts = ["The Licence", "licen", "no such word", None, "li", "LICENSE\nline", "ce lien", "éàü licences", "x" * 30_000 + " liCEn", "li cen"] + [f"entry {i}" for i in range(300)]
    df = spark.createDataFrame([(i, t, "a" if i % 2 else None) for i, t in enumerate(texts)], "id int, text string, owner string")
    path = scratch_path(spark, "postings")
    write_postings(df, "id", ["text", "owner"], path, buckets=8)
    for needle in ("licen", " LICEN ", "li", "", "éàü", "entry 29", "nothing at all", "e\nl"):
        folded = needle.strip().lower()
        want = [i for i, t in enumerate(texts) if not folded or folded in (t or "").lower() or (i % 2 and folded in "a")]
        assert [r[0] for r in rows(indexed_search(df, path, needle, "id", ["text", "owner"], 8).select("id"))] == sorted(want, key=lambda i: repr((i,)))
    found = candidates(spark, path, "licen", 8)
    assert found.count() == 5  # entries read and verified, of 310
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString()


def test_drift_of_single_records(spark):
    lines = ['{"a": 1, "b": "x"}', '{"a": null, "b": "x"}', '{"b": "x"}', '{"a": "q", "b": 2, "z": [1], "c": {}}', "{broken", "", '{"a": 1.5, "b": null}']
    expected = {"a": "int", "b": "string"}
    got = record_drift(spark.createDataFrame([(t,) for t in lines], "line string"), "line", expected).cache()
    assert [(r["drift"], r["dropped"], r["unknown"], r["mistyped"]) for r in got.collect()] == [
        ("ok", [], [], []), ("ok", [], [], []), ("drifted", ["a"], [], []), ("drifted", [], ["c", "z"], ["a"]),
        ("unreadable", None, None, None), ("unreadable", None, None, None), ("drifted", [], [], ["a"])]
    assert rows(accepted(got, "line", expected)) == sorted([(1, "x"), (None, "x")], key=repr)


def test_distinct_counts_digest_only_what_may_be_long(spark):
    from civiclake.operators import governance

    df = spark.sql("""select id, if(id % 5 = 0, null, id % 4) as few, cast(id % 6 as double) / 3 as part, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, id % 7) as at,
                      repeat(if(id % 2 = 0, 'x', 'y'), 100 + id % 3) as long_text, array(id % 9, 1) as items from range(200)""")
    short = ["id", "few", "part", "at"]
    got = {r["column_name"]: r["n_distinct"] for r in governance.distinct_counts(df).collect()}
    assert got == {"id": 200, "few": 4, "part": 6, "at": 7, "long_text": 6, "items": 9}
    plan = governance.distinct_counts(df.select(*short))._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan and "sha2" in governance.distinct_counts(df)._jdf.queryExecution().executedPlan().toString()
    profiles = governance.partial_profiles(df.select("at"), F.lit(0))._jdf.queryExecution().optimizedPlan().toString()
    assert profiles.count(" as string)") == 1
