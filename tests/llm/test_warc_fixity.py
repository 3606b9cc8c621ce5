import os

import pytest
from compare import check_engine, compare
from pyspark.sql import functions as F

from civiclake.llm import queries
from civiclake.llm import warc_fixity as W
from civiclake.session import materialise

PAGES = [(1, "http://a", "x" * 300), (2, None, "é" * 50), (None, "http://c", None), (3, "http://d", "y" * 200_000), (4, "u", "same"), (4, "u", "same")]
PAGES += [(10 + i, f"http://h/{i}", f"page {i} " * (i % 40)) for i in range(300)]


@pytest.fixture(scope="module")
def replica(spark):
    df = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, file string, offset int")
    return materialise(W.archive(df, file_bytes=100_000), "replica")


def test_records_fill_their_files_in_order(replica):
    files: dict = {}
    for r in replica.collect():
        files.setdefault(r["file"], []).append((r["offset"], r["length"], bytes(r["record"])))
    assert sum(map(len, files.values())) == len(PAGES) and len(files) > 1
    for rows in files.values():
        at = 0
        for offset, length, record in sorted(rows):
            assert offset == at and length == len(record) and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            head, _, body = record.partition(b"\r\n\r\n")
            assert int(head.rpartition(b"Content-Length: ")[2]) == len(body) - 4
            at += length


def test_equal_replicas_have_equal_roots(replica):
    assert W.audit(replica, replica.repartition(7), range_bytes=2000, fan=2).count() == 0


def test_every_fault_is_found_and_nothing_else(replica):
    rows = {r["id"]: r for r in replica.where("id >= 10").collect()}
    at, n = F.col("id"), F.length("record")
    other = replica.where("id is null or id not in (20, 21)").withColumn("record", F.when(
        at == 30, F.expr("concat(substring(record, 1, 40), cast('~' as binary), substring(record, 42))")).when(
        at == 31, F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record"))).withColumn("length", n.cast("long"))
    extra = replica.where("id = 40").withColumn("offset", F.lit(10_000_000).cast("long")).withColumn("id", F.lit(77).cast("long"))
    both = W.audit(replica, materialise(other.unionByName(extra), "other"), range_bytes=2000, fan=2).collect()
    got = {(r["id"], r["kind"]) for r in both}
    assert got == {(20, "missing"), (21, "missing"), (30, "changed"), (31, "resized"), (77, "extra")} and len(both) == 5
    assert all(r["offset"] == rows[r["id"]]["offset"] for r in both if r["id"] != 77)


def test_empty_replicas(replica):
    none = replica.limit(0)
    assert W.audit(none, none).count() == 0
    assert W.audit(replica, none, range_bytes=2000).count() == len(PAGES)


def test_many_equal_rows_fill_several_files(spark):
    df = spark.createDataFrame([(1, "u", "x" * 500)] * 900 + [(None, "u", "y" * 500)] * 5 + [(2, "v", "z")], "page_id long, url string, html string")
    rows = W.archive(df, file_bytes=40_000).collect()
    assert len(rows) == 906 and sum(r["id"] is None for r in rows) == 5
    files: dict = {}
    for r in rows:
        files.setdefault(r["file"], []).append((r["offset"], r["length"], bytes(r["record"])))
    assert len(files) > 5 and max(sum(n for _, n, _ in held) for held in files.values()) < 8 * 40_000
    for held in files.values():
        at = 0
        for offset, length, record in sorted(held):
            assert offset == at and length == len(record)
            at += length


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_finds_faults_of_each_kind_at_every_scale(spark, sf):
    found = queries.QUERIES["op10_warc_fixity"](spark, f"/root/testdata/{sf}").collect()
    assert {r["kind"] for r in found} == {"changed", "resized", "missing"}


def test_query_equals_its_sql(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    assert compare(spark, check_engine(sf), queries.QUERIES["op10_warc_fixity"], queries.ORACLES["op10_warc_fixity"], sf) is None
