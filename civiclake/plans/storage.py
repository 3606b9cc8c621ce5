"""Round trips through files and layer tables in the shared folder."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from civiclake.functions import text
from civiclake.operators import current
from civiclake.operators.quality import record_drift
from civiclake.operators.text_index import indexed_search, write_postings
from civiclake.plans.council_tax import LINE_TIES, EARLIER, LATER, ORDER_STATES_SQL, collection_summary, order_states
from civiclake.plans.registry import ORACLES, query
from civiclake.session import scratch_path
from civiclake.sources import files, lake
from civiclake.sources.domain import read, table
from civiclake.sources.history import History


@query("io_csv_typed", """
    select account_ref, nullif(title, '') as title, liable_name, nullif(surname, '') as surname,
           case when annual_charge >= 0 then annual_charge end as annual_charge,
           case when balance_outstanding >= 0 then balance_outstanding end as balance_outstanding from accounts""")
def io_csv_typed(spark, sf_dir):
    """Accounts written as CSV with untidy headers, read back tidy and typed."""
    path = scratch_path(spark, "csv")
    table(spark, sf_dir, "accounts").select(
        F.col("account_ref").alias(" Account Ref"), F.col("title").alias("Title "),
        F.concat(F.lit("  "), "liable_name").alias("Liable  Name"), F.col("surname").alias("SURNAME"),
        F.col("annual_charge").alias("Annual Charge"), F.col("balance_outstanding").alias("Balance Outstanding"),
    ).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return files.read_csv(spark, path, ["annual_charge", "balance_outstanding"])


@query("io_csv_sniffed", """
    select account_ref, nullif(title, '') as title, cast(c_custkey as double) as customer_number, cast(1000 + 10 * (c_custkey % 100) as double) as charge_in_pounds,
           case when c_custkey % 3 = 0 then cast(-c_custkey as string) else cast(c_custkey as string) end as movement from accounts""")
def io_csv_sniffed(spark, sf_dir):
    """Accounts as CSV whose numeric columns are found by reading their cells: one with negative cells stays text, as unsigned numbers only count."""
    path, n = scratch_path(spark, "csv"), F.col("c_custkey")
    table(spark, sf_dir, "accounts").select(
        F.col("account_ref").alias(" Account Ref"), "title", n.alias("Customer Number"), (1000 + 10 * (n % 100)).alias("Charge  in Pounds"),
        F.when(n % 3 == 0, -n).otherwise(n).alias("Movement")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return files.read_csv(spark, path, None)


@query("io_json_geo", """
    select account_ref, ward_code, 'Point' as geometry_type, cast(c_custkey % 180 as double) as lon,
           cast(c_custkey % 90 as double) as lat from accounts""")
def io_json_geo(spark, sf_dir):
    """Accounts written as one GeoJSON feature per line and read back against a fixed schema."""
    path = scratch_path(spark, "geo")
    point = F.array((F.col("c_custkey") % 180).cast("double"), (F.col("c_custkey") % 90).cast("double"))
    table(spark, sf_dir, "accounts").select(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), point.alias("coordinates")).alias("geometry"),
        F.struct("account_ref", "ward_code").alias("properties")).write.json(path)
    found = files.read_geojson(spark, path, "account_ref: string, ward_code: string")
    return found.select("account_ref", "ward_code", "geometry_type", F.element_at("coordinates", 1).alias("lon"),
                        F.element_at("coordinates", 2).alias("lat"))


@query("io_json_feed", "select event_id, user_id, event_type, value, cast(props->>'k' as bigint) as k from events")
def io_json_feed(spark, sf_dir):
    """Events as a JSON-lines feed; unreadable lines would surface in _corrupt_record."""
    path = scratch_path(spark, "json")
    read(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", F.from_json("props", "k bigint").alias("props")).write.json(path)
    feed = files.read_json(spark, path, "event_id bigint, user_id bigint, event_type string, value double, props struct<k: bigint>")
    return feed.where("_corrupt_record is null").select("event_id", "user_id", "event_type", "value", "props.k")


@query("io_schema_evolution", """
    select c_custkey as id, c_name as name, cast(null as double) as balance, 'customer' as origin from customer
    union all select s_suppkey, s_name, s_acctbal, 'supplier' from supplier""")
def io_schema_evolution(spark, sf_dir):
    """Two appends, the second with a column the first lacked, partitioned by origin."""
    path = scratch_path(spark, "evolving")
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    suppliers = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    lake.append(customers.withColumn("origin", F.lit("customer")), path, ["origin"])
    lake.append(suppliers.withColumn("origin", F.lit("supplier")), path, ["origin"])
    return lake.read_evolving(spark, path).select("id", "name", "balance", "origin")


@query("io_create_or_merge", f"""
    with {ORDER_STATES_SQL}
    select account_key, state, band, charge, changed_on from states where fresh union all
    select account_key, state, band, charge, changed_on from states t where not fresh
      and not exists (select 1 from states s where s.fresh and s.account_key = t.account_key)""")
def io_create_or_merge(spark, sf_dir):
    """A layer table created from the first feed and merged with the second."""
    name, root = f"states_{uuid.uuid4().hex}", scratch_path(spark, "silver")
    lake.create_or_merge(spark, name, order_states(spark, sf_dir, EARLIER), ["account_key"], root, buckets=8)
    lake.create_or_merge(spark, name, order_states(spark, sf_dir, LATER), ["account_key"], root, buckets=8)
    return spark.table(name)


@query("io_merge_partitions", """
    select o_orderkey, case when o_orderdate >= DATE '2000-07-01' then 'X' else o_orderstatus end as o_orderstatus,
           cast(year(o_orderdate) as int) as year from orders""")
def io_merge_partitions(spark, sf_dir):
    """Orders by year with the newest ones corrected: only their two partitions are rewritten."""
    path = scratch_path(spark, "by-year")
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderdate", F.year("o_orderdate").alias("year"))
    lake.append(orders.drop("o_orderdate"), path, ["year"])
    late = orders.where("o_orderdate >= timestamp_ntz'2000-07-01'").withColumn("o_orderstatus", F.lit("X"))
    lake.merge_partitions(spark, path, late.drop("o_orderdate"), ["o_orderkey"], "year")
    return spark.read.parquet(path)


def io_view_read(spark, sf_dir):
    """The collection mart published as a view and read by name."""
    name = f"gold_summary_{uuid.uuid4().hex}"
    lake.publish_view(collection_summary(table(spark, sf_dir, "accounts"), table(spark, sf_dir, "wards")), name)
    return spark.sql(f"SELECT ward_name, band, total_accounts, total_collected FROM {name}")


query("io_view_read", f"select ward_name, band, total_accounts, total_collected from ({ORACLES['ct_collection_summary']})")(io_view_read)


@query("io_stage_log", """
    select 'bronze' as stage, count(*) as n_rows from lineitem
    union all select 'silver', count(*) from (select distinct l_orderkey, l_linenumber from lineitem)
    union all select 'gold', count(distinct l_returnflag) from lineitem""")
def io_stage_log(spark, sf_dir):
    """Rows per stage of a small pipeline, observed during its one write."""
    log = lake.StageLog()
    bronze = log.watch("bronze", read(spark, sf_dir, "lineitem"), "l_shipdate")
    newest = current.latest_per_key(bronze, ["l_orderkey", "l_linenumber"], ["l_shipdate"], LINE_TIES)
    silver = log.watch("silver", newest)
    gold = log.watch("gold", silver.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")))
    gold.write.parquet(scratch_path(spark, "gold"))
    return spark.createDataFrame([(s, n) for s, n, _ in log.entries()], "stage string, n_rows bigint")


@query("bronze_rebuild_silver", """
    select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey
      order by o_orderdate desc, o_orderkey) as rn from orders) where rn = 1""")
def bronze_rebuild_silver(spark, sf_dir):
    """Silver rebuilt from bronze files partitioned by year of landing."""
    path = scratch_path(spark, "bronze")
    orders = read(spark, sf_dir, "orders").withColumn("landed_year", F.year("o_orderdate"))
    lake.append(orders, path, ["landed_year"])
    bronze = spark.read.parquet(path)
    moment = F.lit("2100-01-01").cast("timestamp_ntz")
    return current.as_of(bronze, ["o_custkey"], moment, "o_orderdate", ["o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_orderstatus")


FEED = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double"}


@query("io_record_drift", """
    with f as (select event_id, event_id % 10 = 3 or event_type is null as no_type, event_id % 25 = 0 as extra, event_id % 40 = 7 as bad_user,
        event_id % 200 = 11 as broken, value is null as no_value, user_id is null as no_user from events)
    select case when broken then null else event_id end as event_id,
      case when broken then 'unreadable' when no_type or extra or bad_user or no_value or no_user then 'drifted' else 'ok' end as drift,
      case when not broken then concat_ws(',', case when no_user and not bad_user then 'user_id' end, case when no_type then 'event_type' end, case when no_value then 'value' end) end as dropped,
      case when not broken then case when extra then 'channel' else '' end end as unknown,
      case when not broken then case when bad_user then 'user_id' else '' end end as mistyped
    from f""")
def io_record_drift(spark, sf_dir):
    """A JSON feed whose source drops, adds and changes fields and cuts lines off: what is wrong with each record."""
    path = scratch_path(spark, "feed")
    n = F.col("event_id")
    record = F.to_json(F.struct(
        n, F.when(n % 40 == 7, F.concat(F.lit("u"), F.coalesce(F.col("user_id").cast("string"), F.lit("")))).otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(n % 10 != 3, F.col("event_type")).alias("event_type"), "value", F.when(n % 25 == 0, "web").alias("channel")))
    read(spark, sf_dir, "events").select(F.when(n % 200 == 11, F.substring(record, 1, 12)).otherwise(record).alias("value")).write.text(path)
    marked = record_drift(spark.read.text(path), "value", FEED)
    return marked.select(F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"), "drift",
                         *[F.array_join(c, ",").alias(c) for c in ("dropped", "unknown", "mistyped")])


@query("bronze_as_of_snapshot", """
    select user_id, event_id, event_type, value from (
      select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn
      from events where ts <= TIMESTAMP '2024-01-15 06:00:00') where rn = 1""")
def bronze_as_of_snapshot(spark, sf_dir):
    """The state on 15 January from the snapshot of the 10th, itself made from that of the 5th, and five days of bronze."""
    history = History(spark, scratch_path(spark, "history"), ["user_id"], "ts", [F.col("event_id").desc()])
    history.append(read(spark, sf_dir, "events"))
    for day in (5, 10):
        history.snapshot(date(2024, 1, day))
    return history.as_of(datetime(2024, 1, 15, 6)).select("user_id", "event_id", "event_type", "value")


@query("gov_search_indexed", """
    select doc_id, source, lang from documents
    where contains(lower(text), 'licen') or contains(lower(source), 'licen') or contains(lower(lang), 'licen')""")
def gov_search_indexed(spark, sf_dir):
    """Documents that mention a licence, found by trigram postings."""
    path, docs = scratch_path(spark, "postings"), read(spark, sf_dir, "documents")
    fields = ["text", "source", "lang"]
    write_postings(docs, "doc_id", fields, path, buckets=16)
    return indexed_search(docs, path, " Licen ", "doc_id", fields, buckets=16).select("doc_id", "source", "lang")
