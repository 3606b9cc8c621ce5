"""Housing properties: staging model, type-2 history, void analytics, and the smaller marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclake.functions import text
from civiclake.functions.measures import divide, money, percent, rows, rows_where
from civiclake.operators import current
from civiclake.operators.point_in_time import at_event_time
from civiclake.plans.council_tax import EARLIER, LATER, ORDER_STATES_SQL, order_states
from civiclake.plans.registry import query
from civiclake.plans.repairs import ENRICHED_SQL, _enriched
from civiclake.sources.domain import AS_OF, read, table

LOADED_AT = "2001-12-31 03:00:00"

STAGED_SQL = """
    staged as (select property_reference as property_id, upper(trim(address_1)) as address_line_1,
        upper(trim(address_2)) as address_line_2, upper(trim(address_3)) as address_line_3,
        upper(replace(postcode, ' ', '')) as postcode_raw,
        case when length(replace(postcode, ' ', '')) < 5 then upper(replace(postcode, ' ', '')) else
          concat(left(upper(replace(postcode, ' ', '')), length(replace(postcode, ' ', '')) - 3), ' ',
                 right(upper(replace(postcode, ' ', '')), 3)) end as postcode,
        ward_code, property_type, bedrooms, build_year, tenure_type, void_status, void_start_date,
        last_modified_date as source_updated_at, '2001-12-31 03:00:00' as _loaded_at
      from properties where property_reference is not null)"""


def staged(properties: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """Renamed, trimmed, upper-cased properties with a standard postcode; rows without a key are left out."""
    tidy = {f"address_line_{i}": F.upper(F.trim(F.col(f"address_{i}"))) for i in (1, 2, 3)}
    return properties.where(F.col("property_reference").isNotNull()).select(
        F.col("property_reference").alias("property_id"),
        *[c.alias(n) for n, c in tidy.items()],
        text.postcode_clean("postcode", spaces_only=True).alias("postcode_raw"),
        text.postcode_formatted("postcode", spaces_only=True).alias("postcode"),
        "ward_code", "property_type", "bedrooms", "build_year", "tenure_type", "void_status", "void_start_date",
        F.col("last_modified_date").alias("source_updated_at"),
        (F.lit(LOADED_AT) if loaded_at is None else loaded_at).alias("_loaded_at"),
    )


@query("prop_staging", f"with {STAGED_SQL} select * from staged")
def prop_staging(spark, sf_dir):
    return staged(table(spark, sf_dir, "properties"))


# ------------------------------------------------------------- type-2 history

SCD_DAY = AS_OF
TRACKED = ["state", "band", "charge"]


def history(states: DataFrame) -> DataFrame:
    """A first load of account states as a history table."""
    return states.drop("changed_on").withColumns({
        "start_date": F.lit("1999-12-31").cast("date"), "end_date": F.lit(None).cast("date"),
        "is_current": F.lit(True), "_updated_at": F.lit("1999-12-31").cast("timestamp"),
    })


def _scd_inputs(spark, sf_dir):
    before = history(order_states(spark, sf_dir, EARLIER))
    return before, order_states(spark, sf_dir, LATER).drop("changed_on")


SCD_SQL = f"""{ORDER_STATES_SQL},
    t as (select * from states where not fresh), s as (select * from states where fresh),
    j as (select coalesce(t.account_key, s.account_key) as account_key, t.state as ts, t.band as tb, t.charge as tc,
            s.state as ss, s.band as sb, s.charge as sc, t.account_key is not null as has_t, s.account_key is not null as has_s,
            t.state is distinct from s.state or t.band is distinct from s.band or t.charge is distinct from s.charge as differs
          from t full outer join s on t.account_key = s.account_key),
    nxt as (
      select account_key, ts as state, tb as band, tc as charge, DATE '1999-12-31' as start_date,
             case when has_s and differs then DATE '2001-12-31' end as end_date, not (has_s and differs) as is_current
      from j where has_t
      union all
      select account_key, ss, sb, sc, DATE '2001-12-31', cast(null as date), true from j
      where has_s and (not has_t or differs))"""


@query("scd2_next_state", f"with {SCD_SQL} select * from nxt")
def scd2_next_state(spark, sf_dir):
    before, source = _scd_inputs(spark, sf_dir)
    return current.scd2(before, source, ["account_key"], TRACKED, SCD_DAY).drop("_updated_at")


@query("scd2_counts", f"""
    with {SCD_SQL} select count(*) filter (where start_date = DATE '2001-12-31') as opened,
      count(*) filter (where end_date = DATE '2001-12-31') as closed,
      (select count(*) from j where not has_t) as new_keys from nxt""")
def scd2_counts(spark, sf_dir):
    before, source = _scd_inputs(spark, sf_dir)
    after = current.scd2(before, source, ["account_key"], TRACKED, SCD_DAY)
    return current.scd2_counts(before, after, ["account_key"], SCD_DAY)


# ------------------------------------------------------------- marts

@query("mart_property_void", """
    select ward_code, property_type, count(*) filter (where void_status = 'Occupied') as occupied,
           count(*) filter (where void_status = 'Void') as void,
           count(*) filter (where void_status = 'Under Repair') as under_repair, count(*) as properties
    from properties group by 1, 2""")
def mart_property_void(spark, sf_dir):
    """Void status per ward and type over the current versions of the property history.

    The history is a first load with every home occupied, then a second load of today's status.
    """
    homes = table(spark, sf_dir, "properties").select("property_reference", "ward_code", "property_type", "void_status")
    first = history(homes.withColumn("void_status", F.lit("Occupied")))
    versions = current.scd2(first, homes, ["property_reference"], ["void_status"], SCD_DAY, check_keys=False)
    per_status = versions.where("is_current").groupBy("ward_code", "property_type")
    return per_status.agg(
        rows_where(F.col("void_status") == "Occupied").alias("occupied"),
        rows_where(F.col("void_status") == "Void").alias("void"),
        rows_where(F.col("void_status") == "Under Repair").alias("under_repair"), rows().alias("properties"))


@query("mart_collections", """
    select ward_code, collection_type, count(*) as scheduled, count(*) filter (where not collected) as missed,
           round(count(*) filter (where collected) * 100.0 / count(*), 4) as completion_pct
    from collections group by 1, 2""")
def mart_collections(spark, sf_dir):
    return table(spark, sf_dir, "collections").groupBy("ward_code", "collection_type").agg(
        rows().alias("scheduled"), rows_where(~F.col("collected")).alias("missed"),
        F.round(percent(F.col("collected")), 4).alias("completion_pct"))


@query("mart_star_flat", f"""
    with {ENRICHED_SQL}
    select e.repair_id, e.property_ref, e.reported_date, e.actual_cost, e.ward_name, p.property_type, p.tenure_type,
           e.contractor, s.s_name as contractor_name
    from enriched e left join properties p on p.property_reference = e.property_ref
    left join supplier s on s.s_suppkey = e.contractor""")
def mart_star_flat(spark, sf_dir):
    """Repairs fact flattened over its property, ward and contractor dimensions."""
    homes = table(spark, sf_dir, "properties").select(
        F.col("property_reference").alias("property_ref"), "ward_code", "property_type", "tenure_type")
    wards = table(spark, sf_dir, "wards").select("ward_code", "ward_name")
    firms = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("contractor"), F.col("s_name").alias("contractor_name"))
    flat = (
        table(spark, sf_dir, "repairs")
        .join(homes.join(wards, "ward_code", "left"), "property_ref", "left")
        .join(firms, "contractor", "left")
    )
    return flat.select("repair_id", "property_ref", "reported_date", "actual_cost", "ward_name", "property_type",
                       "tenure_type", "contractor", "contractor_name")


@query("mart_star_point_in_time", f"""
    with {SCD_SQL}
    select o.o_orderkey, o.o_custkey, n.state, n.band, n.start_date
    from orders o left join nxt n on n.account_key = o.o_custkey and cast(o.o_orderdate as date) >= n.start_date
      and (n.end_date is null or cast(o.o_orderdate as date) < n.end_date)""")
def mart_star_point_in_time(spark, sf_dir):
    before, source = _scd_inputs(spark, sf_dir)
    dimension = current.scd2(before, source, ["account_key"], TRACKED, SCD_DAY)
    facts = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("on"))
    found = at_event_time(facts, dimension.withColumnRenamed("account_key", "o_custkey"), "o_custkey", "on")
    return found.select("o_orderkey", "o_custkey", "state", "band", "start_date")


@query("mart_ward_context", """
    with people as (select ward_code, count(*) as population from accounts group by 1),
    d as (select ward_code, count(*) as requests, cast(sum(cast(amount as decimal(18,2))) as double) as amount
          from requests group by 1)
    select w.ward_name, w.imd_score, p.population, coalesce(d.requests, 0) as requests, d.amount,
           round(d.requests * 1000.0 / p.population, 4) as requests_per_1000
    from wards w left join people p on p.ward_code = w.ward_code left join d on d.ward_code = w.ward_code""")
def mart_ward_context(spark, sf_dir):
    """Demand per ward beside deprivation and population; both facts shrink to one row per ward first."""
    people = table(spark, sf_dir, "accounts").groupBy("ward_code").agg(rows().alias("population"))
    demand = table(spark, sf_dir, "requests").groupBy("ward_code").agg(
        rows().alias("requests"), money("amount").cast("double").alias("amount"))
    joined = table(spark, sf_dir, "wards").join(people, "ward_code", "left").join(demand, "ward_code", "left")
    return joined.select(
        "ward_name", "imd_score", "population", F.coalesce("requests", F.lit(0)).alias("requests"), "amount",
        F.round(divide(F.col("requests") * 1000.0, F.col("population"), None), 4).alias("requests_per_1000"))
