"""Housing repairs: increment, enrichment with SLA, performance mart, rolling compliance, backlog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclake.functions.measures import day, days_between, divide, money, percent, rows, rows_where, share, sla_days
from civiclake.operators import current, timeline
from civiclake.plans.registry import query
from civiclake.sources.domain import AS_OF, read, table

ENRICHED_SQL = """
    enriched as (select r.*, p.ward_code, w.ward_name,
        case priority when 'Emergency' then 1 when 'Urgent' then 5 else 28 end as sla_days,
        date_diff('day', reported_date, coalesce(completed_date, DATE '2001-12-31')) as turnaround_days,
        date_diff('day', reported_date, coalesce(completed_date, DATE '2001-12-31'))
          <= case priority when 'Emergency' then 1 when 'Urgent' then 5 else 28 end as sla_met
      from repairs r left join properties p on p.property_reference = r.property_ref
      left join wards w on w.ward_code = p.ward_code)"""


def with_sla(repairs: DataFrame, today=AS_OF) -> DataFrame:
    """SLA limit, days taken (open repairs age until ``today``) and whether the limit was met."""
    taken = days_between("reported_date", F.coalesce("completed_date", day(today)))
    limit = sla_days("priority")
    return repairs.withColumns({"sla_days": limit, "turnaround_days": taken, "sla_met": taken <= limit})


def enrich(repairs: DataFrame, properties: DataFrame, wards: DataFrame, today=AS_OF) -> DataFrame:
    homes = properties.select(F.col("property_reference").alias("property_ref"), "ward_code")
    named = homes.join(wards.select("ward_code", "ward_name"), "ward_code", "left")
    return with_sla(repairs, today).join(named, "property_ref", "left")


def performance(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("ward_name", "repair_category", "priority").agg(
        rows().alias("total_repairs"),
        F.round(F.avg("turnaround_days"), 4).alias("avg_turnaround"),
        F.round(percent(F.col("sla_met")), 4).alias("sla_compliance_pct"),
        money("actual_cost").cast("double").alias("total_cost"),
        rows_where(F.col("status") == "Open").alias("open_backlog"),
    )


def _enriched(spark, sf_dir):
    return enrich(*[table(spark, sf_dir, t) for t in ("repairs", "properties", "wards")])


@query("rep_enriched_sla", f"""
    with {ENRICHED_SQL}
    select repair_id, property_ref, ward_name, priority, reported_date, completed_date, cast(sla_days as int) as sla_days,
           cast(turnaround_days as int) as turnaround_days, sla_met, status from enriched""")
def rep_enriched_sla(spark, sf_dir):
    return _enriched(spark, sf_dir).select(
        "repair_id", "property_ref", "ward_name", "priority", "reported_date", "completed_date", "sla_days",
        "turnaround_days", "sla_met", "status")


@query("rep_performance", f"""
    with {ENRICHED_SQL}
    select ward_name, repair_category, priority, count(*) as total_repairs,
           round(avg(turnaround_days), 4) as avg_turnaround,
           round(count(*) filter (where sla_met) * 100.0 / count(*), 4) as sla_compliance_pct,
           cast(sum(cast(actual_cost as decimal(18,2))) as double) as total_cost,
           count(*) filter (where status = 'Open') as open_backlog
    from enriched group by 1, 2, 3""")
def rep_performance(spark, sf_dir):
    return performance(_enriched(spark, sf_dir))


@query("rep_sla_rolling_30d", f"""
    with {ENRICHED_SQL},
    d as (select reported_date as day, count(*) as n, count(*) filter (where sla_met) as met from enriched group by 1)
    select day, n as repairs, round(coalesce(cast(sum(met) over w as double) / nullif(sum(n) over w, 0), 0), 6)
      as sla_30d from d
    window w as (order by date_diff('day', DATE '1970-01-01', day) range between 29 preceding and current row)""")
def rep_sla_rolling_30d(spark, sf_dir):
    repairs = with_sla(table(spark, sf_dir, "repairs"))
    days = timeline.daily(repairs, "reported_date", repairs=rows(), met=rows_where(F.col("sla_met")))
    rolled = timeline.rolling_days(days, "met", "repairs", 30, "sla_30d")
    return rolled.select("day", "repairs", F.round("sla_30d", 6).alias("sla_30d"))


@query("rep_sla_compliance", f"""
    with {ENRICHED_SQL}
    select priority, count(*) as repairs, round(count(*) filter (where sla_met) * 1.0 / count(*), 6) as sla_compliance
    from enriched group by 1""")
def rep_sla_compliance(spark, sf_dir):
    return with_sla(table(spark, sf_dir, "repairs")).groupBy("priority").agg(
        rows().alias("repairs"), F.round(share(F.col("sla_met")), 6).alias("sla_compliance"))


@query("rep_avg_cost", """
    select repair_category, round(cast(sum(cast(actual_cost as decimal(18,2))) as double) / count(actual_cost), 4)
      as avg_repair_cost from repairs group by 1""")
def rep_avg_cost(spark, sf_dir):
    return table(spark, sf_dir, "repairs").groupBy("repair_category").agg(
        F.round(divide(money("actual_cost"), F.count("actual_cost"), None), 4).alias("avg_repair_cost"))


@query("rep_incremental", """
    select l_orderkey, l_linenumber, l_partkey, l_extendedprice, cast(l_shipdate as date) as last_modified from (
      select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_extendedprice,
        l_quantity, l_partkey, l_suppkey, l_discount, l_tax, l_returnflag, l_linestatus) as rn
      from lineitem where l_shipdate >= (select max(o_orderdate) from orders where o_orderstatus = 'F'))
    where rn = 1""")
def rep_incremental(spark, sf_dir):
    """Pull from a stored mark on: the mark is the date of the newest finished order."""
    finished = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    control = finished.agg(F.lit("repairs").alias("pipeline_name"), F.max("o_orderdate").alias("watermark_value"))
    mark = current.watermark_of(control, "repairs")
    delta = current.increment(
        read(spark, sf_dir, "lineitem"), "l_shipdate", mark, ["l_orderkey", "l_linenumber"],
        ["l_extendedprice", "l_quantity", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])
    return delta.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                        F.col("l_shipdate").cast("date").alias("last_modified"))


@query("rep_watermark", """
    select 'repairs' as pipeline_name, cast(max(l_shipdate) as date) as watermark_value from lineitem
    union all select 'orders', cast(max(o_orderdate) as date) from orders""")
def rep_watermark(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("watermark_value"))
    control = orders.select(F.lit("orders").alias("pipeline_name"), "watermark_value")
    moved = current.advance(control, "repairs", read(spark, sf_dir, "lineitem"), "l_shipdate")
    return moved.withColumn("watermark_value", F.col("watermark_value").cast("date"))


@query("ti_backlog_trend", """
    with moves as (
      select repair_category, cast(date_trunc('month', reported_date) as date) as month, 1 as o, 0 as c from repairs
      union all
      select repair_category, cast(date_trunc('month', completed_date) as date), 0, 1 from repairs
      where completed_date is not null),
    m as (select repair_category, month, sum(o) as o, sum(c) as c from moves group by 1, 2),
    span as (select repair_category, unnest(generate_series(min(month), max(month), interval 1 month)) as month
             from m group by 1)
    select s.repair_category, cast(s.month as date) as month, cast(coalesce(m.o, 0) as bigint) as opened,
           cast(coalesce(m.c, 0) as bigint) as closed,
           cast(sum(coalesce(m.o, 0) - coalesce(m.c, 0)) over (partition by s.repair_category order by s.month) as bigint)
             as open_at_month_end
    from span s left join m on m.repair_category = s.repair_category and m.month = cast(s.month as date)""")
def ti_backlog_trend(spark, sf_dir):
    trend = timeline.backlog(table(spark, sf_dir, "repairs"), "reported_date", "completed_date", ["repair_category"])
    return trend.select("repair_category", timeline.month_start("month_idx").alias("month"), "opened", "closed",
                        "open_at_month_end")


@query("kpi_avg_resolution", """
    select cast(date_trunc('month', completed_date) as date) as month, count(*) as completed,
           round(avg(date_diff('day', reported_date, completed_date)), 4) as avg_resolution_days
    from repairs where completed_date is not null group by 1""")
def kpi_avg_resolution(spark, sf_dir):
    done = table(spark, sf_dir, "repairs").where(F.col("completed_date").isNotNull())
    months = timeline.monthly(done, "completed_date", completed=rows(),
                              avg_resolution_days=F.round(F.avg(days_between("reported_date", "completed_date")), 4))
    return months.select(timeline.month_start("month_idx").alias("month"), "completed", "avg_resolution_days")
