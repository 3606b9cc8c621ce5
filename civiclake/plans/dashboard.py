"""Dashboard datasets and executive measures over service requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civiclake.functions.measures import (
    KPI_TARGETS, Measures, arrears_band, divide, money, rows, rows_where, score_band,
)
from civiclake.operators import timeline
from civiclake.plans.registry import query
from civiclake.plans.repairs import ENRICHED_SQL, with_sla
from civiclake.sources.domain import table

MONTHS_SQL = """
    months as (select department, year(request_date) * 12 + month(request_date) - 1 as month_idx, count(*) as n
               from requests group by 1, 2),
    totals as (select month_idx, cast(sum(n) as bigint) as n from months group by 1)"""
FIRST_SQL = "(select min(month_idx) from totals)"


def monthly_requests(requests: DataFrame, dims=("department",)) -> DataFrame:
    return timeline.monthly(requests, "request_date", dims, requests=rows())


def totals(months: DataFrame) -> DataFrame:
    return months.groupBy("month_idx").agg(F.sum("requests").alias("requests"))


def sliced(months: DataFrame, department: str | None = None, periods: int | None = None) -> DataFrame:
    """The department and last-N-periods slicers; ``None`` leaves a slicer open.

    The period slicer counts back from the last month of the whole series.
    """
    placed = timeline.last_periods(months, periods)
    return placed if department is None else placed.where(F.col("department") == department)


def _months(spark, sf_dir):
    return monthly_requests(table(spark, sf_dir, "requests"))


@query("dash_monthly_total", f"""
    with {MONTHS_SQL} select make_date(cast(month_idx // 12 as int), cast(month_idx % 12 + 1 as int), 1) as month,
    n as requests from totals""")
def dash_monthly_total(spark, sf_dir):
    return totals(_months(spark, sf_dir)).select(timeline.month_start("month_idx").alias("month"), "requests")


@query("dash_dept_totals", "select department, count(*) as requests from requests group by 1")
def dash_dept_totals(spark, sf_dir):
    return table(spark, sf_dir, "requests").groupBy("department").agg(rows().alias("requests"))


@query("dash_rollup", """
    select department, cast(year(request_date) as int) as year, count(*) as requests,
           cast(grouping(department) * 2 + grouping(year(request_date)) as bigint) as level
    from requests group by grouping sets ((department, year(request_date)), (department), ())""")
def dash_rollup(spark, sf_dir):
    return table(spark, sf_dir, "requests").withColumn("year", F.year("request_date")).rollup("department", "year").agg(
        rows().alias("requests"), F.grouping_id().cast("long").alias("level"))


@query("dash_kpis", f"""
    with {MONTHS_SQL},
    y as (select month_idx // 12 as year, sum(n) as n, count(*) as months from totals group by 1)
    select cast(y.year as int) as year, cast(y.n as bigint) as total_requests,
           cast(floor(y.n * 1.0 / y.months + 0.5) as bigint) as avg_monthly,
           round(coalesce((y.n / nullif(p.n, 0) - 1) * 100, 0), 1) as growth_pct
    from y left join y p on p.year = y.year - 1""")
def dash_kpis(spark, sf_dir):
    """Total, monthly mean (half-up) and growth on the real prior year, per year."""
    by_year = totals(_months(spark, sf_dir)).groupBy(F.floor(F.col("month_idx") / 12).cast("int").alias("year")).agg(
        F.sum("requests").alias("total"), rows().alias("months"))
    grown = timeline.year_on_year(by_year, "total", "year", 1, "growth")
    return grown.select(
        "year", F.col("total").alias("total_requests"),
        F.floor(F.col("total") / F.col("months") + 0.5).alias("avg_monthly"),
        F.round(F.col("growth") * 100, 1).alias("growth_pct"))


@query("dash_top_wards", """
    select row_number() over (order by imd_score desc, ward_name) as rank, ward_name, imd_score,
      case when imd_score > 35 then 'high' when imd_score > 20 then 'medium' else 'low' end as band, requests from (
      select w.ward_name, w.imd_score, count(r.request_id) as requests from wards w
      left join requests r on r.ward_code = w.ward_code group by 1, 2)
    qualify rank <= 12""")
def dash_top_wards(spark, sf_dir):
    """The twelve most deprived wards in order, with their demand; counts are formed before the join."""
    per_ward = table(spark, sf_dir, "requests").groupBy("ward_code").agg(rows().alias("requests"))
    wards = table(spark, sf_dir, "wards").join(per_ward, "ward_code", "left").na.fill(0, ["requests"])
    top = wards.orderBy(F.col("imd_score").desc(), "ward_name").limit(12)
    place = F.row_number().over(Window.orderBy(F.col("imd_score").desc(), "ward_name"))  # over twelve rows
    return top.select(place.alias("rank"), "ward_name", "imd_score", score_band("imd_score", 35, 20, inclusive=False).alias("band"), "requests")


@query("dash_score_bands", """
    with s as (select department, round(count(*) filter (where amount > 50000) * 100.0 / count(*), 1) as score
               from requests group by 1)
    select department, score, case when score >= 95 then 'high' when score >= 90 then 'medium' else 'low' end as quality_band,
           case when score >= 90 then 'pass' when score >= 70 then 'warn' else 'fail' end as dq_band from s""")
def dash_score_bands(spark, sf_dir):
    scored = table(spark, sf_dir, "requests").groupBy("department").agg(
        F.round(rows_where(F.col("amount") > 50000) * 100.0 / rows(), 1).alias("score"))
    return scored.select("department", "score", score_band("score", 95, 90).alias("quality_band"),
                         score_band("score", 90, 70, labels=("pass", "warn", "fail")).alias("dq_band"))


@query("dash_budget", """
    select department, cast(sum(allocated) as double) as allocated, cast(sum(spent) as double) as spent,
           cast(sum(spent) - sum(allocated) as double) as variance, sum(spent) > sum(allocated) as overspent
    from budget_lines group by 1""")
def dash_budget(spark, sf_dir):
    sums = table(spark, sf_dir, "budget_lines").groupBy("department").agg(
        F.sum("allocated").alias("a"), F.sum("spent").alias("s"))
    return sums.select("department", F.col("a").cast("double").alias("allocated"), F.col("s").cast("double").alias("spent"),
                       (F.col("s") - F.col("a")).cast("double").alias("variance"), (F.col("s") > F.col("a")).alias("overspent"))


@query("dash_forecast", f"""
    with {MONTHS_SQL},
    p as (select department, month_idx - {FIRST_SQL} as x, n from months),
    f as (select department, regr_slope(n, x) as b, regr_intercept(n, x) as a, max(x) as hi from p group by 1)
    select department, cast(k as int) as step, round(a + b * (hi + k), 4) as forecast
    from f, (select unnest([1, 2, 3]) as k)""")
def dash_forecast(spark, sf_dir):
    placed = timeline.last_periods(_months(spark, sf_dir), None)
    ahead = timeline.forecast(placed, "requests", 3, ["department"])
    return ahead.select("department", "step", F.round("forecast", 4).alias("forecast"))


@query("dash_slicers", f"""
    with {MONTHS_SQL}
    select department, cast(month_idx - (select max(month_idx) - 5 from totals) as int) as pos, n as requests
    from months where department = 'MACHINERY' and month_idx > (select max(month_idx) - 6 from totals)""")
def dash_slicers(spark, sf_dir):
    return sliced(_months(spark, sf_dir), "MACHINERY", 6).select("department", F.col("pos").cast("int"), "requests")


@query("dash_series", f"""
    with {MONTHS_SQL},
    p as (select month_idx - {FIRST_SQL} as x, n from totals),
    f as (select regr_slope(n, x) as b, regr_intercept(n, x) as a, max(x) as hi from p)
    select cast(x as int) as pos, 'Actual' as series, cast(n as double) as value,
           strftime(make_date(cast((x + {FIRST_SQL}) // 12 as int), cast((x + {FIRST_SQL}) % 12 + 1 as int), 1), '%Y-%m') as label
      from p
    union all select cast(x as int), 'Forecast', cast(n as double),
           strftime(make_date(cast((x + {FIRST_SQL}) // 12 as int), cast((x + {FIRST_SQL}) % 12 + 1 as int), 1), '%Y-%m')
      from p where x = (select max(x) from p)
    union all select cast(hi + k as int), 'Forecast', round(a + b * (hi + k), 4), 'Next +' || k
      from f, (select unnest([1, 2, 3]) as k)""")
def dash_series(spark, sf_dir):
    """Actuals, then a forecast line that starts at the last actual."""
    placed = timeline.last_periods(totals(_months(spark, sf_dir)), None).withColumn(
        "label", F.date_format(timeline.month_start("month_idx"), "yyyy-MM"))
    last = placed.agg(F.max("pos")).scalar()
    actual = placed.select("pos", F.lit("Actual").alias("series"), F.col("requests").cast("double").alias("value"), "label")
    joint = actual.where(F.col("pos") == last).withColumn("series", F.lit("Forecast"))
    ahead = timeline.forecast(placed, "requests", 3).select(
        "pos", F.lit("Forecast").alias("series"), F.round("forecast", 4).alias("value"),
        F.concat(F.lit("Next +"), "step").alias("label"))
    return actual.unionByName(joint).unionByName(ahead).withColumn("pos", F.col("pos").cast("int"))


@query("dash_sparkline", f"""
    with {MONTHS_SQL}
    select department, string_agg(cast(n as string), ',' order by month_idx) as points,
           max_by(n, month_idx) as latest from months group by 1""")
def dash_sparkline(spark, sf_dir):
    """Monthly counts as one ordered list per department: at most one entry per calendar month."""
    entry = F.struct("month_idx", "requests")
    points = _months(spark, sf_dir).groupBy("department").agg(F.array_sort(F.collect_list(entry)).alias("points"))
    values = F.transform("points", lambda p: p["requests"].cast("string"))
    return points.select("department", F.array_join(values, ",").alias("points"),
                         F.element_at("points", -1)["requests"].alias("latest"))


# ------------------------------------------------------------- executive measures

def council_measures() -> Measures:
    """Collection and arrears measures over accounts; later ones build on earlier ones."""
    m = Measures()
    m.add("liability", money("annual_charge")).add("outstanding", money("balance_outstanding"))
    m.add("collected", m["liability"] - m["outstanding"])
    m.add("collection_rate", F.round(divide(m["collected"], m["liability"]), 6))
    m.add("accounts_critical", rows_where(arrears_band("balance_outstanding") == "Critical"))
    m.add("accounts_no_arrears", rows_where(arrears_band("balance_outstanding") == "No Arrears"))
    return m


def repair_measures() -> Measures:
    m = Measures()
    m.add("repairs", rows()).add("within_sla", rows_where(F.col("sla_met")))
    m.add("sla_compliance", F.round(divide(m["within_sla"], m["repairs"]), 6))
    m.add("avg_repair_cost", F.round(divide(money("actual_cost"), F.count("actual_cost")), 2))
    return m


COUNCIL_SQL = """
    c as (select round(cast(sum(cast(annual_charge as decimal(18,2))) - sum(cast(balance_outstanding as decimal(18,2))) as double)
            / cast(sum(cast(annual_charge as decimal(18,2))) as double), 6) as collection_rate,
          count(*) filter (where balance_outstanding > 1000) as accounts_critical,
          count(*) filter (where coalesce(balance_outstanding, 0) = 0) as accounts_no_arrears from accounts),
    r as (select count(*) as repairs, round(count(*) filter (where sla_met) * 1.0 / count(*), 6) as sla_compliance,
          round(cast(sum(cast(actual_cost as decimal(18,2))) as double) / count(actual_cost), 2) as avg_repair_cost
          from enriched),
    q as (select count(*) as total_requests from requests)"""


def executive_row(accounts: DataFrame, repairs: DataFrame, requests: DataFrame) -> DataFrame:
    """All measures side by side: one row from each fact table, joined on a constant key."""
    parts = [
        council_measures().evaluate(accounts, ["collection_rate", "accounts_critical", "accounts_no_arrears"]),
        repair_measures().evaluate(with_sla(repairs), ["repairs", "sla_compliance", "avg_repair_cost"]),
        requests.agg(rows().alias("total_requests")),
    ]
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    return keyed[0].join(keyed[1], "_one").join(keyed[2], "_one").drop("_one")


def _executive(spark, sf_dir):
    return executive_row(*[table(spark, sf_dir, t) for t in ("accounts", "repairs", "requests")])


@query("measures_exec", f"with {ENRICHED_SQL}, {COUNCIL_SQL} select c.*, r.*, q.* from c, r, q")
def measures_exec(spark, sf_dir):
    return _executive(spark, sf_dir)


@query("kpi_targets", f"""
    with {ENRICHED_SQL}, {COUNCIL_SQL},
    k as (select 'collection_rate_pct' as kpi, round(collection_rate * 100, 1) as value, 95.5 as target from c
          union all select 'sla_compliance_pct', round(sla_compliance * 100, 1), 90.0 from r)
    select kpi, value, cast(target as double) as target, case when value >= target then 'met' else 'missed' end as status from k""")
def kpi_targets(spark, sf_dir):
    row = _executive(spark, sf_dir)
    source = {"collection_rate_pct": "collection_rate", "sla_compliance_pct": "sla_compliance"}
    entries = [
        F.struct(F.lit(kpi).alias("kpi"), F.round(F.col(source[kpi]) * 100, 1).alias("value"), F.lit(goal).alias("target"))
        for kpi, goal in KPI_TARGETS.items()
    ]
    return row.select(F.inline(F.array(*entries))).withColumn(
        "status", F.when(F.col("value") >= F.col("target"), "met").otherwise("missed"))


# ------------------------------------------------------------- time intelligence

DAYS_SQL = "days as (select department, request_date as day, count(*) as n from requests group by 1, 2)"


def _days(spark, sf_dir):
    return timeline.daily(table(spark, sf_dir, "requests"), "request_date", ["department"], requests=rows())


@query("ti_mtd", f"""
    with {DAYS_SQL} select department, day, n as requests, cast(sum(n) over (partition by department,
      date_trunc('month', day) order by day) as bigint) as requests_mtd from days""")
def ti_mtd(spark, sf_dir):
    return timeline.to_date(_days(spark, sf_dir), "requests", "month", ["department"])


@query("ti_ytd", f"""
    with {DAYS_SQL} select department, day, n as requests, cast(sum(n) over (partition by department,
      year(day) order by day) as bigint) as requests_ytd from days""")
def ti_ytd(spark, sf_dir):
    return timeline.to_date(_days(spark, sf_dir), "requests", "year", ["department"])


@query("ti_rolling_3m", f"""
    with {MONTHS_SQL} select department, month_idx, n as requests, round(avg(n) over (partition by department
      order by month_idx range between 2 preceding and current row), 6) as requests_avg_3m from months""")
def ti_rolling_3m(spark, sf_dir):
    rolled = timeline.rolling_months(_months(spark, sf_dir), "requests", 3, ["department"])
    return rolled.withColumns({"requests_avg_3m": F.round("requests_avg_3m", 6), "month_idx": F.col("month_idx").cast("long")})


@query("ti_rolling_3m_days", f"""
    with {DAYS_SQL}
    select a.department, a.day as report_day,
           round(sum(b.n) * 1.0 / count(distinct date_trunc('month', b.day)), 6) as requests_avg_3m_days
    from days a join days b on b.department = a.department and b.day between a.day - interval 3 month and a.day
    group by 1, 2""")
def ti_rolling_3m_days(spark, sf_dir):
    rolled = timeline.rolling_month_days(_days(spark, sf_dir), "requests", 3, ["department"])
    return rolled.withColumn("requests_avg_3m_days", F.round("requests_avg_3m_days", 6))


@query("ti_prior_year", f"""
    with {MONTHS_SQL} select a.department, a.month_idx, a.n as requests, b.n as requests_prior
    from months a left join months b on b.department = a.department and b.month_idx = a.month_idx - 12""")
def ti_prior_year(spark, sf_dir):
    both = timeline.prior_year(_months(spark, sf_dir), "requests", "month_idx", 12, ["department"])
    return both.withColumn("month_idx", F.col("month_idx").cast("long"))


@query("ti_yoy", f"""
    with {MONTHS_SQL},
    y as (select month_idx, sum(n) over (partition by month_idx // 12 order by month_idx) as ytd from totals)
    select a.month_idx, cast(a.ytd as bigint) as ytd, cast(b.ytd as bigint) as ytd_prior,
           round(coalesce((a.ytd - b.ytd) / nullif(b.ytd, 0), 0), 6) as yoy
    from y a left join y b on b.month_idx = a.month_idx - 12""")
def ti_yoy(spark, sf_dir):
    """Year-to-date demand against the same months of the year before."""
    months = totals(_months(spark, sf_dir)).withColumn("day", timeline.month_start("month_idx"))
    running = timeline.to_date(months, "requests", "year").select("month_idx", F.col("requests_ytd").alias("ytd"))
    grown = timeline.year_on_year(running, "ytd", "month_idx", 12, "yoy")
    return grown.select(F.col("month_idx").cast("long").alias("month_idx"), "ytd", "ytd_prior", F.round("yoy", 6).alias("yoy"))


@query("ti_calendar", """
    with span as (select department, unnest(generate_series(date_trunc('month', min(request_date)),
        date_trunc('month', max(request_date)), interval 1 month)) as m from requests group by 1),
    n as (select department, date_trunc('month', request_date) as m, count(*) as n from requests group by 1, 2)
    select s.department, cast(s.m as date) as month, coalesce(n.n, 0) as requests
    from span s left join n on n.department = s.department and n.m = s.m""")
def ti_calendar(spark, sf_dir):
    """Every month of a department's span, empty ones with zero requests."""
    requests = table(spark, sf_dir, "requests")
    months = timeline.calendar(requests, F.min("request_date"), F.max("request_date"), ["department"])
    dense = months.join(monthly_requests(requests), ["department", "month_idx"], "left").na.fill(0, ["requests"])
    return dense.select("department", "month", "requests")


@query("ti_month_attrs", """
    select distinct cast(date_trunc('month', request_date) as date) as month, strftime(request_date, '%Y-%m') as month_year,
           cast(month(request_date) as int) as month_number, cast(year(request_date) as int) as year,
           cast(quarter(request_date) as int) as quarter,
           cast(date_trunc('month', request_date) + interval 3 month as date) as three_months_on
    from requests""")
def ti_month_attrs(spark, sf_dir):
    months = timeline.calendar(table(spark, sf_dir, "requests"), F.min("request_date"), F.max("request_date"))
    return months.drop("month_idx").withColumn("three_months_on", F.add_months("month", 3))
