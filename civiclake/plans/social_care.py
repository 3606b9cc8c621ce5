"""Social care: pseudonymised landing, demand mart, quarter forecast, repeat contacts, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclake.functions import text
from civiclake.functions.measures import day, days_between, divide, percent, rows, rows_where
from civiclake.operators import current, timeline
from civiclake.plans.registry import query
from civiclake.sources.domain import REFERRAL_AS_OF, read, table

def pseudonymised(referrals: DataFrame, today=REFERRAL_AS_OF, years: int = 3, salt: str = "") -> DataFrame:
    """Referrals of the last ``years`` years with the identifier hashed and the postcode cut to its area."""
    recent = referrals.where(F.col("contact_date") >= F.add_months(day(today), -12 * years))
    return recent.select(
        "referral_id", "contact_date", "referral_source", "primary_support_reason", "age_band", "gender",
        text.pseudonym("nhs_number", salt).alias("nhs_number_hash"),
        text.postcode_area("postcode").alias("postcode_area"), "ward_code", "outcome", "assessment_date",
    )


def demand(referrals: DataFrame, person: str, today=REFERRAL_AS_OF) -> DataFrame:
    """Monthly demand per ward and support reason; ``person`` identifies distinct people."""
    people = F.count_distinct(person)
    return referrals.groupBy(
        F.trunc("contact_date", "MM").alias("month"), "ward_name", "primary_support_reason"
    ).agg(
        people.alias("unique_people"), rows().alias("total_referrals"),
        F.round(divide(rows(), people, None), 2).alias("avg_referrals_per_person"),
        F.round(F.avg(days_between("contact_date", F.coalesce("assessment_date", day(today)))), 4)
        .alias("avg_days_to_assessment"),
        F.round(percent(F.col("outcome") == "Service Provided"), 4).alias("conversion_rate_pct"),
    )


@query("sc_pseudonymised", r"""
    with f as (select *, upper(regexp_replace(postcode, '\s+', '', 'g')) as k from referrals)
    select referral_id, contact_date, referral_source, primary_support_reason, age_band, gender,
           sha256(nhs_number) as nhs_number_hash,
           rtrim(left(concat(left(k, length(k) - 3), ' ', right(k, 3)), 4)) as postcode_area,
           ward_code, outcome, assessment_date
    from f where contact_date >= DATE '2021-02-28'""")
def sc_pseudonymised(spark, sf_dir):
    return pseudonymised(table(spark, sf_dir, "referrals"))


@query("sc_demand", """
    select cast(date_trunc('month', contact_date) as date) as month, w.ward_name, primary_support_reason,
           count(distinct user_id) as unique_people, count(*) as total_referrals,
           round(count(*) * 1.0 / count(distinct user_id), 2) as avg_referrals_per_person,
           round(avg(date_diff('day', contact_date, coalesce(assessment_date, DATE '2024-02-29'))), 4)
             as avg_days_to_assessment,
           round(count(*) filter (where outcome = 'Service Provided') * 100.0 / count(*), 4) as conversion_rate_pct
    from referrals r left join wards w on w.ward_code = r.ward_code group by 1, 2, 3""")
def sc_demand(spark, sf_dir):
    wards = table(spark, sf_dir, "wards").select("ward_code", "ward_name")
    return demand(table(spark, sf_dir, "referrals").join(wards, "ward_code", "left"), "user_id")


@query("sc_forecast_quarter", """
    with m as (select year(contact_date) * 12 + month(contact_date) - 1 as i, count(distinct user_id) as people
               from referrals where contact_date >= DATE '2022-06-01' group by 1)
    select round(regr_intercept(people, i - 24269) + regr_slope(people, i - 24269) * (max(i) - 24269 + 3), 0)
      as forecast_next_quarter from m""")
def sc_forecast_quarter(spark, sf_dir):
    """Distinct people three months past the last month, off the straight line through the monthly counts."""
    since = table(spark, sf_dir, "referrals").where(F.col("contact_date") >= "2022-06-01")
    months = timeline.monthly(since, "contact_date", people=F.count_distinct("user_id"))
    ahead = timeline.forecast(timeline.last_periods(months, None), "people", 3)
    return ahead.where("step = 3").select(F.round("forecast", 0).alias("forecast_next_quarter"))


@query("kpi_repeat_contacts", """
    with p as (select user_id, count(*) as n from referrals group by 1)
    select count(*) as people, count(*) filter (where n > 1) as repeat_people,
           cast(sum(n) as bigint) as referrals, round(sum(n) * 1.0 / count(*), 2) as referrals_per_person from p""")
def kpi_repeat_contacts(spark, sf_dir):
    per_person = table(spark, sf_dir, "referrals").groupBy("user_id").agg(rows().alias("n"))
    return per_person.agg(
        rows().alias("people"), rows_where(F.col("n") > 1).alias("repeat_people"), F.sum("n").alias("referrals"),
        F.round(divide(F.sum("n"), rows(), None), 2).alias("referrals_per_person"))


# Retention in years per outcome class used by the purge queries (NULL keeps for ever).
RETENTION_SQL = "case outcome when 'NFA' then 1 when 'Signposted' then 2 else null end"


def _with_retention(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "referrals").withColumn("_retention_years", F.expr(RETENTION_SQL))


@query("retention_purge", f"""
    select referral_id, contact_date, outcome from referrals
    where not coalesce(contact_date + to_months(12 * ({RETENTION_SQL})) < DATE '2024-02-29', false)""")
def retention_purge(spark, sf_dir):
    kept = current.purge(_with_retention(spark, sf_dir), "contact_date", "_retention_years", day(REFERRAL_AS_OF))
    return kept.select("referral_id", "contact_date", "outcome")


@query("retention_audit", f"""
    with g as (select outcome, coalesce(contact_date + to_months(12 * ({RETENTION_SQL})) < DATE '2024-02-29', false) as gone
               from referrals)
    select outcome, count(*) filter (where gone) as purged, count(*) filter (where not gone) as kept from g group by 1""")
def retention_audit(spark, sf_dir):
    return current.purge_audit(_with_retention(spark, sf_dir), "contact_date", "_retention_years", day(REFERRAL_AS_OF), ["outcome"])


@query("bronze_as_of", """
    select user_id, event_id, event_type, value from (
      select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn
      from events where ts <= TIMESTAMP '2024-01-15 00:00:00') where rn = 1""")
def bronze_as_of(spark, sf_dir):
    """Latest event per user as it stood on 15 January."""
    moment = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    state = current.as_of(read(spark, sf_dir, "events"), ["user_id"], moment, "ts", [F.col("event_id").desc()])
    return state.select("user_id", "event_id", "event_type", "value")
