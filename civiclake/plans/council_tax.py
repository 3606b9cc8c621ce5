"""Council tax: landing, cleansing, upsert, collection mart, arrears, support cross-match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclake.functions import text
from civiclake.functions.measures import MONEY, arrears_band, day, days_between, divide, money, rows, rows_where
from civiclake.operators import current, timeline
from civiclake.operators.skew import counted_copies, join_in_cells, unfold_copies
from civiclake.operators.ranking import numbered
from civiclake.plans.registry import query
from civiclake.sources.domain import AS_OF, read, table

def collection_summary(accounts: DataFrame, wards: DataFrame, today=AS_OF) -> DataFrame:
    """Collection figures per ward and band.

    Aggregated before the ward names are joined, so the join touches a few hundred rows.
    """
    paid_up = F.col("balance_outstanding") <= 0
    per_group = accounts.groupBy("ward_code", "band").agg(
        rows().alias("total_accounts"),
        money("annual_charge").alias("liability"),
        money("balance_outstanding").alias("outstanding"),
        rows_where(paid_up).alias("accounts_paid_up"),
        F.avg(days_between("liable_start", day(today))).alias("avg_days_since_start"),
    )
    return per_group.join(wards.select("ward_code", "ward_name"), "ward_code", "left").select(
        "ward_code", "band", "ward_name", "total_accounts",
        F.col("liability").cast("double").alias("total_liability"),
        F.col("outstanding").cast("double").alias("total_outstanding"),
        "accounts_paid_up",
        F.round("avg_days_since_start", 4).alias("avg_days_since_start"),
        F.round(divide(F.col("accounts_paid_up") * 100.0, F.col("total_accounts"), None), 1).alias("collection_rate_pct"),
        (F.col("liability") - F.col("outstanding")).cast("double").alias("total_collected"),
    )


@query("ct_collection_summary", """
    select a.ward_code, a.band, w.ward_name, count(*) as total_accounts,
           cast(sum(cast(annual_charge as decimal(18,2))) as double) as total_liability,
           cast(sum(cast(balance_outstanding as decimal(18,2))) as double) as total_outstanding,
           cast(count(*) filter (where balance_outstanding <= 0) as bigint) as accounts_paid_up,
           round(avg(date_diff('day', liable_start, DATE '2001-12-31')), 4) as avg_days_since_start,
           round(count(*) filter (where balance_outstanding <= 0) * 100.0 / count(*), 1) as collection_rate_pct,
           cast(sum(cast(annual_charge as decimal(18,2))) - sum(cast(balance_outstanding as decimal(18,2))) as double)
             as total_collected
    from accounts a left join wards w on a.ward_code = w.ward_code
    group by a.ward_code, a.band, w.ward_name""")
def ct_collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection_summary(table(spark, sf_dir, "accounts"), table(spark, sf_dir, "wards"))


def source_extract(accounts: DataFrame, properties: DataFrame, today=AS_OF) -> DataFrame:
    """This year's accounts with the address of their property."""
    homes = properties.select(
        F.col("property_reference").alias("property_ref"), F.col("address_1").alias("address_line_1"),
        "postcode", "ward_code",
    )
    return (
        accounts.where(F.col("year") == F.year(day(today)))
        .select("account_ref", "property_ref", "liable_name", "liable_start", "band", "annual_charge",
                "balance_outstanding")
        .join(homes, "property_ref")
    )


@query("ct_source_extract", """
    select a.property_ref, a.account_ref, a.liable_name, a.liable_start, a.band, a.annual_charge,
           a.balance_outstanding, p.address_1 as address_line_1, p.postcode, p.ward_code
    from accounts a join properties p on a.property_ref = p.property_reference where a.year = 2001""")
def ct_source_extract(spark, sf_dir):
    return source_extract(table(spark, sf_dir, "accounts"), table(spark, sf_dir, "properties"))


@query("ct_bronze_audit", """
    select account_ref, band, annual_charge, 'revenues' as _source_system, 'batch-1' as _batch_id,
           '2001-12-31 02:00:00' as _ingested_at, 'OFFICIAL' as _data_classification, 7 as _retention_years
    from accounts""")
def ct_bronze_audit(spark, sf_dir):
    landed = current.with_audit(
        table(spark, sf_dir, "accounts").select("account_ref", "band", "annual_charge"),
        "revenues", "batch-1", "2001-12-31 02:00:00")
    tagged = current.with_policy(landed, "OFFICIAL", 7)
    return tagged.withColumn("_ingested_at", F.date_format("_ingested_at", "yyyy-MM-dd HH:mm:ss"))


@query("ct_postcode_standard", r"""
    with c as (select account_ref, postcode, upper(regexp_replace(postcode, '\s+', '', 'g')) as k from accounts),
    f as (select *, case when length(k) < 5 then k else concat(left(k, length(k) - 3), ' ', right(k, 3)) end as fmt from c)
    select account_ref, postcode, k as postcode_clean, fmt as postcode_formatted, rtrim(left(fmt, 4)) as postcode_area
    from f""")
def ct_postcode_standard(spark, sf_dir):
    return table(spark, sf_dir, "accounts").select(
        "account_ref", "postcode", text.postcode_clean("postcode").alias("postcode_clean"),
        text.postcode_formatted("postcode").alias("postcode_formatted"),
        text.postcode_area("postcode").alias("postcode_area"),
    )


LINE_TIES = ("l_extendedprice", "l_quantity", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag",
             "l_linestatus")


@query("ct_dedupe_latest", """
    select * exclude (rn, l_shipdate), cast(l_shipdate as date) as l_shipdate from (
      select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_extendedprice,
        l_quantity, l_partkey, l_suppkey, l_discount, l_tax, l_returnflag, l_linestatus) as rn from lineitem)
    where rn = 1""")
def ct_dedupe_latest(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    newest = current.latest_per_key(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate"], LINE_TIES)
    return newest.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


def order_states(spark: SparkSession, sf_dir: str, when: str) -> DataFrame:
    """Newest order of each customer among the orders meeting ``when``: a feed of account states."""
    orders = read(spark, sf_dir, "orders").where(when)
    newest = current.latest_per_key(orders, ["o_custkey"], ["o_orderdate"], ["o_orderkey"])
    return newest.select(
        F.col("o_custkey").alias("account_key"), F.col("o_orderstatus").alias("state"),
        F.col("o_orderpriority").alias("band"), F.col("o_totalprice").alias("charge"),
        F.col("o_orderdate").cast("date").alias("changed_on"))


ORDER_STATES_SQL = """
    latest as (select *, o_orderdate >= DATE '2000-01-01' as fresh,
        row_number() over (partition by o_custkey, o_orderdate >= DATE '2000-01-01'
                           order by o_orderdate desc, o_orderkey) as rn from orders),
    states as (select o_custkey as account_key, o_orderstatus as state, o_orderpriority as band,
        o_totalprice as charge, cast(o_orderdate as date) as changed_on, fresh from latest where rn = 1)"""

EARLIER = "o_orderdate < timestamp_ntz'2000-01-01'"
LATER = "o_orderdate >= timestamp_ntz'2000-01-01'"


@query("ct_upsert", f"""
    with {ORDER_STATES_SQL}
    select account_key, state, band, charge, changed_on from states where fresh
    union all
    select account_key, state, band, charge, changed_on from states t where not fresh
      and not exists (select 1 from states s where s.fresh and s.account_key = t.account_key)""")
def ct_upsert(spark, sf_dir):
    return current.upsert(order_states(spark, sf_dir, EARLIER), order_states(spark, sf_dir, LATER), ["account_key"])


@query("ct_collection_rate_yoy", """
    with y as (select year, cast(sum(cast(annual_charge as decimal(18,2))) as double) as charged,
        cast(sum(cast(annual_charge as decimal(18,2)) - cast(balance_outstanding as decimal(18,2))) as double)
          as collected from accounts group by year),
    r as (select year, coalesce(collected / nullif(charged, 0), 0) as rate from y)
    select r.year, round(r.rate, 6) as rate, round(r.rate - coalesce(p.rate, 0), 6) as rate_change
    from r left join r p on p.year = r.year - 1""")
def ct_collection_rate_yoy(spark, sf_dir):
    by_year = table(spark, sf_dir, "accounts").groupBy("year").agg(
        money("annual_charge").alias("charged"), money("balance_outstanding").alias("owed"))
    rated = by_year.select("year", divide(F.col("charged") - F.col("owed"), F.col("charged")).alias("rate"))
    both = timeline.prior_year(rated, "rate", "year", 1)
    return both.select("year", F.round("rate", 6).alias("rate"),
                       F.round(F.col("rate") - F.coalesce("rate_prior", F.lit(0.0)), 6).alias("rate_change"))


@query("ct_arrears_bands", """
    select case when coalesce(balance_outstanding, 0) = 0 then 'No Arrears' when balance_outstanding <= 200 then 'Low Risk'
             when balance_outstanding <= 500 then 'Medium Risk' when balance_outstanding <= 1000 then 'High Risk'
             else 'Critical' end as arrears_risk, count(*) as accounts,
           cast(sum(cast(balance_outstanding as decimal(18,2))) as double) as balance
    from accounts group by 1""")
def ct_arrears_bands(spark, sf_dir):
    return table(spark, sf_dir, "accounts").groupBy(arrears_band("balance_outstanding").alias("arrears_risk")).agg(
        rows().alias("accounts"), money("balance_outstanding").cast("double").alias("balance"))


# ------------------------------------------------------------- support cross-match

def active_accounts(accounts: DataFrame, wards: DataFrame, year: int) -> DataFrame:
    live = accounts.where((F.col("status") == "Active") & (F.col("year") == year))
    return live.join(wards.select("ward_code", "ward_name"), "ward_code").select(
        "account_ref", "property_ref", "liable_name", "postcode", "band", "annual_charge", "balance_outstanding",
        "ward_name")


def live_awards(awards: DataFrame, financial_year: str) -> DataFrame:
    kept = (F.col("award_status") == "Live") & (F.col("financial_year") == financial_year)
    return awards.where(kept).select("account_ref").distinct()


def live_claims(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("claim_status") == "Live").select("postcode", "surname", "claim_type", "weekly_amount")


def unclaimed(accounts: DataFrame, awards: DataFrame) -> DataFrame:
    """Accounts without a live award, with the award they could expect."""
    estimate = F.round(F.col("annual_charge").cast(MONEY) * F.lit(0.75).cast("decimal(3,2)"), 2)
    return accounts.join(awards, "account_ref", "left_anti").withColumn("estimated_cts_award", estimate.cast(MONEY))


def support_matches(accounts: DataFrame, awards: DataFrame, claims: DataFrame, whole_name: bool = False) -> DataFrame:
    """Accounts without support that share a postcode with a live benefit claim.

    The result is one row per account and claim. Equal claims travel as one row with a
    count, and postcodes with many rows on either side are joined in cells.
    """
    matched = join_in_cells(unclaimed(accounts, awards), counted_copies(claims), ["postcode"])
    alike = text.sounds_like("liable_name", "surname", whole_name)
    return unfold_copies(matched.select(
        "account_ref", "liable_name", "ward_name", "band", "annual_charge", "balance_outstanding",
        F.col("claim_type").alias("hb_claim_type"), F.col("weekly_amount").alias("hb_weekly_amount"),
        F.when(alike, "High").otherwise("Medium").alias("match_confidence"),
        F.col("estimated_cts_award").cast("double").alias("estimated_cts_award"), "_copies", "_part",
    ))


def _cross_match_inputs(spark, sf_dir):
    return (
        active_accounts(table(spark, sf_dir, "accounts"), table(spark, sf_dir, "wards"), 2001),
        live_awards(table(spark, sf_dir, "cts_awards"), "2001/02"),
        live_claims(table(spark, sf_dir, "benefit_claims")),
    )


CROSS_MATCH_SQL = """
    active as (select a.*, w.ward_name from accounts a join wards w on a.ward_code = w.ward_code
               where a.status = 'Active' and a.year = 2001),
    open_accounts as (select * from active where account_ref not in
        (select account_ref from cts_awards where award_status = 'Live' and financial_year = '2001/02')),
    matched as (select o.*, h.surname as hb_surname, h.claim_type, h.weekly_amount from open_accounts o
        join benefit_claims h on o.postcode = h.postcode where h.claim_status = 'Live')"""


@query("cts_cross_match", f"""
    with {CROSS_MATCH_SQL}
    select account_ref, liable_name, ward_name, band, annual_charge, balance_outstanding,
           claim_type as hb_claim_type, weekly_amount as hb_weekly_amount,
           cast(round(cast(annual_charge as decimal(18,2)) * 0.75, 2) as double) as estimated_cts_award
    from matched""")
def cts_cross_match(spark, sf_dir):
    return support_matches(*_cross_match_inputs(spark, sf_dir)).drop("match_confidence")


def _soundex_sql(word: str) -> str:
    """Soundex in plain SQL: letter codes, H and W skipped, runs collapsed, vowels dropped, three digits kept."""
    letters, codes = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230127022455012623017202"
    code = f"translate(upper({word}), '{letters}', '{codes}')"
    first = f"replace(left({code}, 1), '7', '0')"
    run = f"concat({first}, replace(substring({code}, 2), '7', ''))"
    for digit in "0123456":
        run = f"regexp_replace({run}, '{digit}+', '{digit}', 'g')"
    return f"concat(upper(left({word}, 1)), left(rpad(replace(substring({run}, 2), '0', ''), 3, '0'), 3))"


@query("cts_cross_match_soundex", f"""
    with {CROSS_MATCH_SQL}, w as (select *, list_last(string_split(liable_name, ' ')) as last_name from matched)
    select account_ref, liable_name, ward_name, band, annual_charge, balance_outstanding,
           claim_type as hb_claim_type, weekly_amount as hb_weekly_amount,
           cast(round(cast(annual_charge as decimal(18,2)) * 0.75, 2) as double) as estimated_cts_award,
           case when {_soundex_sql('last_name')} = {_soundex_sql('hb_surname')} then 'High' else 'Medium' end as match_confidence
    from w""")
def cts_cross_match_soundex(spark, sf_dir):
    return support_matches(*_cross_match_inputs(spark, sf_dir))


@query("cts_ranked", f"""
    with {CROSS_MATCH_SQL}, w as (select *, list_last(string_split(liable_name, ' ')) as last_name from matched),
    graded as (select *, case when {_soundex_sql('last_name')} = {_soundex_sql('hb_surname')} then 'High' else 'Medium' end as match_confidence from w)
    select row_number() over (order by balance_outstanding desc, match_confidence, account_ref, claim_type, weekly_amount) as rank,
           account_ref, balance_outstanding, match_confidence, claim_type as hb_claim_type,
           cast(round(cast(annual_charge as decimal(18,2)) * 0.75, 2) as double) as estimated_cts_award
    from graded""")
def cts_ranked(spark, sf_dir):
    """The matches in order of what is owed and how sure the match is, with their rank."""
    found = support_matches(*_cross_match_inputs(spark, sf_dir)).where(F.col("match_confidence").isin("High", "Medium"))
    order = [F.col("balance_outstanding").desc(), F.col("match_confidence"), F.col("account_ref"), F.col("hb_claim_type"), F.col("hb_weekly_amount")]
    return numbered(found, order).select("rank", "account_ref", "balance_outstanding", "match_confidence", "hb_claim_type", "estimated_cts_award")


@query("cts_award_summary", f"""
    with {CROSS_MATCH_SQL}
    select count(*) as matches, count(distinct account_ref) as accounts,
           cast(sum(round(cast(annual_charge as decimal(18,2)) * 0.75, 2)) as double) as unclaimed_support
    from matched""")
def cts_award_summary(spark, sf_dir):
    """Totals of the cross-match without forming its pairs: claims are counted per postcode first."""
    accounts, awards, claims = _cross_match_inputs(spark, sf_dir)
    per_postcode = claims.groupBy("postcode").agg(rows().alias("claims"))
    joined = unclaimed(accounts, awards).join(per_postcode, "postcode")
    return joined.agg(
        F.coalesce(F.sum("claims"), F.lit(0)).alias("matches"), F.count_distinct("account_ref").alias("accounts"),
        F.sum(F.col("estimated_cts_award") * F.col("claims")).cast("double").alias("unclaimed_support"))


@query("ct_active_accounts", """
    with active as (select a.*, w.ward_name from accounts a join wards w on a.ward_code = w.ward_code
                    where a.status = 'Active' and a.year = 2001)
    select account_ref, property_ref, liable_name, postcode, band, annual_charge, balance_outstanding, ward_name
    from active""")
def ct_active_accounts(spark, sf_dir):
    return active_accounts(table(spark, sf_dir, "accounts"), table(spark, sf_dir, "wards"), 2001)


@query("ct_distinct_awards", """
    select distinct account_ref from cts_awards where award_status = 'Live' and financial_year = '2001/02'""")
def ct_distinct_awards(spark, sf_dir):
    return live_awards(table(spark, sf_dir, "cts_awards"), "2001/02")


@query("ct_filters", """
    select account_ref, property_ref, band, liable_start from accounts
    where status = 'Active' and year = 2001 and band in ('A', 'B', 'C') and forename is not null
      and liable_start >= DATE '1990-06-30'""")
def ct_filters(spark, sf_dir):
    """Equality, list, not-null, current-year and trailing-years filters together."""
    accounts = table(spark, sf_dir, "accounts")
    return accounts.where(
        (F.col("status") == "Active") & (F.col("year") == F.year(day(AS_OF))) & F.col("band").isin("A", "B", "C")
        & F.col("forename").isNotNull() & (F.col("liable_start") >= F.add_months(day(AS_OF), -138))
    ).select("account_ref", "property_ref", "band", "liable_start")


@query("cts_scalar_battery", r"""
    select account_ref, upper(trim(liable_name)) as name_upper, replace(postcode, ' ', '') as no_space,
           left(postcode, 4) as first4, right(postcode, 3) as last3, length(postcode) as n_chars,
           concat(band, '-', ward_code) as band_ward,
           cast(round(cast(annual_charge as decimal(18,2)) * 0.75, 2) as double) as award,
           cast(year(liable_start) as int) as start_year, cast(liable_start + interval 12 month as date) as year_later,
           try_cast(start_date as date) as parsed_start, cast(date_trunc('month', liable_start) as date) as start_month,
           date_diff('day', liable_start, DATE '2001-12-31') as days_liable,
           coalesce(nullif(title, ''), '(none)') as shown_title,
           contains(lower(liable_name), 'son') as has_son
    from accounts""")
def cts_scalar_battery(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "accounts").select(
        "account_ref", F.upper(F.trim("liable_name")).alias("name_upper"),
        F.replace(c("postcode"), F.lit(" "), F.lit("")).alias("no_space"),
        F.left("postcode", F.lit(4)).alias("first4"), F.right("postcode", F.lit(3)).alias("last3"),
        F.length("postcode").cast("long").alias("n_chars"), F.concat("band", F.lit("-"), "ward_code").alias("band_ward"),
        F.round(c("annual_charge").cast(MONEY) * F.lit(0.75).cast("decimal(3,2)"), 2).cast("double").alias("award"),
        F.year("liable_start").alias("start_year"), F.add_months("liable_start", 12).alias("year_later"),
        F.try_to_date("start_date", "yyyy-MM-dd").alias("parsed_start"), F.trunc("liable_start", "MM").alias("start_month"),
        days_between("liable_start", day(AS_OF)).cast("long").alias("days_liable"),
        F.coalesce(F.nullif("title", F.lit("")), F.lit("(none)")).alias("shown_title"),
        text.contains_folded("liable_name", "son").alias("has_son"),
    )
