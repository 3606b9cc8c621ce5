"""Data-quality queries over the council-tax accounts, properties and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civiclake.functions import text
from civiclake.functions.measures import day
from civiclake.operators import quality
from civiclake.plans.properties import STAGED_SQL, staged
from civiclake.plans.registry import query
from civiclake.sources.domain import AS_OF, read, table

# The reference ward set holds codes up to ...1099; later codes are genuine failures.
WARD_LIMIT = "E05001099"


def suite(spark, sf_dir) -> quality.Suite:
    known = table(spark, sf_dir, "wards").where(F.col("ward_code") <= WARD_LIMIT).select("ward_code")
    return quality.council_tax_suite(known, day(AS_OF))


_TEXTS = ", ".join(f"('{k}', '{name}', '{text_}')" for k, (name, text_) in quality.RULE_TEXTS.items())
RULES_SQL = rf"""
    rule_texts as (select * from (values {_TEXTS}) t(rule_id, rule_name, description)),
    flags as (select a.*,
        coalesce(account_ref <> '', false) as "R001",
        coalesce(account_ref = '', true) or regexp_full_match(account_ref, 'CT\d{{8}}') as "R002",
        coalesce(surname <> '', false) as "R003", coalesce(forename <> '', false) as "R004",
        coalesce(postcode = '', true) or regexp_full_match(postcode, '[A-Z]{{1,2}}\d[A-Z\d]?\s*\d[A-Z]{{2}}', 'i') as "R005",
        coalesce(ward_code in (select ward_code from wards where ward_code <= 'E05001099'), false) as "R006",
        coalesce(band in ('A','B','C','D','E','F','G','H'), false) as "R007",
        coalesce(try_cast(start_date as date) <= DATE '2001-12-31', false) as "R008",
        coalesce(annual_charge > 0 and not isnan(annual_charge), false) as "R009",
        coalesce(title <> '', false) as "R010" from accounts a),
    long as (select account_ref, year(liable_start) as batch, t.* from flags, lateral (values
        ('R001','account_ref',account_ref,'fail',"R001"), ('R002','account_ref',account_ref,'fail',"R002"),
        ('R003','surname',surname,'fail',"R003"), ('R004','forename',forename,'warn',"R004"),
        ('R005','postcode',postcode,'fail',"R005"), ('R006','ward_code',ward_code,'fail',"R006"),
        ('R007','band',band,'fail',"R007"), ('R008','start_date',start_date,'fail',"R008"),
        ('R009','annual_charge',cast(annual_charge as string),'fail',"R009"), ('R010','title',title,'warn',"R010"))
        t(rule_id, field, raw, severity, ok)),
    card as (select batch, count(*) as total_checks, count(*) filter (where ok) as passed,
        count(*) filter (where not ok and severity = 'warn') as warnings,
        count(*) filter (where not ok and severity = 'fail') as failures,
        round(count(*) filter (where ok) * 100.0 / count(*), 1) as score from long group by batch)"""


def _card_sql(source: str) -> str:
    return f"""select total_checks, passed, warnings, failures, score, case when score >= 90 then 'pass'
      when score >= 70 then 'warn' else 'fail' end as band from {source}"""


@query("dq_scorecard", f"""
    with {RULES_SQL}, one as (select cast(sum(total_checks) as bigint) as total_checks, cast(sum(passed) as bigint) as passed,
      cast(sum(warnings) as bigint) as warnings, cast(sum(failures) as bigint) as failures,
      round(sum(passed) * 100.0 / sum(total_checks), 1) as score from card) {_card_sql('one')}""")
def dq_scorecard(spark, sf_dir):
    return suite(spark, sf_dir).scorecard(table(spark, sf_dir, "accounts"))


@query("dq_by_rule", f"""
    with {RULES_SQL} select rule_id, rule_name, field, severity, count(*) filter (where ok) as passed,
      count(*) filter (where not ok) as failed from long join rule_texts using (rule_id) group by 1, 2, 3, 4""")
def dq_by_rule(spark, sf_dir):
    return suite(spark, sf_dir).by_rule(table(spark, sf_dir, "accounts"))


@query("dq_results", f"""
    with {RULES_SQL} select account_ref as key_account_ref, rule_id, rule_name, field, ok as passed, severity, description,
      case when raw is null then '(null)' when raw = '' then '(empty)' else raw end as value,
      cast(substr(rule_id, 2) as int) as rule_number from long join rule_texts using (rule_id)""")
def dq_results(spark, sf_dir):
    return suite(spark, sf_dir).results(table(spark, sf_dir, "accounts"), ["account_ref"])


@query("dq_issues", f"""
    with {RULES_SQL} select account_ref as key_account_ref, rule_id, rule_name, field, severity, description,
      case when raw is null then '(null)' when raw = '' then '(empty)' else raw end as value,
      cast(substr(rule_id, 2) as int) as rule_number from long join rule_texts using (rule_id) where not ok""")
def dq_issues(spark, sf_dir):
    return suite(spark, sf_dir).issues(table(spark, sf_dir, "accounts"), ["account_ref"])


@query("dq_gate", f"""
    with {RULES_SQL}, one as (select round(sum(passed) * 100.0 / sum(total_checks), 1) as score from card)
    select account_ref, band, annual_charge from accounts where (select score from one) >= 70""")
def dq_gate(spark, sf_dir):
    """The accounts if their score reaches 70, as a published table would be; no rows where the gate is shut."""
    accounts = table(spark, sf_dir, "accounts")
    try:
        passed = suite(spark, sf_dir).gate(accounts, 70)
    except quality.QualityGateError:
        passed = accounts.where("false")
    return passed.select("account_ref", "band", "annual_charge")


@query("dq_quarantine", f"""
    with {RULES_SQL}, broken as (select account_ref, string_agg(rule_id, ',' order by rule_id) as rules
      from long where not ok and severity = 'fail' group by 1) select account_ref, rules from broken""")
def dq_quarantine(spark, sf_dir):
    _, held = suite(spark, sf_dir).split(table(spark, sf_dir, "accounts"))
    return held.select("account_ref", F.array_join("_dq_failed", ",").alias("rules"))


@query("dq_clean_rows", f"""
    with {RULES_SQL} select account_ref, band, postcode from flags
    where "R001" and "R002" and "R003" and "R005" and "R006" and "R007" and "R008" and "R009" """)
def dq_clean_rows(spark, sf_dir):
    clean, _ = suite(spark, sf_dir).split(table(spark, sf_dir, "accounts"))
    return clean.select("account_ref", "band", "postcode")


@query("dq_history", f"""
    with {RULES_SQL} select cast(batch as int) as batch, score,
      round(score - lag(score) over (order by batch), 1) as change from card""")
def dq_history(spark, sf_dir):
    """Score per batch (year of liability) with its change on the batch before."""
    accounts = table(spark, sf_dir, "accounts").withColumn("batch", F.year("liable_start"))
    cards = suite(spark, sf_dir).scorecard(accounts, ["batch"])
    w = Window.orderBy("batch")  # one row per batch: a history, not the data
    return cards.select("batch", "score", F.round(F.col("score") - F.lag("score").over(w), 1).alias("change"))


# ------------------------------------------------------------- column tests

@query("dq_unique", """
    select text, count(*) as n from documents where text is not null group by text having count(*) > 1""")
def dq_unique(spark, sf_dir):
    return quality.duplicates(read(spark, sf_dir, "documents"), "text")


@query("dq_relationships", """
    select o_orderkey, o_custkey from orders where o_custkey is not null
      and o_custkey not in (select c_custkey from customer where c_acctbal >= 0)""")
def dq_relationships(spark, sf_dir):
    """Orders whose customer is not among the customers in credit."""
    in_credit = read(spark, sf_dir, "customer").where("c_acctbal >= 0")
    return quality.orphans(read(spark, sf_dir, "orders"), "o_custkey", in_credit, "c_custkey").select("o_orderkey", "o_custkey")


@query("dq_between", f"""
    with {STAGED_SQL} select property_id, bedrooms from staged where not (bedrooms between 0 and 10)""")
def dq_between(spark, sf_dir):
    return staged(table(spark, sf_dir, "properties")).where(quality.outside("bedrooms", 0, 10)).select("property_id", "bedrooms")


@query("dq_regex", rf"""
    with {STAGED_SQL} select property_id, postcode from staged
    where not regexp_full_match(postcode, '[A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}}')""")
def dq_regex(spark, sf_dir):
    homes = staged(table(spark, sf_dir, "properties"))
    return homes.where(quality.not_matching("postcode", text.POSTCODE_ONE_SPACE)).select("property_id", "postcode")


@query("dq_test_report", rf"""
    with {STAGED_SQL},
    t as (
      select 'unique_property_id' as test, (select count(*) from (select 1 from staged group by property_id
        having count(*) > 1)) as failures
      union all select 'not_null_property_id', count(*) filter (where property_id is null) from staged
      union all select 'not_null_postcode', count(*) filter (where postcode is null) from staged
      union all select 'regex_postcode', count(*) filter (where not regexp_full_match(postcode,
        '[A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}}')) from staged
      union all select 'not_null_ward_code', count(*) filter (where ward_code is null) from staged
      union all select 'relationships_ward_code', count(*) from staged where ward_code not in
        (select ward_code from wards where ward_code <= 'E05001099')
      union all select 'between_bedrooms', count(*) filter (where not (bedrooms between 0 and 10)) from staged)
    select test, failures, case when failures = 0 then 'PASS' else 'FAIL' end as status from t""")
def dq_test_report(spark, sf_dir):
    """The staging model's column tests: five in one pass, uniqueness and the foreign key beside it."""
    homes = staged(table(spark, sf_dir, "properties"))
    known = table(spark, sf_dir, "wards").where(F.col("ward_code") <= WARD_LIMIT)
    return quality.test_report(
        homes,
        {
            "not_null_property_id": quality.not_null("property_id"),
            "not_null_postcode": quality.not_null("postcode"),
            "regex_postcode": quality.not_matching("postcode", text.POSTCODE_ONE_SPACE),
            "not_null_ward_code": quality.not_null("ward_code"),
            "between_bedrooms": quality.outside("bedrooms", 0, 10),
        },
        {
            "unique_property_id": quality.duplicates(homes, "property_id"),
            "relationships_ward_code": quality.orphans(homes, "ward_code", known, "ward_code"),
        },
    )


# Declared types of the account columns.
ACCOUNT_TYPES = {
    "account_ref": "VARCHAR(10)", "property_ref": "VARCHAR(12)", "liable_name": "VARCHAR(15)",
    "postcode": "VARCHAR(8)", "ward_code": "VARCHAR(9)", "band": "CHAR(1)",
    "annual_charge": "DECIMAL(10,2)", "start_date": "DATE",
}


@query("dq_dictionary_rules", """
    select 'account_ref' as column_name, 'VARCHAR(10)' as declared, count(*) filter (where length(account_ref) > 10) as failures from accounts
    union all select 'property_ref', 'VARCHAR(12)', count(*) filter (where length(property_ref) > 12) from accounts
    union all select 'liable_name', 'VARCHAR(15)', count(*) filter (where length(liable_name) > 15) from accounts
    union all select 'postcode', 'VARCHAR(8)', count(*) filter (where length(postcode) > 8) from accounts
    union all select 'ward_code', 'VARCHAR(9)', count(*) filter (where length(ward_code) > 9) from accounts
    union all select 'band', 'CHAR(1)', count(*) filter (where length(band) > 1) from accounts
    union all select 'annual_charge', 'DECIMAL(10,2)', count(*) filter (where annual_charge is not null and
      try_cast(annual_charge as decimal(10,2)) is null) from accounts
    union all select 'start_date', 'DATE', count(*) filter (where start_date is not null and
      try_cast(start_date as date) is null) from accounts""")
def dq_dictionary_rules(spark, sf_dir):
    """Length and type rules generated from a data dictionary, all in one pass."""
    checks = {c: ~quality.conforms(c, declared) for c, declared in ACCOUNT_TYPES.items()}
    report = quality.test_report(table(spark, sf_dir, "accounts"), checks)
    declared = F.create_map(*[F.lit(x) for pair in ACCOUNT_TYPES.items() for x in pair])
    return report.select(F.col("test").alias("column_name"), declared[F.col("test")].alias("declared"), "failures")


@query("dq_schema", """
    select column_name, expected, actual, status, n as n_rows from (values
      ('c_custkey', 'bigint', 'bigint', 'ok'), ('c_name', 'string', 'string', 'ok'),
      ('c_nationkey', 'bigint', 'int', 'type_changed'), ('c_phone', 'string', null, 'missing'),
      ('c_acctbal', null, 'double', 'unexpected'), ('c_mktsegment', null, 'string', 'unexpected'))
      v(column_name, expected, actual, status), (select count(*) as n from customer)""")
def dq_schema(spark, sf_dir):
    """Landing check of the customer feed against the schema it is expected to have."""
    customer = read(spark, sf_dir, "customer")
    expected = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint", "c_phone": "string"}
    drift = quality.schema_drift(expected, customer)
    entries = [
        F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("column_name", "expected", "actual", "status"), row)])
        for row in drift
    ]
    return customer.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(F.array(*entries)), "n_rows")


# Hours each feed may lag.
FRESHNESS_HOURS = {"orders": 48, "lineitem": 24 * 120, "events": 6}


@query("dq_freshness", """
    with f as (select 'orders' as dataset, max(o_orderdate) as newest, 48 as target_hours from orders
      union all select 'lineitem', max(l_shipdate), 2880 from lineitem
      union all select 'events', max(ts), 6 from events)
    select dataset, strftime(newest, '%Y-%m-%d %H:%M:%S') as newest, target_hours,
           newest >= case dataset when 'events' then TIMESTAMP '2024-01-31 03:00:00' else TIMESTAMP '2002-01-01 00:00:00' end
             - to_hours(target_hours) as fresh from f""")
def dq_freshness(spark, sf_dir):
    """Newest record per feed against its target."""
    now = {"orders": "2002-01-01 00:00:00", "lineitem": "2002-01-01 00:00:00", "events": "2024-01-31 03:00:00"}
    stamps = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
    parts: list[DataFrame] = []
    for name, hours in FRESHNESS_HOURS.items():
        newest = F.max(stamps[name])
        limit = F.lit(now[name]).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")
        parts.append(read(spark, sf_dir, name).agg(
            F.lit(name).alias("dataset"), F.date_format(newest, "yyyy-MM-dd HH:mm:ss").alias("newest"),
            F.lit(hours).alias("target_hours"), (newest >= limit).alias("fresh")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
