"""Domain tables (accounts, properties, repairs ...) as projections of the supplied star schema.

Every projection is a list of SQL expressions that Spark and DuckDB read alike, so
the same text feeds ``selectExpr`` here and the check queries. Nothing is filtered:
each domain table keeps every row of the tables it is built from.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Reporting dates used by the registered queries in place of "today".
AS_OF = "2001-12-31"
REFERRAL_AS_OF = "2024-02-29"

FORENAMES = (
    "ALICE,BENJAMIN,CHLOE,DANIEL,ELEANOR,FRANCIS,GRACE,HARRY,ISLA,JACOB,KATHERINE,LEWIS,"
    "MARTHA,NATHAN,OLIVIA,PETER,QUENTIN,ROSE,SAMUEL,THERESA,UMA,VICTOR,WINIFRED,YASMIN"
)
SURNAMES = (
    "ARMSTRONG,BELL,CHARLTON,DIXON,ELLIOTT,FENWICK,GRAHAM,HERON,IRVING,JOHNSTONE,KERR,LITTLE,"
    "MAXWELL,NIXON,OLIVER,POTTS,QUAYLE,ROBSON,STOREY,TAIT,URWIN,VEITCH,WAKE,YOUNG,BURN,CARR,"
    "DODD,FORSTER,HALL,HEDLEY,LAING,MILBURN,NOBLE,RIDLEY,SCOTT,SHAFTOE,TROTTER,TURNBULL,"
    "WILKINSON,YARROW"
)


def _pick(values: str, index: str) -> str:
    return f"split_part('{values}', ',', cast({index} as int))"


def _int_div(value: str, by: int) -> str:
    return f"cast(floor({value} / {by}) as bigint)"


def _letter(value: str) -> str:
    return f"chr(cast(65 + {value} as int))"


def forename(key: str) -> str:
    return _pick(FORENAMES, f"{key} % 24 + 1")


def surname(key: str) -> str:
    return _pick(SURNAMES, f"{_int_div(key, 3)} % 40 + 1")


def postcode(key: str) -> str:
    return (
        f"concat('NE', cast(1 + {key} % 40 as string), ' ', cast({_int_div(key, 40)} % 10 as string), "
        f"{_letter(_int_div(key, 400) + ' % 26')}, {_letter(_int_div(key, 10400) + ' % 26')})"
    )


def ward(key: str) -> str:
    return f"concat('E0500', cast(1080 + {key} as string))"


#: Exact decimal net price of an order line, to the penny.
NET_PRICE = "cast(cast(l_extendedprice as decimal(18,2)) * cast(1 - l_discount as decimal(4,2)) as decimal(18,2))"


def birth_date(key: str) -> str:
    return f"DATE '1940-01-01' + cast(({key} * 7919) % 20000 as int)"


@dataclass(frozen=True)
class Projection:
    """``select exprs from tables[0] [join tables[1] on ...]``."""

    tables: tuple[str, ...]
    exprs: tuple[str, ...]
    on: tuple[str, ...] = ()


def _projection(tables: str, *exprs: str, on: str = "") -> Projection:
    return Projection(tuple(tables.split()), exprs, tuple(on.split()))


def _persons(table: str, prefix: str, row: str, key: str, system: str) -> Projection:
    """One source system's view of people: ``key`` is the person, ``row`` drives the spelling noise."""
    name, family, home = forename(key), surname(key), _int_div(key, 2)
    return _projection(
        table,
        f"concat('{prefix}', lpad(cast({row} as string), 12, '0')) as person_id",
        f"case when {row} % 11 = 3 then concat(left({name}, 1), substring({name}, 3)) "
        f"when {row} % 13 = 5 then concat({name}, 'E') else {name} end as forename",
        f"case when {row} % 19 = 7 then concat({family}, 'S') "
        f"when {row} % 43 = 9 then null else {family} end as surname",
        f"case when {row} % 31 = 3 then '1985-02-31' when {row} % 29 = 11 then null "
        f"when {row} % 23 = 2 then cast({birth_date(key)} + 1 as string) "
        f"else cast({birth_date(key)} as string) end as dob",
        f"case when {row} % 37 = 5 then null when {row} % 17 = 1 then {postcode(home + ' + 1')} "
        f"else {postcode(home)} end as postcode",
        f"'{system}' as source_system",
    )


PROJECTIONS: dict[str, Projection] = {
    "wards": _projection(
        "nation",
        f"{ward('n_nationkey')} as ward_code",
        "n_name as ward_name",
        "cast(8 + 1.5 * ((n_nationkey * 7) % 25) as double) as imd_score",
        "n_regionkey as area_key",
    ),
    "accounts": _projection(
        "customer",
        "c_custkey",
        "concat('CT', lpad(cast(c_custkey as string), case when c_custkey % 53 = 0 then 6 else 8 end, '0')) "
        "as account_ref",
        f"concat('P', lpad(cast({_int_div('c_custkey', 2)} as string), 8, '0')) as property_ref",
        "case when c_custkey % 13 = 0 then '' else "
        f"{_pick('Mr,Mrs,Ms,Dr', 'c_custkey % 4 + 1')} end as title",
        f"case when c_custkey % 29 = 0 then null else {forename('c_custkey')} end as forename",
        f"case when c_custkey % 31 = 0 then '' else {surname('c_custkey')} end as surname",
        f"concat({forename('c_custkey')}, ' ', {surname('c_custkey')}) as liable_name",
        f"{ward('c_nationkey')} as ward_code",
        f"{_letter('c_custkey % 9')} as band",
        "c_acctbal as balance_outstanding",
        "case when c_custkey % 47 = 0 then -500.0 else cast(1000 + 10 * (c_custkey % 100) as double) end "
        "as annual_charge",
        "DATE '1990-04-01' + cast(c_custkey % 3000 as int) as liable_start",
        "case when c_custkey % 41 = 0 then '2001-13-01' when c_custkey % 59 = 0 then '2002-06-01' else "
        "cast(DATE '1990-04-01' + cast(c_custkey % 3000 as int) as string) end as start_date",
        "case when c_custkey % 50 = 0 then 'INVALID' when c_custkey % 7 = 0 then "
        f"lower(replace({postcode(_int_div('c_custkey', 2))}, ' ', '')) "
        f"else {postcode(_int_div('c_custkey', 2))} end as postcode",
        "case when c_custkey % 10 = 9 then 'Closed' else 'Active' end as status",
        "cast(2000 + c_custkey % 2 as int) as year",
        "c_mktsegment as segment",
    ),
    "properties": _projection(
        "part",
        "concat('P', lpad(cast(p_partkey as string), 8, '0')) as property_reference",
        "concat(' ', cast(1 + p_partkey % 200 as string), ' ', p_name, ' road ') as address_1",
        "concat(p_brand, ' ') as address_2",
        "lower(p_type) as address_3",
        f"case when p_partkey % 9 = 0 then lower({postcode('p_partkey')}) "
        f"when p_partkey % 5 = 0 then replace({postcode('p_partkey')}, ' ', '  ') "
        f"when p_partkey % 61 = 0 then 'NE' else {postcode('p_partkey')} end as postcode",
        f"{ward('p_partkey % 25')} as ward_code",
        "p_type as property_type",
        "cast(p_size % 12 as int) as bedrooms",
        "cast(1900 + p_size as int) as build_year",
        f"{_pick('Secure,Introductory,Leasehold', 'p_partkey % 3 + 1')} as tenure_type",
        f"{_pick('Occupied,Occupied,Void,Under Repair', 'p_size % 4 + 1')} as void_status",
        "case when p_size % 4 >= 2 then DATE '2001-01-01' + cast(p_partkey % 300 as int) end as void_start_date",
        "DATE '2001-06-01' + cast(p_partkey % 200 as int) as last_modified_date",
        "p_brand as brand",
    ),
    "repairs": _projection(
        "lineitem orders",
        "concat('R', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as repair_id",
        "concat('P', lpad(cast(l_partkey as string), 8, '0')) as property_ref",
        "cast(least(o_orderdate, l_shipdate) as date) as reported_date",
        "case when l_linestatus = 'O' then null else cast(greatest(o_orderdate, l_shipdate) as date) end "
        "as completed_date",
        "case l_returnflag when 'A' then 'Plumbing' when 'N' then 'Electrical' else 'Structural' end "
        "as repair_category",
        "case left(o_orderpriority, 1) when '1' then 'Emergency' when '2' then 'Urgent' "
        "when '3' then 'Routine' else 'Planned' end as priority",
        "l_suppkey as contractor",
        "l_extendedprice as cost_estimate",
        f"case when l_linestatus = 'O' then null else cast({NET_PRICE} as double) end as actual_cost",
        "case when l_linestatus = 'O' then 'Open' else 'Completed' end as status",
        "cast(greatest(o_orderdate, l_shipdate) as date) as last_modified",
        on="l_orderkey o_orderkey",
    ),
    "requests": _projection(
        "orders customer",
        "o_orderkey as request_id",
        "c_mktsegment as department",
        "cast(o_orderdate as date) as request_date",
        "o_totalprice as amount",
        f"{ward('c_nationkey')} as ward_code",
        on="o_custkey c_custkey",
    ),
    "referrals": _projection(
        "events",
        "event_id as referral_id",
        "cast(ts as date) - cast((user_id % 24) * 30 as int) as contact_date",
        f"{_pick('GP,Hospital,Self,Police', 'event_id % 4 + 1')} as referral_source",
        "event_type as primary_support_reason",
        f"{_pick('18-64,65-74,75-84,85+', _int_div('user_id', 7) + ' % 4 + 1')} as age_band",
        f"case when {_int_div('user_id', 3)} % 2 = 0 then 'F' else 'M' end as gender",
        "lpad(cast(user_id as string), 10, '9') as nhs_number",
        f"{postcode('user_id')} as postcode",
        f"{ward('user_id % 25')} as ward_code",
        "case when value >= 20 then 'Service Provided' when value >= 5 then 'Signposted' else 'NFA' end as outcome",
        "case when value < 5 then null else cast(ts as date) - cast((user_id % 24) * 30 as int) "
        "+ cast(event_id % 21 as int) end as assessment_date",
        "user_id",
    ),
    "collections": _projection(
        "lineitem",
        "concat('W', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as collection_id",
        "l_partkey as property_uprn",
        f"{ward('l_partkey % 25')} as ward_code",
        "case l_returnflag when 'A' then 'Residual' when 'N' then 'Recycling' else 'Garden' end as collection_type",
        "cast(l_shipdate as date) as scheduled_date",
        "l_linestatus = 'F' as collected",
    ),
    "benefit_claims": _projection(
        "supplier",
        f"{postcode(_int_div('s_suppkey', 2))} as postcode",
        f"{surname('s_suppkey')} as surname",
        f"{_pick('Rent Rebate,Rent Allowance', 's_suppkey % 2 + 1')} as claim_type",
        "round(abs(s_acctbal) / 50, 2) as weekly_amount",
        "case when s_suppkey % 6 = 5 then 'Ended' else 'Live' end as claim_status",
    ),
    "cts_awards": _projection(
        "orders",
        "concat('CT', lpad(cast(o_custkey as string), 8, '0')) as account_ref",
        "case o_orderstatus when 'F' then 'Live' when 'O' then 'Suspended' else 'Ended' end as award_status",
        "concat(cast(year(o_orderdate) as string), '/', right(cast(year(o_orderdate) + 1 as string), 2)) "
        "as financial_year",
    ),
    "budget_lines": _projection(
        "lineitem part",
        "p_type as department",
        "cast(l_extendedprice as decimal(18,2)) as allocated",
        f"cast({NET_PRICE} * cast(1 + l_tax as decimal(4,2)) as decimal(18,2)) as spent",
        on="l_partkey p_partkey",
    ),
    "revenues_persons": _persons("customer", "R", "c_custkey", "c_custkey", "revenues"),
    "housing_persons": _persons("orders", "H", "o_orderkey", "o_custkey", "housing"),
    "social_persons": _persons("events", "S", "event_id", "user_id", "social"),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table by name."""
    spec = PROJECTIONS[name]
    frame = read(spark, sf_dir, spec.tables[0])
    if spec.on:
        other = read(spark, sf_dir, spec.tables[1])
        frame = frame.join(other, frame[spec.on[0]] == other[spec.on[1]])
    return frame.selectExpr(*spec.exprs)


def table_sql(name: str) -> str:
    """The same projection as a SELECT for the check engine."""
    spec = PROJECTIONS[name]
    source = spec.tables[0]
    if spec.on:
        source += f" join {spec.tables[1]} on {spec.on[0]} = {spec.on[1]}"
    return f"select {', '.join(spec.exprs)} from {source}"


_WORD = re.compile(r"\b(?:from|join)\s+([a-z_0-9]+)", re.IGNORECASE)


def with_domain_tables(sql: str) -> str:
    """Prefix a check query with the domain tables it names."""
    named = {m.group(1) for m in _WORD.finditer(sql)}
    ctes = [f"{n} as ({table_sql(n)})" for n in PROJECTIONS if n in named]
    body = sql.strip()
    if not ctes:
        return body
    if body[:5].lower() == "with ":
        head = "with recursive " if body[5:].lstrip().lower().startswith("recursive ") else "with "
        rest = body[5:].lstrip()
        rest = rest[len("recursive "):] if head != "with " else rest
        return f"{head}{', '.join(ctes)}, {rest}"
    return f"with {', '.join(ctes)} {body}"
