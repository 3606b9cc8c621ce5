"""Governance queries: a catalogue read from the documents, lineage from page paths, access to accounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclake.operators import governance
from civiclake.plans.registry import query
from civiclake.sources.domain import read, table

EMAIL = r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+"


def catalogue(spark, sf_dir, typed: bool = True) -> DataFrame:
    """Documents as catalogue entries whose columns are the lines of the text; search needs neither types nor marks of personal data."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    docs = read(spark, sf_dir, "documents").join(labels, "doc_id", "left")

    def line(x, i):
        name = F.concat(F.lit("line_"), (i + 1).cast("string")).alias("name")
        if not typed:
            return F.struct(name, x.alias("description"))
        size = F.concat(F.lit("VARCHAR("), F.length(x).cast("string"), F.lit(")")).alias("type")
        return F.struct(name, size, x.alias("description"), x.rlike(EMAIL).alias("pii"))

    return docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("lang").alias("owner"),
        F.col("text").alias("description"),
        F.when(F.col("toxic") == 1, "sensitive").when(F.col("toxic") == 0, "official").otherwise("public").alias("classification"),
        F.transform(F.split("text", "\n"), line).alias("columns"))


ENTRIES_SQL = """
    entries as (select d.doc_id as id, source as name, lang as owner, text as description,
        case l.toxic when 1 then 'sensitive' when 0 then 'official' else 'public' end as classification
        from documents d left join labels l on l.doc_id = d.doc_id),
    lines as (select id, classification, generate_subscripts(string_split(description, chr(10)), 1) as n,
        unnest(string_split(description, chr(10))) as line from entries)"""


@query("gov_search", f"""
    with {ENTRIES_SQL}
    select id, owner, classification from entries where contains(lower(name), 'sensitive') or contains(lower(owner), 'sensitive')
      or contains(lower(description), 'sensitive') or classification = 'sensitive'
      or id in (select id from lines where contains('line_' || n, 'sensitive'))""")
def gov_search(spark, sf_dir):
    return governance.search(catalogue(spark, sf_dir, typed=False), " Sensitive ").select("id", "owner", "classification")


@query("gov_search_flat", """
    with hit as (select distinct conv_id from conversations where contains(lower(text), 'the') or contains(role, 'the'))
    select distinct conv_id as id from conversations where conv_id in (select conv_id from hit)""")
def gov_search_flat(spark, sf_dir):
    """Conversations as entries, their turns as columns kept in rows."""
    turns = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("id"), F.col("role").alias("name"), F.col("text").alias("description"))
    entries = turns.select("id").distinct().select(
        "id", F.concat(F.lit("conversation "), F.col("id").cast("string")).alias("name"),
        *[F.lit("").alias(c) for c in ("owner", "description", "classification")])
    return governance.search_flat(entries, turns, "THE").select("id")


@query("gov_dictionary", f"""
    with {ENTRIES_SQL} select id, cast(n - 1 as int) as position, 'line_' || n as name,
      'VARCHAR(' || length(line) || ')' as type, line as description,
      regexp_matches(line, '{EMAIL}') as pii from lines""")
def gov_dictionary(spark, sf_dir):
    return governance.dictionary(catalogue(spark, sf_dir))


@query("gov_pii", f"""
    with {ENTRIES_SQL} select id, classification, 'line_' || n as name from lines where regexp_matches(line, '{EMAIL}')""")
def gov_pii(spark, sf_dir):
    return governance.pii_register(catalogue(spark, sf_dir))


@query("gov_lineage", """
    with p as (select page_id, string_split(url, '/') as nodes from pages),
    i as (select page_id, nodes, unnest(range(1, len(nodes))) as k from p)
    select page_id, cast(k - 1 as int) as position, nodes[k] as source, nodes[k + 1] as target from i""")
def gov_lineage(spark, sf_dir):
    """Page addresses as paths of nodes, unfolded to edges."""
    return governance.lineage_edges(read(spark, sf_dir, "pages"), F.split("url", "/"), "page_id")


@query("gov_mask", """
    select account_ref, sha256(liable_name) as liable_name,
      regexp_replace(regexp_replace(regexp_replace(postcode, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') as postcode,
      cast(null as string) as forename, ward_code from accounts""")
def gov_mask(spark, sf_dir):
    accounts = table(spark, sf_dir, "accounts").select("account_ref", "liable_name", "postcode", "forename", "ward_code")
    return governance.masked(accounts, {"liable_name": "hash", "postcode": "mask", "forename": "null"})


@query("gov_rls", """
    select a.account_ref, a.ward_code, a.band from accounts a where a.ward_code in (
      select w.ward_code from wards w join region r on r.r_regionkey = w.area_key where r.r_name = 'ASIA')""")
def gov_rls(spark, sf_dir):
    """An area role sees its wards' accounts, without names or balances."""
    areas = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("area_key"), F.col("r_name").alias("role"))
    entitlements = table(spark, sf_dir, "wards").join(areas, "area_key").select("role", "ward_code")
    return governance.secure_view(table(spark, sf_dir, "accounts"), entitlements, "ASIA", "ward_code",
                                  ["account_ref", "ward_code", "band"])


#: Every column of the supplied tables with the type it has.
PROFILED = {
    "region": "r_regionkey:int r_name:string", "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double l_extendedprice:double "
                "l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:timestamp_ntz",
    "events": "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string",
    "documents": "doc_id:bigint text:string lang:string source:string n_chars:bigint", "labels": "doc_id:bigint quality:int toxic:int",
    "conversations": "conv_id:bigint turn:bigint role:string text:string", "benchmark": "item_id:bigint text:string",
    "pages": "page_id:bigint url:string html:string", "embeddings": "vec_id:bigint embedding:array<float> label:int",
}
PROFILED = {name: [tuple(c.split(":")) for c in columns.split()] for name, columns in PROFILED.items()}


def _bound_sql(bound: str, column: str, kind: str) -> str:
    if kind.startswith("array"):
        return "cast(null as string)"
    return f"cast({bound}({column}) + 0::double as string)" if kind == "double" else f"cast({bound}({column}) as string)"


@query("gov_profile", " union all ".join(
    f"""select '{name}' as dataset, '{c}' as column_name, '{t}' as data_type, count(*) as n_rows, count(*) - count({c}) as n_null,
        {_bound_sql("min", c, t)} as least, {_bound_sql("max", c, t)} as greatest from {name}"""
    for name, columns in PROFILED.items() for c, t in columns))
def gov_profile(spark, sf_dir):
    """Every column of every table in its own type, one pass a table."""
    parts = [governance.profile(read(spark, sf_dir, name), [c for c, _ in columns]).withColumn("dataset", F.lit(name)) for name, columns in PROFILED.items()]
    return reduce(DataFrame.unionByName, parts)


COLUMNS = {name: [c for c, _ in columns] for name, columns in PROFILED.items()}


def _in_sql(column: str) -> str:
    return {"embedding": "array_to_string(embedding, ',')"}.get(column, column)


@query("gov_distinct", " union all ".join(
    f"""select '{name}' as dataset, '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_null, count(distinct {_in_sql(c)}) as n_distinct,
        true as sketch_within_5_pct from {name}""" for name, columns in COLUMNS.items() for c in columns))
def gov_distinct(spark, sf_dir):
    """Distinct values of every column of every table, exactly, and whether sketches merged from eight parts agree to 5 % or two."""
    parts = []
    for name, columns in COLUMNS.items():
        df = read(spark, sf_dir, name).select(*columns)
        pieces = governance.partial_profiles(df, F.pmod(F.xxhash64(columns[0]), F.lit(8)))
        merged = governance.merged_profile(pieces).withColumnRenamed("n_distinct", "_estimate")
        both = merged.join(governance.distinct_counts(df), "column_name")
        close = F.abs(F.col("_estimate") - F.col("n_distinct")) <= F.greatest(F.lit(2.0), F.col("n_distinct") * 0.05)
        parts.append(both.select(F.lit(name).alias("dataset"), "column_name", "n_rows", "n_null", "n_distinct", close.alias("sketch_within_5_pct")))
    return reduce(DataFrame.unionByName, parts)


#: The domain tables with the column that dates them, if any.
DATASETS = {
    "wards": None, "accounts": "liable_start", "properties": "last_modified_date", "repairs": "last_modified", "requests": "request_date",
    "referrals": "contact_date", "collections": "scheduled_date", "benefit_claims": None, "cts_awards": None, "budget_lines": None,
    "revenues_persons": None, "housing_persons": None, "social_persons": None,
}


@query("gov_catalog_build", " union all ".join(
    f"""select '{name}' as dataset, count(*) as records, cast({f"max({stamp})" if stamp else "null"} as date) as last_updated from {name}"""
    for name, stamp in DATASETS.items()))
def gov_catalog_build(spark, sf_dir):
    """Record count and last update per dataset, as the catalogue shows them."""
    return reduce(DataFrame.unionByName, [
        table(spark, sf_dir, name).agg(
            F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("records"),
            (F.max(stamp) if stamp else F.lit(None)).cast("date").alias("last_updated"))
        for name, stamp in DATASETS.items()])


@query("gov_completeness", " union all ".join(
    f"""select '{name}' as dataset, case when count(*) = 0 then null else round(100.0 * ({" + ".join(f"count({c})" for c, _ in columns)})
        / (count(*) * {len(columns)}), 1) end as quality from {name}""" for name, columns in PROFILED.items()))
def gov_completeness(spark, sf_dir):
    """The catalogue's quality score: the share of cells that hold a value."""
    parts = []
    for name, columns in PROFILED.items():
        filled = reduce(lambda a, b: a + b, [F.count(c) for c, _ in columns])
        share = F.round(F.try_divide(filled * 100.0, F.count(F.lit(1)) * len(columns)), 1)
        parts.append(read(spark, sf_dir, name).agg(F.lit(name).alias("dataset"), share.alias("quality")))
    return reduce(DataFrame.unionByName, parts)


@query("gov_open_data", """
    select ward_code, count(*) as n, round(count(*) filter (where collected) * 100.0 / count(*), 2) as completion_pct
    from collections group by 1""")
def gov_open_data(spark, sf_dir):
    return governance.open_data(table(spark, sf_dir, "collections"), ["ward_code"], F.col("collected"))
