"""Record linkage of people held by three systems, and of referrals by pseudonymous identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclake.operators import linkage as lk
from civiclake.operators.components import connected_components, extend_components
from civiclake.operators.linkage.model import level_counts
from civiclake.operators.linkage.pairs import pattern_counts, proposed_counts
from civiclake.operators.linkage.predict import review_queue, summary
from civiclake.plans import linkage_sql, social_care
from civiclake.plans.registry import query
from civiclake.session import materialise
from civiclake.sources.domain import table

# Comparison thresholds, blocking rules, cut-offs and day lengths of the person model.
PEOPLE = lk.Linkage(
    comparisons=(
        lk.Comparison("forename", "jaro_winkler", (0.92, 0.85, 0.70), term_frequency=True),
        lk.Comparison("surname", "jaro_winkler", (0.95, 0.88), term_frequency=True),
        lk.Comparison("dob", "date", (30, 365)),
        lk.Comparison("postcode", "levenshtein", (1, 2)),
    ),
    rules=(("surname", "postcode"), ("forename", "dob"), ("surname", "dob")),
)
PEOPLE_TRAINING = (("surname", "dob"), ("forename", "postcode"))
PREDICT_AT, CLUSTER_AT = 0.88, 0.92

# The referral model.
REFERRALS = lk.Linkage(
    comparisons=(
        lk.Comparison("nhs_number_hash", "jaro_winkler", (0.95, 0.88)),
        lk.Comparison("postcode_area", "levenshtein", (1, 2)),
        lk.Comparison("age_band", "exact"),
        lk.Comparison("gender", "exact"),
    ),
    rules=(("postcode_area",), ("age_band", "gender")),
)
REFERRAL_TRAINING = (("postcode_area",), ("age_band", "gender"))
REFERRAL_PREDICT_AT, REFERRAL_CLUSTER_AT = 0.85, 0.90

#: A hand-set model, so that scores can be checked against SQL without training.
GIVEN = lk.Model(
    prior=0.0005,
    m={"forename": [0.02, 0.02, 0.03, 0.13, 0.80], "surname": [0.03, 0.02, 0.10, 0.85],
       "dob": [0.02, 0.02, 0.06, 0.90], "postcode": [0.20, 0.02, 0.03, 0.75]},
    u={"forename": [0.85, 0.07, 0.02, 0.02, 0.04], "surname": [0.955, 0.01, 0.01, 0.025],
       "dob": [0.9779, 0.02, 0.002, 0.0001], "postcode": [0.967, 0.03, 0.002, 0.001]},
)


def persons(spark, sf_dir) -> DataFrame:
    """All person records of the three systems."""
    parts = [table(spark, sf_dir, f"{s}_persons") for s in ("revenues", "housing", "social")]
    return reduce(DataFrame.unionByName, parts)


def compared(people: DataFrame) -> DataFrame:
    """Identifier and compared columns; impossible dates become NULL."""
    return people.select("person_id", "forename", "surname", F.try_to_date("dob", "yyyy-MM-dd").alias("dob"), "postcode")


def _people(spark, sf_dir):
    records = compared(persons(spark, sf_dir))
    return records, materialise(lk.profiles(records, PEOPLE, "person_id"), "profiles")


RECORDS_SQL = """
    people as (select person_id, forename, surname, try_cast(dob as date) as dob, postcode from (
        select * from revenues_persons union all select * from housing_persons union all select * from social_persons)),
    prof0 as (select forename, surname, dob, postcode, min(person_id) as profile_id, count(*) as copies
              from people group by 1, 2, 3, 4),
    tff as (select forename, count(*) * 1.0 / (select count(*) from people) as tf from people where forename is not null group by 1),
    tfs as (select surname, count(*) * 1.0 / (select count(*) from people) as tf from people where surname is not null group by 1),
    prof as (select p.*, f.tf as tf_forename, s.tf as tf_surname from prof0 p left join tff f on f.forename = p.forename
             left join tfs s on s.surname = p.surname)"""


def _levels_sql(source: str) -> str:
    return f"""select *,
        case when forename_l is null or forename_r is null then -1 when forename_l = forename_r then 4
          when jaro_winkler_similarity(forename_l, forename_r) >= 0.92 then 3
          when jaro_winkler_similarity(forename_l, forename_r) >= 0.85 then 2
          when jaro_winkler_similarity(forename_l, forename_r) >= 0.70 then 1 else 0 end as gamma_forename,
        case when surname_l is null or surname_r is null then -1 when surname_l = surname_r then 3
          when jaro_winkler_similarity(surname_l, surname_r) >= 0.95 then 2
          when jaro_winkler_similarity(surname_l, surname_r) >= 0.88 then 1 else 0 end as gamma_surname,
        case when dob_l is null or dob_r is null then -1 when dob_l = dob_r then 3
          when abs(date_diff('day', dob_l, dob_r)) <= 30 then 2
          when abs(date_diff('day', dob_l, dob_r)) <= 365 then 1 else 0 end as gamma_dob,
        case when postcode_l is null or postcode_r is null then -1 when postcode_l = postcode_r then 3
          when levenshtein(postcode_l, postcode_r) <= 1 then 2
          when levenshtein(postcode_l, postcode_r) <= 2 then 1 else 0 end as gamma_postcode
      from {source}"""


PAIRS_SQL = f"""{RECORDS_SQL},
    cand as (select a.profile_id as profile_id_l, b.profile_id as profile_id_r, a.copies as copies_l, b.copies as copies_r,
        a.forename as forename_l, b.forename as forename_r, a.surname as surname_l, b.surname as surname_r,
        a.dob as dob_l, b.dob as dob_r, a.postcode as postcode_l, b.postcode as postcode_r,
        a.tf_forename, a.tf_surname, min(r.rule) as match_key
      from (select *, 0 as rule, surname || '/' || postcode as k from prof
            union all select *, 1, forename || '/' || cast(dob as string) from prof
            union all select *, 2, surname || '/' || cast(dob as string) from prof) a
      join (select *, 0 as rule, surname || '/' || postcode as k from prof
            union all select *, 1, forename || '/' || cast(dob as string) from prof
            union all select *, 2, surname || '/' || cast(dob as string) from prof) b
        on a.rule = b.rule and a.k = b.k and a.profile_id < b.profile_id
      , (select unnest([0, 1, 2]) as rule) r where r.rule = a.rule
      group by all),
    lev as ({_levels_sql('cand')})"""


def _bits_sql(column: str, tf: bool) -> str:
    m, u = GIVEN.m[column], GIVEN.u[column]
    top = len(m) - 1
    cases = " ".join(f"when {i} then log2({m[i]!r}::double / {u[i]!r}::double)" for i in range(top + 1))
    text = f"(case gamma_{column} {cases} else 0 end)"
    if tf:
        text += f" + (case when gamma_{column} = {top} then log2({u[top]!r}::double / tf_{column}) else 0 end)"
    return text


SCORED_SQL = f"""{PAIRS_SQL},
    weighed as (select *, log2({GIVEN.prior!r}::double / (1 - {GIVEN.prior!r}::double)) + {_bits_sql('forename', True)}
      + {_bits_sql('surname', True)} + {_bits_sql('dob', False)} + {_bits_sql('postcode', False)} as match_weight from lev),
    scored as (select *, 1 / (1 + pow(2.0::double, -match_weight)) as match_probability from weighed)"""


@query("persons_union", """
    select person_id, forename, surname, dob, postcode, source_system from revenues_persons
    union all select person_id, forename, surname, dob, postcode, source_system from housing_persons
    union all select person_id, forename, surname, dob, postcode, source_system from social_persons""")
def persons_union(spark, sf_dir):
    return persons(spark, sf_dir)


@query("link_profiles", f"""
    with {RECORDS_SQL} select profile_id, copies, forename, surname, dob, postcode, round(tf_forename, 9) as tf_forename,
      round(tf_surname, 9) as tf_surname from prof""")
def link_profiles(spark, sf_dir):
    _, found = _people(spark, sf_dir)
    return found.withColumns({c: F.round(c, 9) for c in ("tf_forename", "tf_surname")})


@query("link_tf", f"""
    with {RECORDS_SQL} select 'forename' as field, forename as value, round(tf, 9) as tf from tff
    union all select 'surname', surname, round(tf, 9) from tfs""")
def link_tf(spark, sf_dir):
    """Term frequencies of both name columns."""
    _, found = _people(spark, sf_dir)
    cells = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).alias("value"), F.round(f"tf_{c}", 9).alias("tf"))
        for c in ("forename", "surname")])
    return found.select(F.inline(cells)).where("value is not null").distinct()


@query("link_jw_levels", """
    with v as (select distinct forename as x from housing_persons where forename is not null)
    select a.x as value_l, b.x as value_r, round(jaro_winkler_similarity(a.x, b.x), 6) as similarity,
           case when jaro_winkler_similarity(a.x, b.x) >= 0.92 then 3 when jaro_winkler_similarity(a.x, b.x) >= 0.85 then 2
                else 1 end as level
    from v a join v b on a.x < b.x where jaro_winkler_similarity(a.x, b.x) >= 0.70""")
def link_jw_levels(spark, sf_dir):
    """Similar spellings among the distinct forenames of one system; ``link_jw_levels_all`` takes all three."""
    return _similar_forenames(table(spark, sf_dir, "housing_persons"))


@query("link_jw_levels_all", f"""
    with {RECORDS_SQL}, v as (select distinct forename as x from people where forename is not null)
    select a.x as value_l, b.x as value_r, round(jaro_winkler_similarity(a.x, b.x), 6) as similarity,
           case when jaro_winkler_similarity(a.x, b.x) >= 0.92 then 3 when jaro_winkler_similarity(a.x, b.x) >= 0.85 then 2
                else 1 end as level
    from v a join v b on a.x < b.x where jaro_winkler_similarity(a.x, b.x) >= 0.70""")
def link_jw_levels_all(spark, sf_dir):
    return _similar_forenames(persons(spark, sf_dir))


def _similar_forenames(people: DataFrame) -> DataFrame:
    """Similar spellings among distinct forenames, found through shared tokens."""
    from civiclake.functions.similarity import jaro_winkler, jaro_winkler_tokens
    from civiclake.operators.linkage.pairs import value_lengths
    from civiclake.operators.skew import pairs_within

    names = people.where("forename is not null").select("forename").distinct()
    lengths = value_lengths(names, PEOPLE.comparisons[:1])
    marked = names.withColumn("_token", F.explode(jaro_winkler_tokens("forename", 0.70, lengths)))
    near = pairs_within(marked, ["_token"], "forename", []).drop("_token").distinct()
    scored = near.withColumn("similarity", jaro_winkler("forename_l", "forename_r"))
    level = F.when(F.col("similarity") >= 0.92, 3).when(F.col("similarity") >= 0.85, 2).otherwise(1)
    return scored.where("similarity >= 0.70").select(
        F.col("forename_l").alias("value_l"), F.col("forename_r").alias("value_r"),
        F.round("similarity", 6).alias("similarity"), level.alias("level"))


@query("link_dob", """
    select person_id, try_cast(dob as date) as dob, try_cast(dob as date) is null as dob_missing,
           case when try_cast(dob as date) is null then -1
                when abs(date_diff('day', try_cast(dob as date), DATE '1970-06-15')) <= 30 then 2
                when abs(date_diff('day', try_cast(dob as date), DATE '1970-06-15')) <= 365 then 1 else 0 end as level
    from housing_persons""")
def link_dob(spark, sf_dir):
    """Birth dates of one system against a given one; ``link_dob_all`` takes all three systems."""
    return _near_birth_dates(table(spark, sf_dir, "housing_persons"))


@query("link_dob_all", f"""
    with {RECORDS_SQL} select person_id, dob, dob is null as dob_missing,
           case when dob is null then -1 when abs(date_diff('day', dob, DATE '1970-06-15')) <= 30 then 2
                when abs(date_diff('day', dob, DATE '1970-06-15')) <= 365 then 1 else 0 end as level
    from people""")
def link_dob_all(spark, sf_dir):
    return _near_birth_dates(persons(spark, sf_dir))


def _near_birth_dates(people: DataFrame) -> DataFrame:
    """Birth dates against a given one: impossible dates are NULL, nearness is by month and year."""
    found = compared(people)
    against = F.lit("1970-06-15").cast("date")
    return found.select("person_id", "dob", F.col("dob").isNull().alias("dob_missing"),
                        PEOPLE.comparisons[2].level(F.col("dob"), against).alias("level"))


GAMMAS = "gamma_forename, gamma_surname, gamma_dob, gamma_postcode"


@query("link_pairs", f"""
    with {PAIRS_SQL}, hit as (select *, (match_key = 0 and (gamma_forename > 0 or gamma_dob > 0))
        or (surname_l = surname_r and postcode_l = postcode_r and (gamma_forename > 0 or gamma_dob > 0)) as r0,
        coalesce(forename_l = forename_r and dob_l = dob_r and (gamma_surname > 0 or gamma_postcode > 0), false) as r1,
        coalesce(surname_l = surname_r and dob_l = dob_r and (gamma_forename > 0 or gamma_postcode > 0), false) as r2 from lev)
    select profile_id_l, profile_id_r, copies_l, copies_r, {GAMMAS},
           case when coalesce(r0, false) then 0 when r1 then 1 else 2 end as match_key
    from hit where coalesce(r0, false) or r1 or r2""")
def link_pairs(spark, sf_dir):
    """Proposed profile pairs that agree on something outside their rule; ``link_pair_patterns`` counts all proposed ones."""
    _, found = _people(spark, sf_dir)
    return lk.block_pairs(found, PEOPLE).select(
        "profile_id_l", "profile_id_r", "copies_l", "copies_r", *GAMMAS.split(", "), "match_key")


def _blocked_sql(number: int, rule) -> str:
    same = " and ".join(f"a.{c} = b.{c}" for c in rule)
    return f"select {number} as match_key, a.profile_id as l, b.profile_id as r from prof a join prof b on {same} and a.profile_id <= b.profile_id"


@query("link_pair_patterns", f"""
    with {RECORDS_SQL}, blocked as ({" union all ".join(_blocked_sql(i, rule) for i, rule in enumerate(PEOPLE.rules))}),
    proposed as (select l, r, min(match_key) as match_key from blocked group by 1, 2),
    cand as (select p.match_key, a.forename as forename_l, b.forename as forename_r, a.surname as surname_l, b.surname as surname_r,
        a.dob as dob_l, b.dob as dob_r, a.postcode as postcode_l, b.postcode as postcode_r,
        case when p.l = p.r then a.copies * (a.copies - 1) / 2 else a.copies * b.copies end as n
      from proposed p join prof a on a.profile_id = p.l join prof b on b.profile_id = p.r),
    lev as ({_levels_sql('cand')})
    select match_key, {GAMMAS}, cast(sum(n) as bigint) as n from lev group by all having sum(n) > 0""")
def link_pair_patterns(spark, sf_dir):
    """Exact pattern counts of all record pairs the rules propose, those that agree on nothing else included."""
    _, found = _people(spark, sf_dir)
    return proposed_counts(found, PEOPLE, lk.known_spellings(found, PEOPLE)).withColumn("n", F.col("n").cast("long"))


@query("link_gamma_hist", f"""
    with {RECORDS_SQL}, cand as (select a.forename as forename_l, b.forename as forename_r, a.surname as surname_l,
        b.surname as surname_r, a.dob as dob_l, b.dob as dob_r, a.postcode as postcode_l, b.postcode as postcode_r,
        case when a.profile_id = b.profile_id then a.copies * (a.copies - 1) / 2 else a.copies * b.copies end as n
      from prof a join prof b on a.surname = b.surname and a.dob = b.dob and a.profile_id <= b.profile_id),
    lev as ({_levels_sql('cand')})
    select gamma_forename, gamma_postcode, cast(sum(n) as bigint) as n from lev group by 1, 2 having sum(n) > 0""")
def link_gamma_hist(spark, sf_dir):
    """Pattern counts over all record pairs of the (surname, dob) block."""
    _, found = _people(spark, sf_dir)
    rule = ("surname", "dob")
    known = lk.known_spellings(found, lk.Linkage(tuple(PEOPLE.outside(rule)), (rule,)))
    return pattern_counts(found, PEOPLE, rule, known=known).withColumn("n", F.col("n").cast("long"))


def _values_sql(column: str) -> str:
    """Level of each pair of distinct values of a column, with the number of record pairs behind it."""
    others = ", ".join(f"null::{'date' if c == 'dob' else 'varchar'} as {c}_{side}" for c in PEOPLE.columns if c != column for side in "lr")
    return f"""v_{column} as (select {column} as v, count(*)::hugeint as n from people where {column} is not null group by 1),
    c_{column} as (select a.v as {column}_l, b.v as {column}_r, {others},
      case when a.v = b.v then a.n * (a.n - 1) / 2 else a.n * b.n end as n from v_{column} a join v_{column} b on a.v <= b.v),
    l_{column} as ({_levels_sql(f'c_{column}')})"""


@query("link_u", f"with {RECORDS_SQL}, {', '.join(map(_values_sql, PEOPLE.columns))}, counted as (" + " union all ".join(
    f"select '{c}' as column, gamma_{c} as level, sum(n) as pairs from l_{c} group by gamma_{c}" for c in PEOPLE.columns) + """)
    select "column", level, cast(pairs as bigint) as pairs, round(pairs / sum(pairs) over (partition by "column"), 9) as share
    from counted where pairs > 0""")
def link_u(spark, sf_dir):
    """Level counts over all pairs of people."""
    return level_counts(compared(persons(spark, sf_dir)), PEOPLE).withColumn("share", F.round("share", 9))


TRAINED_SQL = f"""
    people as (select person_id, forename, surname, try_cast(dob as date) as dob, postcode from (
        select * from revenues_persons union all select * from housing_persons union all select * from social_persons)),
    {linkage_sql.profiles(PEOPLE, 'person_id')}, {linkage_sql.trained(PEOPLE, PEOPLE_TRAINING, 20, 1e-4)}"""


@query("link_train", f"with recursive {TRAINED_SQL} " + " union all ".join(
    f"""select '{c.column}' as "column", {k} as level, round(m_{c.column}_{k}, 6) as m, round(u_{c.column}_{k}, 6) as u,
      round(log2(m_{c.column}_{k} / u_{c.column}_{k}), 4) as bits from model""" for c in PEOPLE.comparisons for k in range(c.top + 1)))
def link_train(spark, sf_dir):
    """m, u and weight per level after training on two blocks."""
    model = _trained(spark, sf_dir)[1]
    level_rows = [
        (c.column, level, float(model.m[c.column][level]), float(model.u[c.column][level]), model.bits(c.column, level))
        for c in PEOPLE.comparisons for level in range(c.top + 1)
    ]
    found = spark.createDataFrame(level_rows, "column string, level int, m double, u double, bits double")
    return found.withColumns({"m": F.round("m", 6), "u": F.round("u", 6), "bits": F.round("bits", 4)})


def _trained(spark, sf_dir, rules=()):
    """Profiles, the trained model, and the spellings that meet in the blocks of training and of the ``rules``."""
    _, found = _people(spark, sf_dir)
    u = lk.estimate_u(found, PEOPLE)
    known = lk.known_spellings(found, lk.Linkage(PEOPLE.comparisons, tuple(dict.fromkeys((*PEOPLE_TRAINING, *rules)))))
    return found, lk.estimate_m(found, PEOPLE, u, PEOPLE_TRAINING, known=known), known


@query("link_predict", f"""
    with recursive {TRAINED_SQL}, {linkage_sql.scored(PEOPLE)}
    select profile_id_l, profile_id_r, round(match_probability, 6) as match_probability, match_key from scored where match_probability >= {PREDICT_AT}""")
def link_predict(spark, sf_dir):
    """Pairs under the trained model."""
    found, model, known = _trained(spark, sf_dir, PEOPLE.rules)
    return lk.predict(found, PEOPLE, model, PREDICT_AT, known=known).select(
        "profile_id_l", "profile_id_r", F.round("match_probability", 6).alias("match_probability"), "match_key")


def _given_pairs(spark, sf_dir, below: float | None = None) -> DataFrame:
    _, found = _people(spark, sf_dir)
    pairs = lk.predict(found, PEOPLE, GIVEN, PREDICT_AT, known=lk.known_spellings(found, PEOPLE), below=below)
    return materialise(pairs.select("profile_id_l", "profile_id_r", "match_weight", "match_probability", "match_key"), "pairs")


@query("link_scored", f"""
    with {SCORED_SQL} select profile_id_l, profile_id_r, round(match_weight, 4) as match_weight,
      round(match_probability, 6) as match_probability, match_key from scored where match_probability >= 0.88""")
def link_scored(spark, sf_dir):
    """Pairs under the given model."""
    return _given_pairs(spark, sf_dir).select(
        "profile_id_l", "profile_id_r", F.round("match_weight", 4).alias("match_weight"),
        F.round("match_probability", 6).alias("match_probability"), "match_key")


@query("link_review_queue", f"""
    with {SCORED_SQL} select profile_id_l, profile_id_r, round(match_probability, 6) as match_probability
    from scored where match_probability >= 0.88 and match_probability < 0.92""")
def link_review_queue(spark, sf_dir):
    pairs = _given_pairs(spark, sf_dir, below=CLUSTER_AT)
    return review_queue(pairs, PREDICT_AT, CLUSTER_AT).select(
        "profile_id_l", "profile_id_r", F.round("match_probability", 6).alias("match_probability"))


def assigned_people(spark, sf_dir) -> DataFrame:
    records, found = _people(spark, sf_dir)
    named = lk.spanning_clusters(found, PEOPLE, GIVEN, CLUSTER_AT, lk.known_spellings(found, PEOPLE))
    return lk.place_records(records, found, PEOPLE, GIVEN, named, CLUSTER_AT, "person_id")


def _own_bits_sql(column: str, tf: bool) -> str:
    m, u = GIVEN.m[column][-1], GIVEN.u[column][-1]
    rarity = f" + log2({u!r}::double / p.tf_{column})" if tf else ""
    return f"(case when p.{column} is not null then log2({m!r}::double / {u!r}::double){rarity} else 0 end)"


CLUSTERS_SQL = f"""{SCORED_SQL},
    linked as (select profile_id_l as a, profile_id_r as b from scored where match_probability >= 0.92
      union all select profile_id_r, profile_id_l from scored where match_probability >= 0.92),
    reach as (select a as node, a as label from linked union select l.b, r.label from reach r join linked l on l.a = r.node),
    named as (select node, min(label) as cluster_id from reach group by 1),
    own as (select p.*, ((p.surname is not null and p.postcode is not null) or (p.forename is not null and p.dob is not null)
        or (p.surname is not null and p.dob is not null))
        and 1 / (1 + pow(2.0::double, -(log2({GIVEN.prior!r}::double / (1 - {GIVEN.prior!r}::double))
          + {_own_bits_sql('forename', True)} + {_own_bits_sql('surname', True)} + {_own_bits_sql('dob', False)}
          + {_own_bits_sql('postcode', False)}))) >= 0.92 as together from prof p),
    assigned as (select r.person_id, coalesce(n.cluster_id, case when o.together then o.profile_id end, r.person_id) as cluster_id
      from people r join own o on o.forename is not distinct from r.forename and o.surname is not distinct from r.surname
        and o.dob is not distinct from r.dob and o.postcode is not distinct from r.postcode
      left join named n on n.node = o.profile_id)"""


@query("link_clusters", f"with recursive {CLUSTERS_SQL} select person_id, cluster_id from assigned")
def link_clusters(spark, sf_dir):
    return assigned_people(spark, sf_dir)


@query("link_clusters_increment", f"with recursive {CLUSTERS_SQL} select node as profile_id, cluster_id from named")
def link_clusters_increment(spark, sf_dir):
    """Clusters of the matched profiles in two batches: two thirds of the spanning matches first, then the others joined to what is there."""
    _, found = _people(spark, sf_dir)
    near, _, across = lk.spanning_pairs(found, PEOPLE, GIVEN, CLUSTER_AT, known=lk.known_spellings(found, PEOPLE))
    edges = near.unionByName(across)
    later = F.crc32(F.concat("profile_id_l", "profile_id_r").cast("binary")) % 3 == 0
    first = materialise(connected_components(edges.where(~later), "profile_id_l", "profile_id_r").toDF("node", "component"), "clusters")
    return extend_components(first, edges.where(later), "profile_id_l", "profile_id_r").toDF("profile_id", "cluster_id")


@query("link_summary", f"""
    with recursive {CLUSTERS_SQL} select count(*) as records, count(distinct cluster_id) as clusters,
      round(count(*) * 1.0 / count(distinct cluster_id), 1) as dedupe_ratio from assigned""")
def link_summary(spark, sf_dir):
    return summary(assigned_people(spark, sf_dir))


# ------------------------------------------------------------- referrals

def referral_clusters(spark, sf_dir) -> DataFrame:
    """``(referral_id, person_cluster_id)`` from the trained referral model."""
    records = social_care.pseudonymised(table(spark, sf_dir, "referrals")).select("referral_id", *REFERRALS.columns)
    found = materialise(lk.profiles(records, REFERRALS, "referral_id"), "profiles")
    u = lk.estimate_u(found, REFERRALS)
    model = lk.estimate_m(found, REFERRALS, u, REFERRAL_TRAINING, rounds=10, tolerance=1e-3)
    pairs = materialise(lk.predict(found, REFERRALS, model, REFERRAL_PREDICT_AT), "pairs")
    named = lk.cluster_records(records, found, REFERRALS, model, pairs, REFERRAL_CLUSTER_AT, "referral_id")
    return named.withColumnRenamed("cluster_id", "person_cluster_id")


@query("link_attach_cluster", rf"""
    with recursive clean as (select *, upper(regexp_replace(postcode, '\s+', '', 'g')) as k from referrals where contact_date >= DATE '2021-02-28'),
    people as (select referral_id, sha256(nhs_number) as nhs_number_hash, rtrim(left(concat(left(k, length(k) - 3), ' ', right(k, 3)), 4)) as postcode_area,
      age_band, gender from clean),
    {linkage_sql.profiles(REFERRALS, 'referral_id')}, {linkage_sql.trained(REFERRALS, REFERRAL_TRAINING, 10, 1e-3)},
    {linkage_sql.scored(REFERRALS)}, {linkage_sql.clusters(REFERRALS, 'referral_id', REFERRAL_CLUSTER_AT)}
    select cast(date_trunc('month', contact_date) as date) as month, w.ward_name, primary_support_reason,
           count(distinct cluster_id) as unique_people, count(*) as total_referrals,
           round(count(*) * 1.0 / count(distinct cluster_id), 2) as avg_referrals_per_person,
           round(avg(date_diff('day', contact_date, coalesce(assessment_date, DATE '2024-02-29'))), 4) as avg_days_to_assessment,
           round(count(*) filter (where outcome = 'Service Provided') * 100.0 / count(*), 4) as conversion_rate_pct
    from referrals r join assigned using (referral_id) left join wards w on w.ward_code = r.ward_code group by 1, 2, 3""")
def link_attach_cluster(spark, sf_dir):
    """Social-care demand counted by linked person."""
    wards = table(spark, sf_dir, "wards").select("ward_code", "ward_name")
    matched = table(spark, sf_dir, "referrals").join(referral_clusters(spark, sf_dir), "referral_id")
    return social_care.demand(matched.join(wards, "ward_code", "left"), "person_cluster_id")
