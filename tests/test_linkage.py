"""Linkage against brute force on small fixtures."""

import collections
import hashlib
import itertools
import random

import duckdb
import pytest
from small import rows
from pyspark.sql import functions as F

from civiclake.functions.similarity import jaro_winkler_many, jaro_winkler_pair, letter_tokens
from civiclake.operators import linkage as lk
from civiclake.operators.components import connected_components, extend_components
from civiclake.operators.linkage.model import level_counts
from civiclake.operators.linkage.pairs import all_pairs, fuzzy_pairs, pattern_counts, similar_pairs, with_levels, agrees_outside
from civiclake.operators.linkage.predict import predict
from civiclake.operators.linkage.values import date_distances, edit_distances
from civiclake.operators.skew import pairs_within
from civiclake.plans.linkage import GIVEN, PEOPLE

NAMES = ["MARTHA", "MARHTA", "MARTA", "JONES", "JOHNSON", "DWAYNE", "DUANE", "ANNE", "ANN", "A", "DIXON", "DICKSONX", "ZED"]


def test_jaro_winkler_values():
    assert round(jaro_winkler_pair("MARTHA", "MARHTA"), 4) == 0.9611
    con = duckdb.connect()
    rng = random.Random(3)
    words = NAMES + ["".join(rng.choice("ABCDE") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for a, b in itertools.combinations(words, 2):
        want = con.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
        assert abs(jaro_winkler_pair(a, b) - want) < 1e-9, (a, b)


@pytest.mark.parametrize("threshold", [0.70, 0.85, 0.88, 0.92, 0.95])
def test_similar_names_always_share_a_token(threshold):
    rng = random.Random(5)
    words = sorted(set(NAMES + ["".join(rng.choice("ABCDEFGH") for _ in range(rng.randint(1, 10))) for _ in range(220)]))
    lengths = sorted({len(w) for w in words})
    tokens = {w: set(letter_tokens(w, threshold, lengths)) for w in words}
    for a, b in itertools.combinations(words, 2):
        if jaro_winkler_pair(a, b) >= threshold:
            assert tokens[a] & tokens[b], (a, b)


def test_pairs_within_hot_group_are_complete(spark):
    df = spark.range(57).select(F.lit("k").alias("k"), F.col("id"), (F.col("id") * 2).alias("v"))
    got = pairs_within(df, ["k"], "id", ["v"], chunk=10)
    assert rows(got.select("id_l", "id_r", "v_l", "v_r")) == sorted(
        [(a, b, 2 * a, 2 * b) for a, b in itertools.combinations(range(57), 2)], key=repr)


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(11)
    out = []
    for i in range(160):
        dob = rng.choice([None, "1980-01-01", "1980-01-20", "1980-11-02", "1990-05-05"])
        out.append((f"p{i:04d}", rng.choice([*NAMES[:8], None]), rng.choice(["BELL", "BELLS", "DODD", None]), dob,
                    rng.choice(["NE1 1AA", "NE1 1AB", "NE2 9ZZ", None])))
    df = spark.createDataFrame(out, "person_id string, forename string, surname string, dob string, postcode string")
    return df.withColumn("dob", F.col("dob").cast("date"))


def test_token_blocks_lose_no_similar_pair(spark, people):
    found = lk.profiles(people, PEOPLE, "person_id")
    for rule in PEOPLE.rules:
        agree = agrees_outside(PEOPLE, rule)
        every = with_levels(all_pairs(found, rule), PEOPLE).where(agree).select("profile_id_l", "profile_id_r")
        tokened = with_levels(similar_pairs(found, PEOPLE, rule, small=1), PEOPLE).where(agree)
        assert rows(tokened.select("profile_id_l", "profile_id_r")) == rows(every)


def test_pattern_counts_cover_every_record_pair(spark, people):
    rule = ("surname", "postcode")
    found = lk.profiles(people, PEOPLE, "person_id")
    got = {tuple(r)[:2]: r["n"] for r in pattern_counts(found, PEOPLE, rule).collect()}
    raw = people.withColumn("k", F.concat_ws("|", "surname", "postcode")).where("surname is not null and postcode is not null")
    both = raw.toDF(*[f"{c}_l" for c in raw.columns]).join(
        raw.toDF(*[f"{c}_r" for c in raw.columns]), F.expr("k_l = k_r and person_id_l < person_id_r"))
    want = with_levels(both, PEOPLE).groupBy("gamma_forename", "gamma_dob").count()
    assert got == {tuple(r)[:2]: r["count"] for r in want.collect()}


def test_proposed_counts_cover_dissimilar_pairs_once(spark, people):
    from civiclake.operators.linkage.pairs import proposed_counts

    odd = [("q0", "ZED", "WAKE", "1950-01-01", "NE9 9AA"), ("q1", "ANNE", "WAKE", "1990-01-01", "NE9 9AA"), ("q2", "ANNE", "WAKE", "1990-01-01", "NE9 9AA")]
    every = people.union(spark.createDataFrame(odd, "a string, b string, c string, d string, e string").withColumn("d", F.col("d").cast("date")))
    names = [f"gamma_{c}" for c in PEOPLE.columns]
    got = proposed_counts(lk.profiles(every, PEOPLE, "person_id"), PEOPLE).select("match_key", *names, F.col("n").cast("long"))
    left, right = (every.select(*[F.col(c).alias(f"{c}_{s}") for c in every.columns]) for s in "lr")
    key = F.coalesce(*[F.when(F.expr(" and ".join(f"{c}_l = {c}_r" for c in rule)), F.lit(i)) for i, rule in enumerate(PEOPLE.rules)])
    pairs = with_levels(left.join(right, F.col("person_id_l") < F.col("person_id_r")), PEOPLE).withColumn("match_key", key)
    assert rows(got) == rows(pairs.where("match_key is not null").groupBy("match_key", *names).count())
    assert (0, 0, 3, 0, 3) in {tuple(r)[:5] for r in got.collect()}


def test_predictions_equal_scoring_all_pairs(spark, people):
    found = lk.profiles(people, PEOPLE, "person_id").cache()
    for threshold in (0.2, 0.88):
        got = predict(found, PEOPLE, GIVEN, threshold, small=1).select("profile_id_l", "profile_id_r")
        brute = None
        for rule in PEOPLE.rules:
            scored = with_levels(all_pairs(found, rule), PEOPLE).withColumn("w", GIVEN.weight(PEOPLE))
            part = scored.where((1 / (1 + F.pow(F.lit(2.0), -F.col("w")))) >= threshold).select("profile_id_l", "profile_id_r")
            brute = part if brute is None else brute.union(part)
        assert rows(got) == rows(brute.distinct())


def test_pairs_are_scored_where_they_are_formed(spark, people, crowd):
    for found in (lk.profiles(people, PEOPLE, "person_id").localCheckpoint(), crowd):
        known = lk.known_spellings(found, PEOPLE)
        every = predict(found, PEOPLE, GIVEN, 0.5).select("profile_id_l", "profile_id_r", "match_key", F.round("match_probability", 9).alias("p")).localCheckpoint()
        for threshold, below in ((0.5, None), (0.5, 0.98)):
            found_now = predict(found, PEOPLE, GIVEN, threshold, known=known, below=below).select(*every.columns[:3], F.round("match_probability", 9).alias("p"))
            assert rows(found_now) == rows(every if below is None else every.where(F.col("p") < below))
            plan = found_now._jdf.queryExecution().executedPlan().toString()
            assert "jaro" not in plan and not [line for line in plan.splitlines() if "Exchange" in line and "profile_id_l" in line]


def test_pairs_are_levelled_where_they_are_formed(spark, people):
    found = lk.profiles(people, PEOPLE, "person_id").localCheckpoint()
    plan = lk.block_pairs(found, PEOPLE)._jdf.queryExecution().executedPlan().toString()
    assert "profile_id_l" in plan and "jaro" not in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "profile_id_l" in line]


@pytest.fixture(scope="module")
def crowd(spark):
    """People who share name and birth date in different homes, some misspelt or lacking something, among others."""
    rng = random.Random(23)
    out = []
    for i in range(150):
        person = i % 50
        dob = rng.choice(["1970-02-01"] * 8 + ["1970-02-02", None]) if person < 40 else f"19{person}-05-05"
        out.append((f"c{i:04d}", rng.choice(["MARTHA"] * 5 + ["MRTHA", "MARTHAE"]) if person < 40 else rng.choice(NAMES), rng.choice(["BELL"] * 8 + ["BELLS", None]), dob,
                    rng.choice([f"NE{person} 1AA"] * 8 + [f"NE{person} 1AB", None])))
    df = spark.createDataFrame(out, "person_id string, forename string, surname string, dob string, postcode string")
    return lk.profiles(df.withColumn("dob", F.col("dob").cast("date")), PEOPLE, "person_id").localCheckpoint()


@pytest.mark.parametrize("threshold", [0.92, 0.9999])
def test_clusters_need_no_pair_of_equals(spark, people, crowd, threshold):
    for found in (lk.profiles(people, PEOPLE, "person_id").localCheckpoint(), crowd):
        every = predict(found, PEOPLE, GIVEN, threshold)
        want = rows(lk.clusters(every, threshold))
        known = lk.known_spellings(found, PEOPLE) if threshold == 0.92 else None
        assert rows(lk.spanning_clusters(found, PEOPLE, GIVEN, threshold, known)) == want
    near, _, across = lk.spanning_pairs(crowd, PEOPLE, GIVEN, threshold)
    held = near.unionByName(across).select("profile_id_l", "profile_id_r")
    assert rows(held.exceptAll(every.select("profile_id_l", "profile_id_r"))) == []  # each is a match, and given once
    if threshold == 0.92:
        assert held.count() * 2 < every.count()


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randint(0, 90):03d}", f"n{rng.randint(0, 90):03d}") for _ in range(60)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]  # a long chain
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    df = spark.createDataFrame(edges, "a string, b string")
    got = dict(rows(connected_components(df, "a", "b")))
    assert got == {n: find(n) for n in root}


def test_batches_of_edges_give_the_components_of_all(spark):
    rng = random.Random(21)
    edges = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(190)] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(200, 230)]
    rng.shuffle(edges)
    schema = "a string, b string"
    whole = rows(connected_components(spark.createDataFrame(edges, schema), "a", "b"))
    known = connected_components(spark.createDataFrame(edges[:80], schema), "a", "b").cache()
    for batch in (edges[80:81] * 3, edges[81:160], edges[:10], edges[160:]):
        known = extend_components(known, spark.createDataFrame(batch, schema), "a", "b").cache()
    assert rows(known) == whole
    assert rows(extend_components(known, spark.createDataFrame([], schema), "a", "b")) == whole


def test_levels_are_counted_over_all_pairs(spark):
    rng = random.Random(4)
    data = [(f"p{i:03d}", rng.choice([*NAMES, None]), rng.choice(["BELL", "BELLS", "DODD"]), f"19{rng.randint(60, 62)}-0{rng.randint(1, 9)}-11",
             rng.choice([f"NE{k} 1AB" for k in range(1, 30)])) for i in range(60)]
    df = spark.createDataFrame(data, "person_id string, forename string, surname string, dob string, postcode string")
    df = df.withColumn("dob", F.col("dob").cast("date"))
    left, right = (df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns]) for s in "lr")
    levels = with_levels(left.join(right, F.col("person_id_l") < F.col("person_id_r")), PEOPLE)
    want = {(c.column, r["level"]): r["count"] for c in PEOPLE.comparisons
            for r in levels.groupBy(F.col(f"gamma_{c.column}").alias("level")).count().where("level >= 0").collect()}
    for source in (df, lk.profiles(df, PEOPLE, "person_id")):
        got = level_counts(source, PEOPLE).collect()
        assert {(r["column"], r["level"]): r["pairs"] for r in got} == want
        assert abs(sum(r["share"] for r in got) - len(PEOPLE.comparisons)) < 1e-9


CARE = lk.Linkage(comparisons=(
    lk.Comparison("hash", "jaro_winkler", (0.95, 0.88)), lk.Comparison("area", "levenshtein", (1, 2)), lk.Comparison("band", "exact"), lk.Comparison("sex", "exact")),
    rules=(("area",), ("band", "sex")))


def near_digest(rng, digest, changes):
    out = list(digest)
    for _ in range(changes):
        out[rng.randrange(6, 64)] = rng.choice("0123456789abcdef")
    return "".join(out)


@pytest.fixture(scope="module")
def referred(spark):
    """Digests, some near each other, in two areas, with missing values everywhere and copies."""
    rng = random.Random(8)
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)]
    digests += [near_digest(rng, d, k) for k in (1, 2, 4, 9, 14) for d in digests[:8]]
    digests += [d[:3] + hashlib.sha256(d.encode()).hexdigest()[3:] for d in digests[:30]]
    rows = [(f"r{i:04d}", rng.choice([*digests, None]), rng.choice(["NE1", "NE2", None]), rng.choice(["18-25", "26-40", None]), rng.choice(["F", "M", None]))
            for i in range(200)]
    return spark.createDataFrame(rows + rows[:20], "id string, hash string, area string, band string, sex string")


def all_levelled(found, linkage):
    """Every pair of profiles with its levels, worked out one by one."""
    data = [r.asDict() for r in found.collect()]
    for a, b in itertools.combinations(sorted(data, key=lambda r: r["profile_id"]), 2):
        levels = []
        for c in linkage.comparisons:
            x, y = a[c.column], b[c.column]
            if x is None or y is None:
                levels.append(-1)
            elif x == y:
                levels.append(c.top)
            elif c.kind == "jaro_winkler":
                levels.append(sum(jaro_winkler_pair(x, y) >= t for t in c.thresholds))
            elif c.kind == "levenshtein":
                d = sum(p != q for p, q in zip(x, y))  # the areas here have one length
                levels.append(sum(d <= t for t in c.thresholds))
            else:
                levels.append(0)
        yield a, b, tuple(levels)


@pytest.mark.parametrize("small", [0, 256])
def test_referral_patterns_equal_all_pairs(spark, referred, small):
    found = lk.profiles(referred, CARE, "id").cache()
    near = 0
    for rule in CARE.rules:
        free = [c.column for c in CARE.outside(rule)]
        where = [i for i, c in enumerate(CARE.comparisons) if c.column in free]
        want = collections.Counter()
        for a, b, levels in all_levelled(found, CARE):
            if all(a[c] is not None and a[c] == b[c] for c in rule):
                want[tuple(levels[i] for i in where)] += a["copies"] * b["copies"]
                near += 0 < levels[0] < 3
        for r in found.collect():
            if r["copies"] > 1 and all(r[c] is not None for c in rule):
                want[tuple(-1 if r[CARE.comparisons[i].column] is None else CARE.comparisons[i].top for i in where)] += r["copies"] * (r["copies"] - 1) // 2
        got = {tuple(r[f"gamma_{c}"] for c in free): int(r["n"]) for r in pattern_counts(found, CARE, rule, small).collect()}
        assert got == dict(want)
    assert near > 10  # digests that are alike but not equal


def test_exact_columns_form_no_pairs(spark):
    """Two sexes and four bands in one area: half of all pairs agree on the sex, hardly any on the name."""
    rng = random.Random(12)
    names = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(9)) for _ in range(600)]
    df = spark.createDataFrame([(str(i), names[i // 2], "NE1", str(i % 4), str(i % 2)) for i in range(1200)], "id string, hash string, area string, band string, sex string")
    found = lk.profiles(df, CARE, "id").cache()
    formed = fuzzy_pairs(found, CARE, ("area",)).count()
    assert 600 <= formed < 0.2 * 1200 * 1199 / 2  # the name's own tokens; the sex alone would be half of all
    got = {(r["gamma_hash"], r["gamma_band"], r["gamma_sex"]): int(r["n"]) for r in pattern_counts(found, CARE, ("area",)).collect()}
    assert sum(got.values()) == 1200 * 1199 // 2 and sum(n for k, n in got.items() if k[0] == 3) == 600
    assert sum(n for k, n in got.items() if k[1] == 1) == 4 * (300 * 299 // 2) and sum(n for k, n in got.items() if k[2] == 1) == 2 * (600 * 599 // 2)


def test_many_similarities_at_once_equal_each_alone():
    rng = random.Random(2)
    for alphabet, most in (("AB", 8), ("ABCDEFGHIJ", 14), ("0123456789abcdef", 64), ("aé日\0", 70)):
        left, right = ([""] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(300)] for _ in "lr")
        right[:40] = left[:40]
        assert jaro_winkler_many(left, right).tolist() == [jaro_winkler_pair(a, b) for a, b in zip(left, right)]
    assert len(jaro_winkler_many([], [])) == 0


def test_edit_distances_are_counted_as_by_all_pairs(spark):
    rng = random.Random(9)
    words = {"", "a", "ab", "ba", "abc", "bca", "aab", "aba"} | {"".join(rng.choice("ab1 ") for _ in range(rng.randrange(1, 8))) for _ in range(250)}
    words |= {f"NE{a}{b} {c}AB" for a in "123" for b in ("", "4", "5") for c in "01"}
    n = {w: rng.randrange(1, 4) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long").withColumn("n", F.col("n").cast("decimal(19,0)"))
    con = duckdb.connect()
    want = {1: 0, 2: 0}
    for a, b in itertools.combinations(sorted(words), 2):
        d = con.execute("select levenshtein(?, ?)", [a, b]).fetchone()[0] if abs(len(a) - len(b)) <= 2 else 9
        if d <= 2:
            want[d] += n[a] * n[b]
    assert {r["distance"]: int(r["pairs"]) for r in edit_distances(df, "word", 2).collect()} == want
    assert {r["distance"]: int(r["pairs"]) for r in edit_distances(df, "word", 1).collect()} == {1: want[1]}
    assert {r["pairs"] for r in edit_distances(df.limit(0), "word", 2).collect()} == {0}


def test_edits_are_looked_up_without_broadcasting_what_is_repeated_for_its_keys(spark):
    from civiclake.operators.linkage import values

    rows = spark.range(20).select(F.concat(F.lit("NE1 "), F.col("id").cast("string")).alias("v"), F.lit(1).alias("n"))
    for step in (values._shifted, values._shortened_and_changed):
        plan = step(rows)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_dates_are_counted_as_by_all_pairs(spark):
    rng = random.Random(4)
    n = {rng.randrange(-3000, 3000): rng.randrange(1, 5) for _ in range(300)}
    df = spark.createDataFrame(list(n.items()), "day int, n long").select(F.date_from_unix_date("day").alias("d"), F.col("n").cast("decimal(19,0)").alias("n"))
    want = {0: 0, 1: 0}
    for a, b in itertools.combinations(n, 2):
        if abs(a - b) <= 365:
            want[int(abs(a - b) > 30)] += n[a] * n[b]
    near = date_distances(df, "d", [30, 365])
    assert {r["step"]: int(r["pairs"]) for r in near.collect()} == want
    windows = [line for line in near._jdf.queryExecution().executedPlan().toString().splitlines() if "Window " in line]
    assert windows and all("windowspecdefinition(_w0" in line for line in windows)  # never the whole histogram in one task


def test_long_texts_are_compared_by_the_characters_they_share(spark):
    from civiclake.functions.similarity import similar_among
    from civiclake.operators.linkage.pairs import near_texts

    rng = random.Random(6)
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(60)]
    digests += [near_digest(rng, d, k) for k in (1, 4, 9, 14, 20) for d in digests[:20]]
    odd = ["", "a", "ab", "é" * 20, "é" * 19 + "a", "日" + "0" * 30, "0" * 300, "0" * 290, *["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 24))) for _ in range(60)]]
    texts = sorted({*digests, *odd})
    for threshold in (0.6, 0.7, 0.75, 0.88, 0.95):
        want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaro_winkler_pair(texts[a], texts[b]) >= threshold}
        assert set(similar_among(texts, None, threshold, strip=50)) == want
        assert {(i, j) for i, j in similar_among(texts, texts, threshold) if i < j} == want
    df = spark.createDataFrame([(k, t) for k in "xy" for t in texts] + [("x", None), (None, "a")], "k string, t string")
    got = near_texts(df, ["k"], "t", 0.88, chunk=40).collect()
    want = {(k, a, b) for k in "xy" for a, b in itertools.combinations(texts, 2) if jaro_winkler_pair(a, b) >= 0.88}
    assert len(got) == len(want) and {(k, *sorted(p)) for k, *p in got} == want


def test_patterns_pair_values_not_profiles(spark, monkeypatch):
    """300 people in one block share four near areas: six pairs of areas are compared, not 45,000 pairs of people."""
    from civiclake.operators.linkage import pairs

    compared = []
    levels = pairs.with_levels
    monkeypatch.setattr(pairs, "with_levels", lambda p, *rest: compared.append(p) or levels(p, *rest))
    rng = random.Random(3)
    df = spark.createDataFrame([(str(i), hashlib.sha256(str(i).encode()).hexdigest(), rng.choice(["NE1", "NE2", "NE3", "NE4"]), "a", "F") for i in range(300)],
                               "id string, hash string, area string, band string, sex string")
    got = {(r["gamma_hash"], r["gamma_area"]): int(r["n"]) for r in pattern_counts(lk.profiles(df, CARE, "id"), CARE, ("band", "sex")).collect()}
    sizes = [r["count"] for r in df.groupBy("area").count().collect()]
    same = sum(n * (n - 1) // 2 for n in sizes)
    assert got == {(0, 3): same, (0, 2): 300 * 299 // 2 - same}
    assert sum(p.count() for p in compared) == 6


@pytest.mark.parametrize("direct", [4096, 12])
def test_patterns_are_counted_where_blocks_meet(spark, crowd, monkeypatch, direct):
    """With known spellings a profile is sent once and no pair of values is; ids may repeat or be missing, larger blocks are counted as before."""
    from civiclake.operators.linkage import pairs

    monkeypatch.setattr(pairs, "DIRECT_BLOCK", direct)
    twice = crowd.withColumn("copies", F.lit(3_000_000_000) + F.length("profile_id")).localCheckpoint()
    unnamed = twice.withColumn("profile_id", F.lit(None).cast("string"))
    for rule in PEOPLE.rules[::2]:
        known = lk.known_spellings(twice, lk.Linkage(tuple(PEOPLE.outside(rule)), (rule,)))
        want = rows(pattern_counts(twice, PEOPLE, rule))
        assert rows(pattern_counts(twice, PEOPLE, rule, known=known)) == want
        if direct == 4096:
            counts = pattern_counts(unnamed, PEOPLE, rule, known=known)
            assert rows(counts) == want
            plan = counts._jdf.queryExecution().executedPlan().toString()
            assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(gamma" not in line and "Exchange" in line and "copies_l" in line]


def test_digests_agree_only_when_equal(spark):
    df = spark.createDataFrame([("a" * 63 + "b", "a" * 63 + "c"), ("x", "x"), (None, "x")], "v_l string, v_r string")
    c = lk.Comparison("v", "jaro_winkler", (0.95, 0.88), digest=True)
    assert [r[0] for r in df.select(c.level(F.col("v_l"), F.col("v_r"))).collect()] == [0, 3, -1]


def test_training_separates_matches(spark):
    rng = random.Random(8)
    out = []
    for i in range(300):
        base = (rng.choice(NAMES), rng.choice(["BELL", "DODD", "KERR", "HALL", "WAKE"]), f"19{rng.randint(40, 99)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}",
                f"NE{rng.randint(1, 40)} {rng.randint(0, 9)}AB")
        for copy in range(2):
            v = list(base)
            if copy and rng.random() < 0.2:
                v[rng.randint(0, 3)] = None
            out.append((f"p{i:04d}{copy}", *v))
    df = spark.createDataFrame(out, "person_id string, forename string, surname string, dob string, postcode string")
    df = df.withColumn("dob", F.col("dob").cast("date"))
    found = lk.profiles(df, PEOPLE, "person_id")
    u = lk.estimate_u(df, PEOPLE)
    model = lk.estimate_m(found, PEOPLE, u, [("surname", "dob"), ("forename", "postcode")])
    for c in PEOPLE.comparisons:
        assert model.m[c.column][c.top] > model.u[c.column][c.top]
        assert abs(sum(model.m[c.column]) - 1) < 0.05
    pairs = lk.predict(found, PEOPLE, model, 0.88)
    named = dict(rows(lk.cluster_records(df, found, PEOPLE, model, pairs, 0.92, "person_id")))
    assert len(named) == 600
    together = sum(named[f"p{i:04d}0"] == named[f"p{i:04d}1"] for i in range(300))
    assert together > 230


def test_spellings_and_birth_dates_of_all_systems_are_compared(spark):
    from civiclake.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    dated = QUERIES["link_dob_all"](spark, sf)
    assert rows(dated.select("person_id")) == rows(QUERIES["persons_union"](spark, sf).select("person_id"))
    names = {r[0] for r in QUERIES["persons_union"](spark, sf).select("forename").distinct().collect() if r[0]}
    want = sorted((a, b) for a, b in itertools.combinations(sorted(names), 2) if jaro_winkler_pair(a, b) >= 0.70)
    assert rows(QUERIES["link_jw_levels_all"](spark, sf).select("value_l", "value_r")) == want


def test_deletions_that_meet_other_edits_form_no_pairs(spark):
    from civiclake.operators.linkage import values

    letters = "abcdefghij"
    words = ["".join(w) for n in (2, 3) for w in itertools.product(letters, repeat=n)]
    rows_ = spark.createDataFrame([(w, 1) for w in words], "v string, n long")
    con = duckdb.connect()
    pairs = "(select unnest(?) as a) x, (select unnest(?) as b) y where levenshtein(a, b) = 2"
    want = con.execute(f"select count(*) from {pairs} and length(a) = 2 and length(b) = 3", [words, words]).fetchone()[0]
    found = values._shortened_and_changed(rows_)
    assert int(found.agg(F.sum("pairs")).collect()[0][0]) == want
    assert found.count() < want  # sums by what is forbidden, not a row a pair and shared key
    same = con.execute(f"select count(*) from {pairs} and length(a) = length(b) and a < b and list_sum([(a[i] <> b[i])::int for i in range(1, 4)]) > 2", [words, words]).fetchone()[0]
    assert int(values._shifted(rows_).agg(F.sum("pairs")).collect()[0][0]) == same > 0


def test_profiles_are_grouped_once(spark, people):
    plan = lk.profiles(people, PEOPLE, "person_id")._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line and "postcode" in line for line in plan.splitlines()) == 1


def test_few_spellings_are_all_compared(spark, people, monkeypatch):
    from civiclake.operators.linkage import pairs

    found = lk.profiles(people, PEOPLE, "person_id").localCheckpoint()
    some = {c: set(rows(df)) for c, df in lk.known_spellings(found, PEOPLE).items()}
    monkeypatch.setattr(pairs, "_meeting", None)  # not asked for
    assert {c: set(rows(df)) for c, df in lk.known_spellings(found, PEOPLE).items()} == some
    names = [r[0] for r in found.select("forename").dropna().distinct().collect()]
    want = {(a, b) for a, b in itertools.permutations(names, 2) if jaro_winkler_pair(a, b) >= 0.70}
    assert {r[:2] for r in some["forename"]} == want
    monkeypatch.undo()
    monkeypatch.setattr(pairs, "FEW_VALUES", 0)
    for c, df in lk.known_spellings(found, PEOPLE).items():
        assert set(rows(df)) <= some[c]


def test_digests_are_compared_only_with_enough_in_order(monkeypatch):
    from civiclake.functions import similarity

    rng = random.Random(15)
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(700)]
    digests += [near_digest(rng, d, k) for k in (2, 6) for d in digests[:20]] + [d[9:] + d[:9] for d in digests[:20]] + [d[:40] for d in digests[:20]]
    compared = []
    each = similarity.jaro_winkler_many
    monkeypatch.setattr(similarity, "jaro_winkler_many", lambda a, b: compared.extend(a) or each(a, b))
    got = similarity.similar_among(digests, None, 0.88)
    every = list(itertools.combinations(range(len(digests)), 2))
    scores = each([digests[i] for i, _ in every], [digests[j] for _, j in every])
    assert set(got) == {pair for pair, score in zip(every, scores) if score >= 0.88} and len(got) >= 40
    assert len(compared) < len(every) / 1000  # by the characters in common alone, about one in forty
