import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from civiclake.llm import language_id as L

PARTS = {"aa": ["ka", "to", "mi", "ne"], "bb": ["sch", "ung", "ein", "er"], "cc": ["éau", "que", "la", "oir"]}


def line(lang, seed, n=30):
    rnd = random.Random(f"{lang}{seed}")
    return " ".join("".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(i, line(x, i), x) for i in range(40) for x in PARTS], "doc_id long, text string, lang string").cache()


@pytest.fixture(scope="module")
def model(labelled):
    return L.calibrate(L.train(labelled.where("doc_id < 30")), labelled.where("doc_id >= 30"))


def conditional(model: L.LanguageModel, order: int, before: str, symbol: str) -> float:
    """Chance of one symbol ('' is the boundary) after the letters of a word so far, read from the arrays one by one."""
    values = [0, *map(ord, before), ord(symbol) if symbol else 0]
    chance = 2.0 ** model.unseen
    step = pow(0x9E3779B97F4A7C15, 1)

    def entry(part):
        raw = 0
        for k, v in enumerate(reversed(part)):
            raw = (raw + (v + 1) * pow(step, k, 1 << 64)) % (1 << 64)
        key = L._id(np.array([raw], np.uint64), len(part))
        logs, backs = model.look_up(key)
        return logs[0], backs[0]

    for n in range(1, min(order, len(values)) + 1):
        logs, _ = entry(values[-n:])
        if not np.isnan(logs):
            chance = 2.0 ** logs
        elif n > 1:
            _, back = entry(values[-n:-1])
            chance *= 1.0 if np.isnan(back) else 2.0 ** back
    return chance


def test_chances_of_what_may_follow_add_up(model):
    for m, lang in zip(model.models, model.languages):
        known = sorted({c for p in PARTS[lang] for c in p})
        for before in ("", "k", "sch", "éauq", known[0], known[1] + known[0], "字"):
            follow = [*known, "", "ω"]  # the boundary, and all other letters as one
            assert sum(conditional(m, model.order, before, c) for c in follow) == pytest.approx(1.0, abs=1e-4), (lang, before)


def test_vectors_equal_single_look_ups(model):
    words = ["ka", "schung", "zzz", "éau", "a"]
    got = model.token_scores([w.encode() for w in words])
    for w, row in zip(words, got):
        for k, m in enumerate(model.models):
            want = sum(np.log2(conditional(m, model.order, w[:i], w[i:i + 1])) for i in range(len(w) + 1))
            assert row[k] == pytest.approx(want, abs=1e-9)
        assert row[-1] == len(w) + 1


def test_held_out_texts_are_told_apart(labelled):
    got = L.identify(labelled, learn=F.col("doc_id") < 30).join(labelled.select(F.col("doc_id").alias("_id"), "text", "lang").where("doc_id >= 30"), "_id")
    rows = L.identify(labelled, learn=F.col("doc_id") < 30).collect()
    assert len(rows) == 120 and got.count() > 0
    answers = [r["_lang"] for r in rows]
    truth = [r["lang"] for r in labelled.collect()]
    assert np.mean([a == b for a, b in zip(answers, truth)]) > 0.98
    assert all(0 <= r["_score"] <= 1 for r in rows) and np.mean([r["_accepted"] for r in rows]) > 0.95


def test_odd_texts(spark, model):
    shared = spark.sparkContext.broadcast(model)
    texts = [None, "", "123 .. 456", "ka to mi ne kato mine", "x" * 100_000, line("bb", 999, 5000), "字" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rows = [r["p"] for r in df.select(L.predictor(shared)("text").alias("p")).collect()]
    assert [r["lang"] for r in rows[:3]] == ["und"] * 3 and [r["score"] for r in rows[:3]] == [0.0] * 3
    assert rows[3]["lang"] == "aa" and rows[5]["lang"] == "bb" and rows[5]["accepted"]
    assert rows[4]["lang"] in model.languages and not rows[4]["accepted"] and not rows[6]["accepted"]


def test_odd_rows_and_nothing_to_learn(odd, none):
    assert L.identify(odd).count() == odd.count()
    assert {r["_lang"] for r in L.identify(odd, learn=F.lit(False)).collect()} == {"und"}
    assert L.identify(none).count() == 0


def test_a_bound_on_ngrams_keeps_single_symbols(labelled):
    small = L.train(labelled, max_ngrams=60)
    assert all(len(m.ids) < 200 for m in small.models) and small.languages == sorted(PARTS)


def test_a_rare_language_is_learned_above_the_bound(spark):
    rows = [(f"{x}{i}", line(x, i), x, True) for x in ("aa", "bb") for i in range(400)]
    rows += [(f"cc{i}", line("cc", i), "cc", i < 5) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, known boolean")
    got = L.identify(df, learn=F.col("known"), max_train_docs=60).where("_id like 'cc%'").collect()
    assert len(got) == 30 and {r["_lang"] for r in got} == {"cc"}


def test_a_language_with_only_texts_set_aside_is_learned(spark):
    rows = [(f"{x}{i}", line(x, i), x, True) for x in ("aa", "bb") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, known boolean")
    aside = spark.range(200).select(F.concat(F.lit("cc"), "id").alias("id")).where("pmod(xxhash64(id, 8), 8) = 0").limit(2).collect()
    rare = [(r["id"], line("cc", k), "cc", True) for k, r in enumerate(aside)] + [("new", line("cc", 99), "cc", False)]
    got = L.identify(df.union(spark.createDataFrame(rare, df.schema)), learn=F.col("known")).where("_id = 'new'").collect()
    assert [r["_lang"] for r in got] == ["cc"]


def test_shares_are_even_and_leave_nothing_over():
    got = L.shares({"a": 5, "b": 1000, "c": 4000}, 105)
    assert {x: round(s * n) for (x, s), n in zip(got.items(), (5, 1000, 4000))} == {"a": 5, "b": 50, "c": 50}
    assert set(L.shares({"a": 5, "b": 6}, 11).values()) == {1.0}
