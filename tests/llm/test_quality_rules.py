import collections
import re

import numpy as np
from pyspark.sql import functions as F

from civiclake.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(set(w)), len(lines),
            len(re.findall("[A-Z]", text)), len(re.findall("[0-9]", text)), None, text.count("|"), len(text), max((len(x.encode()) for x in w), default=0))


def test_counts(spark):
    texts = [None, "", " \n ", "a b c a b c", "x\nx\n\ny |# $\nx", "é字 😀 é字 😀 é字", "A1 " * 5000, "one", "a b a b a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    for row in Q.with_statistics(df).collect():
        got = tuple(row["_stats"])
        want = brute(row["text"])
        assert [g for g, x in zip(got, want) if x is not None] == [x for x in want if x is not None], row["text"]


def test_a_list_finds_planted_conjunctions_and_leaves_the_rest():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.5) | (x[:, 2] > 0.95)
    rules = Q.learn_decision_list(x, bad, list(Q.FEATURES)[:3])
    hit = np.zeros(len(x), bool)
    for rule in rules.rules:
        h = np.ones(len(x), bool)
        for c in rule:
            v = x[:, list(Q.FEATURES).index(c.feature)]
            h &= (v > c.threshold) if c.above else (v <= c.threshold)
        hit |= h
    assert (hit & bad).sum() > 0.95 * bad.sum() and (hit & ~bad).sum() < 0.01 * (~bad).sum()
    assert "and" in str(rules)


def test_nothing_to_learn():
    assert not Q.learn_decision_list(np.zeros((0, 2)), np.zeros(0, bool), ["a", "b"]).rules
    assert not Q.learn_decision_list(np.ones((50, 2)), np.zeros(50, bool), ["a", "b"]).rules
    assert not Q.learn_decision_list(np.ones((50, 2)), np.arange(50) % 2 == 0, ["a", "b"]).rules


def test_judges_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(10)] + [(None, 0, 0), (101, None, 1)], "doc_id long, quality int, toxic int")
    judged, rules = Q.judge(odd.withColumn("_rule", F.lit(1)).withColumn("_kept", F.lit("k")), labels)
    assert not rules.rules and judged.count() == odd.count()
    kept = {r["_row"]["doc_id"] for r in judged.where("_kept").collect()}
    assert judged.select("_row.*").columns == [*odd.columns, "_rule", "_kept"]
    assert {1, 2, 3, 4, 8, 100} <= kept and not {5, 6, 7, 10, 11} & kept
    assert Q.judge(none, labels)[0].count() == 0
    assert Q.judge(odd.withColumn("_rule", F.lit(1)).withColumn("_kept", F.lit("k")), labels.limit(0))[0].count() == odd.count()


def test_learned_rules_reject_and_a_bound_holds(spark):
    rows = [(i, ("$" * (i % 2) + f"word{i} ") * 60 + " ".join(f"u{i}x{k}" for k in range(400))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, quality int")
    judged, rules = Q.judge(docs, labels, max_labelled=150)
    assert rules.rules
    assert {r["_row"]["doc_id"] % 2 for r in judged.where("_rule is not null").collect()} == {1}


def test_one_labelled_id_on_many_documents(spark):
    rows = [(1, f"word{i} " * 60) for i in range(500)] + [(i, f"other{i} " * 60) for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, quality int")
    x, bad = Q.labelled_features(docs, labels, max_labelled=100)
    assert len(x) == len(bad) <= 100
