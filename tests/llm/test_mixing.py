import collections
import math

import pytest

from civiclake.llm import mixing as M
from llm.odd import prose

SIZES = {"a": 60, "b": 20, "c": 6, None: 3}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1000 * i + k, prose(1000 * i + k, 40 + k % 5), s) for i, (s, n) in enumerate(SIZES.items()) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).cache()


def tokens(docs):
    out = collections.Counter()
    for r in docs.collect():
        out[r["source"]] += len((r["text"] or "").split())
    return out


def test_exponent_meets_the_entropy(docs):
    t = tokens(docs)
    mix = M.temperature(docs.select("source", M.token_count(docs["text"]).alias("tokens")), target_entropy=0.9, max_repeats=None)
    p = [x / sum(t.values()) for x in t.values()]

    def entropy(e):
        w = [x**e for x in p]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    assert mix.entropy == pytest.approx(entropy(mix.exponent)) and mix.entropy == pytest.approx(0.9 * math.log(4), abs=1e-4)
    assert {r["source"]: r["weight"] for r in mix.sources.collect()}.keys() == t.keys()


def test_no_repetition_beyond_the_limit(docs):
    mix = M.temperature(docs.select("source", M.token_count(docs["text"]).alias("tokens")), target_entropy=1.0, max_repeats=3.0)
    repeats = [r["repeats"] for r in mix.sources.collect()]
    assert max(repeats) <= 3.0 + 1e-9 and max(repeats) > 2.99 and min(repeats) == pytest.approx(1.0)


def test_every_document_is_read_and_weights_are_met(docs):
    read, mix = M.mix_sources(docs, block_tokens=200)
    rows = read.select("_row.*", "_epoch", "_slot", "_block").collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    assert len({(r["doc_id"], r["_epoch"]) for r in rows}) == len(rows)
    have, all_ = collections.Counter(), tokens(docs)
    for r in rows:
        have[r["source"]] += len(r["text"].split())
    for r in mix.sources.collect():
        assert r["weight"] * mix.budget <= have[r["source"]] + 1 <= r["weight"] * mix.budget + 46
        epochs = collections.Counter(x["_epoch"] for x in rows if x["source"] == r["source"])
        assert all(epochs[e] == SIZES[r["source"]] for e in range(int(r["repeats"] + 1e-9)))
    assert all(0 <= r["_slot"] < 1 for r in rows) and sum(have.values()) >= sum(all_.values())
    order = {e: [r["_block"] for r in sorted(rows, key=lambda r: r["_slot"]) if r["source"] == "b" and r["_epoch"] == e] for e in (0, 1)}
    assert list(dict.fromkeys(order[0])) != sorted(set(order[0])) or list(dict.fromkeys(order[1])) != list(dict.fromkeys(order[0]))


def test_a_budget_ends_inside_a_block(docs):
    read, mix = M.mix_sources(docs, budget=1000, target_entropy=None, max_repeats=None, block_tokens=10_000)
    assert mix.exponent == 1.0
    have = collections.Counter()
    for r in read.select("_row.source", "_tokens").collect():
        have[r["source"]] += r["_tokens"]
    for r in mix.sources.collect():
        assert r["weight"] * 1000 - 1 <= have[r["source"]] <= r["weight"] * 1000 + 46


def test_odd_rows(odd, none):
    read, _ = M.mix_sources(odd, target_entropy=None)
    got = collections.Counter(map(str, read.select("_row.*").collect()))
    assert got == collections.Counter(map(str, odd.collect()))
    assert read.select("_row.*").columns == odd.columns
    assert M.mix_sources(none)[0].count() == 0
    blank = odd.where("doc_id in (5, 6, 7)")
    assert M.mix_sources(blank)[0].count() == 3
