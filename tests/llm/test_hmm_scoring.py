import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from civiclake.llm import hmm_scoring as H

MODEL = H.Model(np.array([0.3, 0.7]), np.array([[0.6, 0.4], [0.2, 0.8]]), np.array([[0.5, 0.1], [0.3, 0.2], [0.2, 0.7]]))
SEQUENCES = [np.random.default_rng(n).integers(0, 3, n) for n in (1, 5, 3, 8, 1)]


def paths(q):
    for p in itertools.product((0, 1), repeat=len(q)):
        x = MODEL.start[p[0]] * MODEL.emits[q[0], p[0]]
        for t in range(1, len(q)):
            x *= MODEL.moves[p[t - 1], p[t]] * MODEL.emits[q[t], p[t]]
        yield p, x


def test_recursions_equal_the_sum_over_all_paths():
    starts, moves, emits = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for q, got in zip(SEQUENCES, H.Side(SEQUENCES).forward(MODEL)[0]):
        every = list(paths(q))
        total = sum(x for _, x in every)
        assert got == pytest.approx(math.log10(total), abs=1e-12)
        for p, x in every:
            starts[p[0]] += x / total
            for t in range(len(q)):
                emits[q[t], p[t]] += x / total
                if t:
                    moves[p[t - 1], p[t]] += x / total
    got = H.Side(SEQUENCES).expect(MODEL)
    for a, b in zip(got, (starts, moves, emits)):
        assert np.allclose(a, b)


def test_long_sequences_keep_their_scale():
    q = np.tile([0, 1, 2], 20_000)
    whole = H.Side([q]).forward(MODEL, keep=False)[0][0]
    assert np.isfinite(whole) and whole < -10_000


def test_passes_raise_the_likelihood(spark):
    rng = np.random.default_rng(3)
    rows = [(bytearray(np.array(rng.integers(0, 6, 40) + 6 * (i % 2), np.uint16).tobytes()),) for i in range(200)]
    encoded = spark.createDataFrame(rows, "symbols binary")
    shares = np.full(14, 1 / 14)
    model, likes = H.Model.first(shares, 2, 1), []
    for _ in range(8):
        model, like = H.baum_welch_pass(encoded, model, shares)
        likes.append(like)
    assert all(b > a - 1 for a, b in zip(likes, likes[1:])) and likes[-1] > likes[0] + 500
    assert np.allclose(model.emits.sum(0), 1) and np.allclose(model.moves.sum(1), 1)


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_base_scores_and_odd_rows(odd, none):
    got = {(r["_id"], round(r["_base"], 6)): r for r in H.hmm_scores(odd, states=2, own_symbols=50, frequent=100, folds=2, passes=1).collect()}
    rows = odd.select("doc_id", "text").collect()
    words = [(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", fold(r["text"])) + [None]) for r in rows]
    train = [w for i, w in words if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    seen = 0
    for i, w in words:
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        r = next(r for (k, b), r in got.items() if k == i and b == pytest.approx(base, abs=2e-6 * max(1, -base / 100)))
        assert (r["_tokens"], r["_known"], r["_train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert np.isfinite(r["_score"]) and r["_score"] < 0
        seen += 1
    assert seen == odd.count() and H.hmm_scores(none, states=2).count() == 0


def test_the_model_is_a_distribution(spark):
    """Over one-word texts (each training word, the unknown word, the end alone) and what may follow, chances add up to one."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa bb aa", "cc aa", "bb dd ee", "aa", "ff bb"])], "doc_id long, text string")
    texts = spark.createDataFrame([(100 + i, t) for i, t in enumerate(["", "aa", "bb", "cc", "dd", "ee", "ff", "zz"])], "doc_id long, text string")
    got = H.hmm_scores(docs.unionByName(texts), held_out=F.col("doc_id") >= 100, states=1, own_symbols=1, frequent=2, folds=1, passes=1)
    chance = {r["_id"]: 10 ** r["_score"] for r in got.where("_id >= 100").collect()}
    end = chance[100]  # one state: a text's chance is the product of its tokens'
    assert end + sum(chance[i] / end for i in range(101, 108)) == pytest.approx(1.0, abs=1e-9)


def test_nothing_to_train_on(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = H.hmm_scores(docs, held_out=F.lit(True), states=2).collect()
    assert {(r["_tokens"], r["_known"], r["_train_tokens"]) for r in got} == {(3, 0, 0), (1, 0, 0)}
