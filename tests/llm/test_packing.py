import collections
import random

import numpy as np
import pytest

from civiclake.llm import packing as P
from civiclake.llm.queries import VOCABULARY

CODE = P.Encoder(P.read_vocabulary(VOCABULARY))


def test_capacities_find_the_least_that_is_enough():
    rnd = random.Random(1)
    for n in (1, 2, 7, 8, 31):
        for _ in range(60):
            tree, have = P.Capacities(n), collections.Counter()
            for _ in range(rnd.randrange(7)):
                k = rnd.randrange(n + 1)
                tree.add(k, 1)
                have[k] += 1
            for x in range(n + 1):
                assert tree.least_from(x) == next((k for k in range(x, n + 1) if have[k]), -1)


def test_best_fit_decreasing_equals_a_plain_search():
    rnd = random.Random(2)
    lengths = np.array([rnd.randrange(1, 101) for _ in range(300)])
    rows, room = [], []
    for s in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in range(len(rows)) if room[r] >= lengths[s]]
        if fits:
            r = min(fits, key=lambda i: room[i])
        else:
            r = len(rows)
            rows.append([])
            room.append(100)
        rows[r].append(s)
        room[r] -= lengths[s]
    got = P.best_fit_decreasing(lengths, 100)
    assert sorted(x for r in got for x in r) == list(range(300)) and all(sum(lengths[r]) <= 100 for r in got)
    # Rows with the same room are alike, whichever is taken: the fillings agree.
    assert sorted(int(lengths[r].sum()) for r in got) == sorted(int(lengths[r].sum()) for r in rows)


@pytest.mark.parametrize("text", ["a b", "a  b", " a", "a ", "\n a", "a\n b", "don't  x", "x 's y", "a \n", "é字 è\t", " ", "ab\n\ncd e", "<|endoftext|> x"])
def test_words_encoded_apart_equal_the_whole(text):
    assert np.frombuffer(CODE.ids(text), CODE.dtype)[:-1].tolist() == CODE.encoding.encode_ordinary(text)


def test_round_trip_of_odd_rows(spark, odd, none):
    packed = P.pack(odd, VOCABULARY, row_length=64, shard_tokens=5000).cache()
    docs = collections.defaultdict(dict)
    want = collections.Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    got, run = collections.Counter(), {}
    for r in sorted(P.unpack(packed, VOCABULARY).collect(), key=lambda r: (str(r["doc_id"]), r["part"])):
        docs[r["doc_id"]].setdefault(r["part"], []).append((r["ids"], r["last_part"]))
    for doc, parts in docs.items():
        if doc in (9, None):  # several rows under one id: their single parts
            continue
        run = b"".join(bytes(parts[k][0][0]) for k in sorted(parts))
        got[doc, CODE.text(run)] += 1
    assert got == collections.Counter({k: v for k, v in want.items() if k[0] not in (9, None)})
    total = sum(len(CODE.ids(r["text"])) // 2 for r in odd.collect())
    rows = packed.collect()
    assert sum(r["n_tokens"] for r in rows) == total
    for r in rows:
        assert len(r["ids"]) == 128 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64
        assert r["position_resets"] == r["cu_seqlens"][:-1] + ([r["n_tokens"]] if r["n_tokens"] < 64 else [])
    assert P.pack(none, VOCABULARY).count() == 0
