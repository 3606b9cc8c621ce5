import collections
import random

import pytest

from civiclake.llm import jaccard_join as J
from llm.odd import edited, prose


def brute(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links, par = collections.Counter(), list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and c >= threshold * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
                links[a] += 1
                links[b] += 1
                par[max(find(a), find(b))] = min(find(a), find(b))
    return [(links[i], rows[find(i)][0]) for i in range(len(rows))]


@pytest.mark.parametrize("leaf", [32, 1024])
def test_equals_brute_force_with_a_large_group(spark, leaf):
    rnd = random.Random(3)
    base = prose(1, 80)
    rows = [(i, base) for i in range(20)]
    for i in range(20, 220):
        t = base
        for _ in range(rnd.randrange(4)):
            t = edited(t, rnd.randrange(80), f"x{rnd.randrange(999)}")
        rows.append((i, t))
    shared = prose(9, 50)
    rows += [(i, prose(i, 60) + " " + shared) for i in range(220, 320)]
    found = J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), leaf=leaf)
    got = {r["_id"]: (r["_links"], r["_class"]) for r in found.collect()}
    assert [got[i] for i, _ in rows] == brute(rows)


def test_odd_rows(odd, none):
    got = collections.defaultdict(list)
    for r in J.jaccard_classes(odd).collect():
        got[r["_id"]].append((r["_class"], r["_links"]))
    assert got[1] == [(1, 2)] and got[2] == [(1, 2)] and got[3] == [(1, 2)]
    assert got[5] == [(5, 0)] and got[6] == [(6, 0)] and got[7] == [(7, 0)]
    assert sorted(got[9]) == [(9, 0), (9, 1), (9, 1)]
    assert J.jaccard_classes(none).count() == 0


def test_one_of_each_class_stays(odd, none):
    kept = J.one_of_each_class(odd)
    assert kept.columns == odd.columns
    texts = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
    want = collections.Counter({(r["doc_id"], r["text"]): 1 for r in odd.collect() if r["doc_id"] not in (2, 3)})
    assert texts == want
    assert J.one_of_each_class(none).count() == 0


def test_runs_grow_with_the_recall():
    few, many = J.runs_needed(0.9, 0.8, 0.5, 3), J.runs_needed(0.9999, 0.8, 0.5, 3)
    assert 1 <= few < many


def test_clashing_names_and_one_id_on_many_rows(spark):
    """A third of the rows share one id with different texts; columns bear the names that the operator uses itself."""
    rows = [(7, prose(1000 + i, 40), "g", 1, "k", 2.0, "n") for i in range(60)] + [(7, prose(1000, 40), "g", 1, "k", 2.0, "n")]
    rows += [(None, prose(1000 + i, 40), "g", 1, "k", 2.0, "n") for i in range(20, 50)] + [(100 + i, prose(2000 + i // 2, 40), "g", 1, "k", 2.0, "n") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _again int, _key string, _set double, _row string")
    kept = J.one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted({r[1] for r in rows})


def test_a_key_meets_its_sketch_once(spark):
    at = spark.createDataFrame([(b"a", i) for i in range(50)] + [(b"b", 1), (b"gone", 2)], "key binary, bucket long")
    sketches = spark.createDataFrame([(b"a", b"1"), (b"b", b"2"), (b"c", b"3")], "key binary, sketch binary")
    found = J.with_sketches(at, sketches)
    got = sorted((bytes(r["key"]), bytes(r["sketch"]), r["bucket"]) for r in found.collect())
    assert got == [(b"a", b"1", i) for i in range(50)] + [(b"b", b"2", 1)]
    # The rows are repeated above the join, which sees one row a key.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") < plan.index("Aggregate")


def test_values_join_before_rows_are_repeated_for_their_cells(spark):
    rows = spark.createDataFrame([(1, f"{i}".encode()) for i in range(40)] + [(2, b"x")], "component int, key binary")
    values = rows.select("key", rows["key"].alias("shingles"))
    cells = J.in_cells(rows, "component", 10, values=values)
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
    got = cells.collect()
    assert all(r["shingles"] == r["key"] for r in got)
    met = {(a["key"], b["key"]) for a in got for b in got if (a["component"], a["_i"], a["_j"]) == (b["component"], b["_i"], b["_j"])}
    ones = [f"{i}".encode() for i in range(40)]
    assert {(bytes(a), bytes(b)) for a, b in met} == {(a, b) for a in ones for b in ones} | {(b"x", b"x")}
