import hashlib
import heapq
import os
import random
import re
import zlib

import pytest
from compare import check_engine, compare

from civiclake.llm import queries
from civiclake.llm import structure_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, conv string, edit int, part string, piece long, copies string"


def cheapest(rows):
    """Best first over all edit sequences: the cheapest, then least, whose initials are legal. ``rows``: role, text, forced, truncated."""
    heap, number = [(0, "", 0, 0, ())], 1
    while heap:
        cost, audit, i, _, made = heapq.heappop(heap)
        initials = "".join(r[:1] or "-" for r, _ in made)
        if not re.fullmatch("(s?(ua)*u?)?", initials) or initials.count("s") > 1:
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, made
        options = [(2, "I", i, (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, forced, broken = rows[i]
            options.append((3, "D", i + 1, None))
            if not forced:
                options.append((broken, "K", i + 1, (role, text)))
                options += [(2 + broken, "R", i + 1, (r, text)) for r in ("user", "assistant")]
        for extra, letter, to, new in options:
            heapq.heappush(heap, (cost + extra, audit + letter, to, number, made + (() if new is None else (new,))))
            number += 1


def by_hand(rows):
    """The contract for one conversation, row by row: (conv, turn, role, text) in, the summary out."""
    left = []
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        left += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in left:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in left if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
    cost, audit, made = cheapest(judged)
    body = "\n".join(f"{r}:{t}" for r, t in made)
    return gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest()


def conversations():
    rnd = random.Random(5)
    texts = ["Yes.", "No", "", " \t", "Why?", "Ok!", "a.b", "é", "x. \n", None]
    roles = ["user", "assistant", "system", "tool", "User", "", None]
    rows = []
    for conv in [None, *range(120)]:
        for k in range(rnd.randrange(1, 6)):
            turn = rnd.choice([k, k, k, k + 1, None])
            rows.append((conv, turn, rnd.choice(roles[:2] if rnd.random() < 0.6 else roles), rnd.choice(texts)))
    return rows + rows[5:9] + [(500, t, "user", "same.") for t in (1, 1, 1)]


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {c: by_hand(g) for c, g in groups.items()}


def summaries(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("tasks", [None, 40])
def test_against_all_edit_sequences(spark, monkeypatch, tasks):
    rows = conversations()
    df = spark.createDataFrame([(*r, "c", 1, "p", 2, "k") for r in rows], SCHEMA)
    plain = R.repair_structure
    monkeypatch.setattr(R, "repair_structure", lambda d, **k: plain(d, partitions=tasks, **k))
    assert summaries(queries.repaired_summaries(df)) == expected(rows)


def test_conversations_without_rows_and_empty_tables(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert summaries(queries.repaired_summaries(df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert queries.repaired_summaries(df.limit(0)).count() == 0


def long_rows(kind):
    rnd = random.Random(kind)
    for k in range(900):
        role = {"alternating": "user assistant".split()[k % 2], "one role": "user", "mixed": rnd.choice(["user", "assistant", "system", "tool"])}[kind]
        yield 7, k, role, f"{rnd.choice(['Turn', 'Step'])} {k % 211}" + rnd.choice([".", "", "!"])


@pytest.mark.parametrize("kind", ["alternating", "one role", "mixed"])
def test_chunks_agree_with_one_piece(spark, kind):
    rows = [(3, 0, "user", "Hi."), *long_rows(kind), *[(8, k, "system", "Same.") for k in range(60)]]
    rows += [(8, 99, "user", "Copy.")] * 200
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    in_one = R.repair_structure(df, partitions=1)
    cut = R.repair_structure(df, partitions=23)
    parts = cut.where("conv = 7").select("part").distinct().count()
    columns = ["conv", "turn", "role", "text", "copies", "fault", "edit", "new_role", "inserted_before", "inserted_after", "cost", "illegal"]
    assert parts > 5
    assert sorted(map(repr, cut.select(columns).collect())) == sorted(map(repr, in_one.select(columns).collect()))
    both = [sorted(map(tuple, R.summaries(x, 64).collect())) for x in (in_one, cut)]
    assert both[0] == both[1] and both[0] == sorted(map(tuple, R.summaries(cut).collect()))


def test_a_wrong_speculation_is_fixed_up():
    viterbi = R.Viterbi(R.Costs())
    codes = [R.turn_code(k, False) for k in (2, 3, 2, 3)]
    far = (0, 9, 9, 9)
    assert viterbi.fixed_up(codes, viterbi.end, far) in (None, viterbi.backward(codes, far)[0])
    # System turns that no state can keep carry any vector unchanged but for a constant: it must be passed on.
    assert viterbi.fixed_up([R.turn_code(0, False)] * 5, viterbi.end, (0, 2, 1, 1)) == (0, 2, 1, 1)


def test_query_equals_its_sql(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    assert compare(spark, check_engine(sf), queries.QUERIES["op12_structure_repair"], queries.ORACLES["op12_structure_repair"], sf) is None
