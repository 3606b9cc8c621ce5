import collections
import itertools
import random
import re

import pytest

from civiclake.llm import chat_format as C

COSTS = C.Costs()
SCHEMA = "conv_id long, turn long, role string, text string, piece string"


def conversations():
    rnd = random.Random(5)
    rows = [(c, k, rnd.choice(["system", "user", "assistant", "tool", None, " User"]), f"t{c}.{k}", "clash") for c in range(30)
            for k in range(rnd.choice([1, 2, 3, 4]))]
    rows += [(99, k, rnd.choice(["system", "user", "assistant", "x"]), f"h{k}", None) for k in range(300)]
    return rows + [(None, None, "user", None, "p"), (50, 0, "user", "", "p"), (50, 0, "assistant", "x" * 100_000, "p")]


def cheapest(roles):
    best = float("inf")
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        for merged in itertools.product((0, 1), repeat=len(roles)):
            state, cost = C.START, 0.0
            for r, x, m in zip(roles, labels, merged):
                cost += COSTS.relabel * (r != x)
                if m:
                    cost += COSTS.merge if state == x else float("inf")
                else:
                    empty = C._insertions(state, x)
                    cost += float("inf") if empty is None else COSTS.insert * len(empty)
                state = x
            if state != C.ASSISTANT:
                cost += COSTS.insert * (1 + len(C._insertions(state, C.ASSISTANT)))
            best = min(best, cost)
    return best


@pytest.fixture(scope="module")
def rendered(spark):
    df = spark.createDataFrame(conversations(), SCHEMA)
    out = {}
    for parts in (1, 7):
        repaired = C.repair_turns(df, partitions=parts)
        assert repaired.count() == len(conversations())
        out[parts] = {r["conv"]: (r["rendered"], r["cost"]) for r in C.render(repaired).collect()}
    return out


def test_cuts_make_no_difference(rendered):
    assert rendered[1] == rendered[7]


def test_costs_are_least(rendered):
    convs = collections.defaultdict(list)
    for r in sorted(conversations(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0, r[2] or "")):
        convs[r[0]].append(C.role_number(r[2]))
    for c, roles in convs.items():
        if len(roles) <= 4:
            assert rendered[1][c][1] == cheapest(roles), c


def test_renderings_are_legal_and_whole(rendered):
    for c, (text, _) in rendered[1].items():
        roles = re.findall(r"<\|(system|user|assistant)\|>\n", text)
        roles = roles[1:] if roles[0] == "system" else roles
        assert roles == ["user", "assistant"] * (len(roles) // 2) and roles
        assert text.count(C.END) == len(re.findall(r"<\|(?:system|user|assistant)\|>\n", text)) and text.endswith(C.END)
    assert all(f"h{k}" in rendered[1][99][0] for k in range(300))


def test_legal_conversations_stay_as_they_are(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "human", "u"), (2, 1, "gpt", "a")]
    out = C.repair_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["cost"] for r in out.collect()} == {0.0} and not any(r["merged"] for r in out.collect())


def test_nothing(spark):
    assert C.repair_turns(spark.createDataFrame([], SCHEMA)).count() == 0
