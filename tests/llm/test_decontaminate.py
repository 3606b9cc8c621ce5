import random

import numpy as np
import pyarrow as pa
import pytest

from civiclake.llm import decontaminate as D
from llm.odd import prose


def distance(item, words):
    """Least edits between the item and any stretch of the words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_finds_edited_items_and_nothing_else(spark):
    rnd = random.Random(2)
    items = [(i, prose(i, n)) for i, n in enumerate([1, 4, 9, 15, 30, 55, 30])]
    items.append((7, items[4][1]))  # equal items
    docs, want = [], set()
    for d in range(160):
        words = [f"v{rnd.randrange(3000)}" for _ in range(120)]
        if d % 2:
            item = rnd.choice(items[2:])
            part = item[1].split()
            for _ in range(rnd.randrange(int(len(part) * 0.2) + 1)):
                at = rnd.randrange(len(part))
                part[at:at + 1] = rnd.choice([[], ["Zz"], [part[at], "yy"]])
            words[40:40] = [p.upper() + "," for p in part]
        docs.append((d, " ".join(words)))
        for i, t in items:
            plain = [w.lower().strip(",") for w in words]
            if distance(t.split(), plain) <= int(0.2 * len(t.split())):
                want.add((d, i))
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["_id"], r["_item"]) for r in found.collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_blocks_of_items_give_the_same(spark):
    items = spark.createDataFrame([(i, prose(i, 20)) for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(500, 30) + " " + prose(i, 20)) for i in range(12)], "doc_id long, text string")
    whole = {tuple(r) for r in D.contaminated(docs, items).select("_id", "_item", "_edits").collect()}
    blocks = {tuple(r) for r in D.contaminated(docs, items, block_bytes=200).select("_id", "_item", "_edits").collect()}
    assert whole == blocks == {(i, i, 0) for i in range(12)}


@pytest.mark.parametrize("items", [[], [(1, None), (2, ""), (None, "?!")]])
def test_items_without_words(spark, odd, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert D.contaminated(odd, benchmark).count() == 0
    assert D.clean(odd, benchmark).count() == odd.count()


def test_odd_rows(spark, odd, none):
    benchmark = spark.createDataFrame([(1, prose(4, 70)), (None, prose(2, 90))], "item_id long, text string")
    assert sorted((r["_id"], str(r["_item"])) for r in D.contaminated(odd, benchmark).collect()) == [(4, "None"), (9, "1")]
    left = D.clean(odd, benchmark)
    assert left.columns == odd.columns and left.count() == odd.count() - 2
    assert D.clean(none, benchmark).count() == 0


def test_an_item_at_the_very_end_and_start():
    index = D.Index([prose(1, 30)])
    for text in (prose(1, 30), prose(7, 40) + " " + prose(1, 30), prose(1, 30) + " " + prose(8, 40)):
        w = D.item_words(pa.array(["other words", text, None]))
        assert [m[:2] + m[3:] for m in index.verify(w, index.candidates(w.hash))] == [(1, 0, 0, 30)]


@pytest.mark.parametrize("short", [5, 6, 7, 9, 10, 12, 13, 18, 20])
def test_fully_edited_short_items_among_long_ones(short):
    """Few short items beside many long ones: their copies must not be lost in the average."""
    index = D.Index([prose(10_000 + i, short) for i in range(5)] + [prose(i, 60) for i in range(100)])
    rng = np.random.default_rng(short)
    hit = 0
    for n in range(400):
        copy = index._edited(n % 5, rng)
        hit += n % 5 in index.candidates(copy)[:, 0]
    assert hit >= 0.99 * 400 and min(index.reached.values()) >= 0.999
