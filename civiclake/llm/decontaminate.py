"""Benchmark decontamination: CGK embedding, bit-sampling LSH over all windows, exact word edit distance.

Words are runs of letters and digits, lower-cased. The random walk of Chakraborty, Goldenberg and Koucky ("Streaming
algorithms for embedding and computing edit distance in the low distance regime", 2016) writes the word under a
pointer at each step and moves the pointer on by a random bit of (step, word); texts a few edits apart
fall into step again, so edit distance turns into Hamming distance. A repetition samples three of the steps; the words
written there are the key. Each item gives keys at several block starts; each position of a document starts a window. A
window is walked only as far as its key so far is the beginning of some item's key, which gives the same
candidates as walking all of it. How many repetitions reach the recall asked for is measured on fully edited copies of the items, for each
length of walk on its own and there for its shortest items apart from the others; if none suffices, a warning gives the recall reached.

A candidate puts the item-sized window in place; Sellers' dynamic programme then finds the exact word edit distance between
the item and the best stretch there. A match has at most ``max_edits`` edits per item word.

Items are taken in blocks of at most ``block_bytes``, so what a task holds is bounded however long the benchmark is. Defined
results: null or wordless items and texts match nothing; equal items are reported each; repeated rows each get their matches;
other columns pass through untouched.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclake.llm.words import ALNUM_GAPS, Words, mix, pieces, release_memory

_MATCH = T.ArrayType(T.StructType([T.StructField("item", T.IntegerType()), T.StructField("first_word", T.IntegerType()),
                                   T.StructField("edits", T.IntegerType()), T.StructField("item_words", T.IntegerType())]))
_MATCH_PA = pa.list_(pa.struct([("item", pa.int32()), ("first_word", pa.int32()), ("edits", pa.int32()), ("item_words", pa.int32())]))
#: Steps of a walk for items of at least so many words; the pointer moves on every other step on average, so each item has room for
#: walks from several starts and edits near one of them leave others whole.
_WALKS = ((18, 24), (9, 12), (4, 6), (1, 2))


def item_words(column: pa.Array) -> Words:
    return Words(pc.utf8_lower(column), gaps=ALNUM_GAPS)


@dataclass
class Repetition:
    steps: tuple[int, ...]
    factors: np.ndarray

    def follow(self, h: np.ndarray, at: np.ndarray, levels=None):
        """Walks from the positions ``at``; yields (level, survivors, pointers, keys). ``levels`` prune after each sampled step."""
        pointer, key, alive, step = at.copy(), np.zeros(len(at), np.uint64), np.arange(len(at)), 0
        for level, stop in enumerate(self.steps):
            for j in range(step, stop):
                pointer += ((h[pointer] * self.factors[j]) >> np.uint64(63)).astype(np.int64)
                np.minimum(pointer, len(h) - 1, out=pointer)
            step = stop
            key = (key ^ h[pointer]) * np.uint64(0x9FB21C651E98DF25)
            if levels is not None:
                bits, keys = levels[level]
                ok = np.flatnonzero(bits[key >> np.uint64(48)])
                ok = ok[keys[np.minimum(np.searchsorted(keys, key[ok]), len(keys) - 1)] == key[ok]]
                pointer, key, alive = pointer[ok], key[ok], alive[ok]
            yield level, alive, pointer, key


def _repetition(walk: int, seed: int) -> Repetition:
    rng = np.random.default_rng(seed)
    cuts = (0, max(1, walk // 6), max(1, walk // 2), walk)
    steps = tuple(int(rng.integers(min(a, walk - 1), max(b, min(a, walk - 1) + 1))) for a, b in zip(cuts, cuts[1:]))
    return Repetition(steps, rng.integers(0, 1 << 63, walk, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def _starts(n: int, walk: int) -> list[int]:
    """Block starts in an item of n words: the first, the last that leaves room for half a walk, and some between."""
    room = max(0, n - walk // 2)
    return sorted({round(room * k / max(1, min(4, room))) for k in range(min(4, room) + 1)})


class Index:
    """Keys of all items; ``repetitions`` by walk, or one number for all."""

    def __init__(self, texts: list[str], max_edits: float = 0.2, repetitions: int | None = None, recall: float = 0.999, seed: int = 11):
        w = item_words(pa.array(texts, pa.string()))
        self.words = [w.hash[w.first[i]:w.first[i + 1]] for i in range(w.n_docs)]
        self.edits = [int(len(x) * max_edits) for x in self.words]
        self.seed = seed
        self.reached: dict[int, float] = {}
        self.repetitions, self.tables = {}, []
        for k, (least, _) in enumerate(_WALKS):
            most = _WALKS[k - 1][0] if k else 1 << 60
            items = [i for i, x in enumerate(self.words) if least <= len(x) < most]
            if items:
                self.repetitions[k] = repetitions or self._needed(k, items, recall)
                self.tables += [t for t in self._build(k, items, self.repetitions[k]) if t is not None]

    def _build(self, k: int, items: list[int], repetitions: int) -> list:
        """A table for each repetition of one walk; None where no walk stays inside its item."""
        h = np.concatenate([*self.words, np.zeros(1, np.uint64)])
        first = np.concatenate(([0], np.cumsum([len(x) for x in self.words])))
        walk = _WALKS[k][1]
        place = [(i, o) for i in items for o in _starts(len(self.words[i]), walk)]
        item, offset = np.array([p[0] for p in place]), np.array([p[1] for p in place])
        end = first[item + 1]
        out: list = []
        for r in range(repetitions):
            rep = _repetition(walk, self.seed + 1000 * k + r)
            levels = []
            for _, _, pointer, key in rep.follow(h, first[item] + offset):
                levels.append(key)
            inside = pointer < end  # a walk that left its item says nothing about it
            full, who, where = levels[-1][inside], item[inside], offset[inside]
            order = np.argsort(full, kind="stable")
            prune = []
            for key in levels:
                keys = np.unique(key[inside])
                bits = np.zeros(1 << 16, np.bool_)
                bits[keys >> np.uint64(48)] = True
                prune.append((bits, keys))
            out.append((rep, prune, full[order], who[order], where[order]) if len(full) else None)
        return out

    def _edited(self, i: int, rng: np.random.Generator) -> np.ndarray:
        """A copy of an item with as many edits as a match may have, between other words."""
        x = list(self.words[i])
        for _ in range(self.edits[i]):
            at, kind = int(rng.integers(len(x) + 1)), rng.integers(3)
            fresh = mix(rng.integers(0, 1 << 63, 1, dtype=np.uint64))[0]
            if kind == 0 or not x:
                x.insert(at, fresh)
            elif kind == 1:
                x[min(at, len(x) - 1)] = fresh
            else:
                x.pop(min(at, len(x) - 1))
        return np.array([*mix(rng.integers(0, 1 << 63, 3, dtype=np.uint64)), *x, *mix(rng.integers(0, 1 << 63, 30, dtype=np.uint64))], np.uint64)

    def _needed(self, k: int, items: list[int], recall: float, copies: int = 1000, most: int = 40) -> int:
        """The fewest repetitions of a walk that find ``recall`` of fully edited copies, of its shortest items and of the others."""
        rng = np.random.default_rng(self.seed + k)
        short = [i for i in items if len(self.words[i]) < 1.5 * _WALKS[k][0]]
        groups = [g for g in (short, sorted(set(items) - set(short))) if g]
        truth = [int(rng.choice(g)) for g in groups for _ in range(copies)]
        edited = [self._edited(i, rng) for i in truth]
        h, first = np.concatenate(edited), np.concatenate(([0], np.cumsum([len(x) for x in edited])))
        owner = np.repeat(np.arange(len(truth)), np.diff(first))
        wanted = np.array(truth)
        found = np.zeros(len(truth), np.bool_)
        for n, table in enumerate(self._build(k, items, most), 1):
            if table is not None:
                position, item, _ = self._lookup(table, h)
                found[owner[position[wanted[owner[position]] == item]]] = True
            self.reached[k] = float(found.reshape(len(groups), copies).mean(1).min())
            if self.reached[k] >= recall:
                return n
        warnings.warn(f"decontamination: {most} repetitions find {self.reached[k]:.4f} of edited copies of items of {_WALKS[k][0]} words and more, {recall} were asked for", stacklevel=3)
        return most

    @staticmethod
    def _lookup(table, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rep, prune, full, who, where = table
        for _, alive, _, key in rep.follow(h, np.arange(len(h)), prune):
            pass
        a, b = np.searchsorted(full, key, "left"), np.searchsorted(full, key, "right")
        n = b - a
        entry = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(alive, n), who[entry], where[entry]

    def candidates(self, h: np.ndarray) -> np.ndarray:
        """Distinct (item, first word of the window) over all repetitions."""
        if not len(h) or not self.tables:
            return np.zeros((0, 2), np.int64)
        found = []
        for table in self.tables:
            position, item, offset = self._lookup(table, h)
            found.append(np.stack([item, position - offset], 1))
        return np.unique(np.concatenate(found), axis=0)

    def verify(self, w: Words, found: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, edits, words) of candidates within the allowed edits, the best for each text and item."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for lo in range(0, len(found), 20_000):
            part = found[lo:lo + 20_000]
            item, start = part[:, 0], part[:, 1]
            doc = w.doc[np.clip(start, 0, len(w) - 1)]
            # A window may begin before its text does, if the item's first words are missing there.
            m = np.array([len(self.words[i]) for i in item])
            slack = np.array([self.edits[i] for i in item]) + 1
            middle = np.clip(start + m // 2, 0, len(w) - 1)
            for text in (doc, w.doc[middle]):
                self._edit_distance(w, item, start, m, slack, text, best)
        return [(d, i, s, e, len(self.words[i])) for (d, i), (e, s) in best.items()]

    def _edit_distance(self, w, item, start, m, slack, doc, best) -> None:
        lo = np.maximum(w.first[doc], start - slack)
        hi = np.minimum(w.first[doc + 1], start + m + slack)
        width = int(max(1, (hi - lo).max()))
        at = lo[:, None] + np.arange(width)
        seen = np.where(at < hi[:, None], w.hash[np.minimum(at, len(w) - 1)], np.uint64(0))
        rows = int(m.max())
        pattern = np.zeros((len(item), rows), np.uint64)
        for i in np.unique(item):
            pattern[np.ix_(item == i, np.arange(len(self.words[i])))] = self.words[i]
        j = np.arange(width + 1, dtype=np.int32)
        row = np.zeros((len(item), width + 1), np.int32)
        allowed = np.array([self.edits[i] for i in item])
        for i in range(rows):
            new = row + 1
            np.minimum(new[:, 1:], row[:, :-1] + (seen != pattern[:, i:i + 1]), out=new[:, 1:])
            row = np.minimum.accumulate(new - j, axis=1) + j
            for c in np.flatnonzero(m == i + 1):
                e = int(row[c].min())
                if e <= allowed[c]:
                    key = (int(doc[c]), int(item[c]))
                    place = (e, int(max(start[c], w.first[doc[c]]) - w.first[doc[c]]))
                    if key not in best or place < best[key]:
                        best[key] = place


def matcher(index: Index):
    """A column function: text -> its matches, as positions in the list of items."""

    @F.arrow_udf(_MATCH)
    def find(text: pa.Array) -> pa.Array:
        out = []
        for lo, hi in pieces(text):
            w = item_words(text.slice(lo, hi - lo))
            rows: list[list[dict]] = [[] for _ in range(hi - lo)]
            if len(w):
                for d, i, s, e, n in sorted(index.verify(w, index.candidates(w.hash))):
                    rows[d].append({"item": i, "first_word": s, "edits": e, "item_words": n})
            out.append(pa.array(rows, _MATCH_PA))
        release_memory()
        return pa.concat_arrays(out) if out else pa.array([], _MATCH_PA)

    return find


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    """Lists of (id, text) of items with words, each of about ``block_bytes`` of text at most."""
    rows = benchmark.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("text", "id")
        yield [(r["id"], r["text"]) for r in part.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", max_edits: float = 0.2, recall: float = 0.999, block_bytes: int = 16_000_000) -> DataFrame:
    """A row for each document and item found in it: ``_id``, ``_item``, ``_first_word``, ``_edits``, ``_item_words``."""
    spark = docs.sparkSession
    out = None
    for block in item_blocks(benchmark, item_id, item_text, block_bytes):
        index = Index([t for _, t in block], max_edits, recall=recall)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)],
                                      T.StructType([T.StructField("item", T.IntegerType()), T.StructField("_item", benchmark.schema[item_id].dataType)]))
        hit = docs.select(F.col(id_col).alias("_id"), F.inline(matcher(index)(F.col(text))))
        hit = hit.join(names, "item").select("_id", "_item", F.col("first_word").alias("_first_word"), F.col("edits").alias("_edits"),
                                             F.col("item_words").alias("_item_words"))
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        kinds = (docs.schema[id_col].dataType, benchmark.schema[item_id].dataType, T.IntegerType(), T.IntegerType(), T.IntegerType())
        names = ("_id", "_item", "_first_word", "_edits", "_item_words")
        out = spark.createDataFrame([], T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          max_edits: float = 0.2, recall: float = 0.999, block_bytes: int = 16_000_000) -> DataFrame:
    """The rows of ``docs`` in which no item is found; decided row by row, without a join."""
    keep: Column = F.lit(True)
    for block in item_blocks(benchmark, item_id, item_text, block_bytes):
        keep = keep & (F.size(matcher(Index([t for _, t in block], max_edits, recall=recall))(F.col(text))) == 0)
    return docs.where(keep)
