"""Language ID by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A text is its words, a word its runs of letters in lower case between boundaries; models predict each letter and the boundary after
the last from up to ``order - 1`` symbols before, not further back than the word's start. Lower orders count distinct left neighbours
(n-grams that begin a word count as they are), every order is discounted by n1 / (n1 + 2 n2) and interpolated with the
next lower one, the lowest with an even share of the alphabet. n-gram counts, continuation counts and context totals are Spark
aggregations; an n-gram's hash finds its log probability and the weight of its continuations in its language's sorted array.

The language with the lowest cross-entropy per symbol wins, equal ones by name. On texts that were not counted, a factor is
fitted that turns cross-entropies into probabilities (``score``), and each language's usual cross-entropy: a text far above it,
for its length, is not ``accepted``.

Bounds: a classifier is fitted here, on at most about ``max_train_docs`` labelled texts (of each language a share by the hash of their ids,
all of a rare one, and at least one text of every language, so their number is a bound too); of all n-grams at most ``max_ngrams`` a
language, by a count threshold, reach the driver and the tasks. Scoring reads whole texts. Defined results: a null text or one without
a letter is ``und`` with score 0 and not accepted, as is every text if no language was learned; rows with a null label or id and texts
without a letter aren't learned from; repeated rows get the same answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclake.llm.words import Words, mix, pieces
from civiclake.session import materialise

UNDETERMINED = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000))
    return _LETTERS[0][points]


@dataclass
class Symbols:
    """Letters and boundaries of many tokens: ``value`` (0 is a boundary), the ``token`` of each and its place ``since`` the last boundary."""

    value: np.ndarray
    token: np.ndarray
    since: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> Symbols:
        points = np.frombuffer((b" " + b" ".join(tokens) + b" ").decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        letter = _is_letter(points)
        token = np.cumsum(points == 32) - 1
        token[points == 32] -= 1  # a token's last boundary is its own
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] = True
        value = np.where(letter, points, 0)[keep].astype(np.uint64)
        at = np.arange(len(value))
        begin = np.maximum.accumulate(np.where(value == 0, at, 0))
        before = np.concatenate(([0], begin[:-1]))
        return Symbols(value, np.maximum(token[keep], 0), at - before)

    def hashes(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, raw hash of the n symbols up to each place, places where they reach back no further than a boundary)."""
        raw = np.zeros(len(self.value), np.uint64)
        factor = np.uint64(1)
        for n in range(1, order + 1):
            older = np.zeros(len(raw), np.uint64)
            older[n - 1:] = self.value[:len(raw) - n + 1] + np.uint64(1)
            raw = raw + older * factor
            with np.errstate(over="ignore"):
                factor = factor * _STEP
            yield n, raw, self.since >= n - 1


def _id(raw: np.ndarray, n: int) -> np.ndarray:
    return mix(raw ^ np.uint64(n * 0x51ED270B7A3F + 1))


def _ngrams(order: int):
    """Counts of all n-grams of the texts that a task reads, by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(parts):
            table = np.concatenate(parts, axis=1)
            ids, at, back = np.unique(table[0], return_index=True, return_inverse=True)
            out = table[:, at]
            out[5] = np.bincount(back, table[5].astype(np.float64)).astype(np.uint64)
            return out

        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = pc.utf8_lower(batch.column(1))
            for lang in sorted(set(langs)):
                own = texts.filter(pa.array([x == lang for x in langs]))
                for lo, hi in pieces(own):
                    w = Words(own.slice(lo, hi - lo))
                    _, at, count = np.unique(w.hash, return_index=True, return_counts=True)
                    if not len(at):
                        continue
                    s = Symbols.of([w.text(i) for i in at])
                    weight = count[s.token]
                    last = np.zeros(len(s.value), np.uint64)
                    for n, raw, ok in s.hashes(order):
                        ok = ok & (s.since > 0) if n > 1 else s.since > 0
                        i = np.flatnonzero(ok)
                        first_boundary = (s.since[i] == n - 1) & (n > 1)
                        context = _id(last[i - 1], n - 1) if n > 1 else np.zeros(len(i), np.uint64)
                        suffix = _id(last[i], n - 1) if n > 1 else np.zeros(len(i), np.uint64)
                        part = np.stack([_id(raw[i], n), np.full(len(i), n, np.uint64), context, suffix, first_boundary.astype(np.uint64),
                                         weight[i].astype(np.uint64)])
                        held.setdefault(lang, []).append(merged([part]))
                        last = raw
                    if sum(x.shape[1] for x in held[lang]) > 1_500_000:
                        held[lang] = [merged(held[lang])]
        for lang, parts in held.items():
            t = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * t.shape[1]), pa.array(t[0].view(np.int64)), pa.array(t[1].astype(np.int32)), pa.array(t[2].view(np.int64)),
                 pa.array(t[3].view(np.int64)), pa.array(t[4].astype(np.bool_)), pa.array(t[5].astype(np.int64))],
                ["lang", "id", "n", "context", "suffix", "begins", "c"])

    return run


@dataclass
class LanguageModel:
    """Sorted n-gram hashes with the log2 probability and the log2 weight of what follows them (nan: nothing does)."""

    ids: np.ndarray
    logs: np.ndarray
    backs: np.ndarray
    unseen: float

    def look_up(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        hit = self.ids[at] == ids
        return np.where(hit, self.logs[at], np.nan), np.where(hit, self.backs[at], np.nan)


@dataclass
class Identifier:
    languages: list[str]
    models: list[LanguageModel]
    order: int
    sharpness: float = 1.0
    usual: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  # mean cross-entropy and its spread at one symbol
    memo_size: int = 300_000

    def __post_init__(self):
        self.memo: dict[int, int] = {}
        self.rows = np.zeros((0, len(self.models) + 1), np.float32)

    def token_scores(self, tokens: list[bytes]) -> np.ndarray:
        """log2 probability of each token in each language, and its number of symbols."""
        s = Symbols.of(tokens)
        out = np.zeros((len(tokens), len(self.models) + 1))
        event = s.since > 0
        out[:, -1] = np.bincount(s.token[event], minlength=len(tokens))
        ids = [(n, _id(raw, n), ok) for n, raw, ok in s.hashes(self.order)]
        for k, model in enumerate(self.models):
            value, follow = np.full(len(s.value), model.unseen), None
            for n, h, ok in ids:
                logs, backs = model.look_up(h)
                if n > 1:
                    context = np.concatenate(([np.nan], follow[:-1]))
                    lower = value + np.where(np.isnan(context), 0.0, context)
                    value = np.where(ok, np.where(np.isnan(logs), lower, logs), value)
                    follow = np.where(ok, backs, np.nan)
                else:
                    value, follow = np.where(np.isnan(logs), model.unseen, logs), backs
            out[:, k] = np.bincount(s.token[event], value[event], len(tokens))
        return out

    def text_scores(self, column: pa.Array) -> np.ndarray:
        """Sums of ``token_scores`` for each text; tokens met before are remembered, up to ``memo_size``."""
        w = Words(pc.utf8_lower(column))
        unique, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        keys = unique.tolist()
        row = np.array([self.memo.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(row < 0)
        fresh = self.token_scores([w.text(at[i]) for i in new]).astype(np.float32) if len(new) else self.rows[:0]
        scores = np.empty((len(unique), len(self.models) + 1), np.float32)
        scores[row >= 0] = self.rows[row[row >= 0]]
        scores[new] = fresh
        room = self.memo_size - len(self.memo)
        if room > 0 and len(new):
            for j, i in enumerate(new[:room]):
                self.memo[keys[i]] = len(self.rows) + j
            self.rows = np.concatenate((self.rows, fresh[:room]))
        per = scores[back].astype(np.float64)
        total = np.concatenate((np.zeros((1, per.shape[1])), np.cumsum(per, axis=0)))
        return total[w.first[1:]] - total[w.first[:-1]]

    def decide(self, sums: np.ndarray) -> dict[str, np.ndarray]:
        n = np.rint(sums[:, -1])
        some = n > 0
        entropy = -sums[:, :-1] / np.maximum(n, 1)[:, None]
        if not self.models:
            none = np.zeros(len(n))
            return {"lang": np.full(len(n), UNDETERMINED, object), "score": none, "entropy": none, "accepted": none.astype(bool)}
        best = entropy.argmin(1)  # languages are sorted by name
        low = entropy[np.arange(len(n)), best]
        logits = -self.sharpness * (entropy - low[:, None])
        score = 1 / np.exp(logits).sum(1)
        lang = np.array([*self.languages, UNDETERMINED], object)[np.where(some, best, len(self.languages))]
        accepted = some
        if len(self.usual):
            mean, spread = self.usual[best, 0], self.usual[best, 1]
            accepted = some & ((low - mean) * np.sqrt(np.maximum(n, 1)) <= 6 * spread)
        return {"lang": lang, "score": np.where(some, score, 0.0), "entropy": np.where(some, low, 0.0), "accepted": accepted}


def kneser_ney(rows: pd.DataFrame, order: int) -> LanguageModel:
    """One language's model from its kept n-grams: ``id, n, context, suffix, a`` (adjusted count), ``total`` (of its context) and ``discount``."""
    rows = rows.sort_values("n", kind="stable")
    alphabet = int((rows["n"] == 1).sum()) + 1
    probability: dict[int, float] = {}
    weight: dict[int, float] = {}
    ids, logs = [], []
    lower = np.full(0, 0.0)
    known = np.zeros(0, np.int64)
    for n, part in rows.groupby("n", sort=True):
        gain = np.maximum(part["a"].to_numpy(float) - part["discount"].to_numpy(float), 0) / part["total"].to_numpy(float)
        context = part["context"].to_numpy(np.int64)
        unique, back = np.unique(context, return_inverse=True)
        rest = np.maximum(1 - np.bincount(back, gain), 1e-6)  # what pruning and discounts leave
        weight.update(zip(unique.tolist(), rest.tolist()))
        if n == 1:
            base = np.full(len(part), 1 / alphabet)
            unseen = math.log2(rest[0] / alphabet)
        else:
            suffix = part["suffix"].to_numpy(np.int64)
            at = np.minimum(np.searchsorted(known, suffix), len(known) - 1)
            base = np.where(known[at] == suffix, lower[at], 2.0**unseen)
        p = gain + rest[back] * base
        own = part["id"].to_numpy(np.int64)
        o = np.argsort(own)
        known, lower = own[o], p[o]
        ids.append(own)
        logs.append(np.log2(p))
    everything = np.concatenate(ids)
    back_weight = np.array([weight.get(i, np.nan) for i in everything.tolist()])
    key = everything.view(np.uint64)
    # The boundary is a context as well, though nothing predicts it at a word's start.
    o = np.argsort(key)
    return LanguageModel(key[o], np.concatenate(logs)[o], np.log2(back_weight)[o], unseen)


def train(labelled: DataFrame, *, order: int = 4, max_ngrams: int = 300_000) -> Identifier:
    """An identifier from ``lang, text`` rows."""
    raw = labelled.select("lang", "text").mapInArrow(
        _ngrams(order), "lang string, id long, n int, context long, suffix long, begins boolean, c long")
    raw = materialise(raw.groupBy("lang", "n", "id").agg(
        F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.first("begins").alias("begins"), F.sum("c").alias("c")), "ngrams")
    left = raw.groupBy("lang", (F.col("n") - 1).alias("n"), F.col("suffix").alias("id")).agg(F.count(F.lit(1)).alias("left"))
    adjusted = raw.join(left, ["lang", "n", "id"], "left").withColumn(
        "a", F.when((F.col("n") == order) | F.col("begins"), F.col("c")).otherwise(F.coalesce("left", F.lit(1))))
    adjusted = materialise(adjusted.select("lang", "n", "id", "context", "suffix", "a"), "adjusted")
    totals = adjusted.groupBy("lang", "n", "context").agg(F.sum("a").alias("total"))
    once = adjusted.groupBy("lang", "n").agg(F.sum((F.col("a") == 1).cast("long")).alias("n1"), F.sum((F.col("a") == 2).cast("long")).alias("n2"))
    discount = once.select("lang", "n", F.when(F.col("n1") + F.col("n2") > 0, F.greatest(
        F.lit(0.05), F.col("n1") / (F.col("n1") + 2 * F.col("n2")))).otherwise(0.5).alias("discount"))
    # A language with too many n-grams keeps those above a count; single symbols always stay.
    size = adjusted.groupBy("lang", F.floor(F.log2("a") * 4).alias("level")).count().collect()
    least: dict[str, int] = {}
    for lang in {r[0] for r in size}:
        held = 0
        for level, c in sorted(((r[1], r[2]) for r in size if r[0] == lang), reverse=True):
            if held + c > max_ngrams:
                break
            held += c
            least[lang] = level
    if not least:
        return Identifier([], [], order)
    cut = labelled.sparkSession.createDataFrame(sorted(least.items()), "lang string, least long")
    kept = adjusted.join(cut, "lang").where((F.floor(F.log2("a") * 4) >= F.col("least")) | (F.col("n") == 1))
    rows = kept.join(totals, ["lang", "n", "context"]).join(discount, ["lang", "n"]).select(
        "lang", "n", "id", "context", "suffix", "a", "total", "discount").toPandas()
    languages = sorted(rows["lang"].unique())
    return Identifier(languages, [kneser_ney(rows[rows["lang"] == x], order) for x in languages], order)


_RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()),
                        T.StructField("accepted", T.BooleanType()), T.StructField("symbols", T.LongType()),
                        T.StructField("entropies", T.ArrayType(T.DoubleType()))])


def predictor(shared):
    """A column function: text -> its language, ``shared`` being the broadcast of an identifier."""

    @F.arrow_udf(_RESULT)
    def predict(text: pa.Array) -> pa.Array:
        own: Identifier = shared.value
        parts = [own.text_scores(text.slice(lo, hi - lo)) for lo, hi in pieces(text)]
        sums = np.concatenate(parts) if parts else np.zeros((0, len(own.models) + 1))
        d = own.decide(sums)
        n = np.rint(sums[:, -1]).astype(np.int64)
        entropies = -sums[:, :-1] / np.maximum(n, 1)[:, None]
        return pa.StructArray.from_arrays(
            [pa.array(d["lang"], pa.string()), pa.array(d["score"]), pa.array(d["entropy"]), pa.array(d["accepted"]), pa.array(n),
             pa.array(list(entropies), pa.list_(pa.float64()))], _RESULT.names)

    return predict


def calibrate(own: Identifier, labelled: DataFrame) -> Identifier:
    """``own`` with sharpness and usual cross-entropies from texts it was not trained on (their number bounds what is collected)."""
    if not own.models:
        return own
    shared = labelled.sparkSession.sparkContext.broadcast(own)
    got = labelled.select("lang", predictor(shared)(F.col("text")).alias("p")).select("lang", "p.symbols", "p.entropies").where("symbols > 0").toPandas()
    got = got[got["lang"].isin(own.languages)]
    if not len(got):
        return own
    h = np.array(got["entropies"].tolist())
    truth = np.array([own.languages.index(x) for x in got["lang"]])
    n = got["symbols"].to_numpy(float)
    gap = h - h[np.arange(len(h)), truth][:, None]

    def loss(b: float) -> float:
        return float(np.logaddexp.reduce(-b * gap, axis=1).mean())

    grid = np.geomspace(0.5, 64, 60)
    sharpness = float(grid[int(np.argmin([loss(b) for b in grid]))])
    usual = []
    for k in range(len(own.languages)):
        own_h, own_n = h[truth == k, k], n[truth == k]
        mean = float(np.median(own_h)) if len(own_h) else float(np.median(h.min(1)))
        spread = float(np.sqrt(np.mean((own_h - mean) ** 2 * own_n))) if len(own_h) > 1 else 10.0
        usual.append((mean, max(spread, 0.1)))
    return Identifier(own.languages, own.models, own.order, sharpness, np.array(usual))


def shares(counts: dict[str, int], most: int) -> dict[str, float]:
    """The share of each language's texts to learn from: the same number of all, ``most`` together, and all texts of languages with fewer."""
    out, left = {}, float(most)
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: x[1])):
        taken = min(n, left / (len(counts) - k))
        out[lang], left = taken / n, left - taken
    return out


def drawn(known: DataFrame, most: int) -> DataFrame:
    """About ``most`` of ``lang, text, place, aside`` by their ``place`` (a hash), as in ``shares``. The first text of a language by its
    place is always among them, and not aside: no language is lost, however rare it is."""
    found = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).collect()  # a row a language
    if not found:
        return known.select("lang", "text", "aside")
    share = shares({r["lang"]: r["n"] for r in found}, most)
    last = {x: (1 << 63) - 1 if s >= 1 else -(1 << 63) + int(s * (1 << 64)) for x, s in share.items()}

    def by_lang(values: dict[str, int]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("lang")]

    first = F.col("place") == by_lang({r["lang"]: r["first"] for r in found})
    return known.where(first | (F.col("place") <= by_lang(last))).select("lang", "text", (F.col("aside") & ~first).alias("aside"))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", learn: Column | None = None, order: int = 4,
             max_train_docs: int = 50_000, max_ngrams: int = 300_000) -> DataFrame:
    """``_id``, ``_lang``, ``_score``, ``_entropy`` (bits a symbol) and ``_accepted`` for each document.

    ``learn`` marks the rows that may be learned from. Seven eighths of those taken train the models, an eighth calibrates.
    """
    spark = docs.sparkSession
    number = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(2)).cast("long")
    learn = (number % 4 != 2) if learn is None else learn
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(id_col).isNotNull() & F.col(text).rlike(r"\p{L}"))
    number = F.col(id_col).cast("string")
    known = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(number).alias("place"),
                         (F.pmod(F.xxhash64(number, F.lit(8)), F.lit(8)) == 0).alias("aside"))
    rows = drawn(known, max_train_docs)
    own = calibrate(train(rows.where("not aside"), order=order, max_ngrams=max_ngrams), rows.where("aside"))
    shared = spark.sparkContext.broadcast(own)
    return docs.select(F.col(id_col).alias("_id"), predictor(shared)(F.col(text)).alias("p")).select(
        "_id", F.col("p.lang").alias("_lang"), F.col("p.score").alias("_score"), F.col("p.entropy").alias("_entropy"), F.col("p.accepted").alias("_accepted"))
