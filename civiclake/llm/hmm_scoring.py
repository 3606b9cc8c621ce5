"""LM scoring with a hidden Markov model over words, trained by Baum-Welch across partitions.

Every training word is counted (one shuffle of partial counts). The most frequent words are symbols of the model, all others share
one symbol per class, a class being a hash of a word's last three bytes; within a class a word has its share of the class's counts,
so the model is a distribution over all training words, one unknown word and the end of a text.

Texts are written once as sequences of symbols. Each pass of Baum-Welch runs the scaled forward and backward recursions over
the sequences that a task reads, many texts side by side, and adds the expected counts of all tasks. The first
passes take one of ``folds`` disjoint parts of the training texts each, which cover all of them once; the passes
after that take all of them. The forward recursion then gives the exact likelihood of each whole text.

Frequent words (at most ``frequent``, found by a threshold from a histogram of counts) travel with the tasks; all others are
joined with the counts by their hashes, so the vocabulary may be of any size.

Defined results: a null text is empty and has its end token only; a text's words are known if they stand in training texts; rows
with a null id are not trained on; repeated rows are scored each; with nothing to train on, all is unknown.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclake.llm.words import Words, mix, pieces
from civiclake.session import materialise, scratch_path

CLASSES = 2000


def word_classes(w: Words) -> np.ndarray:
    """A class for each word, from its last three bytes."""
    value = np.zeros(len(w), np.uint64)
    for k in (1, 2, 3):
        at = w.end - k
        value = value * np.uint64(257) + np.where(at >= w.start, w.raw[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(value) % np.uint64(CLASSES)).astype(np.int32)


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    h = np.concatenate([p[0] for p in parts])
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    c = np.concatenate([p[1] for p in parts])[order]
    n = np.concatenate([p[2] for p in parts])[order]
    return h[first], c[first], (np.add.reduceat(n, first) if len(first) else n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1]), pa.array(held[2])], ["hash", "class", "n"])

    held: list = []
    for batch in batches:
        text = batch.column(0)
        for lo, hi in pieces(text):
            w = Words(text.slice(lo, hi - lo), lower=True)
            if len(w):
                held.append(_merge([(w.hash, word_classes(w), np.ones(len(w), np.int64))]))
            if sum(len(x[0]) for x in held) > 2_000_000:
                held = [_merge(held)]
                if len(held[0][0]) > 1_000_000:
                    yield out(held[0])
                    held = []
    if held:
        yield out(_merge(held))


@dataclass(frozen=True)
class Vocabulary:
    """What tasks need of the vocabulary: frequent words by hash, their counts and symbols, and the mass of each class."""

    hashes: np.ndarray
    logs: np.ndarray  # log10(c + 0.1)
    symbols: np.ndarray
    class_logs: np.ndarray  # log10 of a class's mass
    shares: np.ndarray  # of each symbol in the base distribution, the unknown word last
    own: int  # symbols of single words; classes, end and unknown follow

    @property
    def end(self) -> int:
        return self.own + CLASSES

    @property
    def unknown(self) -> int:
        return self.own + CLASSES + 1


def bounded_threshold(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words have it or more: from a histogram, without sorting the words."""
    sizes = counts.groupBy(F.when(F.col("n") < 1024, F.col("n")).otherwise(F.pow(2.0, F.floor(F.log2("n") * 8) / 8).cast("long")).alias("n")).count()
    total, best = 0, None
    for n, c in sorted(((r[0], r[1]) for r in sizes.collect()), reverse=True):
        if total + c > most:
            break
        total, best = total + c, n
    return best if best is not None else 1 << 62


def vocabulary(counts: DataFrame, tokens: int, types: int, ends: int, frequent: int, own: int) -> Vocabulary:
    hot = counts.where(F.col("n") >= bounded_threshold(counts, frequent)).select("hash", "class", "n").toPandas()
    single = F.col("n") >= bounded_threshold(counts, own)
    hot = hot.sort_values(["n", "hash"], ascending=[False, True], ignore_index=True)
    mass = {r[0]: r[1] for r in counts.where(~single).groupBy("class").agg(F.sum(F.col("n") + F.lit(0.1))).collect()}
    n_own = counts.where(single).count()
    symbols = np.where(np.arange(len(hot)) < n_own, np.arange(len(hot)), n_own + hot["class"].to_numpy(np.int64)).astype(np.uint16)
    z = tokens + 0.1 * (types + 1)
    masses = np.array([mass.get(c, 0.0) for c in range(CLASSES)])
    shares = np.concatenate([hot["n"].to_numpy(np.float64)[:n_own] + 0.1, masses, [ends + 0.1 if ends else 0.1], [0.1]]) / z
    order = np.argsort(hot["hash"].to_numpy(np.int64).view(np.uint64))
    return Vocabulary(
        hot["hash"].to_numpy(np.int64).view(np.uint64)[order], np.log10(hot["n"].to_numpy(np.float64) + 0.1)[order], symbols[order],
        np.log10(np.maximum(masses, 1e-300)), shares / shares.sum(), n_own)


_ENCODED = T.StructType([
    T.StructField("symbols", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("n_frequent", T.LongType()),
    T.StructField("base_log", T.DoubleType()), T.StructField("inner_log", T.DoubleType()),
    T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("rare_at", T.ArrayType(T.IntegerType()))])

_ENCODED_PA = pa.struct([("symbols", pa.binary()), ("n_words", pa.int64()), ("n_frequent", pa.int64()), ("base_log", pa.float64()),
                         ("inner_log", pa.float64()), ("rare", pa.list_(pa.int64())), ("rare_at", pa.list_(pa.int32()))])


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.longdouble)))
    return (total[first[1:]] - total[first[:-1]]).astype(np.float64)


def _ragged(values: np.ndarray, first: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def symbol_writer(shared):
    """A column function: text -> its symbols, sums over its frequent words, and the hashes and places of the others."""

    @F.arrow_udf(_ENCODED)
    def encode(text: pa.Array) -> pa.Array:
        v: Vocabulary = shared.value
        parts = []
        for lo, hi in pieces(text):
            w = Words(text.slice(lo, hi - lo), lower=True)
            h, n = w.hash, len(w)
            at = np.minimum(np.searchsorted(v.hashes, h), max(0, len(v.hashes) - 1))
            known = v.hashes[at] == h if len(v.hashes) else np.zeros(n, np.bool_)
            classes = word_classes(w)
            symbols = v.own + classes
            logs = np.zeros(n)
            if len(v.hashes):
                symbols = np.where(known, v.symbols[at], symbols)
                logs = np.where(known, v.logs[at], 0.0)
            inner = np.where(known & (symbols >= v.own), logs - v.class_logs[classes], 0.0)
            # Each text's symbols with its end.
            place = np.arange(n) + w.doc
            line = np.full(n + w.n_docs, v.end, np.uint16)
            line[place] = symbols
            cut = (w.first + np.arange(w.n_docs + 1)) * 2
            raw = line.tobytes()
            rare = np.flatnonzero(~known)
            rare_first = np.searchsorted(rare, w.first)
            parts.append(pa.StructArray.from_arrays([
                pa.array([raw[a:b] for a, b in zip(cut, cut[1:])], pa.binary()), pa.array(w.counts.astype(np.int64)),
                pa.array(np.rint(_row_sums(known, w.first)).astype(np.int64)), pa.array(_row_sums(logs, w.first)), pa.array(_row_sums(inner, w.first)),
                _ragged(h[rare].view(np.int64), rare_first, pa.int64()),
                _ragged((rare - w.first[w.doc[rare]]).astype(np.int32), rare_first, pa.int32())], _ENCODED.names))
        return pa.concat_arrays(parts) if parts else pa.array([], _ENCODED_PA)

    return encode


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # K
    moves: np.ndarray  # K x K
    emits: np.ndarray  # symbols x K

    @staticmethod
    def first(shares: np.ndarray, states: int, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        emits = shares[:, None] * rng.gamma(2.0, size=(len(shares), states))
        moves = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return Model(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))

    @staticmethod
    def from_counts(start, moves, emits, shares: np.ndarray, prior: float = 200.0, part: float = 0.02) -> Model:
        """Expected counts with a prior: emissions lean on the base shares (``prior`` tokens and a ``part`` of all), so no symbol has
        probability 0. Training text has no unknown words; in every state they keep the chance the base gives them."""
        start, moves = start + 0.1, moves + 0.1
        emits = emits + (prior + part * emits.sum(0)) * shares[:, None]
        emits[-1] = 0
        emits *= (1 - shares[-1]) / emits.sum(0)
        emits[-1] = shares[-1]
        return Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emits)


class Side:
    """Sequences side by side: the tokens of all at one time stand together, longer sequences first."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.steps = int(lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-lengths, -np.arange(1, self.steps + 1), side="right")
        self.off = np.concatenate(([0], np.cumsum(self.active)))
        position = np.concatenate([np.arange(n) for n in lengths])
        self.symbols = np.empty(self.off[-1], np.int64)
        self.symbols[self.off[position] + np.repeat(np.arange(len(lengths)), lengths)] = np.concatenate([sequences[i] for i in self.order])
        self.n = len(sequences)

    def forward(self, m: Model, keep: bool = True):
        emitted = m.emits[self.symbols]
        likelihood = np.zeros(self.n)
        scales = np.empty(self.off[-1])
        alpha = emitted if keep else None
        before = None
        for t in range(self.steps):
            a, b = self.off[t], self.off[t + 1]
            now = (m.start if t == 0 else before[:b - a] @ m.moves) * emitted[a:b]
            scale = now.sum(1)
            now /= scale[:, None]
            scales[a:b] = scale
            if keep:
                alpha[a:b] = now  # the emission of this time is read no more
            before = now
        logs = np.log10(scales)
        for t in range(self.steps):
            likelihood[:self.active[t]] += logs[self.off[t]:self.off[t + 1]]
        out = np.empty(self.n)
        out[self.order] = likelihood
        return out, alpha, scales

    def expect(self, m: Model):
        """Expected counts of starts, moves and emissions, and the log10 likelihood."""
        likelihood, alpha, scales = self.forward(m)
        k = len(m.start)
        moves = np.zeros((k, k))
        after = None
        back = m.moves.T.copy()
        for t in range(self.steps - 1, -1, -1):
            a, b = self.off[t], self.off[t + 1]
            beta = np.ones((b - a, k))
            if after is not None:
                beta[:len(after)] = after @ back
                moves += alpha[a:a + len(after)].T @ after
            if t:
                after = m.emits[self.symbols[a:b]] * beta
                after /= scales[a:b][:, None]
            alpha[a:b] *= beta  # now the chance of each state
        emits = np.stack([np.bincount(self.symbols, alpha[:, s], len(m.emits)) for s in range(k)], 1)
        return alpha[:self.off[1]].sum(0) if self.steps else np.zeros(k), moves * m.moves, emits, likelihood


def _sides(sequences: list[np.ndarray], tokens: int) -> Iterator[tuple[Side, list[int]]]:
    """Sequences of like length together, about ``tokens`` at a time."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    held: list[int] = []
    size = 0
    for i in order:
        held.append(i)
        size += len(sequences[i])
        if size >= tokens:
            yield Side([sequences[j] for j in held]), held
            held, size = [], 0
    if held:
        yield Side([sequences[j] for j in held]), held


def expected_counts(encoded: DataFrame, shared, tokens: int = 300_000, buffer: int = 3_000_000) -> DataFrame:
    """One row per symbol, and rows -1 (starts) and -2 - i (moves from state i), summed over all tasks."""
    k = len(shared.value.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        start, moves, emits, like, seen = np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emits), 0.0, 0

        def work(sequences):
            nonlocal start, moves, emits, like, seen
            for side, _ in _sides(sequences, tokens):
                s, mv, e, ll = side.expect(m)
                start, moves, like, seen = start + s, moves + mv, like + ll.sum(), seen + len(side.symbols)
                emits += e

        held, size = [], 0
        for batch in batches:
            for x in batch.column(0):
                held.append(np.frombuffer(x.as_py(), np.uint16))
                size += len(held[-1])
                if size >= buffer:
                    work(held)
                    held, size = [], 0
        if held:
            work(held)
        if not seen:
            return
        rows = np.flatnonzero(emits.any(1))
        names = np.concatenate([rows, [-1], -2 - np.arange(k)])
        values = np.concatenate([emits[rows], start[None], moves])
        extra = np.zeros(len(names))
        extra[len(rows)] = like
        yield pa.RecordBatch.from_arrays([pa.array(names), *[pa.array(values[:, s]) for s in range(k)], pa.array(extra)],
                                         ["symbol", *[f"s{s}" for s in range(k)], "likelihood"])

    schema = "symbol long, " + ", ".join(f"s{s} double" for s in range(k)) + ", likelihood double"
    found = encoded.select("symbols").mapInArrow(run, schema)
    return found.groupBy("symbol").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)], F.sum("likelihood").alias("likelihood"))


def baum_welch_pass(encoded: DataFrame, model: Model, shares: np.ndarray) -> tuple[Model, float]:
    """One pass over all given sequences; the driver gets one row per symbol."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    got = expected_counts(encoded, shared).toPandas()
    k = len(model.start)
    values = got[[f"s{s}" for s in range(k)]].to_numpy(np.float64)
    names = got["symbol"].to_numpy(np.int64)
    emits, moves, start = np.zeros_like(model.emits), np.zeros((k, k)), np.zeros(k)
    emits[names[names >= 0]] = values[names >= 0]
    for name, row in zip(names, values):
        if name == -1:
            start = row
        elif name < -1:
            moves[-2 - name] = row
    return Model.from_counts(start, moves, emits, shares), float(got["likelihood"].sum())


def likelihoods(shared_model, unknown: int):
    """A column function: (symbols, places of unknown words) -> log10 likelihood of the whole sequence."""

    @F.arrow_udf(T.DoubleType())
    def score(symbols: pa.Array, places: pa.Array) -> pa.Array:
        m: Model = shared_model.value
        out = np.zeros(len(symbols))
        sequences = []
        for x, p in zip(symbols, places):
            s = np.frombuffer(x.as_py(), np.uint16)
            if p.is_valid and len(p):
                s = s.copy()
                s[p.values.to_numpy()] = unknown
            sequences.append(s)
        for side, who in _sides(sequences, 300_000):
            out[who] = side.forward(m, keep=False)[0]
        return pa.array(out)

    return score


def is_held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def hmm_scores(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", held_out: Column | None = None, states: int = 8,
               own_symbols: int = 12_000, frequent: int = 500_000, folds: int = 8, passes: int = 2, seed: int = 5) -> DataFrame:
    """A row for each document: ``_id``, ``_held_out``, ``_tokens``, ``_known``, ``_train_tokens``, ``_base`` and ``_score``, both log10.

    ``held_out`` marks the rows that are not learned from. Bounds: ``frequent`` words of 18 bytes and ``own_symbols`` + 2,002 symbols
    times ``states`` numbers travel to the tasks.
    """
    spark = docs.sparkSession
    out = is_held_out(F.col(id_col)) if held_out is None else held_out
    source = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), out.alias("_held_out"))
    partial = source.where(~F.col("_held_out")).select("_text").mapInArrow(_count, "hash long, class int, n long")
    counts = materialise(partial.groupBy("hash").agg(F.min("class").alias("class"), F.sum("n").alias("n")), "word-counts")
    types, words = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = source.where(~F.col("_held_out")).count()
    tokens, types = words + ends, types + (1 if ends else 0)
    v = vocabulary(counts, tokens, types, ends, frequent, own_symbols)
    z = math.log10(tokens + 0.1 * (types + 1))

    shared = spark.sparkContext.broadcast(v)
    fold = F.pmod(F.xxhash64("_id"), F.lit(folds)).cast("int")
    encoded = source.select("_id", "_held_out", symbol_writer(shared)(F.col("_text")).alias("e")).select(
        F.monotonically_increasing_id().alias("_row"), "_id", "_held_out", "e.*", F.when(F.col("_held_out"), -1).otherwise(fold).alias("_fold"))
    path = scratch_path(spark, "symbols")
    encoded.write.partitionBy("_fold").parquet(path)
    encoded = spark.read.schema(encoded.schema).parquet(path)

    model = Model.first(v.shares, states, seed)
    if ends:
        for k in range(folds):
            part = encoded.where(F.col("_fold") == k)
            model, _ = baum_welch_pass(part, model, v.shares)
        for _ in range(passes):
            model, _ = baum_welch_pass(encoded.where("_fold >= 0"), model, v.shares)

    # Words that are not frequent meet their counts; a word that is met nowhere is unknown.
    masses = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v.class_logs)], "class int, mass double")
    single = F.col("n") >= bounded_threshold(counts, own_symbols)
    worth = counts.join(masses, "class").select(
        F.col("hash").alias("_hash"), F.log10(F.col("n") + 0.1).alias("log"),
        F.when(single, F.lit(0.0)).otherwise(F.log10(F.col("n") + 0.1) - F.col("mass")).alias("inner"))
    rare = encoded.select("_row", F.explode(F.arrays_zip("rare", "rare_at")).alias("r")).select("_row", F.col("r.rare").alias("_hash"), F.col("r.rare_at").alias("at"))
    met = rare.join(worth, "_hash", "left").groupBy("_row").agg(
        F.count("log").alias("rare_known"), F.sum(F.coalesce("log", F.lit(-1.0))).alias("rare_log"), F.sum("inner").alias("rare_inner"),
        F.collect_list(F.when(F.col("log").isNull(), F.col("at"))).alias("unknown_at"))
    joined = encoded.drop("rare", "rare_at").join(met, "_row", "left")
    shared_model = spark.sparkContext.broadcast(model)
    empty = F.array().cast("array<int>")
    likelihood = likelihoods(shared_model, v.unknown)(F.col("symbols"), F.coalesce("unknown_at", empty))
    n_tokens = F.col("n_words") + 1
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    end_log = math.log10((ends or 0) + 0.1)
    return joined.select(
        "_id", "_held_out", n_tokens.alias("_tokens"),
        (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0)) + F.lit(1 if ends else 0)).alias("_known"),
        F.lit(tokens).cast("long").alias("_train_tokens"),
        (F.col("base_log") + zero("rare_log") + F.lit(end_log) - n_tokens * F.lit(z)).alias("_base"),
        (likelihood + F.col("inner_log") + zero("rare_inner")).alias("_score"))
