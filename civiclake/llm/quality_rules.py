"""Quality rules: a decision list learned from labelled documents and applied as one Spark conditional expression.

``with_statistics`` counts, for every whole text, what the rules may test. ``learn_decision_list`` is sequential covering:
a rule is grown condition by condition on one part of the labelled rows (FOIL gain over quantile thresholds), pruned
from its end on the other part, kept if it is precise enough there, and the rows it covers are set aside before the next
rule is grown. ``DecisionList.verdict`` gives the ordered rules as ``CASE WHEN ... THEN rule ... END``.

Defined results: a null text has no words and all counts 0. Rows are judged one by one, so ties and repeated rows keep
their own verdicts; the whole row passes through as one struct, so no column of the input meets a name used here. With no labels, or labels of one kind only, the list is empty and rejects nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclake.llm.words import Words, pieces, release_memory

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines",
          "n_upper", "n_digits", "n_punct", "n_bars", "n_chars", "max_word_bytes")
_COUNTS_TYPE = pa.struct([(c, pa.int64()) for c in COUNTS])
#: What rules may test: name -> SQL over the counts.
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "longest_word": "max_word_bytes",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "bars_per_word": "n_bars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_chars, 1)",
    "digit_share": "n_digits / greatest(n_chars, 1)",
    "punct_per_word": "n_punct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.bool_)
    table[list(chars.encode())] = True
    return table


_SYMBOLS, _BARS = _class("#*$%&|<>"), _class("|")
_UPPER, _DIGITS = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_PUNCT = _class("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_LEAD = np.ones(256, np.bool_)
_LEAD[0x80:0xC0] = False  # bytes that continue a code point


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _duplicate_lines(text: str | None) -> tuple[int, int]:
    lines = (text or "").split("\n")
    worded = [x for x in lines if x.strip(" \t\n\r\x0b\x0c")]
    return len(worded) - len(set(worded)), len(worded)


def _count(column: pa.Array) -> dict[str, np.ndarray]:
    w = Words(column)
    lead = _LEAD[w.raw]
    spans = np.zeros(len(w.raw) + 1, np.int64)
    np.cumsum(lead, out=spans[1:])
    chars = spans[w.end] - spans[w.start]
    out = {"n_words": w.counts, "n_chars": _per_row(lead, w.offsets)}
    out["word_chars"] = np.add.reduceat(np.append(chars, 0), np.minimum(w.first[:-1], len(chars))) * (w.counts > 0)
    out["max_word_bytes"] = np.maximum.reduceat(np.append(w.end - w.start, 0), np.minimum(w.first[:-1], len(chars))) * (w.counts > 0)
    for name, table in (("n_symbols", _SYMBOLS), ("n_bars", _BARS), ("n_upper", _UPPER), ("n_digits", _DIGITS), ("n_punct", _PUNCT)):
        out[name] = _per_row(table[w.raw], w.offsets)
    key = np.sort((w.doc.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
    fresh = np.ones(len(key), np.bool_)
    fresh[1:] = key[1:] != key[:-1]
    out["n_distinct_words"] = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=w.n_docs)
    start, window = w.windows(3)
    window = window + w.doc[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ordered = np.sort(window)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    covered = np.zeros(len(w) + 2, np.bool_)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
        hit = start[twice[at] == window]
        for k in range(3):
            covered[hit + k] = True
    out["n_repeat_words"] = np.bincount(w.doc[covered[:len(w)]], minlength=w.n_docs)
    lines = [_duplicate_lines(x) for x in column.to_pylist()]
    out["n_dup_lines"] = np.array([x[0] for x in lines], np.int64)
    out["n_lines"] = np.array([x[1] for x in lines], np.int64)
    return out


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def statistics(text: pa.Array) -> pa.Array:
    """The counts of each text, worked out for a quarter of a million bytes at a time."""
    parts = []
    for a, b in pieces(text, 250_000):
        got = _count(text.slice(a, b - a))
        parts.append(pa.StructArray.from_arrays([pa.array(got[c].astype(np.int64)) for c in COUNTS], COUNTS))
    release_memory()
    return pa.concat_arrays(parts) if parts else pa.array([], _COUNTS_TYPE)


def with_statistics(docs: DataFrame, text: str = "text", name: str = "_stats") -> DataFrame:
    """``docs`` with the struct column ``name`` that holds ``COUNTS``."""
    return docs.withColumn(name, statistics(F.col(text)))


def feature(name: str, stats: str = "_stats") -> Column:
    sql = FEATURES[name]
    for c in sorted(COUNTS, key=len, reverse=True):
        sql = sql.replace(c, f"{stats}.{c}")
    return F.expr(sql).cast("double")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, stats: str) -> Column:
        value = feature(self.feature, stats)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects the row."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def fired(self, stats: str = "_stats") -> Column:
        """The number of the first rule that holds, from 1; null if none does."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            holds = rule[0].column(stats)
            for condition in rule[1:]:
                holds = holds & condition.column(stats)
            out = F.when(holds, F.lit(i)) if out is None else out.when(holds, F.lit(i))
        return F.lit(None).cast("int") if out is None else out

    def verdict(self, stats: str = "_stats") -> Column:
        return self.fired(stats).isNull()

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, rule)) for rule in self.rules)


def _grow(x: np.ndarray, bad: np.ndarray, names: Sequence[str], most: int, quantiles: int) -> list[tuple[int, bool, float]]:
    """Conditions in the order found; each raises FOIL's gain most."""
    rule, alive = [], np.ones(len(bad), np.bool_)
    while len(rule) < most and (~bad & alive).any():
        p0, n0 = (bad & alive).sum(), (~bad & alive).sum()
        best = (1e-9, None)
        for f in range(len(names)):
            values = x[alive, f]
            seen = np.unique(values)
            below = np.searchsorted(seen, np.unique(np.quantile(values, np.linspace(0, 1, quantiles + 2)[1:-1], method="lower")))
            below = below[below + 1 < len(seen)]
            if not len(below):
                continue
            cuts = (seen[below] + seen[below + 1]) / 2  # midway, so that a gap between the kinds is shared
            order = np.sort(values[bad[alive]])
            other = np.sort(values[~bad[alive]])
            p = np.searchsorted(order, cuts, "right")
            n = np.searchsorted(other, cuts, "right")
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - np.log2(p0 / (p0 + n0))), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, above, float(cuts[k])))
        if best[1] is None:
            break
        f, above, cut = best[1]
        rule.append(best[1])
        alive &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return rule


def _covers(rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), np.bool_)
    for f, above, cut in rule:
        hit &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return hit


def learn_decision_list(x: np.ndarray, bad: np.ndarray, names: Sequence[str], *, max_rules: int = 12, max_conditions: int = 4,
                        quantiles: int = 200, min_precision: float = 0.9, min_covered: int = 10, seed: int = 7) -> DecisionList:
    """Sequential covering over at most ``max_rules`` rules.

    A third of the rows prunes: of a grown rule's leading parts the one with the best (p - n) / (p + n) there stays. A rule
    enters the list if it covers ``min_covered`` rows and its Laplace-corrected precision reaches ``min_precision`` on
    the pruning part and on all rows; the first that doesn't ends the search.
    """
    out = DecisionList()
    if len(bad) == 0 or bad.all() or not bad.any():
        return out
    prune = np.random.default_rng(seed).random(len(bad)) < 1 / 3
    left = np.ones(len(bad), np.bool_)
    while len(out.rules) < max_rules and (bad & left).any():
        g = left & ~prune
        if not (bad & g).any():
            break
        rule = _grow(x[g], bad[g], names, max_conditions, quantiles)
        if not rule:
            break
        held, held_bad = x[left & prune], bad[left & prune]

        def worth(part) -> float:
            hit = _covers(part, held)
            p, n = (hit & held_bad).sum(), (hit & ~held_bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda part: (worth(part), len(part)))
        hit, hit_held = _covers(rule, x) & left, _covers(rule, held)
        precise = lambda h, b: ((h & b).sum() + 1) / (h.sum() + 2)
        if hit.sum() < min_covered or precise(hit, bad) < min_precision or precise(hit_held, held_bad) < min_precision:
            break
        out.rules.append(tuple(Condition(names[f], above, cut) for f, above, cut in rule))
        left &= ~hit
    return out


def base_failed(stats: str = "_stats") -> Column:
    """The fixed rules that stand before the learned list: under 50 words, or over half of them in repeated 3-word windows."""
    return (F.col(f"{stats}.n_words") < 50) | (100 * F.col(f"{stats}.n_repeat_words") > 50 * F.col(f"{stats}.n_words"))


def labelled_features(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "quality",
                      max_labelled: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and the low-quality flag (label 0) of labelled documents that pass the base rules.

    ``max_labelled`` bounds the rows a classifier is fitted on: of more labels, those with the smallest hashes of their
    ids are taken. It bounds what is broadcast and, once more after the join, what reaches the driver: an id may stand on many documents.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).select(id_col, F.col(label).alias("_label"))
    n = known.count()
    if n > max_labelled:
        share = int(max_labelled / n * 1_000_000)
        known = known.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < share)
    known = known.orderBy(F.xxhash64(id_col), id_col, "_label").limit(max_labelled)
    joined = docs.select(id_col, text).join(F.broadcast(known), id_col)
    m = joined.count()
    if m > max_labelled:
        share = int(max_labelled / m * 1_000_000)
        joined = joined.where(F.pmod(F.xxhash64(id_col, text, "_label"), F.lit(1_000_000)) < share).limit(max_labelled)
    rows = with_statistics(joined, text)
    rows = rows.where(~base_failed()).select(F.col("_label").alias("label"), *[feature(f).alias(f) for f in FEATURES])
    got = rows.toPandas()
    # The same rows in another order must give the same list.
    got = got.sort_values(list(got.columns), ignore_index=True)
    return got[list(FEATURES)].to_numpy(np.float64), (got["label"].to_numpy() == 0)


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> tuple[DataFrame, DecisionList]:
    """``_row`` (the document), ``_stats``, ``_base_failed``, ``_rule`` (the learned rule that rejects, or null) and ``_kept``; and the list."""
    x, bad = labelled_features(docs, labels, id_col=id_col, text=text, **options)
    rules = learn_decision_list(x, bad, list(FEATURES))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), docs[text].alias("_text"))
    out = with_statistics(rows, "_text").withColumn("_base_failed", base_failed()).withColumn("_rule", rules.fired())
    return out.withColumn("_kept", ~F.col("_base_failed") & F.col("_rule").isNull()).drop("_text"), rules
