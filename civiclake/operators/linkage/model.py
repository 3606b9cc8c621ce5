"""Match and non-match probabilities per level: counted u, EM for m, and match weights as Columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civiclake.operators.linkage.compare import COPIES, Comparison, Linkage
from civiclake.operators.linkage.pairs import LONG, near_texts, pattern_counts, value_lengths
from civiclake.operators.linkage.values import EXACT, date_distances, edit_distances
from civiclake.operators.skew import pairs_within
from civiclake.session import materialise

FLOOR = 1e-6  # keeps an unseen level from deciding a pair on its own


@dataclass(frozen=True)
class Model:
    """``m`` and ``u`` hold one probability per level 0..top and column; ``prior`` is the match rate of random pairs."""

    prior: float
    m: Mapping[str, Sequence[float]]
    u: Mapping[str, Sequence[float]]

    def bits(self, column: str, level: int) -> float:
        return 0.0 if level < 0 else math.log2(self.m[column][level] / self.u[column][level])

    @property
    def prior_bits(self) -> float:
        return math.log2(self.prior / (1 - self.prior))

    def level_bits(self, c: Comparison) -> Column:
        """Evidence of a pair's level, with rare shared values counting for more."""
        gamma = F.col(f"gamma_{c.column}")
        weights = F.lit(0.0)
        for level in range(c.top + 1):
            weights = F.when(gamma == level, self.bits(c.column, level)).otherwise(weights)
        if not c.term_frequency:
            return weights
        return weights + F.when(gamma == c.top, self.rarity(c, f"tf_{c.column}_l")).otherwise(0.0)

    def weight(self, linkage: Linkage) -> Column:
        total = F.lit(self.prior_bits)
        for c in linkage.comparisons:
            total = total + self.level_bits(c)
        return total

    def most_bits(self, linkage: Linkage, disagreeing: Sequence[str], held: tuple[str, int] | None = None) -> Column:
        """Most weight any pair with this row can reach.

        The ``disagreeing`` columns are taken to be on level 0 or missing, the ``held``
        column on the given level.
        """
        total = F.lit(self.prior_bits)
        for c in linkage.comparisons:
            if c.column in disagreeing:
                total = total + max(0.0, self.bits(c.column, 0))
                continue
            top = F.lit(self.bits(c.column, c.top))
            if c.term_frequency:
                top = top + F.coalesce(self.rarity(c, f"tf_{c.column}"), F.lit(0.0))
            if held is not None and held[0] == c.column:
                total = total + (top if held[1] == c.top else F.lit(self.bits(*held)))
            else:
                total = total + F.greatest(top, F.lit(self.best_below_top(c)))
        return total

    def rarity(self, c: Comparison, frequency: str) -> Column:
        """Extra weight of sharing a value of the given frequency."""
        return F.log2(F.lit(float(self.u[c.column][c.top])) / F.col(frequency))

    def best_below_top(self, c: Comparison) -> float:
        return max(0.0, *[self.bits(c.column, level) for level in range(c.top)])

    def pair_bound(self, linkage: Linkage, unseen: Sequence[str] = ("jaro_winkler",)) -> Column:
        """Most weight of a pair whose values of the ``unseen`` kinds are only known to be equal or not, while the other levels are known."""
        total = F.lit(self.prior_bits)
        for c in linkage.comparisons:
            if c.kind not in unseen:
                total = total + self.level_bits(c)
                continue
            left, right = F.col(f"{c.column}_l"), F.col(f"{c.column}_r")
            top = F.lit(self.bits(c.column, c.top))
            if c.term_frequency:
                top = top + self.rarity(c, f"tf_{c.column}_l")
            total = total + F.when(left == right, top).otherwise(self.best_below_top(c))
        return total

    def pair_least(self, linkage: Linkage) -> Column:
        """Least weight of a pair of which it is only known where the values are equal or missing."""
        total = F.lit(self.prior_bits)
        for c in linkage.comparisons:
            left, right = F.col(f"{c.column}_l"), F.col(f"{c.column}_r")
            top = F.lit(self.bits(c.column, c.top))
            if c.term_frequency:
                top = top + self.rarity(c, f"tf_{c.column}_l")
            below_top = min(self.bits(c.column, level) for level in range(c.top))
            total = total + F.when(left.isNull() | right.isNull(), 0.0).when(left == right, top).otherwise(below_top)
        return total


def probability(weight: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(2.0), -weight))


def threshold_bits(p: float) -> float:
    return math.log2(p / (1 - p))


def level_counts(records: DataFrame, linkage: Linkage) -> DataFrame:
    """``(column, level, pairs, share)`` over all pairs of records with both values present, counted exactly.

    Columns are counted on their own, by value: equal pairs from the number of records per value, near dates and short edit
    distances by ``values``, similar spellings by joining distinct values on tokens that similar values share, and the rest by
    subtraction. ``records`` may be profiles with their number of copies.
    """
    copies = F.sum(COPIES) if COPIES in records.columns else F.count(F.lit(1))
    cells = F.array(*[F.struct(F.lit(i).alias("which"), F.col(c.column).cast("string").alias("value")) for i, c in enumerate(linkage.comparisons)])
    kept = [COPIES] if COPIES in records.columns else []
    counted = records.select(*kept, F.inline(cells)).where("value is not null").groupBy("which", "value").agg(copies.cast("decimal(19,0)").alias("n"))
    everything = materialise(counted, "values")
    types = dict(records.dtypes)
    parts = []
    for i, c in enumerate(linkage.comparisons):
        values = everything.where(F.col("which") == i).select(F.col("value").cast(types[c.column]).alias(c.column), "n")
        n, all_ = F.col("n"), F.sum("n").cast("decimal(19,0)")
        whole = values.agg((all_ * (all_ - 1) / 2).cast(EXACT).alias("all_pairs"), F.sum((n * (n - 1) / 2).cast(EXACT)).cast(EXACT).alias("same"))
        top = whole.select(F.lit(c.top).alias("level"), F.col("same").alias("pairs"))
        near = _near_levels(values, c)
        some = top if near is None else top.unionByName(near)
        # Every pair on another level is one less on level 0.
        less = some.select(F.inline(F.array(F.struct("level", "pairs"), F.struct(F.lit(0).alias("level"), (-F.col("pairs")).cast(EXACT).alias("pairs")))))
        levels = less.unionByName(whole.select(F.lit(0).alias("level"), F.col("all_pairs").alias("pairs")))
        parts.append(levels.select(F.lit(c.column).alias("column"), "level", "pairs"))
    summed = reduce(DataFrame.unionByName, parts).groupBy("column", "level").agg(F.sum("pairs").cast(EXACT).alias("pairs")).where("pairs > 0")
    share = F.col("pairs").cast("double") / F.sum("pairs").over(Window.partitionBy("column")).cast("double")
    return summed.select("column", "level", F.col("pairs").cast("long").alias("pairs"), share.alias("share"))


def _near_levels(values: DataFrame, c: Comparison) -> DataFrame | None:
    """``(level, pairs)`` for pairs of different values that agree a little."""
    if not c.thresholds or c.digest:
        return None
    if c.kind == "date":
        return date_distances(values, c.column, [int(t) for t in c.thresholds]).select((c.top - 1 - F.col("step")).alias("level"), "pairs")
    if c.kind == "levenshtein" and c.thresholds[-1] <= 2:
        step = F.coalesce(*[F.when(F.col("distance") <= int(t), F.lit(i)) for i, t in enumerate(c.thresholds)])
        return edit_distances(values, c.column, int(c.thresholds[-1])).select((c.top - 1 - step).alias("level"), "pairs")
    lengths = value_lengths(values, [c])
    if c.kind == "jaro_winkler" and max(lengths, default=0) > LONG:  # no token tells long texts apart
        near = near_texts(values, [], c.column, c.thresholds[-1])
        counts = [values.select(F.col(c.column).alias(f"{c.column}_{side}"), F.col("n").alias(f"n_{side}")) for side in "lr"]
        pairs = near.join(counts[0], f"{c.column}_l").join(counts[1], f"{c.column}_r")
    else:
        marked = values.withColumn("_token", F.explode(c.tokens(lengths, 1)))
        pairs = pairs_within(marked, ["_token"], c.column, ["n"], drop=["_token"]).distinct()
    level = c.level(F.col(f"{c.column}_l"), F.col(f"{c.column}_r"))
    return pairs.withColumn("level", level).where(F.col("level").between(1, c.top - 1)).groupBy("level").agg(
        F.sum((F.col("n_l") * F.col("n_r")).cast(EXACT)).cast(EXACT).alias("pairs"))


def estimate_u(records: DataFrame, linkage: Linkage) -> dict[str, list[float]]:
    """Level probabilities among all pairs of records. Reads back one number per column and level; ``FLOOR`` stands for a level
    that no pair is on, so that it can't decide a pair on its own."""
    u = {c.column: [FLOOR] * (c.top + 1) for c in linkage.comparisons}
    for row in level_counts(records, linkage).collect():  # at most sum of (levels) rows
        u[row["column"]][row["level"]] = max(FLOOR, row["share"])
    return u


def _em(patterns: list[tuple[tuple[int, ...], int]], free: list[Comparison], u: Mapping[str, Sequence[float]],
        rounds: int, tolerance: float) -> tuple[float, dict[str, list[float]], int]:
    """EM over pattern counts: match rate and m of the free columns, u held fixed."""
    # Start from "agreement is likely among matches": most mass on the top level.
    m = {c.column: [0.05 / c.top] * c.top + [0.95] for c in free}
    rate, total = 0.1, sum(n for _, n in patterns)
    for done in range(1, rounds + 1):
        weight = {c.column: [0.0] * (c.top + 1) for c in free}
        matched = 0.0
        for levels, n in patterns:
            yes, no = rate, 1 - rate
            for c, level in zip(free, levels):
                if level >= 0:
                    yes *= m[c.column][level]
                    no *= u[c.column][level]
            share = n * yes / (yes + no)
            matched += share
            for c, level in zip(free, levels):
                if level >= 0:
                    weight[c.column][level] += share
        new = {k: [max(FLOOR, w / (sum(ws) or 1.0)) for w in ws] for k, ws in weight.items()}
        new_rate = min(max(matched / total, FLOOR), 1 - FLOOR)
        moved = max([abs(new_rate - rate), *[abs(a - b) for k in m for a, b in zip(m[k], new[k])]])
        m, rate = new, new_rate
        if moved < tolerance:
            break
    return rate, m, done


def estimate_m(found: DataFrame, linkage: Linkage, u: Mapping[str, Sequence[float]], training: Sequence[Sequence[str]],
               rounds: int = 20, tolerance: float = 1e-4, known: Mapping[str, DataFrame] | None = None) -> Model:
    """One EM run per training block; a column's m is the mean over the runs that leave it open.

    Spark reduces each block to its table of pattern counts, at most the product of the
    level numbers however large the data; only that table is iterated on.
    """
    estimates: dict[str, list[list[float]]] = {c.column: [] for c in linkage.comparisons}
    rates = []
    for rule in training:
        free = linkage.outside(rule)
        names = [f"gamma_{c.column}" for c in free]
        counts = [(tuple(r[x] for x in names), int(r["n"])) for r in pattern_counts(found, linkage, rule, known=known).collect()]
        if not counts:
            continue
        rate, m, _ = _em(counts, free, u, rounds, tolerance)
        rates.append((rule, rate))
        for column, values in m.items():
            estimates[column].append(values)
    m = {}
    for c in linkage.comparisons:
        runs = estimates[c.column] or [[0.05 / c.top] * c.top + [0.95]]
        m[c.column] = [sum(v) / len(runs) for v in zip(*runs)]
    priors = []
    for rule, rate in rates:
        # A block's match rate is the prior raised by the agreement on its columns.
        odds = rate / (1 - rate)
        for c in linkage.comparisons:
            if c.column in rule:
                odds /= m[c.column][c.top] / u[c.column][c.top]
        priors.append(odds / (1 + odds))
    prior = sum(priors) / len(priors) if priors else 1e-4
    return Model(min(max(prior, 1e-9), 0.5), m, dict(u))
