"""What is compared and on which levels; exact copies are folded into profiles first."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclake.functions import similarity

ID, COPIES = "profile_id", "copies"
KINDS = ("date", "levenshtein", "jaro_winkler", "exact")  # from most to least selective


@dataclass(frozen=True)
class Comparison:
    """One column's comparison.

    ``kind`` is ``jaro_winkler`` (thresholds fall), ``levenshtein`` (thresholds rise),
    ``date`` (largest distance in days, rising) or ``exact``. Levels count up from 0
    (no agreement) to ``top`` (equal); a NULL on either side is level -1. Of a ``digest`` only equality means
    anything: unequal ones are on level 0 however they are spelt.
    """

    column: str
    kind: str
    thresholds: tuple[float, ...] = ()
    term_frequency: bool = False
    digest: bool = False

    @property
    def top(self) -> int:
        return len(self.thresholds) + 1

    def level(self, left: Column, right: Column) -> Column:
        agree = F.when(left.isNull() | right.isNull(), -1).when(left == right, self.top)
        if self.thresholds and not self.digest:
            if self.kind == "jaro_winkler":
                near = similarity.jaro_winkler(left, right)
                reached = [near >= t for t in self.thresholds]
            elif self.kind == "levenshtein":
                far = F.levenshtein(left, right, int(self.thresholds[-1]))
                reached = [(far >= 0) & (far <= int(t)) for t in self.thresholds]
            else:
                far = F.abs(F.datediff(left, right))
                reached = [far <= int(t) for t in self.thresholds]
            for step, condition in enumerate(reached):
                agree = agree.when(condition, self.top - 1 - step)
        return agree.otherwise(0)

    def tokens(self, lengths: list[int], level: int = 1) -> Column:
        """Array of strings; two values on ``level`` or above always share an element."""
        if level >= self.top or self.digest:
            return F.when(F.col(self.column).isNotNull(), F.array(F.col(self.column).cast("string")))
        limit = self.thresholds[self.top - 1 - level]
        if self.kind == "jaro_winkler":
            return similarity.jaro_winkler_tokens(self.column, limit, lengths)
        if self.kind == "levenshtein":
            return similarity.edit_tokens(self.column, int(limit))
        return similarity.day_tokens(self.column, int(limit))


@dataclass(frozen=True)
class Linkage:
    """Comparisons plus the blocking rules that propose pairs."""

    comparisons: tuple[Comparison, ...]
    rules: tuple[tuple[str, ...], ...]

    @property
    def columns(self) -> list[str]:
        return [c.column for c in self.comparisons]

    def outside(self, rule: Sequence[str]) -> list[Comparison]:
        """Comparisons a rule leaves open (the rule's own columns agree by construction)."""
        return [c for c in self.comparisons if c.column not in rule]


def profiles(records: DataFrame, linkage: Linkage, id_col: str) -> DataFrame:
    """One row per distinct combination of compared values, with the number of records behind it.

    Records with equal values get equal levels against everything, so pairs are formed
    between profiles only: a third of all rows being copies of one record costs one row.
    Term frequencies (share of records with the value) are attached per profile.
    """
    distinct = records.groupBy(*linkage.columns).agg(F.min(id_col).alias(ID), F.count(F.lit(1)).alias(COPIES))
    total = records.agg(F.count(F.lit(1))).scalar()
    for c in linkage.comparisons:
        if c.term_frequency:
            # Counted on the records: one column of them is read, and a row per value is sent.
            uses = records.where(F.col(c.column).isNotNull()).groupBy(c.column).agg((F.count(F.lit(1)) / total).alias(f"tf_{c.column}"))
            distinct = distinct.join(uses, c.column, "left")
    frequencies = [f"tf_{c.column}" for c in linkage.comparisons if c.term_frequency]
    return distinct.select(ID, COPIES, *linkage.columns, *frequencies)
