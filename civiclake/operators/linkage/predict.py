"""Scored pairs, the review band and clusters of records."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civiclake.operators.components import connected_components, extend_components
from civiclake.operators.linkage.compare import ID, KINDS, Linkage
from civiclake.operators.linkage.model import Model, probability, threshold_bits
from civiclake.operators.linkage.pairs import DIRECT_BLOCK, SMALL_BLOCK, in_block, proposed_pairs, similar_pairs, with_levels
from civiclake.session import materialise


def predict(found: DataFrame, linkage: Linkage, model: Model, threshold: float, small: int | None = None,
            known: Mapping[str, DataFrame] | None = None, below: float | None = None) -> DataFrame:
    """Profile pairs whose match probability reaches ``threshold``, each once; if ``below`` is given, those under it only.

    In large blocks only pairs are formed that agree where they must to get there, see
    ``demanded``. Where the blocking values alone are rare enough to carry a pair over
    the threshold, all pairs of the block are. With ``known`` spellings, see ``known_spellings``,
    pairs are scored where they are formed. Pairs that equal values alone carry to ``below`` are left out before any level is found.
    """
    parts = [_block(found, linkage, model, rule, threshold, small, known) for rule in linkage.rules]
    if below is not None:
        open_ = model.pair_least(linkage) < threshold_bits(below) + 1e-9
        parts = [part.where(open_) for part in parts]
    scored = _scored(proposed_pairs(parts, linkage.rules, deal=known is None), linkage, model, threshold, known)
    return scored if below is None else scored.where(F.col("match_probability") < below)


def _block(rows: DataFrame, linkage: Linkage, model: Model, rule: tuple[str, ...], threshold: float, small: int | None,
           known: Mapping[str, DataFrame] | None) -> DataFrame:
    """A rule's pairs, complete for those that reach ``threshold``."""
    enough = threshold_bits(threshold) - 1e-9
    alone = model.most_bits(linkage, [c.column for c in linkage.outside(rule)]) >= enough
    direct = small or (SMALL_BLOCK if known is None else DIRECT_BLOCK)
    return similar_pairs(rows, linkage, rule, direct, whole=alone, demands=demanded(linkage, model, rule, enough), deal=known is not None)


def _scored(proposed: DataFrame, linkage: Linkage, model: Model, threshold: float, known: Mapping[str, DataFrame] | None) -> DataFrame:
    """Those of the proposed pairs that reach ``threshold``, with their weight; spellings are compared last.

    Where spellings are looked up, the first sieve sees only what is equal: Spark moves it into the join, and levels would be found there
    once for every mention.
    """
    cheap = with_levels(proposed, linkage, [k for k in KINDS if k != "jaro_winkler"])
    bound = model.pair_bound(linkage) if known is None else model.pair_bound(linkage, KINDS)
    hopeful = cheap.where(bound >= threshold_bits(threshold) - 1e-9)
    scored = with_levels(hopeful, linkage, ["jaro_winkler"], known).withColumn("match_weight", model.weight(linkage))
    scored = scored.withColumn("match_probability", probability(F.col("match_weight")))
    return scored.where(F.col("match_probability") >= threshold).withColumnRenamed("_rule", "match_key")


def spanning_pairs(found: DataFrame, linkage: Linkage, model: Model, threshold: float, small: int | None = None,
                   known: Mapping[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(near, homes, across)``: of the pairs that ``predict`` gives, enough to hold the same profiles together.

    Profiles equal in a rule's columns and one more mostly all match, so their pairs grow with the square of such a group. Here each is
    scored with the first of its group only: ``near`` are those that match, ``homes`` their components. Pairs of a block
    are formed only between different homes; ``across`` are those that match. What no pair of ``near`` joins is compared in full, so no
    link between homes is lost, however the scores in a group turn out.
    """
    ends = [f"{ID}_l", f"{ID}_r"]
    more = [(rule, [c.column for c in linkage.outside(rule)] or list(rule)) for rule in linkage.rules]
    groups = {tuple(c for c in linkage.columns if c in rule or c == one) for rule, ones in more for one in ones}
    stars = reduce(DataFrame.unionByName, [_with_first(found, group) for group in sorted(groups)])
    near = materialise(_scored(stars, linkage, model, threshold, known).select(*ends, "match_probability").distinct(), "near")
    homes = materialise(connected_components(near, *ends).toDF(ID, "_home"), "homes")
    placed = materialise(found.join(homes, ID, "left").withColumn("_home", F.coalesce("_home", ID)), "placed")
    parts = []
    for rule in linkage.rules:
        rows = in_block(placed, rule)
        mixed = rows.groupBy(*rule).agg(F.min("_home").alias("_least"), F.max("_home").alias("_most")).where("_least <> _most")
        rows = materialise(rows.join(mixed.select(*rule), list(rule), "left_semi"), "mixed")
        parts.append(_block(rows, linkage, model, rule, threshold, small, known).where("_home_l <> _home_r"))
    across = _scored(proposed_pairs(parts, linkage.rules, deal=known is None), linkage, model, threshold, known)
    return near, homes, materialise(across.select(*ends, "match_probability"), "across")


def _with_first(found: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Each profile with the first one equal in the columns of the group, which is on the left."""
    ahead = Window.partitionBy(*group).orderBy(ID).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = {f"{c}_l": F.first(c).over(ahead) for c in found.columns if c not in group}
    pairs = found.dropna(subset=list(group)).withColumns(first).where(F.col(f"{ID}_l") < F.col(ID))
    return pairs.select(*[(F.col(f"{c}_l") if c not in group else F.col(c)).alias(f"{c}_l") for c in found.columns],
                        *[F.col(c).alias(f"{c}_r") for c in found.columns])


def spanning_clusters(found: DataFrame, linkage: Linkage, model: Model, threshold: float, known: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``(profile_id, cluster_id)`` as ``clusters`` gives for all pairs of ``predict``, from the ``spanning_pairs``."""
    _, homes, across = spanning_pairs(found, linkage, model, threshold, known=known)
    return extend_components(homes.toDF("node", "component"), across, f"{ID}_l", f"{ID}_r").toDF(ID, "cluster_id")


def demanded(linkage: Linkage, model: Model, rule: tuple[str, ...], enough: float) -> dict[tuple[str, int], Column]:
    """For each column outside the rule and each level: the rows whose tokens of that level are needed.

    Columns are taken from most to least selective. A row shows its tokens of a level if
    it could reach the threshold with the column on that level and all columns before it
    disagreeing. A pair that gets there that way has two such rows, since the bound holds
    for either side.
    """
    conditions, before = {}, []
    for c in sorted(linkage.outside(rule), key=lambda c: KINDS.index(c.kind)):
        for level in range(1, c.top + 1):
            conditions[c.column, level] = model.most_bits(linkage, before, (c.column, level)) >= enough
        before.append(c.column)
    return conditions


def copies_match(linkage: Linkage, model: Model, threshold: float) -> Column:
    """Whether the records behind one profile belong together: some rule blocks them and their score suffices."""
    blocked = F.lit(False)
    for rule in linkage.rules:
        present = F.lit(True)
        for c in rule:
            present = present & F.col(c).isNotNull()
        blocked = blocked | present
    weight = F.lit(model.prior_bits)
    for c in linkage.comparisons:
        bits = F.lit(model.bits(c.column, c.top))
        if c.term_frequency:
            bits = bits + model.rarity(c, f"tf_{c.column}")
        weight = weight + F.when(F.col(c.column).isNotNull(), bits).otherwise(0.0)
    return blocked & (probability(weight) >= threshold)


def clusters(pairs: DataFrame, threshold: float) -> DataFrame:
    """``(profile_id, cluster_id)`` for the profiles joined by pairs at or above ``threshold``."""
    edges = pairs.where(F.col("match_probability") >= threshold).select(f"{ID}_l", f"{ID}_r")
    return connected_components(edges, f"{ID}_l", f"{ID}_r").toDF(ID, "cluster_id")


def cluster_records(records: DataFrame, found: DataFrame, linkage: Linkage, model: Model, pairs: DataFrame,
                    threshold: float, id_col: str) -> DataFrame:
    """``(id, cluster_id)`` for every record; a record that matches nothing is its own cluster."""
    return place_records(records, found, linkage, model, clusters(pairs, threshold), threshold, id_col)


def place_records(records: DataFrame, found: DataFrame, linkage: Linkage, model: Model, named: DataFrame, threshold: float, id_col: str) -> DataFrame:
    """``(id, cluster_id)`` for every record, given the clusters of the profiles that match any other."""
    homes = found.join(named, ID, "left").select(
        *linkage.columns, ID, "cluster_id", copies_match(linkage, model, threshold).alias("_together"))
    same = [records[c].eqNullSafe(homes[c]) for c in linkage.columns]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    group = F.coalesce("cluster_id", F.when(F.col("_together"), F.col(ID)), records[id_col])
    return records.join(homes, condition).select(records[id_col], group.alias("cluster_id"))


def review_queue(pairs: DataFrame, low: float, high: float) -> DataFrame:
    """Pairs too close to call: probability in [low, high)."""
    p = F.col("match_probability")
    return pairs.where((p >= low) & (p < high))


def summary(assigned: DataFrame) -> DataFrame:
    """Records, clusters and records per cluster."""
    n, k = F.count(F.lit(1)), F.count_distinct("cluster_id")
    return assigned.agg(n.alias("records"), k.alias("clusters"), F.round(F.try_divide(n, k), 1).alias("dedupe_ratio"))
