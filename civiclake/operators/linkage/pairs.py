"""Candidate pairs inside blocks, and counts of agreement patterns over all pairs of a block."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclake.functions.similarity import similar_in_cells
from civiclake.operators.linkage.compare import COPIES, ID, KINDS, Comparison, Linkage
from civiclake.operators.skew import join_in_cells, pairs_within
from civiclake.session import materialise


SMALL_BLOCK = 256  # profiles
#: Where spellings are looked up, a pair costs so little that larger blocks are paired directly too.
DIRECT_BLOCK = 4096
#: Pairs of similar spellings that are given to every task; beyond that, spellings are compared pair by pair.
FEW_SPELLINGS = 100_000
#: Up to so many different values of a column are all compared with each other; more only where they meet.
FEW_VALUES = 1000
#: Texts longer than this, such as digests, have nearly all letters in common by chance, so the letter filter keeps nearly all pairs.
LONG = 16


def in_block(found: DataFrame, rule: Sequence[str]) -> DataFrame:
    """Profiles with all blocking columns present; NULL never blocks."""
    return found.dropna(subset=list(rule))


def value_lengths(found: DataFrame, comparisons: Sequence[Comparison]) -> list[int]:
    """The distinct lengths of the texts compared by Jaro-Winkler: a handful of numbers."""
    fuzzy = [F.length(c.column) for c in comparisons if c.kind == "jaro_winkler"]
    if not fuzzy:
        return []
    rows = found.select(F.explode(F.array(*fuzzy)).alias("n")).where("n > 0").distinct().collect()
    return sorted(r["n"] for r in rows)


def carried(found: DataFrame) -> list[str]:
    return [c for c in found.columns if c != ID]


def similar_pairs(found: DataFrame, linkage: Linkage, rule: Sequence[str], small: int = SMALL_BLOCK,
                  whole: Column | None = None, demands: Mapping[tuple[str, int], Column] | None = None, deal: bool = False) -> DataFrame:
    """Pairs of a block, complete for those that agree at least a little outside the rule.

    Blocks of up to ``small`` profiles are paired in full, which costs each profile at
    most ``small`` pairs. Larger blocks are joined on (block, token), see
    ``Comparison.tokens``, so dissimilar pairs are never formed there; a pair may share
    several tokens and is made distinct before anything is compared. Blocks for which
    ``whole`` holds need every pair whatever their size.

    ``demands`` narrows the tokens: a row shows those of a (column, level) only where the
    condition holds for it. A pair needed on a level must meet it on both sides.

    Similar spellings of long texts share no token that others lack: the few that are similar are found among the texts of a block, see
    ``near_texts``, and rows are paired by them; equal ones are by their token.
    """
    rows = in_block(found, rule)
    large = rows.groupBy(*rule).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > small)
    if large.isEmpty():
        return plain_pairs(rows, rule, found, deal)
    sized = rows.join(large, list(rule), "left")
    pairs = plain_pairs(sized.where("_n is null").drop("_n"), rule, found, deal)
    many = sized.where("_n is not null").drop("_n")
    if whole is not None:
        pairs = pairs.unionByName(all_pairs(many.where(whole), rule))
        many = many.where(~whole)

    free = linkage.outside(rule)
    lengths = value_lengths(many, free)
    if demands is None:
        demands = {(c.column, 1): F.lit(True) for c in free}
    by_name = {c.column: c for c in free}

    def shown(column: str, level: int, condition: Column) -> Column:
        label = F.lit(f"{column}.{level}:")
        marks = F.transform(by_name[column].tokens(lengths, level), lambda t: F.concat(label, t))
        return F.coalesce(F.when(condition, marks), F.array().cast("array<string>"))

    long = {c.column for c in free if c.kind == "jaro_winkler" and not c.digest} if max(lengths, default=0) > LONG else set()
    dense: dict[str, list[tuple[str, int]]] = {}
    for key in demands:
        if key[0] in long and key[1] < by_name[key[0]].top:
            dense.setdefault(key[0], []).append(key)
    tokened = {key: condition for key, condition in demands.items() if key not in sum(dense.values(), [])}
    parts = []
    for column, keys in dense.items():
        c, wanted = by_name[column], reduce(lambda a, b: a | b, [demands[key] for key in keys])
        some = many.where(wanted & F.col(column).isNotNull())
        near = near_texts(some, rule, column, c.thresholds[c.top - 1 - min(level for _, level in keys)])
        parts.append(pairs_by_values(some, near, rule, column))
        tokened[column, c.top] = wanted | tokened[column, c.top] if (column, c.top) in tokened else wanted
    marks = F.array_distinct(F.flatten(F.array(*[shown(*key, condition) for key, condition in tokened.items()])))
    if tokened:
        marked = many.withColumn("_token", F.explode(marks))
        parts.append(pairs_within(marked, [*rule, "_token"], ID, carried(found), drop=rule).drop("_token"))
    return pairs.unionByName(reduce(DataFrame.unionByName, parts).distinct()) if parts else pairs


def near_texts(rows: DataFrame, keys: Sequence[str], column: str, threshold: float, chunk: int = 4000) -> DataFrame:
    """``keys, <column>_l, <column>_r``: different texts of a group whose Jaro-Winkler similarity reaches ``threshold``, each pair once.

    A group's texts are cut into parts of about ``chunk``, and each pair of parts is compared on its own by the characters they have in
    common. That is every pair still, at some nanoseconds each. The number of partitions is fixed: the bytes of a cell say little of its pairs.
    """
    held = [*keys] or ["_all"]
    texts = (rows if keys else rows.withColumn("_all", F.lit(0))).select(*held, column).dropna().distinct()
    sizes = texts.groupBy(*held).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > chunk)
    cut = texts.join(sizes, held, "left").withColumn("_parts", F.coalesce(F.ceil(F.col("_size") / chunk), F.lit(1)).cast("int"))
    part = F.pmod(F.xxhash64(column), F.col("_parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda k: F.struct(F.least("_part", k).alias("_i"), F.greatest("_part", k).alias("_j")))
    placed = cut.withColumn("_part", part).select(*held, column, "_part", F.inline(cells))
    dealt = placed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *held, "_i", "_j")
    return similar_in_cells(dealt, held, column, threshold).select(*keys, f"{column}_l", f"{column}_r")


def pairs_by_values(rows: DataFrame, near: DataFrame, rule: Sequence[str], column: str) -> DataFrame:
    """Pairs of a block's rows whose values of ``column`` are a pair of ``near``, as ``<c>_l``/``<c>_r`` with the smaller id on the left."""
    keys = [F.col(c).alias(f"_{c}") for c in rule]
    a, b = (near.select(*keys, F.col(f"{column}_l").alias("_a"), F.col(f"{column}_r").alias("_b")), rows)
    first = b.select(*[F.col(c).alias(f"{c}_a") for c in b.columns]).join(
        a, reduce(lambda x, y: x & y, [F.col(f"{c}_a") == F.col(f"_{c}") for c in rule] + [F.col(f"{column}_a") == F.col("_a")])).drop("_a")
    second = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns], *[F.col(c).alias(f"_{c}") for c in rule], F.col(column).alias("_b"))
    joined = join_in_cells(first, second, [*[f"_{c}" for c in rule], "_b"])
    swap = F.col(f"{ID}_a") > F.col(f"{ID}_b")
    return joined.select(*[F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{side}")
                           for c in rows.columns for side, x, y in (("l", "a", "b"), ("r", "b", "a"))])


def plain_pairs(rows: DataFrame, rule: Sequence[str], found: DataFrame, deal: bool = False) -> DataFrame:
    """All pairs of each block by one self-join. ``deal`` fixes its number of partitions: the bytes of its rows say little of its pairs."""
    if deal:
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rule)
    left = rows.select(*rule, *[F.col(c).alias(f"{c}_l") for c in found.columns])
    right = rows.select(*rule, *[F.col(c).alias(f"{c}_r") for c in found.columns])
    joined = left.join(right, list(rule)).where(F.col(f"{ID}_l") < F.col(f"{ID}_r"))
    return joined.select(*[f"{c}_{side}" for c in found.columns for side in ("l", "r")])


def all_pairs(found: DataFrame, rule: Sequence[str]) -> DataFrame:
    """Every pair of a block, for blocks that need no further agreement to match."""
    return pairs_within(in_block(found, rule), list(rule), ID, carried(found), drop=rule)


def with_levels(pairs: DataFrame, linkage: Linkage, kinds: Sequence[str] = KINDS, known: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Pairs with the level of each column of the given kinds; those of ``known``, see ``known_spellings``, are looked up."""
    known = known or {}
    for c in linkage.comparisons:
        if c.kind in kinds and c.column in known:
            pairs = looked_up(pairs, c, known[c.column])
    return pairs.withColumns({
        f"gamma_{c.column}": c.level(F.col(f"{c.column}_l"), F.col(f"{c.column}_r"))
        for c in linkage.comparisons if c.kind in kinds and c.column not in known
    })


def looked_up(pairs: DataFrame, c: Comparison, known: DataFrame) -> DataFrame:
    """Pairs with the level of a column whose similar values, in either order, are the rows of ``known``."""
    left, right = f"{c.column}_l", f"{c.column}_r"
    level = F.when(F.col(left).isNull() | F.col(right).isNull(), -1).when(F.col(left) == F.col(right), c.top).otherwise(F.coalesce("_near", F.lit(0)))
    return pairs.join(F.broadcast(known), [left, right], "left").withColumn(f"gamma_{c.column}", level).drop("_near")


def known_spellings(found: DataFrame, linkage: Linkage, small: int = SMALL_BLOCK) -> dict[str, DataFrame] | None:
    """For each column compared by Jaro-Winkler ``<c>_l, <c>_r, _near``: values that differ and agree a little, in either order, and at least
    all those that meet in some block.

    Values meet far less often than profiles do, and each pair of them is compared once; of up to ``FEW_VALUES`` every pair is, which
    spares the look for those that meet. None where some column has more than ``FEW_SPELLINGS`` pairs that meet: they are too many to be given to every task.
    """
    known = {}
    for c in linkage.comparisons:
        if c.kind != "jaro_winkler":
            continue
        left, right = f"{c.column}_l", f"{c.column}_r"
        asked = [] if c.digest else [rule for rule in linkage.rules if c.column not in rule]  # else level 0 unless equal, or not asked for
        near = None
        values = materialise(found.select(F.col(c.column).alias(left)).dropna().distinct(), "values") if asked else found.limit(0).select(F.col(c.column).alias(left))
        if not asked or values.count() <= FEW_VALUES:
            near = _near_spellings(values.join(F.broadcast(values.select(F.col(left).alias(right))), F.col(left) < F.col(right)), c)
        if near is None or near.count() > FEW_SPELLINGS:
            near = _near_spellings(reduce(DataFrame.unionByName, [_meeting(found, c, rule, small) for rule in asked]).distinct(), c)
            if near.count() > FEW_SPELLINGS:
                return None
        known[c.column] = near.unionByName(near.select(F.col(right).alias(left), F.col(left).alias(right), "_near"))
    return known


def _near_spellings(values: DataFrame, c: Comparison) -> DataFrame:
    left, right = f"{c.column}_l", f"{c.column}_r"
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = values.repartition(n, left, right).withColumn("_near", c.level(F.col(left), F.col(right)))
    return materialise(level.where(F.col("_near").between(1, c.top - 1)), "spellings")


def _meeting(found: DataFrame, c: Comparison, rule: Sequence[str], small: int) -> DataFrame:
    """Pairs of different values of a column that meet in a block of the rule, the lesser one on the left."""
    left, right = f"{c.column}_l", f"{c.column}_r"
    values = in_block(found, rule).dropna(subset=[c.column]).groupBy(*rule, c.column).agg(F.min(ID).alias(ID))
    pairs = similar_pairs(values, Linkage((c,), (tuple(rule),)), rule, small, demands={(c.column, 1): F.lit(True)})
    return pairs.select(F.least(left, right).alias(left), F.greatest(left, right).alias(right)).where(F.col(left) < F.col(right))


def agrees_outside(linkage: Linkage, rule: Sequence[str]) -> Column:
    agree = F.lit(False)
    for c in linkage.outside(rule):
        agree = agree | (F.col(f"gamma_{c.column}") > 0)
    return agree


def spread(pairs: DataFrame, id_col: str = ID) -> DataFrame:
    """Pairs dealt evenly over the shuffle partitions before they are compared.

    Comparing costs far more than the bytes of a pair suggest, so the number is fixed:
    left to its byte counts, Spark would merge these partitions into a few.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, f"{id_col}_l", f"{id_col}_r")


def proposed_pairs(parts: Sequence[DataFrame], rules: Sequence[Sequence[str]], deal: bool = True) -> DataFrame:
    """Union of the rules' pairs, each pair once, with ``_rule``, the first rule that blocks it.

    Whether an earlier rule blocks a pair as well is seen on the pair itself, so nothing is grouped. That rule has formed the pair
    too: it agrees on the later rule's columns, which is more than blocks ask for. ``deal`` spreads the pairs for a costly comparison.
    """
    union, earlier = None, F.lit(False)
    for number, (part, rule) in enumerate(zip(parts, rules)):
        marked = part.where(~earlier).withColumn("_rule", F.lit(number))
        union = marked if union is None else union.unionByName(marked)
        agree = F.lit(True)
        for c in rule:
            agree = agree & F.coalesce(F.col(f"{c}_l") == F.col(f"{c}_r"), F.lit(False))
        earlier = earlier | agree
    return spread(union) if deal else union


def block_pairs(found: DataFrame, linkage: Linkage, small: int | None = None) -> DataFrame:
    """Levels of all pairs some rule proposes and that agree on something outside it; each pair once.

    ``match_key`` is the first such rule.
    """
    known = known_spellings(found, linkage, small or SMALL_BLOCK)
    direct = small or (SMALL_BLOCK if known is None else DIRECT_BLOCK)
    proposed = proposed_pairs([similar_pairs(found, linkage, rule, direct, deal=known is not None) for rule in linkage.rules], linkage.rules, deal=known is None)
    key = F.coalesce(*[F.when((F.col("_rule") == i) & agrees_outside(linkage, rule), F.lit(i)) for i, rule in enumerate(linkage.rules)])
    levelled = with_levels(proposed, linkage, known=known).withColumn("match_key", key)
    return levelled.where(F.col("match_key").isNotNull()).drop("_rule")


def is_exact(c: Comparison) -> bool:
    """Whether unequal values are all on level 0."""
    return c.kind == "exact" or c.digest


def fuzzy_pairs(found: DataFrame, linkage: Linkage, rule: Sequence[str], small: int = SMALL_BLOCK) -> DataFrame | None:
    """Pairs of a block, complete for those that agree a little on a column with degrees; None where no such column is open."""
    fuzzy = [c for c in linkage.outside(rule) if not is_exact(c)]
    return similar_pairs(found, linkage, rule, small, demands={(c.column, 1): F.lit(True) for c in fuzzy}) if fuzzy else None


def near_values(rows: DataFrame, rule: Sequence[str], c: Comparison, small: int = SMALL_BLOCK) -> DataFrame:
    """The rule's columns, ``<c>_l, <c>_r, gamma_<c>``: different values of a block that agree a little, each pair once."""
    values = rows.dropna(subset=[c.column]).groupBy(*rule, c.column).agg(F.min(ID).alias(ID))
    alone = Linkage((c,), (tuple(rule),))
    pairs = similar_pairs(values, alone, rule, small, demands={(c.column, 1): F.lit(True)})
    levelled = with_levels(spread(pairs) if c.kind == "jaro_winkler" else pairs, alone)
    return levelled.where(F.col(f"gamma_{c.column}").between(1, c.top - 1)).select(
        *[F.col(f"{r}_l").alias(r) for r in rule], f"{c.column}_l", f"{c.column}_r", f"gamma_{c.column}")


def _pairs_of_copies(rows: DataFrame, free: Sequence[Comparison]) -> DataFrame:
    """Levels and ``n``: pairs of records behind one profile."""
    n = F.col(COPIES).cast("decimal(19,0)")
    names = [f"gamma_{c.column}" for c in free]
    return rows.where(n > 1).select(
        *[F.when(F.col(c.column).isNull(), -1).otherwise(c.top).alias(f"gamma_{c.column}") for c in free],
        (n * (n - 1) / 2).cast("decimal(38,0)").alias("n"),
    ).groupBy(*names).agg(F.sum("n").cast("decimal(38,0)").alias("n"))


def _counted_directly(rows: DataFrame, free: Sequence[Comparison], rule: Sequence[str], known: Mapping[str, DataFrame]) -> DataFrame:
    """Levels and ``n``: record pairs of different profiles of a block, levelled where they are formed, so that only their counts are sent.

    Profiles differ in some free column, so these order the two of a pair; ids may repeat or be missing.
    """
    exact, columns = "decimal(38,0)", [c.column for c in free]
    dealt = rows.select(*rule, COPIES, *columns).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rule)
    sides = {side: dealt.select(*rule, *[F.col(c).alias(f"{c}_{side}") for c in [COPIES, *columns]]) for side in "lr"}
    ordered = F.struct(*[f"{c}_l" for c in columns]) < F.struct(*[f"{c}_r" for c in columns])
    pairs = with_levels(sides["l"].join(sides["r"], list(rule)).where(ordered), Linkage(tuple(free), ()), known=known)
    # The sum may outgrow a long, so both halves of each product are summed.
    product, half = F.col(f"{COPIES}_l") * F.col(f"{COPIES}_r"), 31
    counted = pairs.groupBy(*[f"gamma_{c}" for c in columns]).agg(
        F.sum(F.shiftright(product, half)).alias("_high"), F.sum(product.bitwiseAND(F.lit((1 << half) - 1).cast("long"))).alias("_low"))
    n = F.col("_high").cast("decimal(19,0)") * F.lit(1 << half).cast("decimal(10,0)") + F.col("_low").cast("decimal(19,0)")
    return counted.select(*[f"gamma_{c}" for c in columns], n.cast(exact).alias("n"))


def pattern_counts(found: DataFrame, linkage: Linkage, rule: Sequence[str], small: int = SMALL_BLOCK,
                   known: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """How many record pairs of the block show each pattern of levels outside the rule.

    With ``known`` spellings, see ``known_spellings``, blocks of up to ``DIRECT_BLOCK`` profiles are counted pair by pair: a profile is
    sent once. The others are as follows.

    Covers all pairs without forming most of them. For each set of columns, the pairs that agree at least a little on all of the set are
    counted, whatever the others say: those equal on the set from the sizes of the groups with equal values, the others from the
    pairs of values that agree a little, each with the sizes of the groups that hold them. Profiles are paired only where two columns
    differ and yet agree a little. Pairs that agree on just the set follow by inclusion and exclusion over the sets that hold it, copies
    of one profile by formula. Totals are kept per set of missing values.
    """
    free = linkage.outside(rule)
    names = [f"gamma_{c.column}" for c in free]
    rows = in_block(found, rule)
    exact = "decimal(38,0)"  # pair counts of a hot block outgrow a long
    n = F.col(COPIES).cast("decimal(19,0)")
    if known is not None and free:
        large = rows.groupBy(*rule).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > DIRECT_BLOCK).select(*rule)
        some = not large.isEmpty()
        few = rows.join(large, list(rule), "left_anti") if some else rows
        parts = [_counted_directly(few, free, rule, known), _pairs_of_copies(few, free)]
        parts += [pattern_counts(rows.join(large, list(rule), "left_semi"), linkage, rule, small)] if some else []
        return reduce(DataFrame.unionByName, parts).groupBy(*names).agg(F.sum("n").cast(exact).alias("n")).where("n > 0")

    bit = {c.column: 1 << i for i, c in enumerate(free)}
    mask = F.lit(0)
    for c in free:
        mask = mask + F.when(F.col(c.column).isNull(), bit[c.column]).otherwise(0)
    marked = rows.withColumn("_mask", mask)
    near = {c.column: materialise(near_values(rows, rule, c, small), "near") for c in free if not is_exact(c)}
    fewest = {column: found.count() for column, found in near.items()} if len(near) > 1 else dict.fromkeys(near, 0)

    parts = []
    for together in _subsets([c.column for c in free]):
        masks = [m for m in range(1 << len(free)) if not any(m & bit[c] for c in together)]
        tops = [F.lit(c.top).alias(f"gamma_{c.column}") for c in free if c.column in together]
        counted = [_pairs_in_groups(marked, rule, together, masks, n).select("_mask", *tops, "n")]
        for differing in _subsets([c for c in together if c in near])[1:]:
            pivot = min(differing, key=lambda c: fewest[c])
            counted.append(_pairs_of_near(marked, linkage, rule, together, differing, pivot, near[pivot]))
        pattern = F.array(*[F.struct(
            *[(F.col(f"gamma_{c.column}") if c.column in just else F.when(F.col("_mask").bitwiseAND(bit[c.column]) != 0, -1).otherwise(0)).alias(f"gamma_{c.column}")
              for c in free], (F.col("n") * (-1) ** (len(together) - len(just))).cast(exact).alias("n")) for just in _subsets(together)])
        parts += [part.select(F.inline(pattern)) for part in counted]
    return reduce(DataFrame.unionByName, parts).unionByName(_pairs_of_copies(rows, free)).groupBy(*names).agg(F.sum("n").cast(exact).alias("n")).where("n > 0")


def _pairs_of_near(marked: DataFrame, linkage: Linkage, rule: Sequence[str], together: Sequence[str], differing: Sequence[str], pivot: str,
                   near: DataFrame) -> DataFrame:
    """``_mask``, levels and ``n``: record pairs that are equal on ``together`` but for the ``differing`` columns, on which they agree a
    little; ``near`` has the pairs of values of the ``pivot``, one of them."""
    exact = "decimal(38,0)"
    by_name = {c.column: c for c in linkage.comparisons}
    n = F.col(COPIES).cast("decimal(19,0)")
    groups = marked.dropna(subset=list(together)).groupBy(*rule, *together, "_mask").agg(F.sum(n).cast("decimal(19,0)").alias("n"))
    equal, others = [c for c in together if c not in differing], [c for c in differing if c != pivot]
    sides = {side: groups.select(*rule, *equal, F.col(pivot).alias(f"{pivot}_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in [*others, "_mask", "n"]]) for side in "lr"}
    first = near.join(sides["l"], [*rule, f"{pivot}_l"])
    keys = [*rule, *equal, f"{pivot}_r"]
    pairs = join_in_cells(materialise(first, "near"), sides["r"], keys) if others else first.join(sides["r"], keys)
    for c in others:
        level = by_name[c].level(F.col(f"{c}_l"), F.col(f"{c}_r"))
        pairs = pairs.withColumn(f"gamma_{c}", level).where(F.col(f"gamma_{c}").between(1, by_name[c].top - 1))
    levels = [F.lit(by_name[c].top).alias(f"gamma_{c}") if c in equal else F.col(f"gamma_{c}") for c in together]
    counted = pairs.select(F.col("_mask_l").bitwiseOR(F.col("_mask_r")).alias("_mask"), *levels, (F.col("n_l") * F.col("n_r")).cast(exact).alias("n"))
    return counted.groupBy("_mask", *[f"gamma_{c}" for c in together]).agg(F.sum("n").cast(exact).alias("n"))


def _subsets(columns: Sequence[str]) -> list[tuple[str, ...]]:
    return [tuple(c for i, c in enumerate(columns) if k >> i & 1) for k in range(1 << len(columns))]


def _pairs_in_groups(marked: DataFrame, rule: Sequence[str], together: Sequence[str], masks: Sequence[int], n: Column) -> DataFrame:
    """``(_mask, n)``: record pairs of different profiles that agree on ``together`` and lack, on either side, the columns of the mask."""
    exact = "decimal(38,0)"
    wide = marked.dropna(subset=list(together)) if together else marked
    wide = wide.groupBy(*rule, *together).agg(*[
        agg for m in masks for agg in (
            F.sum(F.when(F.col("_mask") == m, n).otherwise(0)).cast("decimal(19,0)").alias(f"c{m}"),
            F.sum(F.when(F.col("_mask") == m, (n * n).cast(exact)).otherwise(0)).cast(exact).alias(f"s{m}"),
        )
    ])

    def cross(a: int, b: int) -> Column:
        if a == b:
            return ((F.col(f"c{a}") * F.col(f"c{a}") - F.col(f"s{a}")) / 2).cast(exact)
        return (F.col(f"c{a}") * F.col(f"c{b}")).cast(exact)

    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(a | b).alias("_mask"), cross(a, b).alias("n")) for a in masks for b in masks if a <= b
    ]))).groupBy("_mask").agg(F.sum("n").cast(exact).alias("n"))


def proposed_counts(found: DataFrame, linkage: Linkage, known: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """How many of all record pairs that some rule proposes show each pattern of levels, dissimilar ones included.

    Each pair counts once, under ``match_key``, the first rule that proposes it: a pattern shows whether an earlier rule
    does too, since only equal values reach the top level.
    """
    parts, earlier = [], F.lit(False)
    for number, rule in enumerate(linkage.rules):
        counts = pattern_counts(found, linkage, rule, known=known)
        levels = [F.lit(c.top).alias(f"gamma_{c.column}") if c.column in rule else F.col(f"gamma_{c.column}") for c in linkage.comparisons]
        parts.append(counts.select(F.lit(number).alias("match_key"), *levels, "n").where(~earlier))
        agree = F.lit(True)
        for c in linkage.comparisons:
            if c.column in rule:
                agree = agree & (F.col(f"gamma_{c.column}") == c.top)
        earlier = earlier | agree
    return reduce(DataFrame.unionByName, parts)
