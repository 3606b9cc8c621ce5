"""How many pairs of values are how similar, counted without forming the pairs wherever a formula can.

``values`` holds one row per distinct value with ``n``, the number of records behind it. Numbers of record pairs outgrow a long.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EXACT = "decimal(38,0)"


def _pairs_of_groups(rows: DataFrame, *by: str | Column) -> DataFrame:
    """``pairs``: record pairs of different values that share a group."""
    total, squares = F.sum("n").cast("decimal(19,0)"), F.sum((F.col("n") * F.col("n")).cast(EXACT)).cast(EXACT)
    return rows.groupBy(*by).agg(((total * total - squares) / 2).cast(EXACT).alias("pairs")).where("pairs > 0")


def _sum(rows: DataFrame, distance: int, weight: Column) -> DataFrame:
    return rows.agg(F.sum(weight.cast(EXACT)).cast(EXACT).alias("pairs")).select(F.lit(distance).alias("distance"), F.coalesce("pairs", F.lit(0).cast(EXACT)).alias("pairs"))


def date_distances(values: DataFrame, column: str, limits: Sequence[int]) -> DataFrame:
    """``(step, pairs)``: pairs of different dates within ``limits[step]`` days and not within the limit before.

    One sliding sum over the day histogram for each limit. Days are cut into buckets; the days after a bucket's last that its
    own windows reach are copied into it, so that no task holds the whole histogram.
    """
    width = max(limits) + 1
    days = values.select(F.unix_date(column).alias("day"), F.col("n"))
    bucket = F.floor(F.col("day") / width)
    placed = days.select("day", "n", F.explode(F.array(
        F.struct(bucket.alias("bucket"), F.lit(True).alias("own")), F.struct((bucket - 1).alias("bucket"), F.lit(False).alias("own")))).alias("at"))
    window = Window.partitionBy("at.bucket").orderBy("day")
    reached = placed.select("at.own", "n", *[
        F.coalesce(F.sum("n").over(window.rangeBetween(1, int(t))), F.lit(0)).alias(f"within{i}") for i, t in enumerate(limits)])
    sums = reached.where("own").agg(*[F.sum((F.col("n") * F.col(f"within{i}")).cast(EXACT)).cast(EXACT).alias(f"s{i}") for i in range(len(limits))])
    steps = [F.struct(F.lit(i).alias("step"), (F.col(f"s{i}") - (F.col(f"s{i - 1}") if i else F.lit(0))).cast(EXACT).alias("pairs")) for i in range(len(limits))]
    return sums.select(F.inline(F.array(*steps)))


def _numbers(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _without(s: Column, i: Column) -> Column:
    return F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))


def _at(i: Column) -> Column:
    """The character of ``v`` at a position; empty beyond its end."""
    return F.substring(F.col("v"), i, F.lit(1))


def _alike(s: Column) -> Column:
    """Whether a text that is not empty is one character over and over."""
    return s == F.repeat(F.substring(s, 1, 1), F.length(s))


def _stretches(rows: DataFrame, least: int) -> DataFrame:
    """Each value with the first and last positions, ``i`` and ``j``, of all its stretches of more than ``least`` characters."""
    begun = rows.select("v", "n", F.explode(_numbers(F.lit(1), F.length("v") - least)).alias("i"))
    return begun.select("v", "n", "i", F.explode(_numbers(F.col("i") + least, F.length("v"))).alias("j"))


def edit_distances(values: DataFrame, column: str, limit: int) -> DataFrame:
    """``(distance, pairs)`` for edit distances 1 and (``limit`` 2) 2.

    No pairs are formed. Two values that differ at one position share exactly one group of (position, rest), those that differ at two
    exactly one group of (both positions, rest), and the former share length - 1 of the latter. Deletions alone are looked up; each result
    is made once, by the last deletions that give it. Deletions that meet an insertion or a substitution are counted from group sizes too.
    """
    v, i, j, length = F.col("v"), F.col("i"), F.col("j"), F.length("v")
    rows = values.select(F.col(column).alias("v"), F.col("n").cast("long").alias("n"))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v")  # a value has many keys
    known = rows.select(F.col("v").alias("rest"), F.col("n").alias("n_rest"))
    lengths = _lengths(rows)
    one = rows.select("v", "n", F.explode(_numbers(F.lit(1), length)).alias("i")).withColumn("rest", _without(v, i))
    changed = _pairs_of_groups(one.select("n", length.alias("len"), "i", "rest"), "rest", "i", "len").groupBy("len").agg(F.sum("pairs").cast(EXACT).alias("pairs"))

    def looked_up(results: DataFrame, distance: int) -> DataFrame:
        return _sum(_fitting(results, lengths, -distance).select("n", "rest").join(known, "rest"), distance, _product("n", "n_rest"))

    parts = [_sum(changed, 1, F.col("pairs")), looked_up(one.where(_at(i) != _at(i + 1)), 1)]
    if limit == 2:
        two = _stretches(rows, 1).withColumn("rest", _without(_without(v, j), i))
        both = _pairs_of_groups(two, "rest", "i", "j")
        parts += [_sum(both, 2, F.col("pairs")), _sum(changed, 2, -F.col("pairs") * (F.col("len") - 1))]
        parts.append(looked_up(two.where((_at(j) != _at(j + 1)) & (_at(i) != _at(F.when(j == i + 1, j + 1).otherwise(i + 1)))), 2))
        parts += [_sum(found, 2, F.col("pairs")) for found in (_shifted(rows), _shortened_and_changed(rows, lengths))]
    return reduce(DataFrame.unionByName, parts).groupBy("distance").agg(F.sum("pairs").cast(EXACT).alias("pairs"))


def _lengths(rows: DataFrame) -> list[int]:
    """The different lengths: a handful of numbers."""
    return [r["len"] for r in rows.select(F.length("v").alias("len")).distinct().collect()]


def _fitting(rows: DataFrame, lengths: Sequence[int], longer: int) -> DataFrame:
    """Rows whose value has others that are so much longer."""
    return rows.where(F.length("v").isin([n for n in lengths if n + longer in lengths]))


def _product(left: str, right: str) -> Column:
    return (F.col(left).cast("decimal(19,0)") * F.col(right).cast("decimal(19,0)")).cast(EXACT)


def _by_key(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Joined by shuffles: Spark takes rows repeated for their keys to be as few as the values, and would broadcast them."""
    return left.hint("merge").join(right.hint("merge"), list(key))


def _shifted(rows: DataFrame) -> DataFrame:
    """``pairs`` of one length that a deletion and an insertion make equal, but not two substitutions.

    Without what both begin and end with, such values are x + middle and middle + y, where x differs from the first character of the
    middle, y from its last and, or else two substitutions would do, the middle is not one character over and over. Each side shows that
    alone, so all pairs of a (rest, stretch) count. Stretches that alternate between two characters are met from both sides and
    looked up to take one off.
    """
    v, i, j, key = F.col("v"), F.col("i"), F.col("j"), ["rest", "i", "j"]
    ends = _stretches(rows, 2)
    long = (j - i).cast("int")
    first = ends.where((_at(i) != _at(i + 1)) & ~_alike(F.substring(v, i + 1, long))).select(_without(v, i).alias("rest"), "i", "j", "n")
    last = ends.where((_at(j) != _at(j - 1)) & ~_alike(F.substring(v, i, long))).select(_without(v, j).alias("rest"), "i", "j", "n")
    sides = [side.groupBy(*key).agg(F.sum("n").alias(f"n_{name}")) for side, name in ((first, "l"), (last, "r"))]
    turned = F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, long), _at(j - 1), F.substring(v, j + 1, F.length(v)))
    alternating = ends.where((_at(i) != _at(i + 1)) & (F.substring(v, i, long - 1) == F.substring(v, i + 2, long - 1)))
    twice = alternating.select(turned.alias("rest"), "v", F.col("n").alias("n_l")).where(F.col("v") < F.col("rest"))
    both = _by_key(twice, rows.select(F.col("v").alias("rest"), F.col("n").alias("n_r")), ["rest"])
    return _by_key(*sides, key).select(_product("n_l", "n_r").alias("pairs")).unionByName(both.select((-_product("n_l", "n_r")).alias("pairs")))


def _shortened_and_changed(rows: DataFrame, lengths: Sequence[int] | None = None) -> DataFrame:
    """``pairs`` at distance two whose lengths differ by one: a deletion and a substitution.

    Without what both begin and end with, such values are x + middle and y + middle + z, where x differs from y and the last character
    of x + middle from z, or (``late``) the same from the other end: middle + x, where z differs from x and y from the first one. So from the pairs of a
    (rest, stretch) those are taken off whose x is a character that the longer one forbids. A middle that is x over and over is
    both, an empty one too: the former is forbidden from the other end, the latter not met there. The longer values of a group
    are summed by what they forbid, each once in full; rows are sorted by a hash, which is quicker than by text.
    """
    v, i, j, key = F.col("v"), F.col("i"), F.col("j"), ["hash", "rest", "i", "middle", "late"]
    hashed = F.xxhash64("rest", "i", "middle", "late")
    lengths = _lengths(rows) if lengths is None else lengths
    short = _stretches(_fitting(rows, lengths, 1), 0)
    long = _stretches(_fitting(rows, lengths, -1), 1).withColumn("middle", j - i - 1)
    either = F.struct(F.lit(False).alias("late"), _without(v, i).alias("rest"), _at(i).alias("x"))
    other = F.struct(F.lit(True).alias("late"), _without(v, j).alias("rest"), _at(j).alias("x"))
    left = short.select("i", (j - i).alias("middle"), F.col("n").alias("n_l"), F.inline(F.when(i == j, F.array(either)).otherwise(F.array(either, other))))
    y, z, middle = _at(i), _at(j), F.col("middle")
    inside = F.substring(v, i + 1, middle)

    def forbids(late: bool, first: Column, *more: Column) -> Column:
        return F.array(*[F.struct(F.lit(late).alias("late"), c.alias("not_x"), F.lit(k == 0).alias("counted")) for k, c in enumerate((first, *more))])

    none = F.filter(forbids(False, y), lambda _: F.lit(False))
    early = F.when((middle == 0) & (y != z), forbids(False, y, z)).when((middle == 0) | (z != _at(j - 1)), forbids(False, y)).otherwise(none)
    begins = (middle > 0) & (y != _at(i + 1))
    late = F.when(begins & _alike(inside) & (z != _at(i + 1)), forbids(True, z, _at(i + 1))).when(begins, forbids(True, z)).otherwise(none)
    right = long.select(_without(_without(v, j), i).alias("rest"), "i", "middle", "n", F.inline(F.concat(early, late))).withColumn("hash", hashed)
    summed = right.groupBy(*key, "not_x").agg(F.sum("n").alias("n_not"), F.sum(F.when(F.col("counted"), F.col("n")).otherwise(0)).alias("n_r"))
    met = _by_key(left.withColumn("hash", hashed), summed, key)
    return met.select((_product("n_l", "n_r") - F.when(F.col("x") == F.col("not_x"), _product("n_l", "n_not")).otherwise(F.lit(0).cast(EXACT))).cast(EXACT).alias("pairs"))
