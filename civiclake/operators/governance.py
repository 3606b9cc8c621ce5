"""Catalogue search, data dictionary, lineage edges, profiling, masking and restricted views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DatetimeType, FractionalType, MapType, NumericType, StructType

from civiclake.functions.text import contains_folded, pseudonym

SEARCHED = ("name", "owner", "description", "classification")


def search(catalogue: DataFrame, text: str) -> DataFrame:
    """Entries whose own text, or a name or description in their ``columns`` array, contains ``text``.

    Case and outer blanks of ``text`` are ignored; an empty search returns everything.
    """
    needle = text.strip().lower()
    if not needle:
        return catalogue
    own = reduce(lambda a, b: a | b, [contains_folded(c, needle) for c in SEARCHED])
    inside = F.exists("columns", lambda c: contains_folded(c["name"], needle) | contains_folded(c["description"], needle))
    return catalogue.where(own | F.coalesce(inside, F.lit(False)))


def search_flat(entries: DataFrame, columns: DataFrame, text: str, id_col: str = "id") -> DataFrame:
    """The same search with columns kept as rows of their own, for entries too wide to nest."""
    needle = text.strip().lower()
    if not needle:
        return entries
    inside = columns.where(contains_folded("name", needle) | contains_folded("description", needle)).select(id_col).distinct()
    own = reduce(lambda a, b: a | b, [contains_folded(c, needle) for c in SEARCHED])
    hit = entries.join(inside.withColumn("_hit", F.lit(True)), id_col, "left")
    return hit.where(own | F.col("_hit").isNotNull()).drop("_hit")


def dictionary(catalogue: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per catalogue column, in order."""
    return catalogue.select(id_col, F.posexplode("columns").alias("position", "c")).select(id_col, "position", "c.*")


def pii_register(catalogue: DataFrame, id_col: str = "id") -> DataFrame:
    """Columns that hold personal data, with the classification of their dataset."""
    personal = F.filter("columns", lambda c: c["pii"])
    return catalogue.select(id_col, "classification", F.explode(personal).alias("c")).select(
        id_col, "classification", F.col("c.name").alias("name"))


def lineage_edges(df: DataFrame, path: str | Column, *keep: str) -> DataFrame:
    """Ordered ``(position, source, target)`` edges of a path kept as an array: no shuffle, no window."""
    nodes = F.col(path) if isinstance(path, str) else path
    edge = F.transform(
        F.slice(nodes, F.lit(2), F.greatest(F.size(nodes) - 1, F.lit(0))),
        lambda target, i: F.struct(F.element_at(nodes, i + 1).alias("source"), target.alias("target")))
    return df.select(*keep, F.posexplode(edge).alias("position", "_edge")).select(*keep, "position", "_edge.*")


#: Sketches of 2**12 registers: the relative standard error of a distinct count is about 1.6 %.
SKETCH_BITS = 12


def partial_profiles(df: DataFrame, by: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """Profiles of parts of a table that can be merged: ``part, column_name`` with counts, bounds, a sketch of the distinct values and, for
    numbers, one of their quantiles.

    Keep them beside the parts (a load, a day): the profile of any set of parts then needs no scan of their rows. Values are sketched
    and compared as text.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    chosen = [f.name for f in fields]
    numeric = {f.name for f in fields if isinstance(f.dataType, NumericType)}
    # Three aggregates read each text; as columns of their own they are made once.
    made = df.select(by.alias("part"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(chosen)],
                     *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(chosen) if c in numeric])
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(chosen):
        text = F.col(f"t{i}")
        aggs += [F.count(text).alias(f"n{i}"), F.min(text).alias(f"a{i}"), F.max(text).alias(f"b{i}"), F.hll_sketch_agg(text, F.lit(SKETCH_BITS)).alias(f"s{i}"),
                 (F.kll_sketch_agg_double(f"x{i}") if c in numeric else F.lit(None).cast("binary")).alias(f"q{i}")]
    cells = [F.struct(F.lit(c).alias("column_name"), F.col("_rows").alias("n_rows"), F.col(f"n{i}").alias("n_values"), F.col(f"a{i}").alias("least"),
                      F.col(f"b{i}").alias("greatest"), F.col(f"s{i}").alias("sketch"), F.when(F.col(f"n{i}") > 0, F.col(f"q{i}")).alias("quantiles")) for i, c in enumerate(chosen)]
    return made.groupBy("part").agg(*aggs).select("part", F.inline(F.array(*cells)))


def merged_profile(parts: DataFrame) -> DataFrame:
    """One row a column for all parts together: rows, NULLs, bounds, the estimated number of distinct values and quartiles (rank error about 1 %)."""
    quantiles = F.kll_merge_agg_double("quantiles").alias("_quantiles")
    merged = parts.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), (F.sum("n_rows") - F.sum("n_values")).alias("n_null"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"), F.count("quantiles").alias("_sketched"), quantiles)
    at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    quartiles = F.when(F.col("_sketched") > 0, F.kll_sketch_get_quantile_double("_quantiles", at))
    return merged.withColumn("quartiles", quartiles).drop("_sketched", "_quantiles")


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, n_distinct``, exact: values are made distinct where they lie before any of them is sent, long ones as digests."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    made = df.select(*[F.col(f.name).cast("string").alias(f"t{i}") for i, f in enumerate(fields)])
    digest = lambda c: F.when(F.length(c) > 64, F.sha2(c, 256)).otherwise(c)
    # Numbers and times are never that long; a number stands for the column's name in what is sent.
    short = [isinstance(f.dataType, (NumericType, DatetimeType)) for f in fields]
    cells = F.array(*[F.struct(F.lit(i).alias("which"), (F.col(f"t{i}") if short[i] else digest(F.col(f"t{i}"))).alias("value")) for i in range(len(fields))])
    distinct = made.select(F.inline(cells)).where("value is not null").distinct().groupBy("which").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(i, f.name) for i, f in enumerate(fields)], "which int, column_name string")
    return names.join(distinct, "which", "left").na.fill(0, ["n_distinct"]).select("column_name", "n_distinct")


def profile(df: DataFrame, columns: Sequence[str] | None = None, distinct: str = "none") -> DataFrame:
    """Type, rows, NULL count, least and greatest value per column (none of nested ones), from one pass.

    ``distinct`` adds ``approx`` (sketch, still one pass) or ``exact`` value counts.
    """
    counters = {"approx": F.approx_count_distinct, "exact": F.count_distinct}
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggs, entries = [F.count(F.lit(1)).alias("_rows")], []
    for i, f in enumerate(fields):
        nested = isinstance(f.dataType, (ArrayType, MapType, StructType))
        value = F.col(f.name) + F.lit(0).cast(f.dataType) if isinstance(f.dataType, FractionalType) else F.col(f.name)  # a negative zero is zero
        bounds = [F.lit(None).cast("string")] * 2 if nested else [F.min(value).cast("string"), F.max(value).cast("string")]
        aggs += [F.count(f.name).alias(f"n{i}"), bounds[0].alias(f"a{i}"), bounds[1].alias(f"b{i}")]
        cells = [
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("_rows").alias("n_rows"), (F.col("_rows") - F.col(f"n{i}")).alias("n_null"),
            F.col(f"a{i}").alias("least"), F.col(f"b{i}").alias("greatest"),
        ]
        if distinct != "none":
            aggs.append(counters[distinct](f.name).alias(f"d{i}"))
            cells.append(F.col(f"d{i}").alias("n_distinct"))
        entries.append(F.struct(*cells))
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def masked(df: DataFrame, how: Mapping[str, str], salt: str = "") -> DataFrame:
    """``df`` with personal columns hashed (``hash``), overwritten letter by letter (``mask``) or emptied (``null``)."""
    kinds = {
        "hash": lambda c: pseudonym(c, salt),
        "mask": lambda c: F.mask(F.col(c).cast("string")),
        "null": lambda c: F.lit(None).cast(df.schema[c].dataType),
    }
    return df.withColumns({c: kinds[k](c) for c, k in how.items()})


def secure_view(df: DataFrame, entitlements: DataFrame, role: str, row_key: str, visible: Sequence[str]) -> DataFrame:
    """Rows whose ``row_key`` the role is entitled to, projected to the columns it may see."""
    allowed = entitlements.where(F.col("role") == role).select(row_key)
    return df.join(allowed, row_key, "left_semi").select(*visible)


def open_data(df: DataFrame, by: Sequence[str], done: Column, smallest: int | None = None) -> DataFrame:
    """Publishable completion rates; groups under ``smallest`` rows can be withheld."""
    rates = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(done.cast("int")) * 100, 2).alias("completion_pct"))
    return rates if smallest is None else rates.where(F.col("n") >= smallest)
