"""Keeping one state per key: latest-row dedupe, upsert, SCD2 history, increments, retention."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HISTORY_COLUMNS = ("start_date", "end_date", "is_current", "_updated_at")


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_by: Sequence[str | Column],
                   ties: Sequence[str | Column] = ()) -> DataFrame:
    """The newest row of every key.

    The rank filter lets Spark keep one row per key in each map task before the
    shuffle (WindowGroupLimit), so a key that holds much of the table stays cheap.
    """
    order = [F.col(c).desc_nulls_last() if isinstance(c, str) else c for c in newest_by]
    order += [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in ties]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def with_audit(df: DataFrame, source_system: str, batch_id: str, ingested_at: datetime | str | None = None) -> DataFrame:
    """Append the landing columns every bronze row carries."""
    stamp = F.current_timestamp() if ingested_at is None else F.lit(ingested_at).cast("timestamp")
    return df.withColumns({
        "_ingested_at": stamp,
        "_source_system": F.lit(source_system),
        "_batch_id": F.lit(batch_id),
    })


def with_policy(df: DataFrame, classification: str, retention_years: int | None) -> DataFrame:
    """Append the classification and retention columns."""
    return df.withColumns({
        "_data_classification": F.lit(classification),
        "_retention_years": F.lit(retention_years).cast("int"),
    })


def as_of(bronze: DataFrame, keys: Sequence[str], moment: Column, ingested: str = "_ingested_at",
          ties: Sequence[str | Column] = ()) -> DataFrame:
    """The state a bronze history had at ``moment``: what had landed by then, newest per key."""
    return latest_per_key(bronze.where(F.col(ingested) <= moment), keys, [ingested], ties)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` with the rows of ``source`` replacing or joining it by key; a key that occurs twice in ``source`` fails the run."""
    source = require_unique(source, keys)
    kept = target.join(source.select(*keys), list(keys), "left_anti").select(*target.columns)
    return kept.unionByName(source, allowMissingColumns=True)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` unchanged, failing while it runs if a key occurs twice.

    Grouping happens on the merge keys, so the merge that follows reuses the shuffle.
    """
    others = [c for c in df.columns if c not in keys]
    if not others:
        others, df = ["_key_only"], df.withColumn("_key_only", F.lit(True))
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*others)).alias("_row"))
    message = F.concat(F.lit("duplicate merge key: "), F.to_json(F.struct(*keys)))
    checked = F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return grouped.where(checked).select(*keys, "_row.*").select(*[c for c in df.columns if c != "_key_only"])


def scd2(target: DataFrame, source: DataFrame, keys: Sequence[str], tracked: Sequence[str], on: date | str,
         updated_at: datetime | str | None = None, null_safe: bool = True, check_keys: bool = True) -> DataFrame:
    """The next state of a type-2 history table.

    One full outer join of the current versions with the source decides each key:
    untouched, closed and reopened with the new values, or new. Keys absent from the
    source stay current. Closed versions never enter the join.
    """
    business = [c for c in target.columns if c not in HISTORY_COLUMNS]
    day = F.lit(on).cast("date")
    stamp = (F.lit(updated_at) if updated_at is not None else day).cast("timestamp")
    incoming = require_unique(source, keys) if check_keys else source

    current = target.where("is_current").select(*keys, F.struct(*target.columns).alias("_old"))
    fresh = incoming.select(*keys, F.struct(*business).alias("_new"))
    both = current.join(fresh, list(keys), "full_outer")

    def differs(c: str) -> Column:
        old, new = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        return ~old.eqNullSafe(new) if null_safe else F.coalesce(old != new, F.lit(False))

    changed = reduce(lambda a, b: a | b, [differs(c) for c in tracked])
    types = {f.name: f.dataType for f in target.schema.fields}

    def version(parent: str, end: Column, is_current: Column, start: Column, updated: Column) -> Column:
        extra = {"start_date": start, "end_date": end, "is_current": is_current, "_updated_at": updated}
        return F.struct(*[
            (extra[c] if c in extra else F.col(f"{parent}.{c}")).cast(types[c]).alias(c) for c in target.columns
        ])

    opened = version("_new", F.lit(None), F.lit(True), day, stamp)
    closed = version("_old", day, F.lit(False), F.col("_old.start_date"), stamp)
    same = version("_old", F.col("_old.end_date"), F.lit(True), F.col("_old.start_date"), F.col("_old._updated_at"))
    versions = (
        F.when(F.col("_old").isNull(), F.array(opened))
        .when(F.col("_new").isNull() | ~changed, F.array(same))
        .otherwise(F.array(closed, opened))
    )
    moved = both.select(F.inline(versions)).select(*target.columns)
    return target.where("NOT is_current").unionByName(moved)


def scd2_counts(before: DataFrame, after: DataFrame, keys: Sequence[str], on: date | str) -> DataFrame:
    """One row: versions closed, versions opened, of which new keys."""
    day = F.lit(on).cast("date")
    known = before.select(*keys).distinct().withColumn("_known", F.lit(True))
    opened = F.col("is_current") & (F.col("start_date") == day)
    return after.join(known, list(keys), "left").agg(
        F.count_if(opened).alias("opened"),
        F.count_if(opened & F.col("_known").isNull()).alias("new_keys"),
        F.count_if(~F.col("is_current") & (F.col("end_date") == day)).alias("closed"),
    )


def increment(source: DataFrame, mark: str, watermark: object | None, keys: Sequence[str] = (),
              ties: Sequence[str | Column] = ()) -> DataFrame:
    """Rows at or after the high-water mark (all rows when there is none yet).

    The boundary is read again on purpose, so late rows with an equal mark are not
    lost; give ``keys`` to keep the newest row of each. The comparison is with a
    literal, which reaches the file or database scan.
    """
    delta = source if watermark is None else source.where(F.col(mark) >= F.lit(watermark))
    return latest_per_key(delta, keys, [mark], ties) if keys else delta


def advance(control: DataFrame, pipeline: str, delta: DataFrame, mark: str) -> DataFrame:
    """The control table after a load: the mark moves to the newest value loaded, never back."""
    newest = delta.agg(F.max(mark).alias("_new")).select(F.lit(pipeline).alias("pipeline_name"), "_new")
    value = F.greatest("watermark_value", "_new")  # skips NULL on either side
    return control.join(newest, "pipeline_name", "full_outer").select("pipeline_name", value.alias("watermark_value"))


def watermark_of(control: DataFrame, pipeline: str) -> object | None:
    """The stored mark of a pipeline: a single value, read to the driver."""
    return control.where(F.col("pipeline_name") == pipeline).agg(F.max("watermark_value")).first()[0]


def expired(basis: str | Column, years: str | Column, today: Column) -> Column:
    """True once ``years`` have passed since ``basis``; NULL years means keep for ever."""
    start = F.col(basis) if isinstance(basis, str) else basis
    span = F.col(years) if isinstance(years, str) else years
    return F.coalesce(F.add_months(start, span * 12) < today, F.lit(False))


def purge(df: DataFrame, basis: str, years: str, today: Column) -> DataFrame:
    return df.where(~expired(basis, years, today))


def purge_audit(df: DataFrame, basis: str, years: str, today: Column, by: Sequence[str]) -> DataFrame:
    """Rows kept and purged per group, in one pass."""
    gone = expired(basis, years, today)
    return df.groupBy(*by).agg(F.count_if(gone).alias("purged"), F.count_if(~gone).alias("kept"))
