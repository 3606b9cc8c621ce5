"""Calendar series: to-date totals, rolling figures, prior-year comparison, backlog, forecast.

Facts are aggregated to days or months first, so every window below runs over a
table bounded by the calendar (times the dimension values), never over raw facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civiclake.functions.measures import divide


def month_index(c: str | Column) -> Column:
    """Months since year 0, so that neighbouring months differ by one."""
    day = F.col(c) if isinstance(c, str) else c
    return F.year(day) * 12 + F.month(day) - 1


def month_start(index: str | Column) -> Column:
    i = F.col(index) if isinstance(index, str) else index
    return F.make_date(F.floor(i / 12).cast("int"), (i % 12 + 1).cast("int"), F.lit(1))


def daily(df: DataFrame, day: str, dims: Sequence[str] = (), **measures: Column) -> DataFrame:
    return df.groupBy(*dims, F.col(day).alias("day")).agg(*[m.alias(n) for n, m in measures.items()])


def monthly(df: DataFrame, day: str, dims: Sequence[str] = (), **measures: Column) -> DataFrame:
    return df.groupBy(*dims, month_index(day).alias("month_idx")).agg(*[m.alias(n) for n, m in measures.items()])


def to_date(days: DataFrame, value: str, period: str, dims: Sequence[str] = ()) -> DataFrame:
    """Adds ``<value>_mtd`` or ``<value>_ytd``: the running total inside each month or year."""
    unit, suffix = {"month": ("MM", "mtd"), "year": ("YEAR", "ytd")}[period]
    w = Window.partitionBy(*dims, F.trunc("day", unit)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn(f"{value}_{suffix}", F.sum(value).over(w))


def rolling_months(months: DataFrame, value: str, n: int = 3, dims: Sequence[str] = ()) -> DataFrame:
    """Adds ``<value>_avg_<n>m``: mean over the last ``n`` calendar months that have rows."""
    w = Window.partitionBy(*dims).orderBy("month_idx").rangeBetween(-(n - 1), 0)
    return months.withColumn(f"{value}_avg_{n}m", F.avg(value).over(w))


def rolling_month_days(days: DataFrame, value: str, n: int = 3, dims: Sequence[str] = ()) -> DataFrame:
    """The inclusive day-range variant: from the same day ``n`` months back up to the day itself.

    The total over the range divided by the months it touches. Each reporting day
    unfolds into its range of days (about 31 n of them) and equi-joins the daily table.
    """
    reach = days.select(*dims, F.col("day").alias("report_day"),
                        F.explode(F.sequence(F.add_months("day", -n), F.col("day"))).alias("day"))
    touched = reach.join(days, [*dims, "day"])
    return touched.groupBy(*dims, "report_day").agg(
        (F.sum(value) / F.count_distinct(F.trunc("day", "MM"))).alias(f"{value}_avg_{n}m_days"))


def rolling_days(days: DataFrame, numerator: str, denominator: str, n: int, name: str, dims: Sequence[str] = ()) -> DataFrame:
    """Adds the ratio of two sums over the ``n`` days up to and including each day."""
    w = Window.partitionBy(*dims).orderBy(F.unix_date("day")).rangeBetween(-(n - 1), 0)
    return days.withColumn(name, divide(F.sum(numerator).over(w), F.sum(denominator).over(w)))


def prior_year(series: DataFrame, value: str, period: str, step: int, dims: Sequence[str] = ()) -> DataFrame:
    """Adds ``<value>_prior``: the value ``step`` periods back, by join, so gaps stay gaps."""
    shifted = series.select(*dims, (F.col(period) + step).alias(period), F.col(value).alias(f"{value}_prior"))
    return series.join(shifted, [*dims, period], "left")


def year_on_year(series: DataFrame, value: str, period: str, step: int, name: str, dims: Sequence[str] = ()) -> DataFrame:
    """Adds growth against the prior year, 0 where there is none."""
    both = prior_year(series, value, period, step, dims)
    return both.withColumn(name, divide(F.col(value) - F.col(f"{value}_prior"), F.col(f"{value}_prior")))


def calendar(df: DataFrame, first: Column, last: Column, dims: Sequence[str] = ()) -> DataFrame:
    """Every month between two aggregates of ``df`` with its attributes, empty months included."""
    span = df.groupBy(*dims).agg(first.alias("_first"), last.alias("_last"))
    months = span.select(*dims, F.explode(F.sequence(month_index("_first"), month_index("_last"))).alias("month_idx"))
    start = month_start("month_idx")
    return months.select(
        *dims, "month_idx", start.alias("month"), F.date_format(start, "yyyy-MM").alias("month_year"),
        F.month(start).alias("month_number"), F.year(start).alias("year"), F.quarter(start).alias("quarter"),
    )


def backlog(df: DataFrame, opened: str, closed: str, dims: Sequence[str]) -> DataFrame:
    """Items still open at each month end: everything opened less everything closed so far.

    Items are first counted by (month opened, month closed), which is bounded by the
    calendar; only these counts are unfolded, and no item is joined to its months.
    """
    spans = df.groupBy(*dims, month_index(opened).alias("_from"), month_index(closed).alias("_to")).agg(
        F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("long")
    moves = F.array_compact(F.array(
        F.struct(F.col("_from").alias("month_idx"), F.col("n").alias("opened"), none.alias("closed")),
        F.when(F.col("_to").isNotNull(),
               F.struct(F.col("_to").alias("month_idx"), none.alias("opened"), F.col("n").alias("closed"))),
    ))
    moved = spans.select(*dims, F.inline(moves)).groupBy(*dims, "month_idx").agg(
        F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))
    span = moved.groupBy(*dims).agg(F.min("month_idx").alias("a"), F.max("month_idx").alias("b"))
    months = span.select(*dims, F.explode(F.sequence("a", "b")).alias("month_idx"))
    w = Window.partitionBy(*dims).orderBy("month_idx").rowsBetween(Window.unboundedPreceding, 0)
    dense = months.join(moved, [*dims, "month_idx"], "left").na.fill(0, ["opened", "closed"])
    return dense.withColumn("open_at_month_end", F.sum(F.col("opened") - F.col("closed")).over(w))


def last_periods(series: DataFrame, n: int | None, index: str = "month_idx") -> DataFrame:
    """The final ``n`` periods (all of them for ``None``), re-based to ``pos`` 0, 1, ..."""
    first = series.agg(F.min(index) if n is None else F.greatest(F.min(index), F.max(index) - (n - 1)))
    placed = series.withColumn("pos", F.col(index) - first.scalar())
    return placed.where("pos >= 0")


def trend(series: DataFrame, value: str, dims: Sequence[str] = (), x: str = "pos") -> DataFrame:
    """Least-squares slope and intercept of ``value`` on ``x`` per group; NULL below two points."""
    n = F.count(value)
    return series.groupBy(*dims).agg(
        F.when(n > 1, F.regr_slope(value, x)).alias("slope"),
        F.when(n > 1, F.regr_intercept(value, x)).alias("intercept"),
        F.max(x).alias("last_x"),
    )


def forecast(series: DataFrame, value: str, horizon: int = 3, dims: Sequence[str] = (), x: str = "pos") -> DataFrame:
    """The trend line carried ``horizon`` periods past the end, without noise."""
    line = trend(series, value, dims, x)
    ahead = line.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    at = F.col("last_x") + F.col("step")
    return ahead.select(*dims, "step", at.alias(x), (F.col("intercept") + F.col("slope") * at).alias("forecast"))
