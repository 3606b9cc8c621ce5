"""Aggregate expressions and a small registry of named, composable measures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclake.functions.text import col

MONEY = "decimal(18,2)"


def divide(numerator: Column, denominator: Column, otherwise: float | None = 0.0) -> Column:
    """Division that yields ``otherwise`` for a missing or zero denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(otherwise))


def day(value: str | Column) -> Column:
    """A reporting day given as ISO text or as an expression."""
    return F.lit(value).cast("date") if isinstance(value, str) else value


def rows() -> Column:
    return F.count(F.lit(1))


def rows_where(condition: Column) -> Column:
    return F.count_if(condition)


def share(condition: Column, otherwise: float | None = 0.0) -> Column:
    """Fraction of rows meeting ``condition``; rows where it is NULL count against it."""
    return divide(rows_where(condition), rows(), otherwise)


def percent(condition: Column, digits: int | None = None) -> Column:
    value = divide(rows_where(condition) * 100.0, rows(), None)
    return value if digits is None else F.round(value, digits)


def money(c: str | Column) -> Column:
    """Exact decimal sum, so that the result does not depend on the order of the rows."""
    return F.sum(col(c).cast(MONEY))


def days_between(start: str | Column, end: str | Column) -> Column:
    return F.datediff(col(end), col(start))


# Bands and day limits shared by reports.
SLA_DAYS = {"Emergency": 1, "Urgent": 5, "Routine": 28}
SLA_DAYS_OTHER = 28
ARREARS_LIMITS = ((200, "Low Risk"), (500, "Medium Risk"), (1000, "High Risk"))
KPI_TARGETS = {"collection_rate_pct": 95.5, "sla_compliance_pct": 90.0}


def sla_days(priority: str | Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in SLA_DAYS.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, col(priority)), F.lit(SLA_DAYS_OTHER))


def arrears_band(balance: str | Column, credit_band: bool = False) -> Column:
    """Arrears risk of a balance. A missing balance owes nothing; credits are low risk unless split out."""
    owed = F.coalesce(col(balance), F.lit(0))
    band = F.when(owed == 0, "No Arrears")
    if credit_band:
        band = band.when(owed < 0, "In Credit")
    for limit, label in ARREARS_LIMITS:
        band = band.when(owed <= limit, label)
    return band.otherwise("Critical")


def score_band(score: str | Column, high: float, medium: float, inclusive: bool = True,
               labels: tuple[str, str, str] = ("high", "medium", "low")) -> Column:
    value = col(score)
    above = (lambda limit: value >= limit) if inclusive else (lambda limit: value > limit)
    return F.when(above(high), labels[0]).when(above(medium), labels[1]).when(value.isNotNull(), labels[2])


class Measures:
    """Named aggregate expressions that later measures may build on."""

    def __init__(self) -> None:
        self._by_name: dict[str, Column] = {}

    def add(self, name: str, expression: Column) -> "Measures":
        self._by_name[name] = expression
        return self

    def __getitem__(self, name: str) -> Column:
        return self._by_name[name]

    def names(self) -> list[str]:
        return list(self._by_name)

    def evaluate(self, df: DataFrame, names: Iterable[str] | None = None, by: Iterable[str] = ()) -> DataFrame:
        """All requested measures in one aggregation over ``df``."""
        chosen = list(names) if names is not None else self.names()
        return df.groupBy(*by).agg(*[self._by_name[n].alias(n) for n in chosen])
