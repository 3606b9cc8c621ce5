"""Reads from a relational source, split over executors and filtered at the source."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession


def sql_literal(value: object) -> str:
    """A value as an SQL literal, quotes doubled."""
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, bool) or value is None:
        raise TypeError("a watermark is a date, a time, a number or a text")
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def increment_query(table: str, mark: str, watermark: object | None, columns: str = "*") -> str:
    """SELECT of the rows at or after the watermark; all rows on the first run."""
    text = f"SELECT {columns} FROM {table}"
    return text if watermark is None else f"{text} WHERE {mark} >= {sql_literal(watermark)}"


@dataclass(frozen=True)
class Database:
    """Where to read from; ``properties`` holds driver, user and fetch size."""

    url: str
    properties: Mapping[str, str] = field(default_factory=dict)

    def table_options(self, table: str, split_on: str | None = None, low: object = None, high: object = None,
                      splits: int | None = None) -> dict[str, str]:
        options = {"url": self.url, **self.properties, "dbtable": table}
        if split_on is not None:
            options |= {"partitionColumn": split_on, "lowerBound": str(low), "upperBound": str(high),
                        "numPartitions": str(splits)}
        return options

    def query_options(self, query: str) -> dict[str, str]:
        return {"url": self.url, **self.properties, "query": query}

    def read_table(self, spark: SparkSession, table: str, **split: object) -> DataFrame:
        """The table, read by ``splits`` concurrent range queries when ``split_on`` names a column.

        Filters and column choices made on the result are pushed into these queries.
        """
        return spark.read.format("jdbc").options(**self.table_options(table, **split)).load()

    def read_query(self, spark: SparkSession, query: str) -> DataFrame:
        return spark.read.format("jdbc").options(**self.query_options(query)).load()

    def read_increment(self, spark: SparkSession, table: str, mark: str, watermark: object | None) -> DataFrame:
        return self.read_query(spark, increment_query(table, mark, watermark))
