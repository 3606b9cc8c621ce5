"""CSV, JSON and GeoJSON feeds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclake.functions.text import header_name, numeric_cell, strip


def read_csv(spark: SparkSession, path: str, numeric: Iterable[str] | None = ()) -> DataFrame:
    """A CSV feed with tidy column names and trimmed cells; short rows are padded with NULL.

    Cells of ``numeric`` columns become doubles where they are plain unsigned numbers and
    NULL elsewhere. ``None`` finds these columns in one extra pass: those whose present
    cells are all numbers.
    """
    raw = spark.read.options(header=True, mode="PERMISSIVE", multiLine=False).csv(path)
    names = [header_name(c) for c in raw.columns]
    tidy = raw.toDF(*names).select(*[strip(c).alias(c) for c in names])
    if numeric is None:
        numeric = numeric_columns(tidy)
    wanted = set(numeric)
    return tidy.select(*[numeric_cell(c).alias(c) if c in wanted else F.col(c) for c in names])


def numeric_columns(df: DataFrame) -> list[str]:
    """Text columns that hold numbers only: one aggregation, one row back."""
    odd = [
        F.count_if((F.col(c) != "") & numeric_cell(c).isNull()).alias(f"bad{i}") for i, c in enumerate(df.columns)
    ]
    present = [F.count_if(F.col(c) != "").alias(f"any{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*odd, *present).first()
    return [c for i, c in enumerate(df.columns) if row[f"bad{i}"] == 0 and row[f"any{i}"] > 0]


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON-lines feed against a fixed schema; unreadable lines are kept in ``_corrupt_record``."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    kept = T.StructType([*wanted.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(kept).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


_POINT = "struct<type: string, coordinates: array<double>>"


def read_geojson(spark: SparkSession, path: str, properties: str, collection: bool = False,
                 geometry: str = _POINT) -> DataFrame:
    """Features as rows: their properties, geometry type and coordinates.

    The default is one feature per line, which splits across tasks; ``collection``
    reads FeatureCollection documents, one task per file.
    """
    feature = f"type string, geometry {geometry}, properties struct<{properties}>"
    if collection:
        docs = spark.read.schema(f"type string, features array<struct<{feature}>>").option("multiLine", True).json(path)
        features = docs.select(F.inline("features"))
    else:
        features = spark.read.schema(feature).json(path)
    return features.where("type = 'Feature'").select(
        "properties.*", F.col("geometry.type").alias("geometry_type"), F.col("geometry.coordinates").alias("coordinates"))
