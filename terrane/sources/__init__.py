"""Readers with explicit schemas, and writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """A Parquet table; columns and filters reach the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A CSV file with a header; the schema keeps codes as strings, so leading zeros stay. A byte order mark is skipped."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, enforceSchema=True, encoding="UTF-8")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON list of records, or one record a line."""
    reader = spark.read.option("multiLine", True)
    return reader.json(path, schema=schema) if schema else reader.json(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A folder of CSV files with headers; arrays and structs as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df = df.select(*flat)
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, digits: int = 6) -> None:
    """A folder of JSON lines; doubles rounded, what isn't finite as null."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, digits)).alias(c)
    df.select(*(finite(c) if t == "double" else F.col(c) for c, t in df.dtypes)).write.mode("overwrite").option("ignoreNullFields", False).json(path)
