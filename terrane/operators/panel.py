"""Panels: long tables of (entity, period, category, value), and what keeps them complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["entity", "period", "category"]


def panel(facts: DataFrame, entity, period, category, value) -> DataFrame:
    """Facts summed to (entity, period, category, value)."""
    return facts.groupBy(entity.alias("entity"), period.alias("period"), category.alias("category")).agg(F.sum(value).alias("value"))


def coverage(cells: DataFrame) -> DataFrame:
    """entity, present (positive cells), wanted (periods x categories of the whole panel)."""
    size = cells.agg((F.countDistinct("period") * F.countDistinct("category")).alias("wanted"))
    have = cells.groupBy("entity").agg(F.count_if(F.col("value") > 0).alias("present"))
    return have.crossJoin(F.broadcast(size))  # one row


def complete_panel(cells: DataFrame) -> DataFrame:
    """Cells of the entities that have a positive value in every cell."""
    whole = coverage(cells).where("present = wanted").select("entity")
    return cells.join(whole, "entity", "left_semi")


def dropped_entities(cells: DataFrame) -> DataFrame:
    """entity, missing (absent or non-positive cells), reason: the others."""
    lost = coverage(cells).where("present < wanted")
    return lost.select("entity", (F.col("wanted") - F.col("present")).alias("missing"), F.lit("incomplete series").alias("reason"))


def totals(cells: DataFrame) -> DataFrame:
    """entity, period, total over categories."""
    return cells.groupBy("entity", "period").agg(F.sum("value").alias("total"))


def unit_table(cells: DataFrame) -> DataFrame:
    """entity, category, mean_value, total_mean and share: mean spend over periods in plain units."""
    mean = cells.groupBy("entity", "category").agg(F.avg("value").alias("mean_value"))
    whole = mean.withColumn("total_mean", F.sum("mean_value").over(Window.partitionBy("entity")))
    return whole.withColumn("share", F.col("mean_value") / F.col("total_mean"))


def valid_version(versions: DataFrame, key: str, year: int) -> DataFrame:
    """Of each key the version valid in a year, [year_from, year_to), else its latest; ties by year_from, last first."""
    inside = (F.col("year_from") <= year) & (year < F.col("year_to"))
    best = Window.partitionBy(key).orderBy(F.desc(inside), F.desc("year_to"), F.desc("year_from"))
    return versions.withColumn("exact", inside).withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def spread_categories(cells: DataFrame, categories: list[str]) -> DataFrame:
    """Wide form: entity, period and a column for each of the categories given."""
    return cells.groupBy("entity", "period").pivot("category", categories).agg(F.min("value"))

