"""Features of entities relative to the cross-section, on long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_total(cells: DataFrame) -> DataFrame:
    """entity, period, x: log total less the period's median over entities."""
    total = cells.groupBy("entity", "period").agg(F.ln(F.sum("value")).alias("x"))
    return centred(total, ["period"])


def centred(df: DataFrame, by: list[str]) -> DataFrame:
    """x less its exact median in each group of ``by``."""
    middle = df.groupBy(*by).agg(F.median("x").alias("middle"))
    return df.join(middle, by).withColumn("x", F.col("x") - F.col("middle")).drop("middle")


def log_ratios(cells: DataFrame) -> DataFrame:
    """entity, period, category, x: centred log-ratio of a cell to the geometric mean of its entity and period."""
    log = cells.select("entity", "period", "category", F.ln("value").alias("x"))
    return log.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("entity", "period")))


def own_deviation(df: DataFrame, by: list[str]) -> DataFrame:
    """x less its mean over time in each group of ``by``."""
    return df.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy(*by)))


def level(cells: DataFrame) -> DataFrame:
    return log_total(cells).groupBy("entity").agg(F.avg("x").alias("level"))


def profile(cells: DataFrame) -> DataFrame:
    """entity, category, profile: mean log-ratio less the cross-section's median."""
    return centred(log_ratios(cells), ["period", "category"]).groupBy("entity", "category").agg(F.avg("x").alias("profile"))


def season(cells: DataFrame, high: list[int], category: str) -> DataFrame:
    """entity, season_amp, high_all, high_category: deviation (population), and mean in the months ``high`` of the total and of one category."""
    in_high = F.month("period").isin(high)
    total = own_deviation(log_total(cells), ["entity"])
    total = total.groupBy("entity").agg(F.stddev_pop("x").alias("season_amp"), F.avg(F.when(in_high, F.col("x"))).alias("high_all"))
    one = cells.where(F.col("category") == category).select("entity", "period", F.ln("value").alias("x"))
    one = own_deviation(centred(one, ["period"]), ["entity"])
    return total.join(one.groupBy("entity").agg(F.avg(F.when(in_high, F.col("x"))).alias("high_category")), "entity", "left")


def series(cells: DataFrame) -> DataFrame:
    """entity, period, channel, x: own deviations of each category and of the total ('total'), less the cross-section."""
    each = centred(cells.select("entity", "period", "category", F.ln("value").alias("x")), ["period", "category"])
    whole = log_total(cells).withColumn("category", F.lit("total")).select("entity", "period", "category", "x")
    both = each.select("entity", "period", "category", "x").unionByName(whole)
    return own_deviation(both, ["entity", "category"]).withColumnRenamed("category", "channel")


def windows(cells: DataFrame, length: int, step: int) -> DataFrame:
    """cells repeated for each sliding window that holds them: window (index of its first period) and place in it.

    Periods are numbered once (they are few); each cell is exploded to its windows, with no self-join.
    """
    number = cells.select("period").distinct().withColumn("t", F.row_number().over(Window.orderBy("period")) - 1)
    last = number.agg((F.max("t") - (length - 1)).alias("last"))
    lo = F.ceil(F.greatest(F.col("t") - (length - 1), F.lit(0)) / step).cast("int")
    hi = F.floor(F.least(F.col("t"), F.col("last")) / step).cast("int")
    placed = cells.join(F.broadcast(number), "period").crossJoin(F.broadcast(last)).where(lo <= hi)
    placed = placed.withColumn("window", F.explode(F.sequence(lo, hi))).withColumn("window", F.col("window") * step)
    return placed.withColumn("place", F.col("t") - F.col("window")).drop("t", "last")


def window_level(cells: DataFrame, length: int, step: int) -> DataFrame:
    """window, entity, level and season_amp in each sliding window."""
    x = windows(log_total(cells), length, step)
    return x.groupBy("window", "entity").agg(F.avg("x").alias("level"), F.stddev_pop("x").alias("season_amp"))


def window_features(cells: DataFrame, length: int, step: int, high: list[int], category: str) -> DataFrame:
    """window, entity, block, feature, value: in each sliding window the level, the profile of each category, and the season's
    amplitude and means in the months ``high``, of the total and of one category, relative to the window's own mean."""
    in_high = lambda x: F.avg(F.when(F.month("period").isin(high), x)) - F.avg(x)
    total = windows(log_total(cells), length, step).groupBy("window", "entity")
    total = total.agg(F.avg("x").alias("level"), F.stddev_pop("x").alias("season_amp"), in_high(F.col("x")).alias("high_all"))
    ratios = windows(centred(log_ratios(cells), ["period", "category"]), length, step).groupBy("window", "entity", "category").agg(F.avg("x").alias("value"))
    one = centred(cells.where(F.col("category") == category).select("entity", "period", F.ln("value").alias("x")), ["period"])
    one = windows(one, length, step).groupBy("window", "entity").agg(in_high(F.col("x")).alias("high_category"))
    each = total.join(one, ["window", "entity"], "left").unpivot(["window", "entity"], ["level", "season_amp", "high_all", "high_category"], "feature", "value")
    each = each.select("window", "entity", F.when(F.col("feature") == "level", "level").otherwise("season").alias("block"), "feature", "value")
    return each.union(ratios.select("window", "entity", F.lit("profile"), "category", "value"))


def fit_scaler(long: DataFrame, block_weights: dict[str, float]) -> DataFrame:
    """feature, block, center (median), scale (interquartile range; sample deviation where that is 0), weight.

    long: entity, block, feature, value. A block's weight is shared by its features' number's root.
    """
    weight = F.coalesce(*(F.when(F.col("block") == k, F.lit(float(v))) for k, v in block_weights.items()))
    quartiles = long.groupBy("block", "feature").agg(
        F.median("value").alias("center"), (F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25))).alias("iqr"), F.stddev_samp("value").alias("sd")
    )
    quartiles = quartiles.withColumn("scale", F.when(F.col("iqr") > 1e-12, F.col("iqr")).otherwise(F.col("sd") + 1e-12))
    shared = weight / F.sqrt(F.count("*").over(Window.partitionBy("block")))
    return quartiles.select("block", "feature", "center", "scale", shared.alias("weight"))


def transform(long: DataFrame, scaler: DataFrame) -> DataFrame:
    """value less its center, by its scale, times its weight. The scaler has a row for each feature."""
    return long.join(scaler, ["block", "feature"]).withColumn("value", (F.col("value") - F.col("center")) / F.col("scale") * F.col("weight")).drop("center", "scale", "weight")


def deviations(long: DataFrame) -> DataFrame:
    """cluster, feature, deviation of a cluster's mean from the grand mean, relative to it; long: entity, cluster, feature, value."""
    grand = long.groupBy("feature").agg(F.avg("value").alias("grand"))
    own = long.groupBy("cluster", "feature").agg(F.avg("value").alias("own"))
    return own.join(grand, "feature").select("cluster", "feature", F.try_divide(F.col("own") - F.col("grand"), "grand").alias("deviation"))


def change(cells: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Period-on-period difference within a key."""
    return cells.withColumn("change", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order)))
