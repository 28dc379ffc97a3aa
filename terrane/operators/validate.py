"""Matching outside tables to entities, and checks of labels against them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.shared import mean_rank, row_numbers


def weighted_mean(rows: DataFrame, key: str, value: str, weight: str, parts: list[str]) -> DataFrame:
    """key, value: mean weighted by ``weight`` (null: 0), plain where a value is null or no weight is; and parts as sums, null
    where all are null."""
    w = F.coalesce(weight, F.lit(0.0))
    plain = (F.count_if(F.col(value).isNull()) > 0) | (F.sum(w) <= 0)
    mean = F.when(plain, F.avg(value)).otherwise(F.try_divide(F.sum(F.col(value) * w), F.sum(w)))
    return rows.groupBy(key).agg(mean.alias(value), *(F.sum(p).alias(p) for p in parts))


def fallback_match(entities: DataFrame, key: str, primary: DataFrame, secondary: DataFrame, columns: list[str], both: list[str]) -> DataFrame:
    """entities with columns of primary by key, and of secondary, as a whole row, where all of ``both`` are null in primary's."""
    names = [f"{c}_2" for c in columns]
    second = secondary.select(key, *(F.col(c).alias(n) for c, n in zip(columns, names)))
    joined = entities.join(primary.select(key, *columns), key, "left").join(second, key, "left")
    missing = F.lit(True)
    for c in both:
        missing = missing & F.col(c).isNull()
    joined = joined.withColumn("fallback", missing)
    picked = [F.when(F.col("fallback"), F.col(n)).otherwise(F.col(c)).alias(c) for c, n in zip(columns, names)]
    return joined.select(*entities.columns, *picked, "fallback")


def unique_name_join(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """rows with the columns of named whose key stands for one row only; ambiguous keys match nothing."""
    alone = named.withColumn("times", F.count("*").over(Window.partitionBy(key))).where("times = 1").drop("times")
    return rows.join(alone, key, "left")


def year_overlay(base: DataFrame, latest: DataFrame, key: str, columns: list[str], base_year: int, latest_year: int) -> DataFrame:
    """base with the latest row where there is one, and the year a row comes from."""
    later = latest.select(key, *(F.col(c).alias(f"{c}_later") for c in columns), F.lit(True).alias("hit"))
    joined = base.join(later, key, "left")
    picked = [F.when(F.col("hit"), F.col(f"{c}_later")).otherwise(F.col(c)).alias(c) for c in columns]
    return joined.select(key, *picked, F.when(F.col("hit"), latest_year).otherwise(base_year).alias("year"))


def rank_in_group(rows: DataFrame, group: str, value: str) -> DataFrame:
    """pct_rank: mean rank of ties over the group's size, and peers_below: share of the other members that are less."""
    size = F.count("*").over(Window.partitionBy(group))
    ranked = rows.withColumn("pct_rank", mean_rank(value, group) / size)
    return ranked.withColumn("peers_below", F.percent_rank().over(Window.partitionBy(group).orderBy(value)))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, rho from mean ranks."""

    def ranks(c: str, name: str) -> DataFrame:
        return row_numbers(rows.select(c), [], [c]).groupBy(c).agg(F.avg("n").alias(name))

    both = rows.select(x, y).join(ranks(x, "rx"), x).join(ranks(y, "ry"), y)
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.nullif(F.stddev_pop("rx") * F.stddev_pop("ry"), F.lit(0.0)))
    return both.agg(F.count("*").alias("n"), rho.alias("rho"))


def ols_residual(rows: DataFrame, x: str, y: str) -> DataFrame:
    """rows with residual of y after a straight line in x."""
    line = rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    fitted = rows.crossJoin(F.broadcast(line))  # one row
    return fitted.withColumn("residual", F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))).drop("slope", "intercept")


def binomial_p(k: int, n: int, p: float = 0.5) -> float:
    """Two-sided exact binomial test: the probability of outcomes no likelier than k."""
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(n + 1)]
    return min(1.0, sum(math.exp(x) for x in log if x <= log[k] + 1e-9))


def official_validity(labels: DataFrame, flags: DataFrame, names: list[str]) -> DataFrame:
    """flag, v: Cramer's V of labels (id, label) with each flag of flags (id, ...)."""
    from terrane.operators.quality import contingency, cramers_v

    joined, out = labels.join(flags, "id"), None
    for name in names:
        one = cramers_v(contingency(joined.where(F.col(name).isNotNull()), "label", name)).select(F.lit(name).alias("flag"), "v")
        out = one if out is None else out.union(one)
    return out


def label_profile(labels: DataFrame, flags: DataFrame, means: list[str], medians: list[str]) -> DataFrame:
    """label, and over its entities the means of some columns and the medians of others."""
    return labels.join(flags, "id").groupBy("label").agg(*(F.avg(c).alias(f"mean_{c}") for c in means), *(F.median(c).alias(f"median_{c}") for c in medians))


def label_flags(rows: DataFrame, flags: list[str], population: str) -> DataFrame:
    """Missing flags as 0 and the population's logarithm, null where it isn't positive."""
    return rows.select(
        *(c for c in rows.columns if c not in flags), *(F.coalesce(F.col(f).cast("int"), F.lit(0)).alias(f) for f in flags),
        F.when(F.col(population) > 0, F.ln(population)).alias(f"log_{population}"),
    )
