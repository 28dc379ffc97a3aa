"""Small expressions that several operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, and -0.0 made 0.0, so that sums in another order give the same rows."""
    return df.select(*(((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes))


def ratio(a, b):
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def written(df: DataFrame) -> DataFrame:
    """df from a table in the folder that spark.checkpoint.dir names: the lineage of an iteration ends here.

    A folder of our own is used only where the setting is unset, as in tests on one machine.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='terrane-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def squared_distance(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)


def coin_p(k, n):
    """Two-sided exact binomial test at one half: twice the lesser tail, 1 where it is the middle. Terms go by logarithms."""
    least = F.least(k, n - k)
    start = F.struct((n * F.lit(-0.6931471805599453)).cast("double").alias("log"), F.lit(0.0).alias("sum"))
    term = lambda acc, i: acc["log"] + F.when(i > 0, F.ln((n - i + 1) / F.greatest(i, F.lit(1)))).otherwise(0.0)
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), least.cast("long")), start, lambda acc, i: F.struct(term(acc, i).alias("log"), (acc["sum"] + F.exp(term(acc, i))).alias("sum")), lambda acc: acc["sum"])
    return F.when(2 * least >= n, 1.0).otherwise(F.least(2 * tail, F.lit(1.0)))


def mean_rank(order, *group: str):
    """Rank with ties at their mean, from 1."""
    from pyspark.sql import Window

    by = Window.partitionBy(*group).orderBy(order)
    same = Window.partitionBy(*group, order)
    return F.rank().over(by) + (F.count("*").over(same) - 1) / 2


def row_numbers(df: DataFrame, group: list[str], order: list, name: str = "n") -> DataFrame:
    """df with a number from 1 in each group by an order, for groups of any size.

    Rows are range-partitioned by group and order, numbered inside their partition, and moved on by the counts of the
    partitions before: a row for each partition and group. ``order`` should be total, or numbers of ties are arbitrary.
    """
    from pyspark.sql import Window

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = written(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part", *group).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    same = placed["_part"] == counts["_part"]
    for c in group:
        same = same & placed[c].eqNullSafe(counts[c])
    joined = placed.join(counts.select("_before", "_part", *group), same).drop(counts["_part"], *(counts[c] for c in group))
    inside = Window.partitionBy("_part", *group).orderBy(*keys[len(group) :])
    return joined.withColumn(name, F.col("_before") + F.row_number().over(inside)).drop("_part", "_before")
