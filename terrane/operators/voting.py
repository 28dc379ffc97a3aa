"""Voting rules over ballots: long tables (candidate, voter, score), greater scores better."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.shared import written


def ballots(wide: DataFrame, key: str, directions: dict[str, int]) -> DataFrame:
    """candidate, voter, score: each index of a wide table as a voter, turned so that greater is better; an index with a null
    anywhere does not vote."""
    stack = ", ".join(f"'{c}', cast(`{c}` as double) * {d}" for c, d in directions.items())
    long = wide.select(F.col(key).alias("candidate"), F.expr(f"stack({len(directions)}, {stack}) as (voter, score)"))
    full = long.groupBy("voter").agg(F.count_if(F.col("score").isNull()).alias("gaps")).where("gaps = 0").select("voter")
    return long.join(full, "voter", "left_semi").select("candidate", "voter", "score")


def duels(votes: DataFrame) -> DataFrame:
    """a, b, prefer, against: voters that put a above b, and b above a. Rows: candidates by candidates."""
    a, b = (votes.select("voter", F.col("candidate").alias(k), F.col("score").alias(f"s_{k}")) for k in "ab")
    met = a.join(b, "voter").where("a <> b")
    return met.groupBy("a", "b").agg(F.count_if(F.col("s_a") > F.col("s_b")).alias("prefer"), F.count_if(F.col("s_a") < F.col("s_b")).alias("against"))


def copeland(votes: DataFrame) -> DataFrame:
    """candidate, score: duels won less duels lost."""
    won = F.signum((F.col("prefer") - F.col("against")).cast("double"))
    return duels(votes).groupBy(F.col("a").alias("candidate")).agg(F.sum(won).alias("score"))


def borda(votes: DataFrame) -> DataFrame:
    """candidate, score: over voters, the candidates below, and half of those level."""
    below = F.rank().over(Window.partitionBy("voter").orderBy("score")) - 1
    level = F.count("*").over(Window.partitionBy("voter", "score")) - 1
    return votes.withColumn("points", below + level / 2).groupBy("candidate").agg(F.sum("points").alias("score"))


def schulze(votes: DataFrame) -> DataFrame:
    """candidate, score: candidates beaten by the strength of the widest path.

    Paths double in length each round, so the rounds are the logarithm of the number of candidates.
    """
    duel = written(duels(votes).withColumn("p", F.when(F.col("prefer") > F.col("against"), F.col("prefer")).otherwise(0)).select("a", "b", "p"))
    n = duel.select("a").distinct().count()
    paths, length = duel, 1
    while length < n:
        x, y = paths.select("a", F.col("b").alias("via"), F.col("p").alias("p1")), paths.select(F.col("a").alias("via"), "b", F.col("p").alias("p2"))
        longer = x.join(y, "via").where("a <> b").select("a", "b", F.least("p1", "p2").alias("p"))
        paths = written(paths.union(longer).groupBy("a", "b").agg(F.max("p").alias("p")))
        length *= 2
    back = paths.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("p").alias("q"))
    return paths.join(back, ["a", "b"]).groupBy(F.col("a").alias("candidate")).agg(F.count_if(F.col("p") > F.col("q")).cast("double").alias("score"))


def threshold(votes: DataFrame, grades: int = 3) -> DataFrame:
    """candidate, score: fewest worst grades first, then fewest second worst, and so on; equal counts, equal scores.

    Grades are equal parts of a voter's order; ties in it are broken by candidate.
    """
    place = F.row_number().over(Window.partitionBy("voter").orderBy("score", "candidate")) - 1
    n = F.count("*").over(Window.partitionBy("voter"))
    graded = votes.withColumn("grade", F.least(F.floor(place * grades / n), F.lit(grades - 1)))
    counts = graded.groupBy("candidate").agg(*(F.count_if(F.col("grade") == g).alias(f"g{g}") for g in range(grades - 1)))
    rank = F.rank().over(Window.orderBy(*(f"g{g}" for g in range(grades - 1))))  # candidates: few
    total = F.count("*").over(Window.partitionBy())
    return counts.select("candidate", (total - rank + 1).cast("double").alias("score"))


RULES = {"copeland": copeland, "borda": borda, "schulze": schulze, "threshold_3": threshold, "threshold_5": lambda v: threshold(v, 5)}


def rule_table(votes: DataFrame, chosen) -> DataFrame:
    """rule, winners, ties, chosen_rank, chosen_wins, chosen_alone for each rule and one chosen candidate."""
    scored = None
    for name, rule in RULES.items():
        one = rule(votes).select(F.lit(name).alias("rule"), "candidate", F.col("score").cast("double").alias("score"))
        scored = one if scored is None else scored.union(one)
    placed = scored.withColumn("place", F.rank().over(Window.partitionBy("rule").orderBy(F.desc("score"))))
    top = F.array_sort(F.collect_list(F.when(F.col("place") == 1, F.col("candidate").cast("string"))))
    found = placed.groupBy("rule").agg(F.array_join(top, "; ").alias("winners"), F.size(top).alias("ties"), F.max(F.when(F.col("candidate") == chosen, F.col("place"))).alias("chosen_rank"))
    return found.withColumn("chosen_wins", F.col("chosen_rank") == 1).withColumn("chosen_alone", (F.col("chosen_rank") == 1) & (F.col("ties") == 1))


def detailed_choice(table: DataFrame, least_k: int, least_stability: float) -> DataFrame:
    """method, k: of each method (method, k, stability) the least k at or over both floors."""
    return table.where((F.col("k") >= least_k) & (F.col("stability") >= least_stability)).groupBy("method").agg(F.min("k").alias("k"))


def largest_share(sweep: DataFrame, tolerance: float) -> DataFrame:
    """One row: the largest share of sweep(share, sw) whose sw is within a tolerance of that at the least share."""
    base = F.first("sw").over(Window.orderBy("share"))  # a row for each share tried
    return sweep.withColumn("base", base).where(F.col("sw") >= F.col("base") - tolerance).agg(F.max("share").alias("share"))
