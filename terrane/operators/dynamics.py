"""How labels change between windows; labels are long: id, window, label (and confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.shared import coin_p, ratio, written


def transition_matrix(labels: DataFrame, first: int, last: int) -> DataFrame:
    """a, b, n: entities by label in two windows, with the empty cells of the labels that occur."""
    x = labels.where(F.col("window") == first).select("id", F.col("label").alias("a"))
    y = labels.where(F.col("window") == last).select("id", F.col("label").alias("b"))
    names = labels.select("label").distinct()
    grid = names.withColumnRenamed("label", "a").crossJoin(names.withColumnRenamed("label", "b"))  # labels by labels
    counts = x.join(y, "id").groupBy("a", "b").agg(F.count("*").alias("n"))
    return grid.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def row_shares(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("share", F.coalesce(F.try_divide("n", F.sum("n").over(Window.partitionBy("a"))), F.lit(0.0)))


def confident_moves(labels: DataFrame, first: int, last: int, least: float) -> DataFrame:
    """id, a, b: entities whose label differs between two windows, with a confidence of at least ``least`` in both."""
    x = labels.where((F.col("window") == first) & (F.col("confidence") >= least)).select("id", F.col("label").alias("a"))
    y = labels.where((F.col("window") == last) & (F.col("confidence") >= least)).select("id", F.col("label").alias("b"))
    return x.join(y, "id").where("a <> b")


def move_counts(labels: DataFrame, first: int, last: int, levels: list[float]) -> DataFrame:
    """least, moves for each level of confidence."""
    grid = labels.sparkSession.createDataFrame([(float(x),) for x in levels], "least double")
    x = labels.where(F.col("window") == first).select("id", F.col("label").alias("a"), F.col("confidence").alias("ca"))
    y = labels.where(F.col("window") == last).select("id", F.col("label").alias("b"), F.col("confidence").alias("cb"))
    moved = x.join(y, "id").where("a <> b").withColumn("sure", F.least("ca", "cb"))
    hit = moved.crossJoin(F.broadcast(grid)).where("sure >= least").groupBy("least").agg(F.count("*").alias("moves"))  # a few levels
    return grid.join(hit, "least", "left").select("least", F.coalesce("moves", F.lit(0)).alias("moves"))


def persistent_moves(labels: DataFrame, run: int = 3) -> DataFrame:
    """id, a, b: one label over the first ``run`` windows, another over the last."""
    number = labels.select("window").distinct().withColumn("t", F.row_number().over(Window.orderBy("window")) - 1)  # windows: few
    total = number.agg(F.count("*").alias("total"))
    rows = labels.join(F.broadcast(number), "window").crossJoin(F.broadcast(total))
    early, late = F.col("t") < run, F.col("t") >= F.col("total") - run
    found = rows.groupBy("id").agg(
        F.min(F.when(early, F.col("label"))).alias("a"), F.max(F.when(early, F.col("label"))).alias("a2"), F.min(F.when(late, F.col("label"))).alias("b"), F.max(F.when(late, F.col("label"))).alias("b2")
    )
    return found.where("a = a2 and b = b2 and a <> b").select("id", "a", "b")


def flow_asymmetry(moves: DataFrame, least: int = 10) -> DataFrame:
    """a, b, forward, backward, p for pairs of labels a < b with at least ``least`` moves both ways together; p: of a fair coin."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    found = moves.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.count_if(F.col("a") < F.col("b")).alias("forward"), F.count_if(F.col("a") > F.col("b")).alias("backward"))
    return found.where(F.col("forward") + F.col("backward") >= least).select(F.col("lo").alias("a"), F.col("hi").alias("b"), "forward", "backward", coin_p(F.col("forward"), F.col("forward") + F.col("backward")).alias("p"))


def consecutive_counts(labels: DataFrame) -> DataFrame:
    """window (the later one), a, b, n for each pair of consecutive windows; windows are numbered without gaps."""
    later = labels.select("id", F.col("window"), F.col("label").alias("b"))
    earlier = labels.select("id", (F.col("window") + 1).alias("window"), F.col("label").alias("a"))
    return earlier.join(later, ["id", "window"]).groupBy("window", "a", "b").agg(F.count("*").alias("n"))


def consecutive_ari(labels: DataFrame) -> DataFrame:
    """window (the later one), ari of its labels against the window's before."""
    counts = written(consecutive_counts(labels))
    pairs = lambda n: n * (n - 1) / 2
    both = counts.groupBy("window").agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("all"))
    for c in "ab":
        side = counts.groupBy("window", c).agg(F.sum("n").alias("n")).groupBy("window").agg(F.sum(pairs(F.col("n"))).alias(f"in_{c}"))
        both = both.join(side, "window")
    expected, most = ratio(F.col("in_a") * F.col("in_b"), pairs(F.col("all"))), (F.col("in_a") + F.col("in_b")) / 2
    return both.select("window", F.when(most == expected, 1.0).otherwise(F.try_divide(F.col("both") - expected, most - expected)).alias("ari"))


def monic(labels: DataFrame, tau: float = 0.5, split: float = 0.25, delta: float = 0.05) -> DataFrame:
    """window, event, label, to, overlap, size_from, size_to, internal, absorbed: what becomes of each cluster in the next window.

    A cluster survives in the cluster that takes at least tau of it (the most; ties to the least label), or is absorbed if
    another cluster does too; it splits where several parts of at least ``split`` each make up tau; else it disappears.
    Clusters of the later window that no one turned into emerge.
    """
    counts = written(consecutive_counts(labels))  # labels by labels by windows, used many times
    sizes_a = counts.groupBy("window", "a").agg(F.sum("n").alias("size_from"))
    sizes_b = counts.groupBy("window", "b").agg(F.sum("n").alias("size_to"))
    over = counts.join(sizes_a, ["window", "a"]).join(sizes_b, ["window", "b"]).withColumn("overlap", F.col("n") / F.col("size_from"))
    strong = over.where(F.col("overlap") >= tau)
    best = Window.partitionBy("window", "a").orderBy(F.desc("overlap"), "b")
    kept = strong.withColumn("place", F.row_number().over(best)).where("place = 1")
    takers = strong.groupBy("window", "b").agg(F.array_sort(F.collect_list("a")).alias("all"))
    kept = kept.join(takers, ["window", "b"])
    grown = F.when(F.col("size_to") > F.col("size_from") * (1 + delta), "grow").when(F.col("size_to") < F.col("size_from") * (1 - delta), "shrink").otherwise("")
    survive = kept.select(
        "window", F.when(F.size("all") > 1, "absorb").otherwise("survive").alias("event"), F.col("a").alias("label"), F.array("b").alias("to"),
        "overlap", "size_from", F.col("size_to").cast("long").alias("size_to"), grown.alias("internal"), F.array_remove("all", F.col("a")).alias("absorbed"),
    )
    weak = over.join(strong.select("window", "a").distinct(), ["window", "a"], "left_anti")
    part = F.col("overlap") >= split
    weak = weak.groupBy("window", "a").agg(
        F.array_sort(F.collect_list(F.when(part, F.col("b")))).alias("to"), F.sum(F.when(part, F.col("overlap"))).alias("parts"), F.max("overlap").alias("most"), F.max("size_from").alias("size_from")
    )
    parted = (F.size("to") >= 2) & (F.coalesce("parts", F.lit(0.0)) >= tau)
    weak = weak.select(
        "window", F.when(parted, "split").otherwise("disappear").alias("event"), F.col("a").alias("label"), F.when(parted, F.col("to")).otherwise(F.slice("to", 1, 0)).alias("to"),
        F.when(parted, F.col("parts")).otherwise(F.col("most")).alias("overlap"), "size_from", F.lit(None).cast("long").alias("size_to"), F.lit("").alias("internal"), F.slice("to", 1, 0).alias("absorbed"),
    )
    targets = survive.union(weak).select("window", F.explode("to").alias("b")).distinct()
    fresh = over.join(targets, ["window", "b"], "left_anti").groupBy("window", "b").agg(F.max("overlap").alias("overlap"), F.max("size_to").alias("size_to"))
    empty = F.slice(F.array("b"), 1, 0)
    emerge = fresh.select(
        "window", F.lit("emerge").alias("event"), F.col("b").alias("label"), empty.alias("to"), "overlap", F.lit(None).cast("long").alias("size_from"),
        F.col("size_to").cast("long").alias("size_to"), F.lit("").alias("internal"), empty.alias("absorbed"),
    )
    return survive.union(weak).union(emerge)


def label_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b, jaccard of the entities of each pair of labels of two partitions (id, label)."""
    x, y = a.select("id", F.col("label").alias("a")), b.select("id", F.col("label").alias("b"))
    na, nb = x.groupBy("a").agg(F.count("*").alias("na")), y.groupBy("b").agg(F.count("*").alias("nb"))
    both = x.join(y, "id").groupBy("a", "b").agg(F.count("*").alias("n"))
    grid = na.crossJoin(nb).join(both, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # labels by labels
    return grid.select("a", "b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))


def best_assignment(weights: list[list[float]]) -> list[int]:
    """Column of each row in the one-to-one assignment of greatest total weight (square), by shortest augmenting paths: time by
    the cube of the rows."""
    n = len(weights)
    row_price, price, row_of = [0.0] * n, [0.0] * (n + 1), [-1] * (n + 1)  # the last column is where a row's search begins
    for row in range(n):
        row_of[n], at = row, n
        slack, back, seen = [float("inf")] * n, [n] * n, [False] * (n + 1)
        while row_of[at] >= 0:
            seen[at], own = True, row_of[at]
            for c in range(n):
                if not seen[c] and (cost := -weights[own][c] - row_price[own] - price[c]) < slack[c]:
                    slack[c], back[c] = cost, at
            to = min((c for c in range(n) if not seen[c]), key=slack.__getitem__)
            step = slack[to]
            for c in range(n + 1):
                if seen[c]:
                    row_price[row_of[c]] += step
                    price[c] -= step
                elif c < n:
                    slack[c] -= step
            at = to
        while at != n:
            row_of[at], at = row_of[back[at]], back[at]
    return [row_of.index(row) for row in range(n)]


def match_labels(reference: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (id, label) renamed to the reference's labels by the assignment of greatest overlap; the driver holds a label by
    label matrix. Both have the labels 0 to k - 1."""
    rows = label_overlaps(reference, labels).collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {x: i for i, x in enumerate(names)}
    weights = [[0.0] * len(names) for _ in names]
    for r in rows:
        weights[at[r["b"]]][at[r["a"]]] = r["jaccard"]
    renamed = [(names[b], names[a]) for b, a in enumerate(best_assignment(weights))]
    table = labels.sparkSession.createDataFrame(renamed, labels.select("label", F.col("label").alias("new")).schema) if renamed else None
    return labels if table is None else labels.join(F.broadcast(table), "label").select("id", F.col("new").alias("label"))
