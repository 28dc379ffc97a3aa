"""Threshold trees that explain a partition: k leaves, k - 1 thresholds, fewest points cut from their centre."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.quality import centres


def split_candidates(points: DataFrame, middles: DataFrame) -> DataFrame:
    """f, theta, mistakes: midpoints of neighbouring values inside the range of the centres, and the points they part from
    their centre. points: id, vec, label; middles: label, centre.

    A point between which and its centre theta lies counts once: +1 at the lesser of the two, -1 at the greater.
    """
    own = points.join(F.broadcast(middles.select("label", "centre")), "label")  # a row for each cluster
    pair = own.select(F.posexplode(F.arrays_zip(F.col("vec").alias("x"), F.col("centre").alias("c"))).alias("f", "p"))
    x, c = F.col("p.x"), F.col("p.c")
    ends = pair.select("f", F.explode(F.array(F.struct(F.least(x, c).alias("v"), F.lit(1).alias("d")), F.struct(F.greatest(x, c).alias("v"), F.lit(-1).alias("d")))).alias("e"))
    middle = middles.select(F.posexplode("centre").alias("f", "v"))
    limits = middle.groupBy("f").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    marks = ends.select("f", "e.v", "e.d").union(middle.select("f", "v", F.lit(0))).groupBy("f", "v").agg(F.sum("d").alias("d"))
    along = Window.partitionBy("f").orderBy("v")
    marks = marks.withColumn("mistakes", F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    marks = marks.withColumn("theta", (F.col("v") + F.lead("v").over(along)) / 2)
    return marks.join(F.broadcast(limits), "f").where("theta >= lo and theta < hi").select("f", "theta", "mistakes")  # a row for each feature


def best_split(points: DataFrame, middles: DataFrame) -> DataFrame:
    """One row: f, theta, mistakes; ties to the first feature, then the least threshold."""
    return split_candidates(points, middles).orderBy("mistakes", "f", "theta").limit(1)


def threshold_tree(points: DataFrame) -> list[dict]:
    """Nodes (node, parent, side, feature, threshold, mistakes, leaf) of the tree for points (id, vec, label).

    The driver holds the tree and the centres; points that a threshold parts from their centre take no part below it.
    """
    middles = {r["label"]: r["centre"] for r in centres(points).collect()}
    spark, nodes = points.sparkSession, []

    def grow(rows: DataFrame, labels: list, parent: int | None, side: str | None) -> None:
        at = len(nodes)
        nodes.append({"node": at, "parent": parent, "side": side, "feature": None, "threshold": None, "mistakes": None, "leaf": None})
        if len(labels) == 1:
            nodes[at]["leaf"] = labels[0]
            return
        kind = points.select("label", F.col("vec").alias("centre")).schema
        known = spark.createDataFrame([(x, middles[x]) for x in labels], kind)
        found = best_split(rows, known).first()
        f, theta = found["f"], found["theta"]
        low = [x for x in labels if middles[x][f] <= theta]
        nodes[at] |= {"feature": f, "threshold": theta, "mistakes": found["mistakes"]}
        for name, own, inside in (("le", low, F.col("vec")[f] <= theta), ("gt", [x for x in labels if x not in low], F.col("vec")[f] > theta)):
            grow(rows.where(inside & F.col("label").isin(own)), own, at, name)

    grow(points, sorted(middles), None, None)
    return nodes


def tree_table(spark, nodes: list[dict]) -> DataFrame:
    schema = "node int, parent int, side string, feature int, threshold double, mistakes long, leaf int"
    return spark.createDataFrame([tuple(n[c.split()[0]] for c in schema.split(", ")) for n in nodes], schema)


def predict(nodes: list[dict], at: int = 0):
    """The tree as one expression of vec."""
    node = nodes[at]
    if node["feature"] is None:
        return F.lit(node["leaf"])
    below = {n["side"]: n["node"] for n in nodes if n["parent"] == at}
    return F.when(F.col("vec")[node["feature"]] <= node["threshold"], predict(nodes, below["le"])).otherwise(predict(nodes, below["gt"]))


def depth(nodes: list[dict], at: int = 0) -> int:
    below = [n["node"] for n in nodes if n["parent"] == at]
    return 1 + max(depth(nodes, b) for b in below) if below else 0


def leaf_conditions(nodes: list[dict]) -> dict[int, dict[int, tuple[float | None, float | None]]]:
    """leaf -> feature -> (over, up to): the thresholds on the way, merged to one interval for each feature."""
    out = {}
    for n in nodes:
        if n["leaf"] is None:
            continue
        limits: dict[int, tuple[float | None, float | None]] = {}
        at = n
        while at["parent"] is not None:
            up = nodes[at["parent"]]
            lo, hi = limits.get(up["feature"], (None, None))
            t = up["threshold"]
            limits[up["feature"]] = (lo, t if hi is None else min(hi, t)) if at["side"] == "le" else (t if lo is None else max(lo, t), hi)
            at = up
        out[n["leaf"]] = limits
    return out


def fidelity(points: DataFrame, nodes: list[dict]) -> DataFrame:
    """label, n, fidelity (share the tree gives the same label), precision (share of those it gives this label)."""
    told = points.withColumn("told", predict(nodes))
    own = told.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("told") == F.col("label")).cast("double")).alias("fidelity"))
    given = told.groupBy(F.col("told").alias("label")).agg(F.avg((F.col("told") == F.col("label")).cast("double")).alias("precision"))
    return own.join(given, "label", "left")


def decision_tree(points: DataFrame, depth: int = 3, seed: int = 42) -> float:
    """Share of points that an ordinary decision tree of a depth labels right: the yardstick for the threshold tree."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    data = points.select(array_to_vector("vec").alias("features"), F.col("label").cast("double").alias("label"))
    told = DecisionTreeClassifier(maxDepth=depth, seed=seed, maxBins=128).fit(data).transform(data)
    return told.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def forest_scores(points: DataFrame, folds: int = 5, trees: int = 50, seed: int = 42) -> DataFrame:
    """One row: accuracy, balanced_accuracy of a random forest by cross-validation; folds by a hash of id."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    data = points.select("id", array_to_vector("vec").alias("features"), F.col("label").cast("double").alias("label"))
    data = data.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(folds)))
    told = None
    for k in range(folds):
        model = RandomForestClassifier(numTrees=trees, seed=seed).fit(data.where(F.col("fold") != k))
        one = model.transform(data.where(F.col("fold") == k)).select("label", "prediction")
        told = one if told is None else told.union(one)
    own = told.groupBy("label").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("recall"), F.count("*").alias("n"))
    return own.agg((F.sum(F.col("recall") * F.col("n")) / F.sum("n")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"))
