"""Clustering of points (id, vec) and of graphs (src, dst, w). Seeding is deterministic, so labels are the library's own:
they agree with other implementations as partitions, not by number."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.quality import centres
from terrane.operators.shared import ratio, squared_distance, written


def assign(points: DataFrame, middles: DataFrame, *by: str) -> DataFrame:
    """id, vec, label, d1, d2: the nearest of a few centres (label, centre), ties by label, and the two least distances.

    by: columns of both sides; points meet the centres of their own group, and the columns come first in the result.
    """
    few = F.broadcast(middles.select(*by, "label", "centre"))  # a row for each group and cluster
    met = points.select(*by, "id", "vec").join(few, list(by)) if by else points.select("id", "vec").crossJoin(few)
    each = met.select(*by, "id", "vec", F.struct(squared_distance("vec", "centre").alias("d"), F.col("label").alias("label")).alias("c"))
    found = each.groupBy(*by, "id").agg(F.first("vec").alias("vec"), F.slice(F.array_sort(F.collect_list("c")), 1, 2).alias("best"))
    return found.select(*by, "id", "vec", F.col("best")[0]["label"].alias("label"), F.sqrt(F.col("best")[0]["d"]).alias("d1"), F.sqrt(F.get("best", F.lit(1))["d"]).alias("d2"))


def margins(assigned: DataFrame) -> DataFrame:
    """id, label, margin: how far from the border to the second centre, 0 on it, up to 1."""
    return assigned.select("id", "label", ((F.col("d2") - F.col("d1")) / F.greatest("d2", F.lit(1e-12))).alias("margin"))


def lloyd(points: DataFrame, middles: DataFrame, steps: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """id, vec, label, d1, d2 after Lloyd steps from given centres (label, centre); stops when no label changes.

    by: columns of both sides; each group is a run of its own, and all runs take a step in one plan.
    """
    found = written(assign(points, middles, *by))
    for _ in range(steps):
        again = written(assign(points, centres(found, *by), *by))
        same = again.select(*by, "id", "label").exceptAll(found.select(*by, "id", "label")).isEmpty()
        found = again
        if same:
            break
    return found


def farthest_first(points: DataFrame, k: int) -> DataFrame:
    """label, centre: the point with the least id, then again and again the point farthest from those chosen, ties by id."""
    spark = points.sparkSession
    chosen = [points.orderBy("id").first()["vec"]]
    while len(chosen) < k:
        known = spark.createDataFrame(list(enumerate(chosen)), "label int, centre array<double>")
        chosen.append(assign(points, known).orderBy(F.desc("d1"), "id").first()["vec"])
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(chosen)], "label int, centre array<double>")


def kmeans(points: DataFrame, k: int, steps: int = 20) -> DataFrame:
    """id, label by Lloyd steps from farthest-first centres."""
    return lloyd(points, farthest_first(points, k), steps).select("id", "label")


def ml_kmeans(points: DataFrame, k: int, seed: int = 42, restarts: int = 5) -> DataFrame:
    """id, label by k-means|| with restarts; the start of least cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = points.select("id", array_to_vector("vec").alias("features"))
    models = [KMeans(k=k, seed=seed + i).fit(data) for i in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(data).select("id", F.col("prediction").alias("label"))


def warm_kmeans(points: DataFrame, previous: DataFrame, steps: int = 20) -> DataFrame:
    """id, label, margin from the centres of previous labels (id, label), so that labels keep their meaning."""
    start = centres(points.select("id", "vec").join(previous.select("id", "label"), "id"))
    return margins(lloyd(points, start, steps))


def mixture(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """id, label by a Gaussian mixture with full covariances."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    data = points.select("id", array_to_vector("vec").alias("features"))
    return GaussianMixture(k=k, seed=seed).fit(data).transform(data).select("id", F.col("prediction").alias("label"))


def mixed_graph(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """alpha A / max(A) + (1 - alpha) B / max(B)."""
    part = lambda g, share: g.crossJoin(F.broadcast(g.agg(F.max("w").alias("top")))).select("src", "dst", (share * F.col("w") / F.col("top")).alias("w"))  # noqa: E731  one row
    return part(a, alpha).union(part(b, 1 - alpha)).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def spectral(net: DataFrame, attr: DataFrame, k: int, alpha: float = 0.5, steps: int = 20) -> DataFrame:
    """id, label by power iteration on the mixed graph: the native relative of spectral clustering, not its equal."""
    from pyspark.ml.clustering import PowerIterationClustering

    mixed = written(mixed_graph(written(net), written(attr), alpha).where("src < dst"))  # read in several jobs
    found = PowerIterationClustering(k=k, maxIter=steps, weightCol="w").assignClusters(mixed)
    return found.select("id", F.col("cluster").alias("label"))


# --- Attributes and a network together -------------------------------------------------------------


def network_terms(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, degree, square (sum of squared weights), pull (sum of weight times the neighbour's degree)."""
    degree = edges.groupBy("src").agg(F.sum("w").alias("degree"), F.sum(F.col("w") * F.col("w")).alias("square"))
    pull = edges.join(degree.select(F.col("src").alias("dst"), "degree"), "dst").groupBy("src").agg(F.sum(F.col("w") * F.col("degree")).alias("pull"))
    both = degree.join(pull, "src").withColumnRenamed("src", "id")
    return nodes.select("id").join(both, "id", "left").na.fill(0.0)


def network_weight(points: DataFrame, terms: DataFrame, share: float) -> float:
    """The weight of the network at which it gives ``share`` of the whole scatter. Its centred rows sum to zero."""
    long = points.select(F.posexplode("vec").alias("f", "x"))
    own = long.groupBy("f").agg((F.var_pop("x") * F.count("*")).alias("ss")).agg(F.sum("ss")).first()[0]
    m, r2 = terms.agg(F.sum("degree"), F.sum(F.col("degree") * F.col("degree"))).first()
    rows = F.col("square") - 2 * F.col("degree") * F.col("pull") / m + F.pow(F.col("degree") / m, F.lit(2)) * r2
    return share / (1 - share) * own / terms.agg(F.sum(rows)).first()[0]


def combined_step(points: DataFrame, edges: DataFrame, terms: DataFrame, labels: DataFrame, weight: float) -> DataFrame:
    """id, label, d: each point's nearest cluster after the centres of labels, by squared distance of attributes plus ``weight``
    times that of modularity-centred network rows.

    The dense rows a_i - (r_i / m) r are never made: with S the mean sparse row of a cluster the distance expands into edge
    sums, so a step costs edges times clusters.
    """
    m, r2 = terms.agg(F.sum("degree"), F.sum(F.col("degree") * F.col("degree"))).first()
    middle = centres(points.select("id", "vec").join(labels.select("id", "label"), "id"))
    size = labels.groupBy("label").agg(F.count("*").alias("size"))
    rows = edges.join(labels.select(F.col("id").alias("src"), "label"), "src").groupBy("label", "dst").agg(F.sum("w").alias("s"))
    rows = rows.join(F.broadcast(size), "label").select("label", "dst", (F.col("s") / F.col("size")).alias("s"))  # a row for each cluster
    per = labels.join(terms, "id").groupBy("label").agg(F.avg("degree").alias("c_degree"), F.avg("pull").alias("c_pull"))
    per = per.join(rows.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("c_square")), "label", "left").na.fill(0.0)
    cross = edges.join(rows, "dst").groupBy("src", "label").agg(F.sum(F.col("w") * F.col("s")).alias("cross"))
    near = middle.select("label", "centre").join(per, "label")
    met = points.select("id", "vec").join(terms, "id").crossJoin(F.broadcast(near))  # a row for each cluster
    met = met.join(cross.withColumnRenamed("src", "id"), ["id", "label"], "left").na.fill(0.0, ["cross"])
    gap = (F.col("degree") - F.col("c_degree")) / m
    net = F.col("square") - 2 * F.col("cross") + F.col("c_square") - 2 * gap * (F.col("pull") - F.col("c_pull")) + gap * gap * r2
    each = met.select("id", F.struct((squared_distance("vec", "centre") + weight * net).alias("d"), F.col("label").alias("label")).alias("c"))
    return each.groupBy("id").agg(F.min("c").alias("c")).select("id", F.col("c.label").alias("label"), F.col("c.d").alias("d"))


def kefrin(points: DataFrame, edges: DataFrame, k: int, share: float = 0.4, steps: int = 20) -> DataFrame:
    """id, label by k-means on attributes and network rows together; a share of 0 or less is plain k-means."""
    labels = kmeans(points, k, steps)
    if share <= 0:
        return labels
    terms = written(network_terms(edges, points))
    weight = network_weight(points, terms, share)
    labels = written(labels)
    for _ in range(steps):
        again = written(combined_step(points, edges, terms, labels, weight).select("id", "label"))
        same = again.exceptAll(labels).isEmpty()
        labels = again
        if same:
            break
    return labels


# --- Communities ------------------------------------------------------------------------------------


def communities(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, steps: int = 12) -> DataFrame:
    """id, label: nodes move to the neighbouring community of greatest modularity gain, ties to the least label.

    Half of the nodes (by a hash) move in each step, so that neighbours don't swap for ever.
    """
    degree = written(nodes.select("id").join(edges.groupBy("src").agg(F.sum("w").alias("degree")), F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree")))
    m2 = degree.agg(F.sum("degree")).first()[0] or 1.0
    labels = written(nodes.select("id", F.col("id").alias("label")))
    quiet = 0
    for step in range(steps):
        size = labels.join(degree, "id").groupBy("label").agg(F.sum("degree").alias("total"))
        pull = edges.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("pull"))
        stay = labels.select("id", "label", F.lit(0.0).alias("pull"))
        options = pull.union(stay).groupBy("id", "label").agg(F.sum("pull").alias("pull")).join(size, "label").join(degree, "id")
        own = labels.select("id", F.col("label").alias("now"))
        options = options.join(own, "id").withColumn("others", F.col("total") - F.when(F.col("label") == F.col("now"), F.col("degree")).otherwise(0.0))
        gain = F.round(F.col("pull") - resolution * F.col("degree") * F.col("others") / m2, 9)
        best = options.groupBy("id").agg(F.min(F.struct((-gain).alias("loss"), F.col("label").alias("label"))).alias("best"), F.first("now").alias("now"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == step % 2
        moved = written(best.select("id", F.when(turn, F.col("best.label")).otherwise(F.col("now")).alias("label"), "now"))
        quiet = quiet + 1 if moved.where("label <> now").isEmpty() else 0
        labels = moved.select("id", "label")
        if quiet == 2:
            break
    return labels


def absorb_small(labels: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """Nodes of communities under ``least`` nodes join the large community they have most weight to, else the largest."""
    size = labels.groupBy("label").agg(F.count("*").alias("n"))
    big = size.where(F.col("n") >= least)
    largest = big.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("label").alias("label"))).alias("x")).select(F.col("x.label").alias("largest"))
    kept = labels.join(big, "label", "left_semi")
    pull = edges.join(kept.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("w"))
    pull = pull.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("label").alias("label"))).alias("x")).select("id", F.col("x.label").alias("to"))
    small = labels.join(big, "label", "left_anti").join(pull, "id", "left").crossJoin(F.broadcast(largest))  # one row
    return kept.select("id", "label").union(small.select("id", F.coalesce("to", "largest", "label").alias("label")))


def communities_k(edges: DataFrame, nodes: DataFrame, k: int, tries: int = 8) -> DataFrame:
    """id, label: communities at a resolution found by bisection, so that k of them have at least 1 % of the nodes."""
    n = nodes.count()
    least, lo, hi, best = max(2.0, 0.01 * n), 0.05, 5.0, None
    for _ in range(tries):
        middle = (lo + hi) / 2
        found = communities(edges, nodes, middle)
        big = found.groupBy("label").count().where(F.col("count") >= least).count()
        if best is None or abs(big - k) < best[0]:
            best = (abs(big - k), found)
        if big == k:
            break
        lo, hi = (middle, hi) if big < k else (lo, middle)
    return absorb_small(best[1], edges, least)


def ward_merges(x: np.ndarray, first: np.ndarray, size: np.ndarray, pairs: int = 1 << 22) -> list[tuple[float, int, int]]:
    """Height, a, b for each merge of Ward's agglomeration of different points x, named by ``first`` (ascending) with weights
    ``size``; by height, a cluster named by its least point.

    Clusters that are each other's nearest are merged at once, all that there are: no later merge comes nearer to another
    cluster than its parts were, so the tree is that of one merge at a time (but for ties). Only clusters whose nearest was
    merged look again. ``pairs`` distances are held at a time.
    """
    live, middle, size = np.arange(len(x)), x - x.mean(0), size.astype(float)
    near, far = np.zeros(len(x), int), np.zeros(len(x))
    stale, merges = live, []
    while len(live) > 1:
        own, weight = middle[live], size[live]
        square = (own * own).sum(1)
        step = max(1, pairs // len(live))
        for lo in range(0, len(stale), step):
            at = stale[lo : lo + step]
            d = np.maximum((middle[at] ** 2).sum(1)[:, None] + square[None, :] - 2 * (middle[at] @ own.T), 0)
            d *= size[at][:, None] * weight[None, :] / (size[at][:, None] + weight[None, :])
            d[np.arange(len(at)), np.searchsorted(live, at)] = np.inf
            best = d.argmin(1)
            near[at], far[at] = live[best], d[np.arange(len(at)), best]
        a = live[(near[near[live]] == live) & (live < near[live])]
        if not len(a):  # rounding may leave no pair of which each is the other's nearest
            one = live[far[live].argmin()]
            a, other = np.array([min(one, near[one])]), max(one, near[one])
            near[a], far[a] = other, far[one]
        b = near[a]
        merges += zip(far[a].tolist(), first[a].tolist(), first[b].tolist())
        whole = size[a] + size[b]
        middle[a] = (size[a][:, None] * middle[a] + size[b][:, None] * middle[b]) / whole[:, None]
        size[a] = whole
        gone = np.zeros(len(x), bool)
        gone[b] = True
        live = live[~gone[live]]
        gone[a] = True
        stale = live[gone[live] | gone[near[live]]]
    return sorted(merges, key=lambda m: m[0])


def ward(points: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """id, label by Ward's agglomeration, in one task: it computes all distances, by the square of the points, but holds only
    the vectors and a bounded number of distances. A caller may refuse more than ``most`` points."""
    if most is not None and (n := points.count()) > most:
        raise ValueError(f"ward takes up to {most} points, not {n}; use kmeans")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        x = np.stack(rows["vec"].to_numpy()).astype(float) + 0.0
        _, first, kind, size = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
        of = first[kind.reshape(-1)]  # copies go to the first of them, at height 0
        order = np.argsort(first)
        copies = np.flatnonzero(of != np.arange(len(x)))
        merges = [(0.0, int(of[j]), int(j)) for j in copies[np.argsort(of[copies], kind="stable")]]
        merges += ward_merges(x[first[order]], first[order], size[order])
        root = np.arange(len(x))
        for _, i, j in merges[: max(0, len(x) - k)]:
            root[j] = i
        while (up := root[root]).tolist() != root.tolist():
            root = up
        return pd.DataFrame({"id": rows["id"].to_numpy(), "label": np.unique(root, return_inverse=True)[1].astype("int32")})

    return points.select("id", "vec").withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fit, "id long, label int")


def run_method(name: str, k: int, points: DataFrame, net: DataFrame, attr: DataFrame, share: float = 0.4, alpha: float = 0.5) -> DataFrame:
    """id, label by name: kmeans, ward, spectral, leiden (communities), kefrin, mixture."""
    return {
        "kmeans": lambda: kmeans(points, k), "ward": lambda: ward(points, k), "spectral": lambda: spectral(net, attr, k, alpha),
        "leiden": lambda: communities_k(net, points, k), "kefrin": lambda: kefrin(points, net, k, share), "mixture": lambda: mixture(points, k),
    }[name]()


def planted(spark, n: int, k: int, dims: int, separation: float, degree: float, inside: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """points (id, vec, label) around k random centres, and edges of a block model: a pair inside a cluster is ``inside`` times
    as likely as one across. Pairs are drawn by hash for this generator of small test graphs."""
    unit = lambda *key: F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    normal = lambda *key: F.sqrt(-2 * F.ln(unit(*key, F.lit("u")) + 1e-12)) * F.cos(6.283185307179586 * unit(*key, F.lit("v")))
    base = spark.range(n).withColumn("label", F.pmod("id", F.lit(k)).cast("int"))
    vec = F.array(*(separation * normal(F.col("label"), F.lit(f)) + normal(F.col("id"), F.lit(f"p{f}")) for f in range(dims)))
    points = base.select("id", vec.alias("vec"), "label")
    p = degree / (n / k * inside + n * (k - 1) / k)
    a, b = base.select(F.col("id").alias("src"), F.col("label").alias("x")), base.select(F.col("id").alias("dst"), F.col("label").alias("y"))
    drawn = a.join(b, F.col("src") < F.col("dst")).where(unit(F.col("src"), F.col("dst")) < F.when(F.col("x") == F.col("y"), p * inside).otherwise(p))
    edges = drawn.select("src", "dst", F.lit(1.0).alias("w"))
    return points, edges.union(edges.select("dst", "src", "w"))


def scatter_share(points: DataFrame, blocks: dict[str, list[int]]) -> DataFrame:
    """block, share: of the whole variance of vec, by groups of its places."""
    long = points.select(F.posexplode("vec").alias("f", "x")).groupBy("f").agg(F.var_pop("x").alias("v"))
    named = points.sparkSession.createDataFrame([(i, b) for b, places in blocks.items() for i in places], "f int, block string")
    own = long.join(F.broadcast(named), "f").groupBy("block").agg(F.sum("v").alias("v"))  # a row for each feature
    return own.select("block", ratio(F.col("v"), F.sum("v").over(Window.partitionBy())).alias("share"))
