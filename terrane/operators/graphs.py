"""Similarity graphs as edge tables (src, dst, w): undirected, kept in both directions, no loops, weights above zero."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.shared import coin_p, row_numbers, written

TILE = 4096  # vectors of a block at most; a tile is a block against a block
CHUNK = 1 << 20  # pairs of a tile that are ranked at once
PLACES = 9  # digits by which similarities are compared, so that ties don't depend on the order of sums


def banded_dtw(x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray:
    """Dynamic time warping distances of pairs (n, time, channel) inside a Sakoe-Chiba band, all pairs a step at a time."""
    n, t = x.shape[:2]
    last = np.full((n, t + 1), np.inf)
    last[:, 0] = 0
    for a in range(1, t + 1):
        row = np.full((n, t + 1), np.inf)
        for b in range(max(1, a - band), min(t, a + band) + 1):
            step = ((x[:, a - 1] - y[:, b - 1]) ** 2).sum(1)
            row[:, b] = step + np.minimum(np.minimum(last[:, b - 1], last[:, b]), row[:, b - 1])
        last = row
    return np.sqrt(last[:, t])


def quick_dtw(x: np.ndarray, y: np.ndarray, band: int) -> tuple[np.ndarray, float, float]:
    """Squared distances of all lines x (m, time, channel) to all lines y in single precision, what each may be off by, and the
    greatest norm of a moment, by which lines are divided first.

    The costs of a cell are a thin matrix product. Its rounding errors (``channel`` products, their inputs' squares) and those
    of a path of up to 2 * time cells of cost 4 at most give the bound.
    """
    (m, t, c), n = x.shape, len(y)
    squares = np.concatenate(((x * x).sum(2).ravel(), (y * y).sum(2).ravel()))
    top = np.sqrt(squares[np.isfinite(squares)].max(initial=0)) or 1.0
    x, y = x / top, y / top
    x = np.concatenate((x, (x * x).sum(2, keepdims=True), np.ones((m, t, 1))), 2).transpose(1, 0, 2).astype("f4")
    y = np.concatenate((-2 * y, np.ones((n, t, 1)), (y * y).sum(2, keepdims=True)), 2).transpose(1, 2, 0).astype("f4", order="C")
    out, few = np.empty((m, n), "f4"), max(1, 32768 // n)  # as many lines at once as a core's cache has room for
    space = np.empty((2 * t + 4, few, n), "f4")
    for lo in range(0, m, few):
        cost, best, start, *rows = space[:, : min(few, m - lo)]
        start[:] = 0
        last = {0: start}
        for a in range(1, t + 1):
            row: dict[int, np.ndarray] = {}
            for b in range(max(1, a - band), min(t, a + band) + 1):
                np.matmul(np.ascontiguousarray(x[a - 1, lo : lo + few]), y[b - 1], out=cost)
                first, *others = (v for v in (last.get(b - 1), last.get(b), row.get(b - 1)) if v is not None)
                for v in others:
                    first = np.minimum(first, v, out=best)
                row[b] = np.add(cost, first, out=rows[a % 2 * t + b - 1])
            last = row
        out[lo : lo + few] = last[t]
    return out, float(np.finfo("f4").eps) * 4 * 2 * t * (c + 5 + t), float(top)


class _Product:
    """Cosine or euclid: pairs are ranked by what a matrix product gives; rounding moves two of them by less than the margin."""

    def __init__(self, x: np.ndarray, y: np.ndarray, metric: str):
        self.cosine, self.margin = metric == "cosine", 2 * 10.0**-PLACES
        with np.errstate(invalid="ignore", divide="ignore"):
            self.x, self.y = (v / np.linalg.norm(v, axis=1, keepdims=True) if self.cosine else v for v in (x, y))

    def rough(self, lo: int, hi: int, back: bool) -> np.ndarray:
        x, y = (self.y, self.x) if back else (self.x, self.y)
        x = x[lo:hi]
        if self.cosine:
            return -(x @ y.T)
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0))

    def exact(self, rough: np.ndarray, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        return np.round(rough, PLACES)


class _Warped:
    """dtw: pairs are ranked in single precision; those that may be among the nearest are computed again in double precision."""

    def __init__(self, x: np.ndarray, y: np.ndarray, channels: int, band: int):
        self.x, self.y, self.band = x.reshape(len(x), -1, channels), y.reshape(len(y), -1, channels), band
        self.all, error, top = quick_dtw(self.x, self.y, band)
        self.margin = 2 * error + 4 * 10.0**-PLACES * np.sqrt(8 * self.x.shape[1]) / top  # and what the rounding to PLACES moves

    def rough(self, lo: int, hi: int, back: bool) -> np.ndarray:
        return self.all.T[lo:hi].astype(float) if back else self.all[lo:hi].astype(float)

    def exact(self, rough: np.ndarray, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        x, y = (self.y, self.x) if back else (self.x, self.y)
        parts = [banded_dtw(x[i[k : k + 8192]], y[j[k : k + 8192]], self.band) for k in range(0, len(i), 8192)]
        return np.round(np.concatenate(parts), PLACES) if parts else np.empty(0)


def _best(pairs, src: np.ndarray, dst: np.ndarray, k: int, back: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """src, dst, key of the k least keys of each source, ties by dst; dst ascends. No source is its own neighbour."""
    out, step, place = [], max(1, CHUNK // len(dst)), min(k, len(dst)) - 1
    for lo in range(0, len(src), step):
        key = pairs.rough(lo, lo + step, back)
        own = src[lo : lo + step]
        key[(own[:, None] == dst[None, :]) | ~np.isfinite(key)] = np.inf
        edge = np.partition(key, place, axis=1)[:, place]
        i, j = np.nonzero((key <= edge[:, None] + pairs.margin) & (key < np.inf))
        exact = pairs.exact(key[i, j], i + lo, j, back)
        order = np.lexsort((j, exact, i))
        i, j, exact = i[order], j[order], exact[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((own[i[keep]], dst[j[keep]], exact[keep]))
    return out


def nearest(vectors: DataFrame, k: int, metric: str = "cosine", channels: int = 1, band: int = 2) -> DataFrame:
    """src, dst, x: the k best others of each vector(id, vec) by similarity (cosine) or distance (euclid, dtw), ties by dst.

    Blocks of vectors meet once, in tiles of bounded size that give k rows for each vector of both: n * n numbers are computed
    but only n * k * blocks rows are made, and a vector travels once for each block. dtw takes vec as time x channel.
    """
    if metric not in ("cosine", "euclid", "dtw"):
        raise KeyError(metric)
    sign = -1 if metric == "cosine" else 1
    vectors = written(vectors.select("id", "vec"))  # counted and dealt to both sides
    n = vectors.count()
    blocks = max(1, -(-n // TILE), min(8, n // 512))  # small inputs in enough tiles for several cores
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    up = F.explode(F.sequence(own, F.lit(blocks - 1)))
    down = F.explode(F.sequence(F.lit(0), own))
    left = vectors.select(F.col("id").alias("src"), F.col("vec").alias("x"), own.alias("block"), up.alias("other"))
    right = vectors.select(F.col("id").alias("dst"), F.col("vec").alias("y"), down.alias("block"), own.alias("other")).where("block < other")  # a block meets itself as left

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("x", pa.float64())])
        alone = len(a) and a.column("block")[0] == a.column("other")[0]
        if not len(a) or not (alone or len(b)):
            return schema.empty_table()
        a = a.select(["src", "x"]).sort_by("src")
        b = a if alone else b.select(["dst", "y"]).sort_by("dst")
        src, dst = a.column(0).to_numpy(), b.column(0).to_numpy()
        x, y = (np.stack(v.column(1).to_numpy(zero_copy_only=False)).astype(float) for v in (a, b))
        pairs = _Warped(x, y, channels, band) if metric == "dtw" else _Product(x, y, metric)
        found = _best(pairs, src, dst, k, False) + ([] if alone else _best(pairs, dst, src, k, True))
        src, dst, key = (np.concatenate(v) for v in zip(*found))
        return pa.table([src, dst, key * sign], schema=schema)

    tiles = left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInArrow(tile, "src long, dst long, x double")
    best = Window.partitionBy("src").orderBy(F.col("x") * sign, "dst")
    return tiles.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge with the greater of their weights."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select("src", "dst", "w").union(back).groupBy("src", "dst").agg(F.max("w").alias("w"))


def knn_from_similarity(top: DataFrame) -> DataFrame:
    """Union kNN graph of rows (src, dst, x): positive similarities as weights."""
    return symmetric(top.where("x > 0").select("src", "dst", F.col("x").alias("w")))


def knn_from_distance(top: DataFrame) -> DataFrame:
    """Union kNN graph of rows (src, dst, x, place): w = max(exp(-x^2 / (s_src s_dst)), 1e-6), s a node's greatest kept
    distance; where that is 0 the median of the others."""
    top = written(top.select("src", "dst", "x"))  # read for the scales and for the edges
    scale = top.groupBy("src").agg(F.max("x").alias("s"))
    middle = scale.where("s > 0").agg(F.median("s").alias("middle"))
    scale = scale.crossJoin(F.broadcast(middle)).select("src", F.when(F.col("s") > 0, F.col("s")).otherwise(F.col("middle")).alias("s"))  # one row
    other = scale.select(F.col("src").alias("dst"), F.col("s").alias("s_dst"))
    weight = F.greatest(F.exp(-F.col("x") * F.col("x") / (F.col("s") * F.col("s_dst"))), F.lit(1e-6))
    return symmetric(top.join(scale, "src").join(other, "dst").select("src", "dst", weight.alias("w")))


def distance_graph(distances: DataFrame, k: int) -> DataFrame:
    """kNN graph from a table of known distances (src, dst, x), in one direction or both."""
    back = distances.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "x")
    both = distances.select("src", "dst", "x").union(back).where("src <> dst").groupBy("src", "dst").agg(F.min("x").alias("x"))
    best = Window.partitionBy("src").orderBy("x", "dst")
    return knn_from_distance(both.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k))


def standard_lines(series: DataFrame) -> DataFrame:
    """id, vec (time x channel): each channel of a series (entity, period, channel, x) at mean 0 and deviation 1 over time."""
    own = Window.partitionBy("entity", "channel")
    sd = F.stddev_pop("x").over(own)
    z = (F.col("x") - F.avg("x").over(own)) / F.when(sd > 1e-12, sd).otherwise(1.0)
    row = F.array_sort(F.collect_list(F.struct("period", "channel", "z")))
    return series.withColumn("z", z).groupBy(F.col("entity").alias("id")).agg(F.transform(row, lambda r: r["z"]).alias("vec"))


def build_graph(rule: str, k: int, vectors: DataFrame, channels: int = 1, band: int = 2) -> DataFrame:
    """attr: features; corr: standard lines; cosine: mean spend; dtw: standard lines; road: known distances."""
    if rule in ("corr", "cosine"):
        return knn_from_similarity(nearest(vectors, k, "cosine"))
    if rule == "road":
        return distance_graph(vectors, k)
    return knn_from_distance(nearest(vectors, k, {"attr": "euclid", "dtw": "dtw"}[rule], channels, band))


def upper(edges: DataFrame) -> DataFrame:
    """Each edge once."""
    return edges.where("src < dst")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component: the least id connected with it, for all of nodes(id).

    Labels go down edges and then jump to their label's label; each round is written, so lineage stays short.
    """
    edges = written(edges.select("src", "dst"))  # read in each round
    labels = written(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = edges.join(labels, edges.src == labels.id).groupBy("dst").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.id == near.dst, "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("far"))
        moved = written(step.join(jump, "component").select("id", F.col("far").alias("component")))
        changed = moved.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").isEmpty()
        labels = moved
        if changed:
            return labels


def diagnostics(edges: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row: edges, mean_degree, same_label_share of a graph whose nodes have labels (id, label)."""
    a, b = (labelled.select(F.col("id").alias(e), F.col("label").alias(f"label_{e}")) for e in ("src", "dst"))
    ends = upper(edges).join(a, "src").join(b, "dst")
    n = labelled.agg(F.count("*").alias("n"))
    found = ends.agg(F.count("*").alias("edges"), F.avg((F.col("label_src") == F.col("label_dst")).cast("double")).alias("same_label_share"))
    return found.crossJoin(F.broadcast(n)).select("edges", (2 * F.col("edges") / F.col("n")).alias("mean_degree"), "same_label_share")  # one row each


def graph_report(edges: DataFrame, points: DataFrame, known: DataFrame) -> DataFrame:
    """One row: diagnostics of a graph over points (id, vec, label), its components, the largest one's share of the nodes, the mean
    homophily of vec's places and the median of known (src, dst, x) over edges."""
    edges, points = written(edges), written(points.select("id", "vec", "label"))  # each read by every part
    size = components(edges, points).groupBy("component").agg(F.count("*").alias("n"))
    size = size.agg(F.count("*").alias("components"), (F.max("n") / F.sum("n")).alias("largest_share"))
    alike = place_homophily(edges, points).agg(F.avg("homophily").alias("homophily"))
    length = upper(edges).join(known, ["src", "dst"]).agg(F.median("x").alias("median_length"))
    return diagnostics(edges, points.select("id", "label")).crossJoin(size).crossJoin(alike).crossJoin(length)  # one row each


def homophily(edges: DataFrame, long: DataFrame) -> DataFrame:
    """feature, homophily: correlation of the values at the ends of edges; long: entity, feature, value. Null where constant."""
    a, b = (long.select(F.col("entity").alias(e), "feature", F.col("value").alias(f"v_{e}")) for e in ("src", "dst"))
    return _alike(upper(edges).join(a, "src").join(b, ["dst", "feature"]))


def place_homophily(edges: DataFrame, points: DataFrame) -> DataFrame:
    """homophily of each place of vec over points (id, vec); whole vectors meet, so that a row travels for each edge only."""
    a, b = (points.select(F.col("id").alias(e), F.col("vec").alias(f"vec_{e}")) for e in ("src", "dst"))
    ends = upper(edges).join(a, "src").join(b, "dst").select(F.posexplode(F.arrays_zip("vec_src", "vec_dst")).alias("feature", "v"))
    return _alike(ends.select("feature", F.col("v.vec_src").alias("v_src"), F.col("v.vec_dst").alias("v_dst")))


def _alike(ends: DataFrame) -> DataFrame:
    spread = F.covar_pop("v_src", "v_dst")
    sd = F.stddev_pop("v_src") * F.stddev_pop("v_dst")
    return ends.groupBy("feature").agg(F.try_divide(spread, sd).alias("homophily"))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: shared, either, jaccard of two graphs' edges."""
    a, b = (upper(g).select("src", "dst").distinct().withColumn(k, F.lit(1)) for g, k in ((a, "x"), (b, "y")))
    both = a.join(b, ["src", "dst"], "full")
    return both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), F.count("*").alias("either")).withColumn(
        "jaccard", F.coalesce(F.try_divide("shared", "either"), F.lit(0.0))
    )


def within_share(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: share of edge weight inside labels (id, label)."""
    a, b = (labels.select(F.col("id").alias(e), F.col("label").alias(f"label_{e}")) for e in ("src", "dst"))
    same = F.when(F.col("label_src") == F.col("label_dst"), F.col("w")).otherwise(0.0)
    return edges.join(a, "src").join(b, "dst").agg(F.try_divide(F.sum(same), F.sum("w")).alias("within_share"))


def strongest(edges: DataFrame, k: int = 10) -> DataFrame:
    """src, dst, w, place: each node's k heaviest edges, ties by dst."""
    return edges.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))).where(F.col("place") <= k)


def lag_correlation(edges: DataFrame, series: DataFrame, most: int) -> DataFrame:
    """src, dst, lag, r: mean product of standardised channels over the overlap when dst is moved by lag; lag > 0: src leads.

    series: entity, t (0, 1, ...), channel, x. Edges once (src < dst).
    """
    lags = edges.sparkSession.range(-most, most + 1).withColumnRenamed("id", "lag")
    a = series.select(F.col("entity").alias("src"), F.col("t").alias("t_src"), "channel", F.col("x").alias("x"))
    b = series.select(F.col("entity").alias("dst"), F.col("t").alias("t_dst"), "channel", F.col("x").alias("y"))
    moved = upper(edges).select("src", "dst").crossJoin(F.broadcast(lags)).join(a, "src").withColumn("t_dst", F.col("t_src") + F.col("lag"))  # 2 * most + 1 rows
    both = moved.join(b, ["dst", "t_dst", "channel"])
    product = F.try_divide(F.covar_pop("x", "y"), F.when(F.stddev_pop("x") > 1e-12, F.stddev_pop("x")).otherwise(1.0) * F.when(F.stddev_pop("y") > 1e-12, F.stddev_pop("y")).otherwise(1.0))
    each = both.groupBy("src", "dst", "lag", "channel").agg(product.alias("r"))
    return each.groupBy("src", "dst", "lag").agg(F.avg("r").alias("r"))


def best_lag(correlations: DataFrame) -> DataFrame:
    """src, dst, lag, r: the lag of the greatest correlation, ties to the least lag."""
    best = Window.partitionBy("src", "dst").orderBy(F.desc("r"), "lag")
    return correlations.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def lead_shares(lags: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b, edges, lagged, share, p for groups a < b of groups (id, label): edges between them, those whose best lag isn't 0, the
    share of these in which a's end leads, and how likely a fair coin strays so far. lags: src, dst, lag; lag > 0: src leads."""
    ends = lags.join(groups.select(F.col("id").alias("src"), F.col("label").alias("x")), "src").join(groups.select(F.col("id").alias("dst"), F.col("label").alias("y")), "dst")
    ends = ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("x") < F.col("y"), F.col("lag")).otherwise(-F.col("lag")).alias("lag"))
    found = ends.groupBy("a", "b").agg(F.count("*").alias("edges"), F.count_if(F.col("lag") != 0).alias("lagged"), F.count_if(F.col("lag") > 0).alias("lead"))
    return found.select("a", "b", "edges", "lagged", F.try_divide("lead", "lagged").alias("share"), F.when(F.col("lagged") > 0, coin_p(F.col("lead"), F.col("lagged"))).alias("p"))


def lagged(moved: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """The lag of the greatest mean correlation of pairs of lines (n, time, channel), ties to the least; an impossible one, most +
    1, where no lag has a value. As ``lag_correlation`` and ``best_lag`` of 9 digits; absent values are NaN."""
    length, found = own.shape[1], []
    for lag in range(-most, most + 1):
        x, y = moved[:, max(0, -lag) : length - max(0, lag)], own[:, max(0, lag) : length + min(0, lag)]
        both = ~(np.isnan(x) | np.isnan(y))
        n = np.maximum(both.sum(1), 1)
        x, y = np.where(both, x, 0.0), np.where(both, y, 0.0)
        x, y = (np.where(both, v - (v.sum(1) / n)[:, None], 0.0) for v in (x, y))
        sd_x, sd_y = (np.sqrt((v * v).sum(1) / n) for v in (x, y))
        r = (x * y).sum(1) / n / (np.where(sd_x > 1e-12, sd_x, 1.0) * np.where(sd_y > 1e-12, sd_y, 1.0))
        known = both.any(1)
        found.append(np.where(known.any(1), np.where(known, r, 0.0).sum(1) / np.maximum(known.sum(1), 1), -np.inf))
    r = np.round(np.stack(found, 1), PLACES)
    return np.where(np.isfinite(r).any(1), r.argmax(1) - most, most + 1)


def lag_null(edges: DataFrame, series: DataFrame, most: int, reps: int, seed: int = 42) -> DataFrame:
    """rep, share_lagged: share of edges whose best lag isn't 0 when dst's series is shifted cyclically by a drawn amount.

    Whole series meet at an edge, once for all repeats, so a row travels for each edge, not for each repeat, lag and moment.
    """
    length = series.agg(F.max("t")).first()[0]
    names = sorted(r[0] for r in series.select("channel").distinct().collect())  # channels: few
    if length is None:
        return series.sparkSession.createDataFrame([], "rep long, share_lagged double")
    length, wide = int(length) + 1, len(names)
    place = F.col("t") * wide + F.array_position(F.array(*map(F.lit, names)), F.col("channel")) - 1
    line = F.collect_list(F.struct(place.cast("int").alias("at"), F.col("x").cast("double").alias("x")))
    lines = written(series.groupBy("entity").agg(line.alias("line")).select("entity", F.col("line.at").alias("at"), F.col("line.x").alias("x")))
    own = lines.select(F.col("entity").alias("src"), F.col("at").alias("own_at"), F.col("x").alias("own"))
    other = lines.select(F.col("entity").alias("dst"), F.col("at").alias("other_at"), F.col("x").alias("other"))
    draw = lambda rep: (most + 1 + F.pmod(F.xxhash64("src", "dst", rep, F.lit(seed)), F.lit(length - 2 * most - 1))).cast("int")
    shifts = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long")), draw)
    pairs = upper(edges).select("src", "dst").join(own, "src").join(other, "dst").select("own_at", "own", "other_at", "other", shifts.alias("shifts"))

    def dense(at: pa.Array, x: pa.Array) -> np.ndarray:
        out = np.full((len(at), length * wide), np.nan)
        counts = at.value_lengths().to_numpy()
        out[np.repeat(np.arange(len(at)), counts), at.flatten().to_numpy()] = x.flatten().to_numpy(zero_copy_only=False)
        return out.reshape(len(at), length, wide)

    def count(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                x, y = dense(b.column("own_at"), b.column("own")), dense(b.column("other_at"), b.column("other"))
                shift = b.column("shifts").flatten().to_numpy().reshape(b.num_rows, reps)
                for rep in range(reps):
                    moment = (np.arange(length)[None, :] + shift[:, rep, None]) % length
                    lag = lagged(np.take_along_axis(y, moment[:, :, None], 1), x, most)
                    lag = lag[lag <= most]
                    yield pa.RecordBatch.from_pydict({"rep": [rep], "lagged": [int((lag != 0).sum())], "n": [len(lag)]}, pa.schema([("rep", pa.int64()), ("lagged", pa.int64()), ("n", pa.int64())]))

    counts = pairs.mapInArrow(count, "rep long, lagged long, n long").groupBy("rep").agg(F.sum("lagged").alias("lagged"), F.sum("n").alias("n"))
    return counts.where("n > 0").select("rep", (F.col("lagged") / F.col("n")).alias("share_lagged"))


def same_share(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: pairs, same: share of pairs (src, dst) with one label (id, label)."""
    a, b = (labels.select(F.col("id").alias(e), F.col("label").alias(f"label_{e}")) for e in ("src", "dst"))
    return pairs.join(a, "src").join(b, "dst").agg(F.count("*").alias("pairs"), F.avg((F.col("label_src") == F.col("label_dst")).cast("double")).alias("same"))


def shuffled_labels(labels: DataFrame, reps: int, seed: int = 42) -> DataFrame:
    """rep, id, label: the labels dealt out anew in each repeat, sizes kept."""
    each = labels.crossJoin(labels.sparkSession.range(reps).withColumnRenamed("id", "rep"))
    names = row_numbers(each.select("rep", "id"), ["rep"], ["id"])
    dealt = row_numbers(each.select("rep", "label", F.xxhash64(F.lit(seed), "rep", "id").alias("draw")), ["rep"], ["draw", "label"])
    return names.join(dealt.select("rep", "label", "n"), ["rep", "n"]).select("rep", "id", "label")


def join_count(pairs: DataFrame, labels: DataFrame, reps: int, seed: int = 42) -> DataFrame:
    """One row: pairs, same, null_mean, null_sd, z, ratio against shuffled labels."""
    deals = shuffled_labels(labels, reps, seed)
    a, b = (deals.select("rep", F.col("id").alias(e), F.col("label").alias(f"label_{e}")) for e in ("src", "dst"))
    null = pairs.select("src", "dst").join(a, "src").join(b, ["rep", "dst"]).groupBy("rep").agg(F.avg((F.col("label_src") == F.col("label_dst")).cast("double")).alias("share"))
    null = null.agg(F.avg("share").alias("null_mean"), F.stddev_pop("share").alias("null_sd"))
    z = F.try_divide(F.col("same") - F.col("null_mean"), "null_sd")
    return same_share(pairs, labels).crossJoin(F.broadcast(null)).withColumn("z", z).withColumn("ratio", F.try_divide("same", "null_mean"))  # one row each


def touching_cells(boxes: DataFrame, size: float) -> DataFrame:
    """src, dst: pairs of boxes (id, x0, y0, x1, y1) that touch or overlap: an equi-join on grid cells, then the exact test.

    Adjacency of polygons is not computed; give their bounding boxes here, or an edge table to the operators above.
    """
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size).cast("long"), F.floor(F.col(hi) / size).cast("long")))
    cells = boxes.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    a = cells.select("cx", "cy", F.col("id").alias("src"), *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")))
    b = cells.select("cx", "cy", F.col("id").alias("dst"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    met = a.join(b, ["cx", "cy"]).where("src < dst and a_x0 <= b_x1 and b_x0 <= a_x1 and a_y0 <= b_y1 and b_y0 <= a_y1")
    return met.select("src", "dst").distinct()
