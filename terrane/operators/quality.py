"""Quality of a partition and agreement of two, as one-row or small tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.shared import ratio, row_numbers, squared_distance, written


def block_matrix(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """k, l, s: edge weight from cluster k to cluster l; labels: id, label."""
    a, b = (labels.select(F.col("id").alias(e), F.col("label").alias(n)) for e, n in (("src", "k"), ("dst", "l")))
    return edges.join(a, "src").join(b, "dst").groupBy("k", "l").agg(F.sum("w").alias("s"))


def graph_indices(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: AVI (isolation), AVU (fusion), ANUI = AVI / (1 + AVI AVU), MQ (modularity). Empty denominators give 0."""
    blocks = block_matrix(edges, labels)
    names = labels.select(F.col("label").alias("k")).distinct()
    diagonal = F.sum(F.when(F.col("k") == F.col("l"), F.col("s")).otherwise(0.0))
    rows = blocks.groupBy("k").agg(F.sum("s").alias("degree"), diagonal.alias("inner"))
    rows = names.join(rows, "k", "left").select("k", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("degree", "inner")))
    rows = rows.withColumn("outer", F.col("degree") - F.col("inner"))
    to = rows.select(F.col("k").alias("l"), F.col("outer").alias("outer_l"))  # the graph is symmetric
    fused = blocks.where("k <> l").join(rows.select("k", "outer"), "k").join(to, "l")
    fused = fused.agg(F.sum(ratio(F.col("s"), F.col("outer") + F.col("outer_l") - F.col("s"))).alias("fused"))
    total = rows.agg(F.sum("degree").alias("m2"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    share = ratio(F.col("degree"), F.col("m2"))
    found = rows.agg(F.avg(ratio(F.col("inner"), F.col("degree"))).alias("AVI"), F.sum(ratio(F.col("inner"), F.col("m2")) - share * share).alias("MQ"), F.count("*").alias("K"))
    found = found.crossJoin(F.broadcast(fused)).withColumn("AVU", F.coalesce("fused", F.lit(0.0)) / F.col("K"))  # one row
    return found.select("AVI", "AVU", (F.col("AVI") / (1 + F.col("AVI") * F.col("AVU"))).alias("ANUI"), "MQ")


def _long(points: DataFrame, *by: str) -> DataFrame:
    """id, label, f, x from points (id, vec, label)."""
    return points.select(*by, "id", "label", F.posexplode("vec").alias("f", "x"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """One row: between, within, CH of points (id, vec, label)."""
    own = _long(points).groupBy("label", "f").agg(F.avg("x").alias("c"), F.count("*").alias("n"), F.var_pop("x").alias("v"))
    sums = own.groupBy("f").agg(F.sum(F.col("n") * F.col("v")).alias("within"), (F.sum(F.col("n") * F.col("c") * F.col("c")) - F.pow(F.sum(F.col("n") * F.col("c")), F.lit(2)) / F.sum("n")).alias("between"), F.sum("n").alias("n"), F.count("*").alias("k"))
    found = sums.agg(F.sum("between").alias("between"), F.sum("within").alias("within"), F.max("n").alias("n"), F.max("k").alias("k"))
    ch = F.try_divide(F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1))
    return found.select("between", "within", ch.alias("CH"))


def centres(points: DataFrame, *by: str) -> DataFrame:
    """label, centre, size, var_norm of points (id, vec, label): a row for each cluster, of each group of ``by`` if given."""
    own = _long(points, *by).groupBy(*by, "label", "f").agg(F.avg("x").alias("c"), F.count("*").alias("n"), F.var_pop("x").alias("v"))
    row = F.array_sort(F.collect_list(F.struct("f", "c")))
    return own.groupBy(*by, "label").agg(F.transform(row, lambda r: r["c"]).alias("centre"), F.max("n").alias("size"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("var_norm"))


def s_dbw(points: DataFrame) -> DataFrame:
    """One row: Scat, Dens_bw, S_Dbw, zero_density (clusters with no point near their centre). Pairs of clusters whose
    densities are both 0 add nothing but count in the mean."""
    own = centres(points)
    whole = _long(points).groupBy("f").agg(F.var_pop("x").alias("v")).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("whole"))
    radius = own.agg((F.sqrt(F.sum("var_norm")) / F.count("*")).alias("radius"), F.avg("var_norm").alias("mean_norm"), F.count("*").alias("k"))
    a = own.select(F.col("label").alias("p"), F.col("centre").alias("c_p"))
    b = own.select(F.col("label").alias("q"), F.col("centre").alias("c_q"))
    middle = a.crossJoin(b).where("p <= q").select("p", "q", F.zip_with("c_p", "c_q", lambda x, y: (x + y) / 2).alias("mid"))  # clusters only
    # A point is near the middles of its own cluster with each, so two equal-joins do: as p, and as q of another p.
    sides = middle.withColumn("label", F.col("p")).union(middle.where("p < q").withColumn("label", F.col("q")))
    near = points.join(sides, "label").crossJoin(F.broadcast(radius))  # one row
    inside = F.count_if(F.sqrt(squared_distance("vec", "mid")) <= F.col("radius"))
    counts = near.groupBy("p", "q").agg(inside.alias("inside"))
    single = counts.where("p = q")
    pairs = counts.where("p < q").join(single.select("p", F.col("inside").alias("d_p")), "p").join(single.select("q", F.col("inside").alias("d_q")), "q")
    dens = pairs.agg((2 * F.sum(ratio(F.col("inside").cast("double"), F.greatest("d_p", "d_q").cast("double")))).alias("dens"))
    zero = single.agg(F.count_if(F.col("inside") == 0).alias("zero_density"))
    row = radius.crossJoin(whole).crossJoin(dens).crossJoin(zero)  # one row each
    scat, bw = F.col("mean_norm") / F.col("whole"), ratio(F.coalesce("dens", F.lit(0.0)), F.col("k") * (F.col("k") - 1))
    return row.select(scat.alias("Scat"), bw.alias("Dens_bw"), (scat + bw).alias("S_Dbw"), "zero_density")


def silhouettes(points: DataFrame, tile: int = 2048) -> DataFrame:
    """id, label, s: Euclidean silhouettes of points (id, vec, label); singletons get 0.

    Blocks of points meet in tiles, each a matrix of distances of bounded size that is summed by cluster at once, so only
    n * clusters * blocks rows leave the tiles.
    """
    blocks = max(1, -(-points.count() // tile))
    own, each = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = points.select("id", "label", F.col("vec").alias("x"), own.alias("block"), each.alias("other"))
    right = points.select(F.col("id").alias("of"), F.col("label").alias("to"), F.col("vec").alias("y"), each.alias("block"), own.alias("other"))
    kind = points.schema["label"].dataType.simpleString()

    def summed(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"id": a.column("id").slice(0, 0), "label": a.column("label").slice(0, 0), "to": b.column("to").slice(0, 0), "d": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        x, y = (np.stack(t.column(c).to_numpy(zero_copy_only=False)).astype(float) for t, c in ((a, "x"), (b, "y")))
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0))
        d[a.column("id").to_numpy()[:, None] == b.column("of").to_numpy()[None, :]] = 0
        names = pc.dictionary_encode(b.column("to").combine_chunks())
        at, k = names.indices.to_numpy(), len(names.dictionary)
        total = d @ (at[:, None] == np.arange(k)[None, :])
        rows = pa.array(np.repeat(np.arange(len(a)), k))
        return pa.table({"id": a.column("id").take(rows), "label": a.column("label").take(rows), "to": names.dictionary.take(pa.array(np.tile(np.arange(k), len(a)))), "d": total.ravel(), "n": np.tile(np.bincount(at, minlength=k), len(a))})

    tiles = left.groupBy("block", "other").cogroup(right.groupBy("block", "other"))
    tiles = tiles.applyInArrow(summed, f"id {points.schema['id'].dataType.simpleString()}, label {kind}, to {kind}, d double, n long")
    sums = tiles.groupBy("id", "label", "to").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    inside = F.max(F.when(F.col("label") == F.col("to"), ratio(F.col("d"), F.col("n") - 1)))
    size = F.max(F.when(F.col("label") == F.col("to"), F.col("n")))
    rest = F.min(F.when(F.col("label") != F.col("to"), F.col("d") / F.col("n")))
    found = sums.groupBy("id", "label").agg(inside.alias("a"), rest.alias("b"), size.alias("size"))
    s = F.when(F.col("size") == 1, 0.0).otherwise(ratio(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return found.select("id", "label", s.alias("s"))


def all_indices(points: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: SW (mean silhouette), CH, Scat, Dens_bw, S_Dbw and the graph's AVI, AVU, ANUI, MQ of points (id, vec, label)."""
    parts = (silhouettes(points).agg(F.avg("s").alias("SW")), calinski_harabasz(points).select("CH"), s_dbw(points).drop("zero_density"), graph_indices(edges, points.select("id", "label")))
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)  # one row each
    return row


def contingency(labels: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    return labels.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def adjusted_rand(table: DataFrame, *by: str) -> DataFrame:
    """ari from counts (a, b, n), one row or a row for each group of ``by``; 1 where both partitions are trivial."""
    pairs = lambda n: n * (n - 1) / 2
    both = table.groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("all"))
    side = lambda c: table.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias(f"in_{c}"))
    row = both.join(side("a"), list(by)).join(side("b"), list(by)) if by else both.crossJoin(side("a")).crossJoin(side("b"))  # one row each
    expected = ratio(F.col("in_a") * F.col("in_b"), pairs(F.col("all")))
    most = (F.col("in_a") + F.col("in_b")) / 2
    return row.select(*by, F.when(most == expected, 1.0).otherwise(F.try_divide(F.col("both") - expected, most - expected)).alias("ari"))


def normalized_mutual_information(table: DataFrame) -> DataFrame:
    """One row: nmi with the arithmetic mean of entropies from counts (a, b, n); 1 where both are trivial."""
    total = table.agg(F.sum("n").alias("total"))
    p = table.crossJoin(F.broadcast(total)).select("a", "b", (F.col("n") / F.col("total")).alias("p"))  # one row
    pa, pb = (p.groupBy(c).agg(F.sum("p").alias(f"p_{c}")) for c in "ab")
    joint = p.join(pa, "a").join(pb, "b").agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("p_a") * F.col("p_b")))).alias("mi"))
    entropy = lambda t, c: t.agg((-F.sum(F.col(f"p_{c}") * F.ln(f"p_{c}"))).alias(f"h_{c}"))
    row = joint.crossJoin(entropy(pa, "a")).crossJoin(entropy(pb, "b"))  # one row each
    mean = (F.col("h_a") + F.col("h_b")) / 2
    return row.select(F.when(mean < 1e-15, 1.0).otherwise(F.try_divide("mi", mean)).alias("nmi"))


def cramers_v(table: DataFrame) -> DataFrame:
    """One row: chi2, v from counts (a, b, n); empty cells count."""
    rows, cols = (table.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in "ab")
    total = table.agg(F.sum("n").alias("total"))
    cells = rows.crossJoin(cols).crossJoin(F.broadcast(total)).join(table, ["a", "b"], "left")  # labels by labels
    expected = F.col("n_a") * F.col("n_b") / F.col("total")
    chi2 = F.sum(F.pow(F.coalesce("n", F.lit(0)) - expected, F.lit(2)) / expected)
    found = cells.agg(chi2.alias("chi2"), F.max("total").alias("total"), F.least(F.countDistinct("a"), F.countDistinct("b")).alias("least"))
    return found.select("chi2", F.sqrt(F.try_divide("chi2", F.col("total") * (F.col("least") - 1))).alias("v"))


def eta_squared(values: DataFrame, by: str = "label", value: str = "value") -> DataFrame:
    """One row: share of the variance of a value that a label explains; nulls and non-finite values are left out."""
    known = values.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    own = known.groupBy(by).agg(F.avg(value).alias("m"), F.count("*").alias("n"), F.var_pop(value).alias("v"))
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * grand * grand
    return own.agg(F.try_divide(between, between + F.sum(F.col("n") * F.col("v"))).alias("eta2"))


def permutation_baseline(edges: DataFrame, labels: DataFrame, reps: int, seed: int = 42) -> DataFrame:
    """One row: MQ_mean, MQ_sd over shuffled labels of the same sizes; all repeats are one plan."""
    from terrane.operators.graphs import shuffled_labels

    deals = shuffled_labels(labels, reps, seed)
    a, b = (deals.select("rep", F.col("id").alias(e), F.col("label").alias(n)) for e, n in (("src", "k"), ("dst", "l")))
    blocks = edges.join(a, "src").join(b, ["rep", "dst"]).groupBy("rep", "k", "l").agg(F.sum("w").alias("s"))
    rows = blocks.groupBy("rep", "k").agg(F.sum("s").alias("degree"), F.sum(F.when(F.col("k") == F.col("l"), F.col("s")).otherwise(0.0)).alias("inner"))
    m2 = F.sum("degree").over(Window.partitionBy("rep"))
    each = rows.withColumn("q", F.col("inner") / m2 - F.pow(F.col("degree") / m2, F.lit(2))).groupBy("rep").agg(F.sum("q").alias("q"))
    return each.agg(F.avg("q").alias("MQ_mean"), F.stddev_pop("q").alias("MQ_sd"))


def subsamples(points: DataFrame, reps: int, share: float, seed: int = 42) -> DataFrame:
    """rep, and points: in each repeat exactly floor(share n) of them, without replacement."""
    size = int(points.count() * share)
    each = points.select("id").crossJoin(points.sparkSession.range(reps).withColumnRenamed("id", "rep"))
    drawn = row_numbers(each.withColumn("draw", F.xxhash64(F.lit(seed), "rep", "id")), ["rep"], ["draw", "id"]).where(F.col("n") <= size)
    return drawn.select("rep", "id").join(points, "id")


def bootstrap_ari(points: DataFrame, full: DataFrame, fit, reps: int = 20, share: float = 0.8, seed: int = 42) -> DataFrame:
    """rep, ari of a refitted partition against full (id, label) on the subsample's points.

    fit: (rep, id, vec) -> (rep, id, label), a partition for each rep; repeats are a column, so all are fitted in one plan.
    """
    again = fit(written(subsamples(points, reps, share, seed))).select("rep", "id", F.col("label").alias("again"))
    return adjusted_rand(contingency(again.join(full.select("id", "label"), "id"), "label", "again", "rep"), "rep")
