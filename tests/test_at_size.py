"""What showed only on larger tables: ties, copies, many points."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane import functions as T
from terrane import queries
from terrane.operators import clustering, graphs
from terrane.plans import common, panels


def test_signed_percent_as_printf(spark):
    values = [0.125, -0.125, 0.135, 0.375, -0.0, 0.0, -0.004, 0.004, -0.005, 1.0]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(T.signed_percent(F.col("x")).alias("text")).collect()
    want = [duckdb.sql(f"select replace(printf('%+.0f%%', {x!r}::double * 100), '-', '−')").fetchall()[0][0] for x in values]
    assert [r.text for r in got] == want
    assert want[:2] == ["+12%", "−12%"] and want[4] == "−0%"


def test_growth_text_near_zero(spark, monkeypatch):
    rows = [(1, -3e-17), (2, 0.0), (3, 3e-17), (4, -2e-7), (5, 0.25 - 1e-16), (6, 0.125)]
    monkeypatch.setattr(panels, "_growth", lambda s, d: spark.createDataFrame(rows, "entity long, growth double"))
    got = {r.entity: (r.text, r.bin) for r in panels._growth_text(spark, "").collect()}
    assert got == {1: ("+0%", 2), 2: ("+0%", 2), 3: ("+0%", 2), 4: ("−0%", 1), 5: ("+25%", 3), 6: ("+12%", 2)}


def ranked(value, k):
    """(src, dst, value) of the k least values of each row, ties by dst, by sorting whole rows."""
    value = np.round(value, graphs.PLACES)
    np.fill_diagonal(value, np.inf)
    return {(i, int(j), value[i, j]) for i in range(len(value)) for j in np.lexsort((np.arange(len(value)), value[i]))[:k]}


@pytest.mark.parametrize("metric", ["cosine", "euclid", "dtw"])
def test_nearest_with_copies_in_small_tiles(spark, monkeypatch, metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 12)).round(1)
    x[20:40] = x[20]
    x[60:80:2] = x[61:81:2]
    monkeypatch.setattr(graphs, "TILE", 17)
    monkeypatch.setattr(graphs, "CHUNK", 60)
    got = graphs.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>"), 6, metric, channels=3)
    lines = x.reshape(90, 4, 3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {
        "cosine": lambda: -(unit @ unit.T),
        "euclid": lambda: np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)),
        "dtw": lambda: np.stack([graphs.banded_dtw(np.broadcast_to(v, lines.shape), lines, 2) for v in lines]),
    }[metric]()
    sign = -1 if metric == "cosine" else 1
    got, want = {(r.src, r.dst): sign * r.x for r in got.collect()}, {(i, j): v for i, j, v in ranked(want, 6)}
    if metric != "euclid":  # a copy's distance by a matrix product is 1e-8 or 0
        assert got.keys() == want.keys()
    assert len(got) == len(want)
    assert all(abs(got[p] - want[p]) < 1e-6 for p in got.keys() & want.keys())


def test_quick_dtw_is_off_by_less_than_its_bound():
    rng = np.random.default_rng(6)
    for size, t, c, band in ((1e12, 9, 2, 2), (1.0, 20, 4, 2), (1e-9, 5, 1, 0)):
        x, y = rng.normal(size=(30, t, c)) * size, rng.normal(size=(40, t, c)) * size
        y[:3] = x[:3]
        rough, error, top = graphs.quick_dtw(x, y, band)
        exact = np.stack([graphs.banded_dtw(np.broadcast_to(v, y.shape), y, band) for v in x])
        assert abs(rough - (exact / top) ** 2).max() < error < 0.01


def test_components_find_the_graph_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    line = [(i, i + 1, 1.0) for i in range(40)]
    edges = spark.createDataFrame(line + [(b, a, w) for a, b, w in line], "src long, dst long, w double").mapInArrow(counted, "src long, dst long, w double")
    found = graphs.components(edges, spark.range(43))
    assert {r.id: r.component for r in found.collect()} == {i: 0 for i in range(41)} | {41: 41, 42: 42}
    assert calls.value == 80


def test_report_finds_the_graph_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    rng = np.random.default_rng(7)
    points = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(rng.normal(size=(12, 3)))], "id long, vec array<double>, label int")
    line = [(i, i + 1, 1.0) for i in range(8)]
    edges = spark.createDataFrame(line + [(b, a, w) for a, b, w in line], "src long, dst long, w double").mapInArrow(counted, "src long, dst long, w double")
    known = spark.createDataFrame([(0, 1, 5.0), (1, 2, 7.0), (0, 2, 9.0)], "src long, dst long, x double")
    (r,) = graphs.graph_report(edges, points, known).collect()
    assert (r.edges, r.components, r.largest_share, r.same_label_share, r.median_length) == (8, 4, 0.75, 0.0, 6.0)
    assert calls.value == 16
    long = points.select(F.col("id").alias("entity"), F.posexplode("vec").alias("feature", "value"))
    each = {x.feature: x.homophily for x in graphs.homophily(edges, long).collect()}
    assert {x.feature: pytest.approx(x.homophily) for x in graphs.place_homophily(edges, points).collect()} == each and len(each) == 3
    assert r.homophily == pytest.approx(sum(each.values()) / 3)


def test_lag_null_by_the_correlations_of_each_repeat(spark):
    """Whole series at an edge give what lag_correlation gives for shifted ones; a value and a channel are absent."""
    rng = np.random.default_rng(8)
    t, most, reps = 12, 2, 3
    x = {e: {(i, c): float(rng.normal()) for i in range(t) for c in "ab" if (e, i, c) != (1, 4, "b") and (e, c) != (3, "a")} for e in range(5)}
    series = spark.createDataFrame([(e, i, c, v) for e in x for (i, c), v in x[e].items()], "entity long, t int, channel string, x double")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (4, 99)], "src long, dst long")
    drawn = edges.crossJoin(spark.range(reps).withColumnRenamed("id", "rep")).where("dst < 99")
    drawn = drawn.withColumn("shift", most + 1 + F.pmod(F.xxhash64("src", "dst", "rep", F.lit(42)), F.lit(t - 2 * most - 1))).collect()
    rows = [(-1 - i, (m - r["shift"]) % t, c, v) for i, r in enumerate(drawn) for (m, c), v in x[r["dst"]].items()]
    both = series.union(spark.createDataFrame(rows, "entity long, t int, channel string, x double"))
    ends = spark.createDataFrame([(-1 - i, r["src"]) for i, r in enumerate(drawn)], "src long, dst long")
    lag = {r.src: r.lag for r in graphs.best_lag(graphs.lag_correlation(ends, both, most)).collect()}
    want = {rep: np.mean([lag[-1 - i] != 0 for i, r in enumerate(drawn) if r["rep"] == rep]) for rep in range(reps)}
    got = {r.rep: r.share_lagged for r in graphs.lag_null(edges, series, most, reps).collect()}
    assert got == pytest.approx(want)


def test_spectral_finds_neighbours_once(spark, monkeypatch):
    calls, real = [], graphs.nearest
    monkeypatch.setattr(graphs, "nearest", lambda p, k, *a, **kw: (calls.append(k), real(p, k, *a, **kw))[1])
    seen, power = [], clustering.spectral
    monkeypatch.setattr(clustering, "spectral", lambda net, attr, k: (seen.append((net, attr)), power(net, attr, k))[1])
    sf = "/root/testdata/sf0.001"
    found = queries.QUERIES["spectral_labels"](spark, sf)
    assert calls == [15] and {r.label for r in found.collect()} == set(range(4))
    for g, k in zip(seen[0], (15, 10)):
        assert sorted(map(tuple, g.collect())) == sorted(map(tuple, common.graph(spark, sf, k).collect()))


def greedy_ward(x, k):
    """Labels by merging the two clusters of least cost at a time, ties by their least points."""
    groups = {i: [i] for i in range(len(x))}
    while len(groups) > k:
        cost = lambda i, j: len(groups[i]) * len(groups[j]) / (len(groups[i]) + len(groups[j])) * ((x[groups[i]].mean(0) - x[groups[j]].mean(0)) ** 2).sum()
        _, i, j = min((cost(i, j), i, j) for i in groups for j in groups if i < j)
        groups[i] += groups.pop(j)
    return {p: label for label, i in enumerate(sorted(groups)) for p in groups[i]}


@pytest.mark.parametrize("n, copies, k", [(40, 0, 5), (40, 15, 4), (12, 9, 6), (7, 0, 7), (3, 0, 5), (5, 5, 1)])
def test_ward_by_one_merge_at_a_time(spark, n, copies, k):
    x = np.random.default_rng(n + copies).normal(size=(n, 3))
    if copies:
        x[-copies:] = x[n - copies]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    assert {r.id: r.label for r in clustering.ward(points, k).collect()} == greedy_ward(x, k)


def test_ward_takes_more_points_than_a_table_of_distances_would(spark):
    x = np.random.default_rng(9).normal(size=(4300, 2)) + np.arange(4300)[:, None] % 3 * 100
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    assert {r.id: r.label for r in clustering.ward(points, 3).collect()} == {i: i % 3 for i in range(4300)}
