"""Cases with known answers, and invariants."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane import functions as T
from terrane.operators import clustering, dynamics, explain, features, graphs, panel, quality, validate, voting
from terrane.operators.shared import coin_p
from terrane.sources import read_csv, read_json, table, write_csv, write_json


def one(df):
    (row,) = df.collect()
    return row


@pytest.fixture(scope="module")
def cliques(spark):
    """Two complete groups of five and no edge between them."""
    edges = [(a, b, 2.0) for g in (range(5), range(5, 10)) for a, b in itertools.permutations(g, 2)]
    return spark.createDataFrame(edges, "src long, dst long, w double"), spark.createDataFrame([(i, i // 5) for i in range(10)], "id long, label int")


def test_two_cliques(spark, cliques):
    edges, labels = cliques
    for l in (labels, labels.withColumn("label", 1 - F.col("label"))):
        r = one(quality.graph_indices(edges, l))
        assert abs(r.AVI - 1) < 1e-12 and abs(r.AVU) < 1e-12 and abs(r.MQ - 0.5) < 1e-12
    assert one(graphs.within_share(edges, labels)).within_share == 1
    found = {r.id: r.component for r in graphs.components(edges, labels).collect()}
    assert found == {i: 5 * (i // 5) for i in range(10)}
    again = {r.id: r.label for r in clustering.communities(edges, labels).collect()}
    assert len(set(again.values())) == 2 and all(again[i] == again[5 * (i // 5)] for i in range(10))
    r = one(graphs.diagnostics(edges, labels))
    assert (r.edges, r.mean_degree, r.same_label_share) == (20, 4.0, 1.0)


def ballots(spark, rows, voters):
    columns = ", ".join(f"{v} double" for v in voters)
    return voting.ballots(spark.createDataFrame(rows, f"c string, {columns}"), "c", voters)


def test_votes(spark):
    # "fig" beats each other candidate for three of five voters; the fourth and fifth rank it third and second.
    rows = [("date", 10.0, 20.0, 30.0, 45.0, 50.0), ("fig", 40.0, 40.0, 40.0, 25.0, 41.0), ("lime", 30.0, 35.0, 12.0, 30.0, 11.0), ("pear", 20.0, 10.0, 25.0, 11.0, 30.0)]
    votes = ballots(spark, rows, dict.fromkeys("vwxyz", 1))
    for rule in voting.RULES.values():
        scores = {r.candidate: r.score for r in rule(votes).collect()}
        assert max(scores, key=scores.get) == "fig" and list(scores.values()).count(scores["fig"]) == 1
    # Middling for all is better than best for three and worst for one, as a bad grade isn't made good.
    rows = [("steady", 6.0, 6.0, 6.0, 6.0), ("peaks", 8.0, 9.0, 7.0, 1.0), ("low", 2.0, 1.0, 3.0, 8.0)]
    votes = ballots(spark, rows, dict.fromkeys("wxyz", 1))
    scores = {r.candidate: r.score for r in voting.threshold(votes).collect()}
    assert max(scores, key=scores.get) == "steady"
    r = {x.rule: x for x in voting.rule_table(votes, "steady").collect()}
    assert r["threshold_3"].chosen_alone and r["threshold_3"].winners == "steady"
    silent = ballots(spark, [("A", 1.0, None), ("B", 2.0, 3.0)], {"x": -1, "y": 1})
    assert {(v.candidate, v.score) for v in silent.collect()} == {("A", -1.0), ("B", -2.0)}


def test_monic(spark):
    """7 keeps 18 of its 20 and takes all 12 of 8; 9 falls into two parts and a rest; 5 and 6 go on, 5 with two more."""
    kinds = {7: {7: 18, 3: 2}, 8: {7: 12}, 9: {1: 8, 2: 8, 4: 4}, 5: {5: 30}, 6: {6: 28, 5: 2}}
    moves = [(a, b) for a, to in kinds.items() for b, n in to.items() for _ in range(n)]
    labels = spark.createDataFrame([(i, w, x) for i, pair in enumerate(moves) for w, x in enumerate(pair)], "id long, window int, label int")
    found = {(r.event, r.label): r for r in dynamics.monic(labels).collect()}
    assert set(found) == {("absorb", 7), ("absorb", 8), ("split", 9), ("survive", 5), ("survive", 6), ("emerge", 3), ("emerge", 4)}
    assert found["split", 9].to == [1, 2] and found["absorb", 7].absorbed == [8] and found["absorb", 8].internal == "grow"
    assert found["survive", 5].internal == "grow" and found["survive", 6].internal == "shrink" and found["absorb", 7].overlap == 0.9
    gone = dynamics.monic(spark.createDataFrame([(i, w, 0 if w == 0 else 1 + i % 6) for w in (0, 1) for i in range(60)], "id long, window int, label int")).collect()
    assert sorted(r.event for r in gone) == ["disappear"] + ["emerge"] * 6
    ari = {r.window: r.ari for r in dynamics.consecutive_ari(labels.union(labels.where("window = 1").withColumn("window", F.lit(2)))).collect()}
    assert ari[2] == 1 and 0 < ari[1] < 1


def test_threshold_tree(spark):
    """Four groups in a row along the first of three places; the second and third tell nothing."""
    rng = np.random.default_rng(11)
    y = rng.permutation(np.arange(480) % 4)
    x = np.column_stack((10.0 * y + rng.uniform(-2, 2, 480), rng.uniform(-2, 2, (480, 2))))
    points = spark.createDataFrame([(i, list(map(float, v)), int(l)) for i, (v, l) in enumerate(zip(x, y))], "id long, vec array<double>, label int")
    tree = explain.threshold_tree(points)
    assert explain.depth(tree) in (2, 3) and sum(n["leaf"] is not None for n in tree) == 4 and {n["feature"] for n in tree} == {0, None}
    assert min(r.fidelity for r in explain.fidelity(points, tree).collect()) == 1
    assert set(explain.leaf_conditions(tree)) == {0, 1, 2, 3}
    assert explain.decision_tree(points) > 0.98
    # The fewest mistakes, by trying every threshold.
    middles = {r.label: r.centre for r in quality.centres(points).collect()}
    best = one(explain.best_split(points, quality.centres(points)))
    own = np.array([middles[l] for l in y])
    tried = []
    for f in range(3):
        v = np.unique(np.concatenate((x[:, f], [c[f] for c in middles.values()])))
        for t in (v[1:] + v[:-1]) / 2:
            if min(c[f] for c in middles.values()) <= t < max(c[f] for c in middles.values()):
                tried.append((int(((x[:, f] <= t) != (own[:, f] <= t)).sum()), f, t))
    assert (best.mistakes, best.f) == min(tried)[:2] and abs(best.theta - min(tried)[2]) < 1e-9


def test_agreement(spark):
    rows = [(i, i % 3, (i % 3) * 7 + 1, i % 4) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x int, y int, z int")
    same, other = quality.contingency(df, "x", "y"), quality.contingency(df, "x", "z")
    assert one(quality.adjusted_rand(same)).ari == 1 and abs(one(quality.normalized_mutual_information(same)).nmi - 1) < 1e-12
    assert abs(one(quality.cramers_v(same)).v - 1) < 1e-12 and abs(one(quality.cramers_v(other)).v) < 1e-12
    assert one(quality.adjusted_rand(other)).ari < 0.01
    values = df.select(F.col("x").alias("label"), F.when(F.col("id") > 5, F.col("x").cast("double")).alias("value"))
    assert abs(one(quality.eta_squared(values)).eta2 - 1) < 1e-12


def pair_agreement(x, y):
    """The adjusted Rand index, pair by pair."""
    pairs = list(itertools.combinations(range(len(x)), 2))
    a, b = ([v[i] == v[j] for i, j in pairs] for v in (x, y))
    both, expected, most = sum(map(min, a, b)), sum(a) * sum(b) / len(pairs), (sum(a) + sum(b)) / 2
    return 1.0 if most == expected else (both - expected) / (most - expected)


def test_bootstrap(spark):
    """Repeats fitted in one plan give what each repeat gives alone, by NumPy and pair by pair."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3)) + 1.5 * (np.arange(90) % 3)[:, None]
    first = np.array([x[np.arange(90) % 3 == k].mean(0) for k in range(3)])
    points = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, vec array<double>, label int")
    starts = spark.createDataFrame([(r, k, first[k].tolist()) for r in range(4) for k in range(3)], "rep long, label int, centre array<double>")
    fit = lambda p: clustering.lloyd(p, starts, by=("rep",))
    got = {r.rep: r.ari for r in quality.bootstrap_ari(points.select("id", "vec"), points, fit, 4).collect()}
    drawn = quality.subsamples(points.select("id", "vec"), 4, 0.8).collect()
    assert sorted(got) == [0, 1, 2, 3]
    for rep, ari in got.items():
        ids = sorted(r.id for r in drawn if r.rep == rep)
        assert len(ids) == 72
        middles, near = first, None
        for _ in range(21):
            near = ((x[ids][:, None] - middles[None]) ** 2).sum(2).argmin(1)
            middles = np.array([x[ids][near == k].mean(0) for k in range(3)])
        assert abs(ari - pair_agreement([i % 3 for i in ids], list(near))) < 1e-9
    assert len(set(got.values())) > 1


def test_planted_groups(spark):
    points, edges = clustering.planted(spark, 240, 3, 4, 6.0, 8.0, 20.0)
    truth = points.select("id", F.col("label").alias("true"))
    blind = points.select("id", "vec")
    for name in ("kmeans", "kefrin", "ward", "mixture"):
        found = clustering.run_method(name, 3, blind, edges, edges)
        ari = one(quality.adjusted_rand(quality.contingency(found.join(truth, "id"), "label", "true"))).ari
        assert ari > 0.9, name
    assert clustering.communities_k(edges, points, 3).select("label").distinct().count() >= 2
    assert clustering.ml_kmeans(blind, 3).count() == 240
    warm = clustering.warm_kmeans(points, points.select("id", "label"))
    assert warm.where("margin < 0 or margin > 1").isEmpty()
    flipped = warm.select("id", ((F.col("label") + 1) % 3).cast("int").alias("label"))
    back = dynamics.match_labels(points.select("id", "label"), flipped)
    assert one(back.join(truth, "id").agg(F.avg((F.col("label") == F.col("true")).cast("double")))) [0] > 0.95
    with pytest.raises(ValueError, match="ward"):
        clustering.ward(blind, 3, most=10)


def test_kefrin_distance_is_that_of_dense_rows(spark):
    points, edges = clustering.planted(spark, 40, 2, 3, 2.0, 6.0, 5.0)
    labels = points.select("id", "label")
    terms = clustering.network_terms(edges, points)
    weight = clustering.network_weight(points, terms, 0.4)
    got = {r.id: (r.label, r.d) for r in clustering.combined_step(points, edges, terms, labels, weight).collect()}
    rows = sorted(points.collect())
    x, lab, a = np.array([r.vec for r in rows]), np.array([r.label for r in rows]), np.zeros((40, 40))
    for r in edges.collect():
        a[r.src, r.dst] = r.w
    r = a.sum(1)
    p = a - np.outer(r, r) / r.sum()
    rho = 0.4 / 0.6 * ((x - x.mean(0)) ** 2).sum() / ((p - p.mean(0)) ** 2).sum()
    assert abs(rho - weight) < 1e-9 * rho
    z = np.hstack([x, np.sqrt(rho) * p])
    d = ((z[:, None] - np.stack([z[lab == c].mean(0) for c in (0, 1)])[None]) ** 2).sum(2)
    for i in range(40):
        assert got[i][0] == int(d[i].argmin()) and abs(got[i][1] - d[i].min()) < 1e-8


def test_dtw(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 5, 9, 2))

    def slow(a, b, band):
        t = len(a)
        c = np.full((t + 1, t + 1), np.inf)
        c[0, 0] = 0
        for i in range(1, t + 1):
            for j in range(max(1, i - band), min(t, i + band) + 1):
                c[i, j] = ((a[i - 1] - b[j - 1]) ** 2).sum() + min(c[i - 1, j - 1], c[i - 1, j], c[i, j - 1])
        return np.sqrt(c[t, t])

    assert np.allclose(graphs.banded_dtw(x, y, 2), [slow(a, b, 2) for a, b in zip(x, y)])
    vectors = spark.createDataFrame([(i, [float(v) for v in m.ravel()]) for i, m in enumerate(x)], "id long, vec array<double>")
    got = {(r.src, r.dst): r.x for r in graphs.nearest(vectors, 4, "dtw", channels=2).collect()}
    assert len(got) == 20 and all(abs(v - slow(x[a], x[b], 2)) < 1e-8 for (a, b), v in got.items())


def test_tiles_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=5)]) for i in range(60)], "id long, vec array<double>")
    for metric in ("cosine", "euclid"):
        whole = sorted(map(tuple, graphs.nearest(vectors, 7, metric).collect()))
        monkeypatch.setattr(graphs, "TILE", 13)
        assert sorted(map(tuple, graphs.nearest(vectors, 7, metric).collect())) == whole
        monkeypatch.undo()
    g = graphs.build_graph("attr", 7, vectors)
    assert g.join(g.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("v")), ["src", "dst"]).where("w = v").count() == g.count()


def test_panel(spark):
    cells = [(e, f"2020-0{m}-01", c, 1.0 + e) for e in (1, 2, 3) for m in (1, 2) for c in "xy"]
    cells = spark.createDataFrame([c for c in cells if c[:3] != (2, "2020-02-01", "y")] + [(4, "2020-01-01", "x", 0.0)], "entity long, period string, category string, value double").withColumn("period", F.col("period").cast("date"))
    assert {r.entity for r in panel.complete_panel(cells).collect()} == {1, 3}
    assert {(r.entity, r.missing) for r in panel.dropped_entities(cells).collect()} == {(2, 1), (4, 4)}
    shares = panel.unit_table(panel.complete_panel(cells)).groupBy("entity").agg(F.sum("share").alias("s"))
    assert all(abs(r.s - 1) < 1e-12 for r in shares.collect())
    w = features.windows(panel.complete_panel(cells), 2, 1)
    assert {(r.window, r.place) for r in w.collect()} == {(0, 0), (0, 1)}
    versions = spark.createDataFrame([("a", 2000, 2010), ("a", 2010, 2020), ("b", 1990, 1995)], "k string, year_from int, year_to int")
    assert {(r.k, r.year_from, r.exact) for r in panel.valid_version(versions, "k", 2010).collect()} == {("a", 2010, True), ("b", 1990, False)}


def test_lag(spark):
    base = [random.Random(1).random() for _ in range(1)] + [((i * 37) % 11) / 3 for i in range(29)]
    rows = [(1, t, "c", base[t]) for t in range(30)] + [(2, t, "c", base[t - 2] if t >= 2 else 0.5) for t in range(30)]
    series = spark.createDataFrame(rows, "entity long, t int, channel string, x double")
    edges = spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, w double")
    r = one(graphs.best_lag(graphs.lag_correlation(edges, series, 3)))
    assert r.lag == 2 and r.r > 0.99


def test_matching(spark):
    entities = spark.createDataFrame([("1",), ("2",), ("3",)], "k string")
    first = spark.createDataFrame([("1", 5.0, None), ("2", None, None)], "k string, wage double, staff double")
    second = spark.createDataFrame([("1", 9.0, 9.0), ("2", 7.0, 7.0)], "k string, wage double, staff double")
    got = {r.k: (r.wage, r.staff, r.fallback) for r in validate.fallback_match(entities, "k", first, second, ["wage", "staff"], ["wage", "staff"]).collect()}
    assert got == {"1": (5.0, None, False), "2": (7.0, 7.0, True), "3": (None, None, True)}
    assert abs(validate.binomial_p(3, 10) - 0.34375) < 1e-12 and validate.binomial_p(5, 10) == pytest.approx(1.0)
    assert dynamics.best_assignment([[0.1, 0.9], [0.8, 0.85]]) == [1, 0]
    names = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    assert {(r.k, r.v) for r in validate.unique_name_join(entities.union(names.select("k").distinct()), names, "k").collect()} == {("1", None), ("2", None), ("3", None), ("a", 1), ("b", None)}


def test_coin(spark):
    cases = [(3, 10), (5, 10), (0, 7), (7, 7), (0, 0), (400, 1500), (1, 1)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", coin_p(F.col("k"), F.col("n")).alias("p")).collect()
    assert all(abs(r.p - validate.binomial_p(r.k, r.n)) < 1e-9 for r in got) and len(got) == len(cases)


def test_assignment():
    rng = random.Random(7)
    for n in (1, 2, 5, 6):
        w = [[rng.random() for _ in range(n)] for _ in range(n)]
        best = max(sum(w[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert abs(sum(w[i][c] for i, c in enumerate(dynamics.best_assignment(w))) - best) < 1e-12
    assert sorted(dynamics.best_assignment([[float(i == (7 * j) % 60) for j in range(60)] for i in range(60)])) == list(range(60))


def test_silhouettes_and_density(spark):
    """Any tiles give the same silhouettes, and those of all pairs."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3)) + 2 * (np.arange(50) % 3)[:, None]
    label = np.where(np.arange(50) == 49, 9, np.arange(50) % 3)
    points = spark.createDataFrame([(i, list(map(float, v)), int(l)) for i, (v, l) in enumerate(zip(x, label))], "id long, vec array<double>, label int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for tile in (2048, 13):
        got = {r.id: r.s for r in quality.silhouettes(points, tile).collect()}
        for i in range(49):
            a = d[i][label == label[i]].sum() / ((label == label[i]).sum() - 1)
            b = min(d[i][label == l].mean() for l in {0, 1, 2, 9} - {int(label[i])})
            assert abs(got[i] - (b - a) / max(a, b)) < 1e-9
        assert got[49] == 0


def test_text_functions(spark):
    r = one(
        spark.createDataFrame([("79-701-000-000", "  Ab \t C ", "1 234,5", 0.125, "x")], "a string, b string, c string, d double, e string").select(
            T.digits_key(F.col("a")), T.name_key(F.col("b")), T.decimal_comma(F.col("c")), T.signed_percent(F.col("d"), 1), T.signed_percent(-F.col("d"), 1), T.decimal_comma(F.col("e")), T.padded(F.lit(7), 5)
        )
    )
    assert tuple(r) == ("79701000", "ab c", 1234.5, "+12.5%", "−12.5%", None, "00007")


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("007", 1.5, [1, 2]), ("008", float("nan"), [])], "code string, x double, to array<int>")
    write_csv(df, f"{tmp_path}/csv", ["code"])
    back = read_csv(spark, f"{tmp_path}/csv", "code string, x double, to string")
    assert [r.code for r in back.orderBy("code").collect()] == ["007", "008"] and one(back.where("code = '007'")).to == "[1,2]"
    write_json(df, f"{tmp_path}/json")
    assert {(r.code, r.x) for r in read_json(spark, f"{tmp_path}/json").collect()} == {("007", 1.5), ("008", None)}
    narrow = table(spark, "/root/testdata/sf0.001", "lineitem", ["l_orderkey"], F.col("l_quantity") > 49)
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan and "l_extendedprice" not in plan


def test_shuffled_labels_and_subsamples(spark, cliques):
    edges, labels = cliques
    deals = graphs.shuffled_labels(labels, 5)
    assert {(r.rep, r.label, r["count"]) for r in deals.groupBy("rep", "label").count().collect()} == {(i, l, 5) for i in range(5) for l in (0, 1)}
    r = one(graphs.join_count(graphs.upper(edges), labels, 30))
    assert r.same == 1 and r.null_mean < 1 and r.z > 0
    assert {x["count"] for x in quality.subsamples(labels, 3, 0.8).groupBy("rep").count().collect()} == {8}
