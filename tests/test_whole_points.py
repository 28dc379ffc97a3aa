"""Queries without SQL use all points, labels and dimensions."""

import numpy as np
import pytest

from terrane import queries
from terrane.operators import clustering, explain

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def whole(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding", "label").collect()
    return np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])


def test_tree_by_trying_every_threshold(spark, whole):
    x, y = whole
    tree = {r.node: r for r in queries.QUERIES["imm_tree"](spark, SF).collect()}
    assert sorted(r.leaf for r in tree.values() if r.leaf is not None) == sorted(set(y.tolist()))
    middles = {k: x[y == k].mean(0) for k in set(y.tolist())}
    own = np.array([middles[k] for k in y])
    fewest = len(x)
    for f in range(x.shape[1]):
        centres = [c[f] for c in middles.values()]
        v = np.unique(np.concatenate((x[:, f], centres)))
        for t in (v[1:] + v[:-1]) / 2:
            if min(centres) <= t < max(centres):
                fewest = min(fewest, int(((x[:, f] <= t) != (own[:, f] <= t)).sum()))
    assert tree[0].mistakes == fewest


def test_forest_sees_all_points(spark, whole, monkeypatch):
    seen, real = [], explain.forest_scores
    monkeypatch.setattr(explain, "forest_scores", lambda p, **kw: (seen.append(p), real(p, **kw))[1])
    (r,) = queries.QUERIES["forest_scores"](spark, SF).collect()
    assert 0 <= r.accuracy <= 1
    got = sorted((tuple(p.vec), p.label) for p in seen[0].collect())
    assert got == sorted((tuple(v), k) for v, k in zip(whole[0].tolist(), whole[1].tolist()))


def test_mixture_sees_all_dimensions(spark, whole, monkeypatch):
    seen, real = [], clustering.mixture
    monkeypatch.setattr(clustering, "mixture", lambda p, *a: (seen.append(p), real(p, *a))[1])
    got = queries.QUERIES["gmm_labels"](spark, SF).collect()
    assert len(got) == len(whole[0]) and len({r.label for r in got}) > 1
    assert sorted(tuple(p.vec) for p in seen[0].collect()) == sorted(map(tuple, whole[0].tolist()))
