import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from helpers import WORDS, awkward, prose, table

from terrane.llm import jaccard_join as J
from terrane.llm.components import connected
from terrane.llm.jaccard_join import Bands, histogram, jaccard_components, least_distance, signatures


def brute(rows, width=5, percent=80):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(root(i), []).append(r[0])
    return sorted(((r[0], len(sets[i]), min((x for x in ids[root(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=str)


def test_brute_force(spark):
    for seed in range(2):
        rows = awkward(seed)
        assert sorted(map(tuple, jaccard_components(table(spark, rows)).collect()), key=str) == brute(rows)


def near_group(seed, n=150):
    """A chain of edits: neighbours are alike, the ends aren't; and documents that only share a passage."""
    rng = random.Random(seed)
    words, passage = prose(rng, 120).split(" "), prose(rng, 60)
    rows = []
    for i in range(n):
        words[rng.randrange(len(words))] = f"{rng.choice(WORDS)}{rng.randrange(99)}"
        rows.append((rng.randrange(10**6), " ".join(words), "en", "a", 0, "", 0))
        rows.append((rng.randrange(10**6), f"{passage} {prose(rng, rng.choice([2, 5, 30]))}", "en", "a", 0, "", 0))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_long_signatures(spark, seed):
    rows = near_group(seed)
    assert sorted(map(tuple, jaccard_components(table(spark, rows)).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert jaccard_components(table(spark, [])).collect() == []
    assert [tuple(r) for r in jaccard_components(table(spark, [(5, None, None, None, 0, None, None)])).collect()] == [(5, 0, 5)]


def test_similar_sets_share_a_signature():
    rng, bands = np.random.default_rng(1), Bands(80)
    for size in (5, 6, 9, 10, 17, 20, 31, 60, 200, 900):
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            lost = rng.integers(0, size // 9 + 1)
            added = rng.integers(0, max(1, int((size - lost) / 0.8) - size + 1))
            y = np.unique(np.concatenate((rng.permutation(x)[: len(x) - lost], rng.integers(0, 1 << 63, added, dtype=np.uint64))))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both) and not np.array_equal(x, y):
                shared = 0
                for (s, _, need), (t, _, too) in [(p, q) for p in signatures(x, bands) for q in signatures(y, bands)]:
                    n = len(set(s.tolist()) & set(t.tolist()))
                    assert n == 0 or n >= max(need, too) or 1 in (need, too)
                    shared += n
                assert shared
                assert (100 + 80) * least_distance(histogram(x), histogram(y)) <= (100 - 80) * (len(x) + len(y))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (20, 21), (21, 22), (22, 23), (30, 20), (30, 31)]
    found = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, **dict.fromkeys(range(5, 10), 5), **dict.fromkeys([20, 21, 22, 23, 30, 31], 20)}


def test_tiles(monkeypatch):
    """Links between components of two tiles, in strips and columns of any size, are those of all pairs."""
    rng = random.Random(3)
    base = [prose(rng, 60).split() for _ in range(4)]
    texts = []
    for k in range(40):
        w = list(base[k % 4])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = rng.choice(WORDS)
        texts.append(" ".join(w))
    side = pa.table({"node": list(range(40)), "component": [k // 2 for k in range(40)], "text": texts})
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for t in texts)]
    want = {(i // 2, j // 2) for i in range(40) for j in range(40) if i // 2 != j // 2 and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    for strip, columns in ((256, 1024), (7, 3)):
        monkeypatch.setattr(J, "STRIP", strip)
        monkeypatch.setattr(J, "COLUMNS", columns)
        got = J._tile(5, 80)(side, side).to_pylist()
        assert {(r["a"] // 2, r["b"] // 2) for r in got} == want and len(got) == len(want)
        for r in got:
            x, y = sets[r["a"]], sets[r["b"]]
            assert 100 * len(x & y) >= 80 * len(x | y)
    assert want
