import random
import re
from collections import Counter

import pytest
from helpers import awkward, table
from pyspark.sql import functions as F

from terrane.llm import mixing


def mixed(docs):
    return mixing.mix_sources(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))


def targets(spark, rows):
    """rows: name -> (words, weight)."""
    df = spark.createDataFrame([(k, *v) for k, v in rows.items()], "source string, words long, weight long")
    return {r.source: r.target for r in mixing.targets(df).collect()}


def shared(rows, most=3):
    """The rule itself: shares by weight, what is above a cap goes round again."""
    out, free, left = {}, set(rows), float(sum(w for w, _ in rows.values()))
    while free:
        unit = left / sum(rows[s][1] for s in free)
        over = {s for s in free if unit * rows[s][1] > most * rows[s][0]}
        for s in over or free:
            out[s] = float(most * rows[s][0]) if over else unit * rows[s][1]
        left -= sum(out[s] for s in over)
        free -= over or free
    return out


def test_targets(spark):
    assert targets(spark, {"a": (1, 5), "b": (100, 2), "c": (100, 1)}) == {"a": 3.0, "b": pytest.approx(132.0), "c": pytest.approx(66.0)}
    assert targets(spark, {"a": (0, 5)}) == {"a": 0.0} and targets(spark, {}) == {}
    rng = random.Random(4)
    for n in (1, 2, 5, 60):
        rows = {f"s{i}": (int(rng.paretovariate(0.5)) % 100_000, rng.choice((5, 2, 1))) for i in range(n)}
        assert targets(spark, rows) == pytest.approx(shared(rows), abs=1e-6)


def test_pairs_decide_one_by_one():
    """Sizes 10, 1, 1, 1 at one half: the small ones are decided each for itself, words stay together, no bias."""
    rng = random.Random(5)
    seen = Counter()
    for _ in range(4000):
        p, a = [0.5] * 4, [10, 1, 1, 1]
        mixing._pair_by_pair(p, a, [rng.random() for _ in p])
        assert sum(x * n for x, n in zip(p, a)) == pytest.approx(6.5) and sum(0 < x < 1 for x in p) <= 1
        seen[tuple(p[1:])] += 1
    assert len(seen) == 8 and all(abs(n - 500) < 120 for n in seen.values())
    # Documents of one size: of two that meet, exactly one is taken.
    for _ in range(50):
        p = [0.5] * 6
        mixing._pair_by_pair(p, [4] * 6, [rng.random() for _ in p])
        assert all(p[i] + p[i + 1] == 1 for i in (0, 2, 4))


@pytest.mark.parametrize("group", [2048, 4])
def test_words_meet_targets(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    rows = awkward(3)
    got = [r.asDict() for r in mixed(table(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in mixed(table(spark, rows).coalesce(1)).collect())
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")) for r in rows if r[0] is not None}
    assert len(got) == len(rows) and all(r["size"] == size[r["doc_id"]] for r in got if r["doc_id"] is not None)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(0 <= r["copies"] <= 3 for r in own)


def test_many_equal_rows(spark, monkeypatch):
    """Copies of one row are documents of their own, and spread over groups."""
    monkeypatch.setattr(mixing, "GROUP", 16)
    monkeypatch.setattr(mixing, "SPREAD", 7)
    rows = [(None, "w " * 5, "", "a", 0, "", 0)] * 400 + [(i, "w " * 9, "", "b", 0, "", 0) for i in range(300)]
    got = mixed(table(spark, rows)).collect()
    assert len(got) == 700 and sum(r.source == "a" for r in got) == 400
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= own[0].size
    assert 1 < len({r.copies for r in got if r.source == "a"})


def test_many_sources(spark, monkeypatch):
    """Beyond FEW sources the plan is joined by a shuffle; order is that of code points, null last."""
    monkeypatch.setattr(mixing, "FEW", 3)
    names = ["Z", "a", "é", "\U0001f600", "\uffee", None]
    rows = [(10 * i + k, "w " * (k + 1), "", s, 0, "", 0) for i, s in enumerate(names) for k in range(8)]
    got = {r.source: r.target for r in mixed(table(spark, rows)).collect()}
    order = sorted(s for s in names if s is not None) + [None]
    assert got == pytest.approx(shared({s: (36, (5, 2, 1)[i % 3]) for i, s in enumerate(order)}))


def test_unbiased(spark):
    rows = [(i, "w " * (1 + i % 7), "", "ab"[i % 3 == 0], 0, "", 0) for i in range(3000)]
    got = mixed(table(spark, rows)).groupBy("source", "size").agg(F.avg("copies").alias("got"), F.first(F.col("target") / F.col("source_size")).alias("want")).collect()
    assert all(abs(r.got - r.want) < 0.12 for r in got)


def test_empty(spark):
    assert mixed(table(spark, [])).collect() == []
