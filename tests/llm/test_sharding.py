import zlib
from itertools import product

from helpers import awkward, prose, table
from pyspark.sql import functions as F

from terrane.llm.sharding import hilbert_index, hilbert_shards


def test_curve_visits_neighbours(spark):
    for axes, bits in ((2, 3), (3, 2), (3, 3)):
        cells = list(product(range(1 << bits), repeat=axes))
        df = spark.createDataFrame(cells, ", ".join(f"x{i} int" for i in range(axes)))
        got = sorted((r[0], tuple(r)[1:]) for r in df.select(hilbert_index([F.col(c) for c in df.columns], bits), *df.columns).collect())
        assert [k for k, _ in got] == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for (_, x), (_, y) in zip(got, got[1:]))


def check(rows, got, shards):
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted(
        (False, r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows if r[0] is not None
    )
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return {s: sum(r.size for r in own) for s, own in by.items()}


def test_awkward_rows(spark):
    rows = awkward(2)
    check(rows, hilbert_shards(table(spark, rows), 4).collect(), 4)
    assert hilbert_shards(table(spark, [])).collect() == []
    check([(1, None, None, None, 0, None, None)], hilbert_shards(table(spark, [(1, None, None, None, 0, None, None)])).collect(), 16)


def test_near_equal_and_groups_whole(spark):
    import random

    rng = random.Random(5)
    hot = prose(rng, 20)
    rows = [(i, hot if i % 3 == 0 else prose(rng, rng.randrange(1, 60)), rng.choice(["en", "de"]), rng.choice("aaab"), 0, "", 0) for i in range(3000)]
    twins = [prose(rng, 30) for _ in range(40)]
    rows += [(5000 + 10 * i + k, t, rng.choice(["en", "de"]), rng.choice("abc"), 0, "", 0) for i, t in enumerate(twins) for k in range(5)]
    got = hilbert_shards(table(spark, rows), 8).collect()
    sizes = check(rows, got, 8)
    assert len(sizes) == 8 and max(sizes.values()) < 1.15 * min(sizes.values())
    where = {r.doc_id: r.shard for r in got}
    assert all(len({where[5000 + 10 * i + k] for k in range(5)}) == 1 for i in range(40))


def test_bound_for_whole_groups(spark):
    """Sizes differ from their mean by mean / whole and a row at most; groups up to mean / whole stay together; clashing columns."""
    import random

    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(1, 80)) for _ in range(120)]
    rows = [(i, rng.choice(texts), rng.choice(["en", None]), rng.choice("ab"), 0, "", 0) for i in range(1500)]
    rows += [(None, texts[0], "en", "a", 0, "", 0)] * 700  # equal in every column
    docs = table(spark, rows)
    for c in ("size", "shard", "slot", "mark", "cell", "large"):
        docs = docs.withColumn(c, F.lit("x"))
    for shards, whole in ((4, 8), (5, 3)):
        got = hilbert_shards(docs, shards, whole).collect()
        sizes = check(rows, got, shards)
        mean, most = sum(sizes.values()) / shards, max(r.size for r in got)
        assert len(sizes) == shards and all(abs(x - mean) <= mean / whole + most for x in sizes.values())
        groups = {}
        for r in got:
            groups.setdefault((r.text_crc32, r.size), []).append(r.shard)
        assert all(len(set(g)) == 1 for (_, size), g in groups.items() if len(g) * size * whole <= mean)
