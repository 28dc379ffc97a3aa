import hashlib
import random
from collections import Counter

from helpers import awkward, prose, table
from pyspark.sql import functions as F

from terrane.llm.suffix_dedup import remove_repeats


def brute(rows, width=200):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = [i for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])]
        out.append((r[0], len(t), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    got = remove_repeats(table(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256), "spans").collect()
    for r in got:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return sorted((tuple(r)[:5] for r in got), key=str)


def test_brute_force(spark):
    for seed in range(2):
        rows = awkward(seed)
        assert found(spark, rows) == brute(rows)


def test_passages_at_every_alignment(spark):
    rng = random.Random(4)
    passages = [prose(rng, k) for k in (27, 30, 33, 60, 200)]
    rows = []
    for i in range(120):
        inside = rng.choice(passages)
        cut = inside[rng.randrange(30) :] if i % 3 else inside[: -rng.randrange(1, 30)]
        rows.append((i, prose(rng, rng.randrange(60)) + cut + prose(rng, rng.randrange(60)), "en", "a", 0, "", 0))
    rows += [(500 + i, "ab" * (90 + 7 * i), "en", "a", 0, "", 0) for i in range(6)] + [(600, "z" * 199, "", "", 0, "", 0), (601, "z" * 200, "", "", 0, "", 0), (602, "z" * 201, "", "", 0, "", 0)]
    assert found(spark, rows) == brute(rows)


def test_empty_and_extra_columns(spark):
    assert found(spark, []) == []
    docs = table(spark, awkward(1)[:5]).withColumn("kept", F.lit(3)).withColumn("block", F.lit("x"))
    got = remove_repeats(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "sig", "node", "block", "kept", "n_bytes", "n_removed", "n_spans", "spans"]
    assert {r.block for r in got.collect()} == {"x"}
