import hashlib
import random

import numpy as np
from helpers import WORDS, awkward, prose, table
from pyspark.sql import functions as F

from terrane.llm import fingerprints as P
from terrane.llm.common import U64, mix


def stepwise(text):
    """The walk step by step, as defined."""
    out, i, step = [], 0, 0
    samples = {0, *(int(s) for b in range(16) for s in P.octave(b))}
    while i < len(text):
        code = int(mix(np.array([ord(text[i])], U64) * U64(0x9E3779B97F4A7C15))[0])
        if step in samples:
            out.append(P.SYMBOLS[(code & 0xFFFF) % len(P.SYMBOLS)])
        c = (code >> 60) % P.CLASSES
        i += int(mix(np.array([step * P.CLASSES + c + (1 << 40)], U64))[0] >> U64(63)) == 0
        step += 1
    return "".join(out)


def test_walk_step_by_step(monkeypatch):
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (1, 2, 9, 40, 300)] + ["", "a", "é😀", "x" * 900, "\x00\n"]
    assert P.fingerprints(texts) == [stepwise(t) for t in texts]
    assert [P.fingerprints([t])[0] for t in texts] == P.fingerprints(texts)
    long = prose(rng, 12000)
    together = P.fingerprints([long, texts[0]])
    monkeypatch.setattr(P, "LONG", 50)
    assert P.fingerprints([long, texts[0]]) == together and P.fingerprints(texts) == [stepwise(t) for t in texts]


def test_likeness_follows_edits():
    rng = random.Random(2)
    a = [prose(rng, 400) for _ in range(40)]
    few = [t.replace(t.split()[300], "changed", 1) for t in a]
    got = [P.likeness(x, y) for x, y in zip(P.fingerprints(a), P.fingerprints(few))]
    assert np.median(got) > 0.9
    assert max(P.likeness(x, y) for x, y in zip(P.fingerprints(a), P.fingerprints(a[1:]))) < 0.35
    assert P.likeness("", "") == 1 and P.likeness("", "ab") == 0 and P.likeness("abc", "abc") == 1


def in_order(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    return [(r[0], r[1] or "", (s[1] or "")) for r, s in zip(rows, rows[1:] + rows[:1])]


def test_next_documents(spark, monkeypatch):
    for per_range in (2000, 7):
        monkeypatch.setattr(P, "ROWS", per_range)
        rows = awkward(4)
        got = sorted(P.with_next(table(spark, rows)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_chars))
        want = in_order(rows)
        assert [(r.doc_id, r.n_chars, r.edited_text) for r in got] == [(d, len(t), P.edited(t, s)) for d, t, s in want]
        for r, (_, t, s) in zip(got, want):
            x, y, z = P.fingerprints([t, r.edited_text, s])
            assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (x, y, P.likeness(x, y), P.likeness(x, z))


def test_one_and_none(spark):
    assert P.with_next(table(spark, [])).collect() == []
    (r,) = P.with_next(table(spark, [(3, "abcdefgh", None, None, 0, None, None)])).collect()
    assert (r.edited_text, r.near_next) == ("abcdefab", 1.0)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = sorted(docs)
    got = {r.doc_id: r for r in P.op4_edit_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    assert sorted(got) == ids
    for d, e in zip(ids, ids[1:] + ids[:1]):
        assert got[d].edited_sha256 == hashlib.sha256(P.edited(docs[d], docs[e]).encode()).hexdigest()
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95
    # Classes against all pairs of the table's distinct fingerprints: nothing linked that isn't alike, and nine of ten links found.
    prints = sorted({r.fingerprint for r in got.values()})
    want = brute_classes(prints)
    classes, wanted = {}, {}
    for d in ids:
        classes.setdefault(got[d].near_class, set()).add(d)
        wanted.setdefault(want[got[d].fingerprint], set()).add(d)
    assert all(min(c) == k for k, c in classes.items())
    assert all(any(c <= w for w in wanted.values()) for c in classes.values())
    pairs = sum(len(w) * (len(w) - 1) for w in wanted.values())
    assert pairs and sum(len(c) * (len(c) - 1) for c in classes.values()) >= 0.9 * pairs


def test_near_documents(spark):
    rng = random.Random(8)
    base = [prose(rng, 200) for _ in range(12)]
    rows = []
    for i, t in enumerate(base):
        for k in range(4):
            w = t.split()
            w[190 + k] = rng.choice(WORDS)
            rows.append((10 * i + k, " ".join(w), "en", "a", 0, "", 0))
    docs = table(spark, rows)
    found = P.near_documents(docs)
    got = P.fingerprint(docs).join(found, "fingerprint").select("doc_id", "class_id").collect()
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    assert sorted(map(sorted, classes.values())) == [[10 * i + k for k in range(4)] for i in range(12)]
    assert P.near_documents(table(spark, [])).collect() == [] and P.fingerprint(docs.withColumn("fingerprint", F.lit(1))).columns[-1] == "fingerprint"


def brute_classes(prints, least=0.8):
    """Classes by comparing all pairs."""
    up = {x: x for x in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(prints):
        for y in prints[:i]:
            if P.likeness(x, y) >= least:
                up[root(x)] = root(y)
    return {x: root(x) for x in prints}


def found_classes(spark, prints, monkeypatch):
    monkeypatch.setattr(P, "fingerprint", lambda docs, text="text": docs.withColumnRenamed("text", "fingerprint"))
    docs = spark.createDataFrame([(x,) for x in prints], "text string")
    return {r.fingerprint: r.class_id for r in P.near_documents(docs).collect()}


def agree(found, want):
    pairs = {(found[x], want[x]) for x in want}
    return set(found) == set(want) and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_alike_members_whose_pivot_is_unlike_them(spark, monkeypatch):
    """Three groups share one band only; whichever holds the least node, the others are linked too."""
    rng = random.Random(11)
    line = lambda n: "".join(rng.choice(P.SYMBOLS) for _ in range(n))
    prints = []
    for _ in range(6):
        base = line(300)
        for _ in range(3):
            prints.append("".join(rng.choice(P.SYMBOLS) if rng.random() < 0.03 else c for c in base))
    monkeypatch.setattr(P, "all_bands", lambda x: [1], raising=False)
    monkeypatch.setattr(P, "bands", lambda x, *_, **__: [1])
    for tile in (500, 4):
        monkeypatch.setattr(P, "TILE", tile, raising=False)
        want = brute_classes(prints)
        assert len(set(want.values())) == 6 and agree(found_classes(spark, prints, monkeypatch), want)


def test_walks_that_end_on_both_sides_of_a_power_of_two(spark, monkeypatch):
    """Recall against brute force: near copies with some text added at the end."""
    rng = random.Random(12)
    texts = [prose(rng, 330)[:2030] for _ in range(20)]
    texts += [t + prose(rng, 6) for t in texts]
    prints = P.fingerprints(texts)
    octaves = [int(P._weights(len(x))[0][-1]) for x in prints]
    near = [(x, y) for k, (x, y) in enumerate(zip(prints, prints[20:])) if octaves[k] != octaves[k + 20] and P.likeness(x, y) >= 0.8]
    assert near and not any(set(P.bands(x)) & set(P.bands(y)) for x, y in near)
    assert agree(found_classes(spark, prints, monkeypatch), brute_classes(prints))
