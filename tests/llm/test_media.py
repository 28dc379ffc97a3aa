import hashlib
import random
import zlib

import pytest
from helpers import awkward, prose, table
from pyspark.sql import functions as F

from terrane.llm import media as M


def want(text):
    raw = (text or "").encode()
    p = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
    return len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])


def test_round_trip(spark):
    rows = awkward(6)
    store = M.store_media(table(spark, rows))
    got = store.references.join(M.read_media(store), "medium").collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted((str(r[0]), *want(r[1])) for r in rows)
    by = {}
    for r in got:
        assert r.media_bytes == r.payload_bytes + 44
        assert by.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    files = {want(r[1])[2]: hashlib.sha256(M.to_file(M.payload((r[1] or "").encode()))).hexdigest() for r in rows}
    assert all(files[p] == m for p, (m, _) in by.items())


def test_chunks_are_kept_once(spark):
    rng = random.Random(3)
    shared = prose(rng, 6000)
    rows = [(i, prose(rng, 300 + i) + shared + prose(rng, 200), None, None, 0, None, None) for i in range(12)]
    store = M.store_media(table(spark, rows))
    assert store.chunks.count() == store.chunks.select("digest").distinct().count()
    total = sum(len(c) for r in rows for c in M.chunks(M.to_file(M.payload(r[1].encode()))))
    unpack = M._decompressor(store.dictionary)
    assert sum(len(unpack.decompress(r.body)) for r in store.chunks.collect()) < 0.45 * total
    assert M.read_media(store).count() == 12


def test_cuts_follow_content():
    rng = random.Random(4)
    data = prose(rng, 30000).encode()
    a, b = (set(M.chunks(x)) for x in (data, prose(rng, 50).encode() + data))
    assert len(a & b) >= len(a) - 2 and b"".join(M.chunks(data)) == data
    for x in (b"\0" * 100_000, data):
        assert all(M.LEAST <= len(c) <= M.MOST for c in list(M.chunks(x))[:-1])


def test_damage_is_found(spark):
    store = M.store_media(table(spark, awkward(6)[:9]))
    wrong = M._compressor(store.dictionary).compress(b"other")
    bad = store._replace(chunks=store.chunks.withColumn("body", F.lit(bytearray(wrong))))
    with pytest.raises(Exception, match="damaged"):
        M.read_media(bad).collect()


def test_empty(spark):
    store = M.store_media(table(spark, []))
    assert store.references.join(M.read_media(store), "medium").collect() == []
