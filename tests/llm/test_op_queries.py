"""The registered queries on a whole small table, against plain Python."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from test_mixing import shared

from terrane.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    (query,) = (q for n, q in catalog.QUERIES.items() if n.startswith(f"{name}_"))
    return query(spark, SF).collect()


def test_op2(spark, docs):
    size = {d: len(re.findall(r"[^\x20\x09-\x0d]+", r.text or "")) for d, r in docs.items()}
    own = Counter()
    for d, r in docs.items():
        own[r.source] += size[d]
    names = sorted(s for s in own if s is not None) + [None] * (None in own)
    goal = shared({s: (own[s], (5, 2, 1)[i % 3]) for i, s in enumerate(names)})
    assert abs(sum(goal.values()) - sum(own.values())) < 1e-6 or all(goal[s] == 3 * own[s] for s in names)
    got = rows(spark, "op2")
    assert len(got) == len(docs)
    for r in got:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], own[s]) and abs(r.target - goal[s]) < 1e-6
        assert r.taken in [k * r.size for k in range(4)]
    taken = Counter()
    for r in got:
        taken[docs[r.doc_id].source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= max(size[d] for d in docs if docs[d].source == s) for s in names)


def test_op6(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: r.n_tokens for r in rows(spark, "op6")} == {d: len(coder.encode_ordinary(r.text or "")) for d, r in docs.items()}


def test_op7(spark, docs):
    got = rows(spark, "op7")
    assert len(got) == len(docs)
    for r in got:
        raw = (docs[r.doc_id].text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_bytes == len(payload) + 44


def test_op8(spark, docs):
    got = rows(spark, "op8")
    by = {}
    for r in got:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(16)) and len(got) == len(docs)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    mean = sum(r.size for r in got) / 16
    assert max(abs(sum(r.size for r in own) - mean) for own in by.values()) <= max(r.size for r in got)
