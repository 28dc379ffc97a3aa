import hashlib

import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from helpers import awkward, table
from pyspark.sql import functions as F

from terrane.llm import sentence_pieces as S

EXTRA = ["a  b   c", "▁x ▁▁ y▁", "   lead", "\n\n a\tb \r\n", "a\xa0b　c​d", "é ﬁ Ａ é", "<s> </s> <unk> <0x41>", "🙂🙃 zwj 👩‍💻", "\x01\x7f", "汉字" * 40, "  "]


@pytest.mark.parametrize("by_word", [True, False])
def test_same_as_library(spark, monkeypatch, by_word):
    if not by_word:
        monkeypatch.setattr(S, "MARKED", None)  # not used
    sp = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    assert S.Pieces(open(S.default_model(), "rb").read()).by_word
    rows = awkward() + [(900 + i, t, None, None, 0, None, None) for i, t in enumerate(EXTRA)]
    if not by_word:
        texts = [r[1] or "" for r in rows]
        ids, ends, decoded = S._whole(S.Pieces(open(S.default_model(), "rb").read()), texts)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == sp.encode(texts) and decoded == [sp.decode(x) if x else "" for x in sp.encode(texts)]
        return
    got = S.encode(table(spark, rows), S.default_model()).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = sp.encode(r.text or "")
        assert (r.ids, r.decoded) == (ids, sp.decode(ids) if ids else ""), r.text
    back = S.decode(S.encode(table(spark, rows), S.default_model()).drop("decoded"), S.default_model()).collect()
    assert sorted(r.decoded for r in back) == sorted(r.decoded for r in got)


class Shipped:
    value = open(S.default_model(), "rb").read()


def packed(texts):
    rows, sink = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())}), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_batch(rows)
    return pa.table({"block": [0], "body": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def answers(texts, buckets):
    """What buckets say to a block of these texts."""
    listed = S._dealt(dict.fromkeys(S._words(texts)[0]), buckets)
    full = [(k, zstandard.compress(S._listed(x))) for k, x in enumerate(listed) if x]
    out = []
    for k, blob in full:
        asked = pa.table({"block": pa.array([0], pa.int64()), "blob": pa.array([blob], pa.binary())})
        out.append(S._answered(Shipped)((pa.scalar(0), pa.scalar(k)), asked))
    return pa.concat_tables(out)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


@pytest.mark.parametrize("buckets", [1, 3])
def test_missing_and_swapped_answers(buckets):
    """A block uses only answers to its own words, however many words another one has."""
    sp = S.Pieces(Shipped.value).sp
    texts, other = ["alpha beta", None, "beta\0 \0x"], ["gamma delta", "", "delta\0 \0y"]
    own, swapped = answers(["alpha beta", "beta\0 \0x"], buckets), answers(["gamma delta", "delta\0 \0y"], buckets)
    for mine, right in ((texts, own), (texts, swapped), (other, own), (texts, own.slice(0, 0))):
        got = S._joined(Shipped, "text", buckets, SCHEMA)(packed(mine), right).to_pylist()
        assert [r["ids"] for r in got] == [sp.encode(t or "") for t in mine]
        assert [r["decoded"] for r in got] == [sp.decode(sp.encode(t)) if t else "" for t in mine]


def test_slabs_and_clashing_columns(spark, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    for name, value in (("SLAB", 2_000), ("BUCKET", 300), ("BLOCK", 900)):
        monkeypatch.setattr(S, name, value)
    docs = table(spark, awkward(5)).withColumn("decoded", F.lit(1)).withColumn("ids", F.lit("x"))
    got = S.encode(docs, S.default_model())
    assert got.columns == [*docs.columns[:-2], "ids", "decoded"]
    assert all(r.ids == sp.encode(r.text or "") for r in got.collect())


def test_query(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = S.op3_sentence_pieces(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = sp.encode(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_empty(spark):
    assert S.encode(table(spark, []), S.default_model()).collect() == []
