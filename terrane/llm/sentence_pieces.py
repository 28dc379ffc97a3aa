"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the vocabulary holds a whitespace marker after another character, merges never cross from a word to the
marker that follows, so a text's ids are those of its marked words (a run of markers and the characters up to the next), one
after another. So:

1. Each block of documents lists its distinct marked words, packed by hash into buckets.
2. A bucket meets equal words of all blocks, segments each of them once by the library, and answers every block with the ids
   of the words it listed, in that order, under a digest of those words.
3. The answers meet the block's texts; ids are joined back by position, vectorised, and each row's ids are decoded by the
   library.

A word comes once from a block, so no bucket is hot, however common a word is; what travels is the texts once, compressed,
and the distinct words and ids of blocks. A block whose words don't have an answer's digest (its rows were dealt otherwise
when read again) segments them itself, so the result never depends on how rows are dealt.

The table is one for each SLAB of text, so that a block's rows (one for each bucket) don't grow with the corpus.

Models for which this doesn't hold (another normaliser, pieces across markers, no dummy prefix) are detected when the
operator is built; they encode whole texts as single chunks, with the same result as the library's.

Edge cases: null counts as empty, empty text has no ids and decodes to empty text; any length; columns ids and decoded of
the input are replaced, other columns pass; repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from terrane.llm.common import documents, numbered_runs, pack_blocks, runs, staged, trim, unpack_block, utf8

MARKED = re.compile("[ ▁]+[^ ▁]*")
PARTED = re.compile("\0(?=[ ▁])")  # no word holds a marker after another character
BLOCK = 4 << 20
SLAB = 16 << 30  # bytes of text that share a table
BUCKET = 12 << 20  # bytes of text for each bucket


class Pieces:
    """The library's processor, and what the table needs to know of it."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
        plain = all(sp.normalize(x) == "▁" + x.replace(" ", "▁") for x in ("a", " a  b\n", "ﬁ　Å Á​", "\t"))
        self.by_word = plain and not any(re.search("[^▁]▁", p) for p in pieces)
        self.marker = sp.encode("a ")[len(sp.encode("a")) :]

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of marked words one after another, and how many each has."""
        found = iter(self.sp.encode([w[1:] for w in words if len(w) > 1], num_threads=1))
        lists = [next(found) if len(w) > 1 else self.marker for w in words]
        return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each row's ids, a run of rows at a time."""
        out: list[str] = []
        for i, j in runs(ends, 1 << 18):
            rows = [ids[a:b].tolist() for a, b in zip(ends[i:j].tolist(), ends[i + 1 : j + 1].tolist())]
            out += self.sp.decode(rows, num_threads=1)
        return out


def _gather(start: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each row, one after another."""
    stop = np.cumsum(size)
    return values[np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]


def _words(texts: list[str]) -> tuple[list[str], list[int]]:
    """All marked words of texts, and where each text's end."""
    words: list[str] = []
    ends = [0]
    for t in texts:
        if t:
            words += MARKED.findall(" " + t)
        ends.append(len(words))
    return words, ends


def _dealt(words: dict[str, int], buckets: int) -> list[list[str]]:
    """Distinct words by bucket, in the order in which they occur."""
    out: list[list[str]] = [[] for _ in range(buckets)]
    for w in words:
        out[zlib.crc32(w.encode()) % buckets].append(w)
    return out


def _listed(words: list[str]) -> bytes:
    return "\0".join(words).encode()


def _digest(listed: bytes) -> bytes:
    return hashlib.blake2b(listed, digest_size=16).digest()


def _asked(text: str, buckets: int, slabs: int):
    """slab, bucket, block, blob: the distinct words of each block."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for block, rows in numbered_runs(batches, text, BLOCK):
            words = dict.fromkeys(w for t in rows.column(text).to_pylist() if t for w in MARKED.findall(" " + t))
            full = [(k, x) for k, x in enumerate(_dealt(words, buckets)) if x]
            if full:
                blobs = [pack.compress(_listed(x)) for _, x in full]
                kinds = ([(block >> 32) % slabs] * len(full), [k for k, _ in full])
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in kinds), pa.array([block] * len(full), pa.int64()), pa.array(blobs, pa.binary())], ["slab", "bucket", "block", "blob"])
                trim()

    return run


def _answer(digest: bytes, size: np.ndarray, ids: np.ndarray) -> bytes:
    """The words' digest, how many words there are and how many ids each has, and the ids: in as few bytes a number as their
    greatest needs."""
    kinds = [next(k for k in (1, 2, 4) if int(x.max(initial=0)) < 1 << 8 * k) for x in (size, ids)]
    return digest + bytes(kinds) + len(size).to_bytes(8, "little") + size.astype(f"<u{kinds[0]}").tobytes() + ids.astype(f"<u{kinds[1]}").tobytes()


def _read_answer(raw: bytes, digest: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """ids and sizes, if they are for the words of this digest."""
    if raw[:16] != digest:
        return None
    n = int.from_bytes(raw[18:26], "little")
    size = np.frombuffer(raw, f"<u{raw[16]}", n, 26).astype(np.int64)
    return np.frombuffer(raw, f"<u{raw[17]}", int(size.sum()), 26 + raw[16] * n).astype(np.int32), size


def _answered(shipped):
    """block, bucket, blob: for each block the ids of the words it listed; each distinct word is segmented once."""

    def run(key: tuple, asked: pa.Table) -> pa.Table:
        trim()
        pieces, pack, unpack = Pieces(shipped.value), zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        number: dict[str, int] = {}
        lists = []
        for x in asked.column("blob"):
            raw = unpack.decompress(x.as_buffer())
            lists.append((_digest(raw), np.array([number.setdefault(w, len(number)) for w in PARTED.split(raw.decode())], np.int64)))
        ids, size = pieces.table(list(number))
        start = np.cumsum(size) - size
        blobs = [pack.compress(_answer(digest, size[at], _gather(start[at], size[at], ids))) for digest, at in lists]
        return pa.table({"block": asked.column("block"), "bucket": pa.array([key[1].as_py()] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _joined(shipped, text: str, buckets: int, schema: pa.Schema):
    """A block's documents with ids and decoded text, from the answers to the words it listed."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        if not len(left):
            return schema.empty_table()
        part, unpack, pieces = unpack_block(left.column("body")[0]), zstandard.ZstdDecompressor(), Pieces(shipped.value)
        words, ends = _words([t or "" for t in part.column(text).to_pylist()])
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("blob")))
        number: dict[str, int] = {}
        sizes, ids = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for bucket, own in enumerate(_dealt(dict.fromkeys(words), buckets)):
            if not own:
                continue
            found = _read_answer(unpack.decompress(answers[bucket].as_buffer()), _digest(_listed(own))) if bucket in answers else None
            found = pieces.table(own) if found is None else found
            number |= zip(own, range(len(number), len(number) + len(own)))
            ids.append(found[0])
            sizes.append(found[1])
        ids, size = np.concatenate(ids), np.concatenate(sizes)
        at = np.array([number[w] for w in words], np.int64)
        del words, number
        out = _gather((np.cumsum(size) - size)[at], size[at], ids)
        stop = np.concatenate(([0], np.cumsum(size[at])))[ends]
        made = {"ids": pa.ListArray.from_arrays(pa.array(stop.astype(np.int32)), pa.array(out)), "decoded": pa.array(pieces.decoded(out, stop), pa.string())}
        return pa.table([made[f.name] if f.name in made else part.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def _whole(pieces: Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    found = pieces.sp.encode(texts, num_threads=1)
    ids, ends = np.array([i for x in found for i in x], np.int32), np.cumsum([0, *map(len, found)])
    return ids, ends, pieces.decoded(ids, ends)


def _texts_alone(shipped, names: list[str], text: str):
    """Whole texts by the library, for models whose pieces cross words."""

    def run(batches):
        pieces = Pieces(shipped.value)
        for b in batches:
            for i, j in runs(utf8(b.column(text))[1], BLOCK):
                part = b.slice(i, j - i)
                ids, ends, decoded = _whole(pieces, [t or "" for t in part.column(text).to_pylist()])
                made = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], [*names, "ids", "decoded"])

    return run


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with ids (array<int>, as the library encodes, without begin or end ids) and decoded (the library's text for them).

    model: path of a SentencePiece model on the driver; its bytes (the vocabulary, of fixed size) go to every task.
    """
    with open(model, "rb") as f:
        data = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast(data)
    docs = docs.select([c for c in docs.columns if c not in ("ids", "decoded")])
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    result = docs.sparkSession.createDataFrame([], f"{kinds}, ids array<int>, decoded string").schema
    if not Pieces(data).by_word:
        return docs.mapInArrow(_texts_alone(shipped, names, text), result)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, slabs = int(min(size, SLAB) // BUCKET) + 8, int(size // SLAB) + 1
    asked = docs.select(text).mapInArrow(_asked(text, buckets, slabs), "slab int, bucket int, block long, blob binary")
    answers = staged(asked.groupBy("slab", "bucket").applyInArrow(_answered(shipped), "block long, bucket int, blob binary"), "answers")
    blocks = docs.mapInArrow(pack_blocks(names, text, BLOCK), "block long, body binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_joined(shipped, text, buckets, to_arrow_schema(result)), result)


def decode(encoded: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Text of any id lists by the library; null lists give null."""
    with open(model, "rb") as f:
        shipped = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text(lists):
        sp = Pieces(shipped.value).sp
        return lists.map(lambda x: None if x is None else sp.decode([int(i) for i in x]) if len(x) else "")

    return encoded.withColumn(into, text(ids))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    found = encode(documents(spark, sf_dir).select("doc_id", "text"), default_model())
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op3_sentence_pieces": op3_sentence_pieces}
