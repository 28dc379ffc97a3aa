"""Exact removal of repeated substrings by prefix-free parsing.

A string of WIDTH bytes is anchored at its trigger: the position whose 8-byte rolling hash is least. The strings that
start in one run and share a trigger form a *phrase* (their union, at most 2 * WIDTH bytes); phrases cut by content are
the same wherever the text is the same. So:

1. Each block of documents is parsed; the dictionary of phrases is counted over the corpus. In highly repetitive text
   nearly all repeats end here: every string of a phrase that occurs twice is a repeat.
2. The parse tells which phrases could share strings at all: those whose text on one side of the trigger (over half a
   string, inside each of the phrase's strings on that side) occurs in several phrases. Only there, at the edges of
   repeated passages, are the dictionary's suffixes needed: each is ranked by its first WIDTH bytes (ranks are hashes, as
   only equality matters), weighed with the phrase's count, and met with equal ones.
3. Blocks get back their repeated phrases and suffixes, and the bytes these cover are cut.

Before the dictionary, keys (that text on one side) which occur once are left out. Equal phrases, keys and strings of a block
are one row, and counts are sums with partial aggregation, so neither a passage in a third of all
documents nor a document that repeats itself puts its occurrences in one task.

Edge cases: null text counts as empty; texts under WIDTH bytes are kept whole; all occurrences of a repeat go, the first
too; repeated rows are repeats of each other; other columns pass, except those named like a result column, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.common import U64, byte_codes, documents, mix, pack_blocks, prefix_hash, release, span_hash, staged, trim, unpack_block, utf8

CODES = byte_codes(5)
TRIGGER = 8
BLOCK = 2 << 20
PIECE = 1 << 18
RESULT = {"kept": "binary", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "spans": "array<struct<start:long,stop:long>>"}


def phrases(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of the parse of consecutive texts (offsets from 0): prefix hash of the piece and its place; key, phrase, first and last start of each run."""
    n, reach, half = len(data), width - TRIGGER + 1, (width - TRIGGER) // 2
    for a in range(0, n - width + 1, PIECE):
        b = min(a + PIECE, n - width + 1)  # starts
        prefix = prefix_hash(data[a : b + width - 1], CODES)
        at = np.arange(b - a + reach - 1)
        least = (span_hash(prefix, at, at + TRIGGER) & U64(0xFFFFFFFF00000000)) | at.astype(U64)
        wide = 1
        while 2 * wide <= reach:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if wide < reach:
            least = np.minimum(least[: wide - reach], least[reach - wide :])
        whole = np.ones(b - a, bool)  # the string lies in one text
        lo, hi = np.searchsorted(offsets, (a, b + width))
        for end in (offsets[lo:hi] - a).tolist():
            whole[max(0, end - width + 1) : max(0, end)] = False
        start = np.flatnonzero(whole)
        if not len(start):
            continue
        trigger = (least[start] & U64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (start[1:] != start[:-1] + 1))))
        first, last, trigger = start[new], start[np.concatenate((new[1:], [len(start)])) - 1], trigger[new]
        # Strings with much text after the trigger, and those with much before it.
        f, p = np.maximum(first, trigger - half), trigger
        right = f <= last
        f, l, p = f[right], last[right], p[right]  # noqa: E741
        key = span_hash(prefix, p, p + (width - half))
        g, q = np.minimum(last, trigger - half - 1), trigger
        left = first <= g
        e, g, q = first[left], g[left], q[left]
        key = np.concatenate((key, mix(span_hash(prefix, q - half - 1, q + TRIGGER) ^ U64(3))))
        f, l = np.concatenate((f, e)), np.concatenate((l, g))  # noqa: E741
        yield prefix, a, key, span_hash(prefix, f, l + width), f, l


def _texts(part: pa.Table, text: str) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(part.column(text))
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _packed(block: int, keys: np.ndarray, several: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A block's sorted distinct keys, and whether each occurs several times in it, cut into the buckets of their range."""
    share = (1 << 64) // buckets + 1
    at = np.concatenate(([0], np.searchsorted(keys, np.array([share * k for k in range(1, buckets)], U64)), [len(keys)]))
    full = np.flatnonzero(np.diff(at))
    blobs = [keys[at[k] : at[k + 1]].tobytes() + np.packbits(several[at[k] : at[k + 1]]).tobytes() for k in full.tolist()]
    sizes = np.diff(at)[full]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), block, np.int64)), pa.array(sizes), pa.array(blobs, pa.binary())], ["bucket", "block", "n", "blob"])


def _met(table: pa.Table) -> pa.Table:
    """For each block those of its keys in this bucket that occur several times in the corpus."""
    trim()
    blobs = [(memoryview(x.as_buffer()), n) for x, n in zip(table.column("blob"), table.column("n").to_pylist())]
    keys = np.concatenate([np.frombuffer(x, U64, n) for x, n in blobs])
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=8 * n), count=n).astype(bool) for x, n in blobs])
    whole = np.sort(keys)
    again = np.unique(np.concatenate((whole[1:][whole[1:] == whole[:-1]], keys[several])))
    hit = _among(keys, again)
    ends = np.cumsum([n for _, n in blobs])
    out = [keys[e - n : e][hit[e - n : e]].tobytes() for (_, n), e in zip(blobs, ends.tolist())]
    return pa.table({"block": table.column("block"), "kind": pa.array(np.ones(len(out), np.int32)), "key": pa.nulls(len(out), pa.int64()), "keys": pa.array(out, pa.binary())}).filter(pa.array([len(x) > 0 for x in out], pa.bool_()))


MARKS = "block long, kind int, key long, keys binary"


def _repeated(packed: DataFrame) -> DataFrame:
    """Keys that occur several times, back at their blocks. A key comes at most once from a block, so no bucket is hot."""
    return packed.groupBy("bucket").applyInArrow(_met, MARKS)


def _keys(text: str, width: int, buckets: int):
    """The distinct keys of each block's phrases."""

    def run(batches):
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body")):
                keys, n = np.unique(np.concatenate([np.empty(0, U64), *(x[2] for x in phrases(*_texts(unpack_block(body), text), width))]), return_counts=True)
                yield _packed(block, keys, n > 1, buckets)
                trim()

    return run


def _listed(right: pa.Table, kind: int = 1) -> np.ndarray:
    """Sorted keys of a kind, given one by one or packed."""
    right = right.filter(pa.compute.equal(right.column("kind"), kind))
    packed = [np.frombuffer(x.as_buffer(), U64) for x in right.column("keys") if x.is_valid]
    return np.sort(np.concatenate([np.empty(0, U64), right.column("key").drop_null().to_numpy().view(U64), *packed]))


def _parsed(text: str, width: int):
    """The block's distinct phrases with a repeated key, how often they occur in it, and how many strings start in them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        keys = _listed(right)
        found = [np.empty((3, 0), U64)]
        for _, _, key, phrase, first, last in phrases(*_texts(unpack_block(left.column("body")[0]), text), width) if len(left) and len(keys) else ():
            hit = _among(key, keys)
            found.append(np.stack((key[hit], phrase[hit], (last - first + 1).astype(U64)[hit])))
        key, phrase, strings = np.concatenate(found, axis=1)
        phrase, at, count = np.unique(phrase, return_index=True, return_counts=True)
        block = left.column("block")[0].as_py() if len(left) else 0
        return pa.table({"key": pa.array(key[at].view(np.int64)), "phrase": pa.array(phrase.view(np.int64)), "n": pa.array(count), "strings": pa.array(strings[at].astype(np.int64)), "block": pa.array(np.full(len(at), block, np.int64))})

    return run


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted table."""
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _starts(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges first..last, and the range of each."""
    size = last - first + 1
    which = np.repeat(np.arange(len(size)), size)
    return first[which] + np.arange(len(which)) - (np.cumsum(size) - size)[which], which


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().view(U64)


def _suffixes(text: str, width: int, buckets: int):
    """The strings of the block's contested phrases, weighed; once for each phrase."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        out = []
        if len(left) and len(right):
            order = np.argsort(names := _column(right, "phrase"))
            names, weight = names[order], right.column("n").to_numpy()[order]
            todo = np.ones(len(names), bool)
            for prefix, _, _, phrase, first, last in phrases(*_texts(unpack_block(left.column("body")[0]), text), width):
                phrase, at = np.unique(phrase, return_index=True)
                hit = _among(phrase, names)
                place = np.searchsorted(names, phrase[hit])
                fresh = todo[place]
                todo[place] = False
                start, which = _starts(first[at[hit]][fresh], last[at[hit]][fresh])
                out.append((span_hash(prefix, start, start + width), weight[place[fresh]][which]))
        strings = np.concatenate([np.empty(0, U64), *(s for s, _ in out)])
        strings, back = np.unique(strings, return_inverse=True)
        n = np.bincount(back, np.concatenate([np.empty(0), *(w for _, w in out)]), len(strings))
        return pa.Table.from_batches([_packed(left.column("block")[0].as_py() if len(left) else 0, strings, n > 1, buckets)])

    return run


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone, and the other bytes of characters that lose one (data is UTF-8, from a character's start)."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(starts):
        return gone
    return np.repeat(np.logical_or.reduceat(gone, starts), np.diff(np.append(starts, len(data))))


def _cut(text: str, width: int, whole: bool, schema: pa.Schema):
    """The block's documents without the bytes that repeats cover."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        if not len(left):
            return schema.empty_table()
        part = unpack_block(left.column("body")[0])
        data, offsets = _texts(part, text)
        repeated, strings, contested = (_listed(right, kind) for kind in range(3))
        edge = np.zeros(len(data) + 1, np.int32)
        if len(repeated) or len(strings):
            for prefix, a, _, phrase, first, last in phrases(data, offsets, width):
                hit = _among(phrase, repeated)
                np.add.at(edge, a + first[hit], 1)
                np.add.at(edge, a + last[hit] + width, -1)
                if len(strings):
                    hit = _among(phrase, contested)
                    start, _ = _starts(first[hit], last[hit])
                    start = start[_among(span_hash(prefix, start, start + width), strings)]
                    np.add.at(edge, a + start, 1)
                    np.add.at(edge, a + start + width, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        del edge
        before = np.zeros(len(data) + 1, np.int32)
        np.cumsum(gone, out=before[1:])
        removed = (before[offsets[1:]] - before[offsets[:-1]]).astype(np.int64)
        began = gone.copy()
        began[1:] &= ~gone[:-1]
        began[offsets[:-1][offsets[:-1] < len(data)]] = gone[offsets[:-1][offsets[:-1] < len(data)]]
        ended = gone.copy()
        ended[:-1] &= ~gone[1:]
        ended[offsets[1:][offsets[1:] > 0] - 1] = gone[offsets[1:][offsets[1:] > 0] - 1]
        start, stop = np.flatnonzero(began), np.flatnonzero(ended) + 1
        bounds = np.searchsorted(start, offsets)
        own = np.repeat(offsets[:-1], np.diff(bounds))
        spans = pa.StructArray.from_arrays([pa.array(start - own), pa.array(stop - own)], ["start", "stop"])
        if whole:
            gone = _whole_characters(data, gone)
            np.cumsum(gone, out=before[1:])
        kept = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((offsets - before[offsets]).astype(np.int32)), pa.py_buffer(data[~gone])])
        made = {"kept": kept, "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed), "n_spans": pa.array(np.diff(bounds)), "spans": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans)}
        return pa.table([made[f.name] if f.name in made else part.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def remove_repeats(docs: DataFrame, text: str = "text", width: int = 200, whole_characters: bool = False) -> DataFrame:
    """Every row of docs with ``kept`` (its bytes without those covered by a string of ``width`` bytes that also starts
    elsewhere in the corpus), n_bytes, n_removed, n_spans and spans (maximal removed runs, in bytes). With ``whole_characters``
    kept also lacks the bytes that a run leaves of a character, so that it is text. See the module's text."""
    names = [c for c in docs.columns if c not in RESULT or c == text]
    blocks = staged(docs.select(names).mapInArrow(pack_blocks(names, text, BLOCK), "block long, body binary"), "blocks")
    by_block = blocks.groupBy("block")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    packed = "bucket int, block long, n long, blob binary"
    keys = staged(_repeated(blocks.mapInArrow(_keys(text, width, int(size // (150 << 20)) + 4), packed)), "keys")
    release()
    parse = staged(by_block.cogroup(keys.groupBy("block")).applyInArrow(_parsed(text, width), "key long, phrase long, n long, strings long, block long"), "parse")
    release()
    dictionary = staged(parse.groupBy("phrase").agg(*(F.min(c).alias(c) for c in ("key", "strings", "block")), F.sum("n").alias("n")), "phrases")
    contested = dictionary.groupBy("key").agg(F.min("phrase").alias("lo"), F.max("phrase").alias("hi")).where("lo < hi").select("key", F.lit(True).alias("contested"))
    contested = staged(contested, "contested")  # written first, so that a hot key's phrases can be split in the join
    known = dictionary.join(contested, "key", "left").withColumn("contested", F.coalesce("contested", F.lit(False)))
    known = staged(known.where("n > 1 or contested").drop("key"), "known")
    del dictionary, contested
    release()
    todo = known.where("contested")
    total = todo.agg(F.sum("strings")).first()[0] or 0
    strings = by_block.cogroup(todo.groupBy("block")).applyInArrow(_suffixes(text, width, int(total // 2_500_000) + 4), packed)
    strings = staged(_repeated(strings), "strings")
    release()
    kind = F.when(F.col("n") > 1, 0).otherwise(2).alias("kind")
    marks = parse.select("phrase", "block").join(known.drop("block"), "phrase").select("block", kind, F.col("phrase").alias("key"), F.lit(None).cast("binary").alias("keys"))
    marks = staged(marks.union(strings), "marks")
    release()
    fields = [docs.schema[c] for c in names if c not in RESULT] + T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in RESULT.items())).fields
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    return by_block.cogroup(marks.groupBy("block")).applyInArrow(_cut(text, width, whole_characters, to_arrow_schema(schema)), schema)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
