"""Media columns kept as content-defined chunks.

A payload is stored as an 8-bit mono WAV file, cut where a gear hash of the last 32 bytes has its low bits zero, so equal
stretches give equal chunks wherever they stand. A chunk is named by 128 bits of its SHA-256 and kept once: a join with the table of
owners (the least medium and place that has the chunk) lets only the owner's copy into the store. A medium is its ordered
list of chunks. Reading puts chunks back in order, verifies each digest and the whole, and takes samples from the file.

What travels: bodies, compressed with a dictionary fitted on a bounded sample (SAMPLE documents), once into the store and
once to their media; only chunks which several places share are also joined by digest. The join that finds the owner is on
(digest, medium, place), so a chunk that a third of all media share is spread over all tasks.

Edge cases: null counts as empty, whose payload is one block of padding; equal texts are one medium; repeated rows refer
to it each; any length; other columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import documents, release, staged, utf8

UNIT, PAD, RATE = 576, b"\xff", 8000
LEAST, MEAN_BITS, MOST = 1 << 10, 12, 1 << 14  # bytes of a chunk: at least, 2**bits more on average, at most
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)
SAMPLE = 300
LEVEL = 15  # bytes on disk count for more than the time to pack them once
NAME = 16  # bytes of a SHA-256 that name a chunk or a medium


def payload(text: bytes) -> bytes:
    return text + PAD * (-len(text) % UNIT or (0 if text else UNIT))


def to_file(samples: bytes) -> bytes:
    """A WAV file of 8-bit mono samples (their number is even, so there is no fill byte)."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def from_file(data: bytes) -> bytes:
    kind, _, wave, _, _, pcm, channels, _, _, _, bits, _, size = struct.unpack_from("<4sI4s4sIHHIIHH4sI", data)
    if (kind, wave, pcm, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8) or len(data) != 44 + size:
        raise ValueError("not an 8-bit mono file")
    return data[44:]


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # h[i] = sum of gear[data[i - j]] << j for j < 32
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    ends, start = [], 0
    for at in (np.flatnonzero(h & np.uint32((1 << MEAN_BITS) - 1 << 20) == 0) + 1).tolist():
        while at - start > MOST:
            start += MOST
            ends.append(start)
        if at - start >= LEAST:
            start = at
            ends.append(start)
    while len(data) - start > MOST:
        start += MOST
        ends.append(start)
    return ends if start == len(data) else [*ends, len(data)]


def chunks(data: bytes) -> Iterator[bytes]:
    start = 0
    for end in cuts(data):
        yield data[start:end]
        start = end


def _payloads(batch: pa.RecordBatch, text: str) -> Iterator[tuple[bytes, int]]:
    data, offsets = utf8(batch.column(text))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield payload(data[a:b].tobytes()), b - a


def name_of(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:NAME]


def _listed(text: str):
    def run(batches):
        for b in batches:
            rows = []
            for samples, n in _payloads(b, text):
                rows.append((n, name_of(samples), [name_of(c) for c in chunks(to_file(samples))]))
            n, media, digests = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(digests, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "medium", "digests"])

    return run


def _compressor(dictionary: bytes):
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _bodies(text: str, shipped):
    def run(batches):
        pack, seen = _compressor(shipped.value), set()
        for b in batches:
            rows = []
            for samples, _ in _payloads(b, text):
                if (medium := name_of(samples)) not in seen:
                    seen.add(medium)
                    rows += [(medium, k, name_of(c), pack.compress(c)) for k, c in enumerate(chunks(to_file(samples)))]
            for i in range(0, len(rows), 2000):
                part = list(zip(*rows[i : i + 2000]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, (pa.binary(), pa.int32(), pa.binary(), pa.binary()))], ["medium", "place", "digest", "body"])

    return run


class Store(NamedTuple):
    """references: doc_id, n_bytes, medium. lists: medium, place, digest, and the owner of that chunk. chunks: medium and
    place of the owner, digest, shared, body. dictionary: for the bodies."""

    references: DataFrame
    lists: DataFrame
    chunks: DataFrame
    dictionary: bytes


def fitted_dictionary(docs: DataFrame, text: str = "text") -> bytes:
    """A compression dictionary from SAMPLE documents, chosen by a hash of doc_id and text.

    A share of the rows that holds several times as many is drawn first, so that tasks don't each send their own SAMPLE.
    """
    share = min(1.0, 4 * SAMPLE / max(1, docs.count()))
    drawn = docs.withColumn("draw", F.xxhash64("doc_id", text)).where(F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = drawn.select(text, "draw").orderBy("draw", text).limit(SAMPLE).collect()
    parts = [c for r in rows for c in chunks(to_file(payload((r[0] or "").encode())))]
    try:
        return zstandard.train_dictionary(112_640, parts[:2000]).as_bytes()
    except zstandard.ZstdError:  # too little text for one
        return b""


def store_media(docs: DataFrame, text: str = "text") -> Store:
    """Payloads of docs(doc_id, text) as a store of deduplicated chunks in the shared folder."""
    docs = docs.select("doc_id", text)
    dictionary = fitted_dictionary(docs, text)
    listed = staged(docs.mapInArrow(_listed(text), "doc_id long, n_bytes long, medium binary, digests array<binary>"), "listed")
    lists = listed.groupBy("medium").agg(F.min("digests").alias("digests")).select("medium", F.posexplode("digests").alias("place", "digest"))
    owners = lists.groupBy("digest").agg(F.min(F.struct("medium", "place")).alias("owner"), (F.count("*") > 1).alias("shared"))
    owners = staged(owners, "owners")  # written first, so that a hot chunk's rows can be split in the join
    own = F.col("owner") == F.struct("medium", "place")
    lists = staged(lists.join(owners, "digest").select("medium", "place", "digest", own.alias("own"), "shared"), "lists")
    kept = lists.where("own").select("digest", "medium", "place", "shared")
    shipped = docs.sparkSession.sparkContext.broadcast(dictionary)
    bodies = docs.mapInArrow(_bodies(text, shipped), "medium binary, place int, digest binary, body binary")
    bodies = bodies.join(kept, ["digest", "medium", "place"]).dropDuplicates(["digest", "medium", "place"])
    bodies = staged(bodies.select("medium", "place", "digest", "shared", "body"), "chunks")
    release()
    return Store(listed.select("doc_id", "n_bytes", "medium"), lists.where("not own").select("medium", "place", "digest"), bodies, dictionary)


MEDIA = "medium binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(samples: bytes) -> str:
    """Mean, deviation, crossings of the middle and the share of each quarter of the range."""
    x = np.frombuffer(samples, np.uint8)
    high = x >= 128
    quarters = np.bincount(x >> 6, minlength=4) / len(x)
    return f"mean={x.mean():.6f};std={x.std():.6f};crossings={int((high[1:] != high[:-1]).sum())};quarters={'/'.join(f'{q:.6f}' for q in quarters)}"


def _assembled(shipped):
    """Chunks in order of medium and place, as whole verified files."""

    def described(medium: bytes, data: bytes) -> tuple:
        samples = from_file(data)
        if name_of(samples) != medium:
            raise ValueError(f"medium {medium.hex()} is damaged")
        return medium, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)

    def run(batches):
        unpack, medium, data = _decompressor(shipped.value), None, []
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = [x.split()[0] for x in MEDIA.split(", ")]
        for b in batches:
            rows = []
            for m, digest, body in zip(*(b.column(c).to_pylist() for c in ("medium", "digest", "body"))):
                if m != medium and medium is not None:
                    rows.append(described(medium, b"".join(data)))
                    data = []
                medium = m
                data.append(unpack.decompress(body))
                if name_of(data[-1]) != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
        if medium is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(described(medium, b"".join(data)), kinds)], names)

    return run


def read_media(store: Store) -> DataFrame:
    """MEDIA for each medium, from the stored chunks."""
    elsewhere = store.lists.join(store.chunks.where("shared").select("digest", "body"), "digest").select("medium", "place", "digest", "body")
    rows = store.chunks.select("medium", "place", "digest", "body").union(elsewhere)
    shipped = rows.sparkSession.sparkContext.broadcast(store.dictionary)
    rows = rows.repartition("medium").sortWithinPartitions("medium", "place").drop("place")
    return rows.mapInArrow(_assembled(shipped), MEDIA)


def op7_media_chunks(spark, sf_dir: str) -> DataFrame:
    store = store_media(documents(spark, sf_dir))
    return store.references.join(staged(read_media(store), "media"), "medium").drop("medium")


QUERIES = {"op7_media_chunks": op7_media_chunks}
