"""Shared pieces: staged tables in the shared folder, Arrow text views, vectorised byte hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STAGED: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where that is unset on a single machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='terrane-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    Shuffle files of the write go when it ends, as its plan isn't run again. The table is deleted when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terrane-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    if not _STAGED:
        atexit.register(_drop_staged)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Let Spark remove the shuffle files of finished phases, whose plans nobody holds any more.

    The gateway tells the JVM of dropped references once a second, so on a cluster this waits a little longer than that.
    """
    gc.collect()
    if spark := SparkSession.getActiveSession():
        if not spark.sparkContext.master.startswith("local["):
            time.sleep(1.2)
        spark.sparkContext._jvm.System.gc()


def _drop_staged() -> None:
    for spark, path in _STAGED:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended before the interpreter
            return


def trim() -> None:
    """In a Python worker: give memory that has been freed back to the system, as workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- Arrow text columns as NumPy views -----------------------------------------------------------


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, without copying; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if pa.types.is_null(col.type) or not len(col):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), offsets


def runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows [i, j) of at most ``limit`` bytes together; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def numbered_runs(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Blocks of consecutive rows, with numbers that are the same whenever the same input is read."""
    seq = TaskContext.get().partitionId() << 32
    for batch in batches:
        for i, j in runs(utf8(batch.column(text))[1], limit):
            yield seq, batch.slice(i, j - i)
            seq += 1


def pack_blocks(names: list[str], text: str, limit: int):
    """block, body: consecutive documents as one compressed Arrow stream, for mapInArrow."""

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))
        for seq, rows in numbered_runs(batches, text, limit):
            sink, part = pa.BufferOutputStream(), pa.table({c: rows.column(c) for c in names})
            with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                writer.write_table(part.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "body"])
            trim()

    return run


def unpack_block(x: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(x.as_buffer())).read_all().combine_chunks()


# --- Polynomial hashing modulo 2**64, vectorised ----------------------------------------------------

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) <= n:
        size = max(2 * len(_POWERS[0]), n + 1, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS


def byte_codes(seed: int, fold_case: bool = False) -> np.ndarray:
    """A random 64-bit code for each byte; with fold_case A-Z have the codes of a-z."""
    codes = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (splitmix64's finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(codes[data] * _powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * _powers(len(prefix))[1][start])
