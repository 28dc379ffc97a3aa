"""Token counts of documents in flat token files without an index.

A flat file is a stream of 2-byte token ids in which an end-of-document id follows each document; nothing else says where
documents are. Files are read in blocks. In a block the separators are found by one vectorised comparison; documents that
lie inside it are counted at once, and the block reports how many separators it has and the tokens before the first and
after the last. A prefix scan over those summaries, a row for each block, gives each block the number of its first document
and the tokens that earlier blocks left open, whether or not they had a separator.

The file's document numbers (its separators so far) are the only names inside a file; the writer's order of documents is
kept beside it as a table (shard, number, doc_id), which no count is read from.

Edge cases: null counts as empty, an empty document has 0 tokens; a document may span any number of blocks; a separator may
be the first or last id of a block; a file whose end lacks a separator ends with an open document, which is counted;
repeated rows are documents of their own; other columns are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import documents, staged

BLOCK = 1 << 18  # tokens
END = 50256


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _written(shipped, pattern: str, end: int, block: int):
    """Blocks of a task's file, in order, and with each the documents that end in it."""

    def run(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shipped.value.splitlines())}
        coder = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        shard, number, open_, ids = TaskContext.get().partitionId(), 0, [], []

        def out(tokens: np.ndarray) -> pa.RecordBatch:
            nonlocal number, ids
            made = pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([number]), pa.array([tokens.astype("<u2").tobytes()]), pa.array([ids], pa.list_(pa.int64()))], ["shard", "block", "tokens", "doc_ids"])
            number, ids = number + 1, []
            return made

        size = 0
        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                x = np.array([*coder.encode_ordinary(t or ""), end], np.int64)
                open_.append(x)
                size += len(x)
                ids.append(d)
                while size >= block:
                    whole = np.concatenate(open_)
                    yield out(whole[:block])
                    open_, size = [whole[block:]], size - block
        if size or ids:
            yield out(np.concatenate(open_) if open_ else np.empty(0, np.int64))

    return run


def write_token_files(docs: DataFrame, ranks: str, pattern: str, end: int = END, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Flat token files of docs(doc_id, text): blocks (shard, block, tokens) and the order of documents (shard, number, doc_id).

    ranks: path of a byte-level vocabulary on the driver, shipped to the tasks (its size is fixed). Ids must fit in 2 bytes.
    """
    with open(ranks, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "shard long, block long, tokens binary, doc_ids array<long>"
    files = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_written(shipped, pattern, end, block), schema), "tokens")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    order = files.select("shard", "block", "doc_ids", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0)).alias("first"))
    order = order.select("shard", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("shard", (F.col("first") + F.col("k")).alias("number"), "doc_id")
    return files.select("shard", "block", "tokens"), order


def read_token_files(spark, path: str, block: int = BLOCK) -> DataFrame:
    """Flat 2-byte token files under a path as blocks: shard is a file (its place by name), block its number.

    Records of a fixed length are what splits files without an index; the last one of a file may be short.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    name = F.dense_rank().over(Window.orderBy("path")) - 1
    named = spark.read.format("binaryFile").load(path).select("path").withColumn("shard", name.cast("long"))  # a row for each file
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("content") / (2 * block)) - 1, F.lit(0)))
    blocks = files.join(named, "path").select("shard", "content", F.explode(parts).alias("block"))
    return blocks.select("shard", "block", F.expr(f"substring(content, int(block * {2 * block} + 1), {2 * block})").alias("tokens"))


SCAN = "shard long, block long, separators long, before long, after long, inner array<long>"


def _scanned(end: int):
    """For each block: its separators, the tokens before the first and after the last, and the counts between."""

    def run(batches):
        for b in batches:
            rows = []
            for tokens in b.column("tokens"):
                x = np.frombuffer(tokens.as_buffer(), "<u2")
                at = np.flatnonzero(x == end)
                if len(at):
                    rows.append((len(at), int(at[0]), len(x) - int(at[-1]) - 1, (np.diff(at) - 1).tolist()))
                else:
                    rows.append((0, len(x), len(x), []))
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("block"), *(pa.array(x, k) for x, k in zip(cols, kinds))], ["shard", "block", "separators", "before", "after", "inner"])

    return run


def count_tokens(blocks: DataFrame, end: int = END) -> DataFrame:
    """shard, number, n_tokens of each document of flat files given as blocks(shard, block, tokens)."""
    scanned = staged(blocks.select("shard", "block", "tokens").mapInArrow(_scanned(end), SCAN), "scan")
    order = Window.partitionBy("shard").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # Blocks between two that have separators form a run; what is open is its first block's rest and all of the others.
    rows = scanned.withColumn("first", F.coalesce(F.sum("separators").over(earlier), F.lit(0)))
    rows = rows.withColumn("run", F.sum((F.col("separators") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    open_ = F.sum("after").over(Window.partitionBy("shard", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("open", open_)
    rows = rows.withColumn("carried", F.coalesce(F.lag("open").over(order), F.lit(0)))
    rows = rows.withColumn("last", F.lead("block").over(order).isNull())
    ended = rows.where("separators > 0").select("shard", "first", F.posexplode(F.concat(F.array(F.col("carried") + F.col("before")), "inner")).alias("k", "n_tokens"))
    left = rows.where("last and open > 0").select("shard", (F.col("first") + F.col("separators")).alias("number"), F.col("open").alias("n_tokens"))
    return ended.select("shard", (F.col("first") + F.col("k")).alias("number"), "n_tokens").union(left)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every whole text, read from flat files by their separators."""
    import public_tokenizers

    blocks, order = write_token_files(documents(spark, sf_dir), default_ranks(), public_tokenizers.PATTERN)
    return order.join(count_tokens(blocks), ["shard", "number"]).select("doc_id", "n_tokens")


QUERIES = {"op6_token_counts": op6_token_counts}
