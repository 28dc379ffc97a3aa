"""Sharding along a Hilbert curve, by DataFrame functions only.

Language and source (hashed to cells, as files are pruned by equality on them) and the size's octave are the axes of a cube
of 32 cells a side. Rows are put in order of their cell's index on the Hilbert curve, then of text, and the order is cut
into runs of near equal bytes. Neighbours on the curve are neighbours in every axis, so a shard covers few languages, few
sources and few sizes, and a filter on any of them prunes shards.

Equal texts stand together: their cell is that of their least language and source. With the target T of bytes for a shard, a
group of them of up to T / ``whole`` bytes is never cut: it goes where its middle is, so each of a shard's two ends moves by
half a group at most, and a shard's bytes differ from T by at most T / whole and a row. A larger group is cut like any run of
rows, as no order of whole groups could keep that bound.

The order is global, yet no window sees all rows: rows are range-partitioned by the order (ties by a hash of doc_id, so a
group of copies of any size is spread; rows equal in doc_id too by their place), summed by partition, and placed by their partition's offset.

Edge cases: null text has no bytes, size 1; null language or source are values of their own; repeated rows take separate
slots, in no particular order among themselves; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import documents, partitions, staged

SIDE_BITS = 5


def hilbert_tables(axes: int) -> tuple[list[int], list[int]]:
    """For each state and corner of a cell (packed as state * 2**axes + corner): place on the curve, and the state inside.

    A state is the corner at which the curve enters a cell and the axis along which it leaves; both follow from Gray codes.
    """
    n = 1 << axes
    gray = [i ^ i >> 1 for i in range(n)]
    turn = lambda x, k: (x >> k % axes | x << axes - k % axes) & n - 1  # noqa: E731  right rotation
    entry = [0, *(gray[2 * ((i - 1) // 2)] for i in range(1, n))]
    ones = lambda i: (~i & i + 1).bit_length() - 1  # noqa: E731  trailing ones
    along = [0, *((ones(i - 1) if i % 2 == 0 else ones(i)) % axes for i in range(1, n))]
    states, place, inside = [(0, 0)], [], []
    for e, d in states:  # grows
        for corner in range(n):
            at = gray.index(turn(corner ^ e, d + 1))
            step = (e ^ turn(entry[at], axes - (d + 1) % axes), (d + along[at] + 1) % axes)
            if step not in states:
                states.append(step)
            place.append(at)
            inside.append(states.index(step))
    return place, inside


def hilbert_index(axes: list[F.Column], bits: int) -> F.Column:
    """Index on the Hilbert curve of a cell given by integers below 2**bits, one for each axis."""
    place, inside = (F.array(*map(F.lit, x)) for x in hilbert_tables(len(axes)))
    corners = []
    for b in reversed(range(bits)):
        corner = F.lit(0)
        for i, x in enumerate(axes):
            corner = corner + F.shiftright(x.cast("int"), b).bitwiseAND(F.lit(1)) * (1 << i)
        corners.append(corner)
    n = 1 << len(axes)
    zero = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))

    def step(acc: F.Column, corner: F.Column) -> F.Column:
        at = acc["state"] * n + corner
        return F.struct((acc["index"] * n + F.get(place, at)).alias("index"), F.get(inside, at).alias("state"))

    return F.aggregate(F.array(*corners), zero, step, lambda acc: acc["index"])


def hilbert_shards(docs: DataFrame, shards: int = 16, whole: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for docs(doc_id, text, lang, source); see the module's text."""
    spark, cells = docs.sparkSession, 1 << SIDE_BITS
    rows = staged(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("mark"),
            *(F.pmod(F.xxhash64(c), F.lit(cells)).cast("int").alias(c) for c in ("lang", "source")),
        ),
        "rows",
    )
    target = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    same = ["mark", "text_crc32", "size"]
    group = rows.groupBy(*same).agg(F.min("lang").alias("lang"), F.min("source").alias("source"), F.count("*").alias("copies"))
    octave = F.least(F.floor(F.log2("size")).cast("int"), F.lit(cells - 1))
    # Written first: then both sides of the join are plain exchanges, and a group of many copies can be split.
    group = staged(group.select(*same, "copies", hilbert_index([F.col("lang"), F.col("source"), octave], SIDE_BITS).alias("cell")), "groups")
    placed = rows.drop("lang", "source").join(group, same)
    large = F.col("copies") * F.col("size") * whole > target
    placed = placed.withColumn("large", large).withColumn("spread", F.when(large, F.xxhash64("doc_id"))).withColumn("place", F.when(large, F.monotonically_increasing_id()))
    order = ["cell", *same, "spread", "place"]
    ordered = placed.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id())
    ordered = staged(ordered, "ordered")
    sums = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"))
    inside = Window.partitionBy("part").orderBy(*order, "doc_id")
    counted = ordered.join(F.broadcast(sums), "part").select(
        "doc_id", "size", "text_crc32", "mark", "part", "copies", "large",
        (F.col("byte0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("at"),
        (F.col("row0") + F.row_number().over(inside) - 1).alias("row"),
    )
    # A small group lies in one partition, as its rows tie in the order; it goes where its middle is.
    start = F.min("at").over(Window.partitionBy("part", *same))
    middle = F.when(F.col("large"), F.col("at") + F.col("size") / 2).otherwise(F.col("start") + F.col("copies") * F.col("size") / 2)
    shard = F.least(F.floor(middle / F.lit(float(target) or 1.0)).cast("int"), F.lit(shards - 1))
    cut = staged(counted.withColumn("start", start).select("doc_id", "size", "text_crc32", shard.alias("shard"), "row"), "cut")
    first = cut.groupBy("shard").agg(F.min("row").alias("first"))  # a row for each shard
    return cut.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def op8_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    return hilbert_shards(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op8_hilbert_shards": op8_hilbert_shards}
