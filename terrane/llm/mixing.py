"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target in words fixes an expected number of copies r of its documents: every document gets floor(r) copies
and keeps the fraction as a probability. Then two documents meet: words of expectation pass from one to the other, at random
and without bias, until one of the two is sure to be taken or left; the other, still open, meets the next. Documents meet
in order of size, the largest first, so that of two alike in size either may stay open and what is open at the end is, as a
rule, small. A group leaves one open document at most, groups' leftovers meet in the same way in the next level of a tree,
and the root's last one is drawn. So each source's taken words differ from its target by less than one document.

Groups are hash buckets of bounded size inside a source, so a source with a third of all rows is many groups. Draws come
from seeded hashes of the rows and of their number among equal rows: reruns agree, and any number of equal rows is spread
over buckets. Only (doc_id, source, size) travel. Sources may be many: their order, targets and sizes stay in tables.

Edge cases: null text has size 0; a null source is a source of its own, last in order; documents without words are drawn
one by one and take nothing; a source without words has target 0; repeated rows are documents of their own; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import documents, staged
from terrane.operators.shared import row_numbers

WEIGHTS = (5, 2, 1)
MOST = 3  # times a source's size
GROUP = 2_048
SPREAD = 1 << 16  # equal rows that are numbered by one task
FEW = 100_000  # sources whose table is broadcast; more are joined by a shuffle


def n_words(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources(words, weight, ...) with target: shares of all words by weight, at most ``most`` times a source's own, the excess
    shared again by weight until none is above. The driver holds the share of a weight of one, and lets it grow."""
    total, unit = sources.agg(F.sum("words")).first()[0] or 0, 0.0
    cap = F.col("words") * most
    while True:
        over = F.col("weight") * unit > cap
        kept, weight = sources.agg(F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        share = (total - kept) / weight if weight else unit
        if share <= unit or not weight:
            return sources.withColumn("target", F.least(F.col("weight") * F.lit(unit), cap.cast("double")))
        unit = share


def _pair_by_pair(p: list[float], a: list[int], luck: list[float]) -> None:
    """Two open documents meet, one is decided, the other meets the next."""
    open_ = -1
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if open_ < 0:
            open_ = i
            continue
        j = open_
        up, down = min(a[i] * (1 - p[i]), a[j] * p[j]), min(a[i] * p[i], a[j] * (1 - p[j]))  # words from j to i, or from i to j
        if luck[i] * (up + down) < down:
            p[i], p[j] = p[i] + up / a[i], p[j] - up / a[j]
        else:
            p[i], p[j] = p[i] - down / a[i], p[j] + down / a[j]
        open_ = next((k for k in (i, j) if 1e-12 < p[k] < 1 - 1e-12), -1)
        for k in (i, j):
            p[k] = p[k] if k == open_ else float(round(p[k]))


def _paired(level: int, last: bool):
    """One group of the tree: chance is 0 or 1 for all rows but one at most; at the root for all."""

    def run(table: pa.Table) -> pa.Table:
        # Large documents first: what stays undecided at the end, and misses the target, is then a small one.
        table = table.sort_by([("size", "descending"), ("draw", "ascending"), ("doc_id", "ascending")])
        chance, size = table.column("chance").to_numpy(), table.column("size").to_numpy()
        rng = np.random.Generator(np.random.PCG64([level, table.column("draw")[0].as_py() & (1 << 63) - 1, len(table)]))
        luck = rng.random(len(table) + 1).tolist()
        n = int((size > 0).sum())  # those without words are decided
        p, a = chance[:n].tolist(), size[:n].tolist()
        _pair_by_pair(p, a, luck)
        open_ = [i for i, x in enumerate(p) if 0 < x < 1]
        if last and open_:
            p[open_[0]] = float(luck[-1] < p[open_[0]])
        return table.set_column(table.column_names.index("chance"), "chance", pa.array(np.concatenate((p, chance[n:])), pa.float64()))

    return run


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for each row of docs(doc_id, source, size).

    Weights repeat over the sources in code-point order, null last.
    """
    equal = docs.select("doc_id", "source", F.col("size").cast("long").alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    equal = staged(equal, "sizes")
    sources = equal.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("rows"))
    sources = row_numbers(sources, [], [F.col("source").isNull(), "source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    plan = targets(staged(sources.select("source", "words", "rows", weight.cast("long").alias("weight")), "sources"), most)
    plan = plan.select(F.col("source").alias("of"), F.col("words").alias("source_size"), "target", F.coalesce(F.try_divide("target", "words"), F.lit(0.0)).alias("rate"), F.ceil(F.col("rows") / GROUP).alias("groups"))
    size = plan.agg(F.count("*"), F.max("groups")).first()
    numbered = equal.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SPREAD)))).repartition("doc_id", "source", "size", "chunk")
    numbered = numbered.withColumn("number", F.explode(F.sequence(F.col("chunk") * SPREAD, F.least("n", (F.col("chunk") + 1) * SPREAD) - 1)))
    numbered = numbered.select("doc_id", "source", "size", F.xxhash64("doc_id", "size", "number", F.lit("mix")).alias("draw"))
    plan = F.broadcast(plan) if size[0] <= FEW else plan
    rows = numbered.join(plan, numbered.source.eqNullSafe(plan.of)).drop("of")
    whole = F.floor("rate")
    chance = F.col("rate") - whole
    luck = F.pmod(F.col("draw"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("copies", whole).withColumn("chance", F.when(F.col("size") > 0, chance).otherwise((luck < chance).cast("double")))
    level, groups, done = 0, size[1] or 1, []
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    while True:
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("draw", F.lit(level)), F.greatest("groups", F.lit(1))))
        paired = rows.groupBy("source", "bucket").applyInArrow(_paired(level, groups == 1), f"{kinds}, bucket long")
        paired = staged(paired.drop("bucket"), f"mixed{level}")
        if groups == 1:
            done.append(paired)
            break
        open_ = F.col("chance").between(1e-12, 1 - 1e-12)
        done.append(paired.where(~open_))
        rows = paired.where(open_).withColumn("groups", F.ceil(F.col("groups") / GROUP))
        level, groups = level + 1, -(-groups // GROUP)
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") + F.col("chance").cast("long")).alias("copies"))


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op2_mix_sources": op2_mix_sources}
