"""Document fingerprints by a randomised edit embedding.

A random walk reads a text's characters: at each step it writes the character it stands on, and a shared random bit of
(step, character) says whether it moves on. Two texts walk together while they agree; after an edit their walks meet again
soon, so a small edit distance becomes a small Hamming distance between what they write. A fingerprint samples the written
sequence: in each octave of steps (2**b up to 2**(b+1)) the same SAMPLES steps for all texts, one of 15 symbols for the
character written there, or a mark beyond the walk's end. Octaves weigh as many steps as they have, so the share of equal
samples estimates the share of equal steps, for texts of any length.

Documents are grouped by banded bit samples of the fingerprint, and pairs verified by likeness.

The walk is computed by character, not by step: a table for each character class gives the step at which the walk leaves
it, so a text of n characters takes n vectorised look-ups, for all texts of a run at once.

Edge cases: null counts as empty; empty texts are alike (likeness 1), and unlike any other (0); equal texts have equal
fingerprints; the next document is the next row by doc_id (nulls first), then text, and after the last the first; one
document is its own next. Other columns are ignored. Rows of one doc_id stand together, ordered by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import U64, documents, mix, staged

SAMPLES = 64  # steps sampled in an octave; octaves of up to so many steps are taken whole
CLASSES = 16  # character classes with walks of their own
RUN = 1 << 20  # characters walked together
SYMBOLS = "abcdefghijklmno"  # what the walk writes; "-" beyond its end
LONG = 1 << 17  # characters beyond which a text is walked alone, with tables for a window of steps at a time
ROWS = 2_000  # documents of a range, as long as there are no more than PARTS ranges
PARTS = 50_000
ALIKE = 0.8  # the least likeness that bands are made for
TILE = 1_000  # members of a band compared with as many others at a time
_SHARED: dict = {"steps": 0}


def octave(b: int) -> np.ndarray:
    """The sampled steps of an octave."""
    size = 1 << b
    if size <= SAMPLES:
        return np.arange(size, 2 * size)
    draws = mix(np.arange(1, SAMPLES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(b)) % U64(size // SAMPLES)
    return size + np.arange(SAMPLES) * (size // SAMPLES) + draws.astype(np.int64)


def _go(start: int, size: int, c: int) -> np.ndarray:
    """The shared bits of a class for steps from start: whether a walk moves on."""
    return mix(np.arange(start, start + size, dtype=U64) * U64(CLASSES) + U64(c) + U64(1 << 40)) >> U64(63) == 0


def _leaves(start: int, size: int) -> np.ndarray:
    """For each class and step of a window: the first step from then on at which a walk on that class moves on, plus 1; the
    window's size if there is none in it. Relative to the window."""
    at, table = np.arange(size, dtype=np.int32), np.full((CLASSES, size + 1), size, np.int32)
    for c in range(CLASSES):
        table[c, :size] = np.minimum.accumulate(np.where(_go(start, size, c), at + 1, size + 1)[::-1])[::-1]
    return table


def _shared(steps: int) -> np.ndarray:
    if _SHARED["steps"] < steps:
        n = 1 << max(16, (steps - 1).bit_length())
        _SHARED.update(steps=n, table=np.minimum(_leaves(0, n), n).ravel())
    return _SHARED["table"]


def _walk_alone(kind: np.ndarray) -> np.ndarray:
    """The step after the last on each character of a text of any length."""
    size, start, now = 1 << 16, 0, 0
    rows, ends = _leaves(0, size).tolist(), []
    for c in kind.tolist():
        while now == size or (there := rows[c][now]) > size:
            start, now = start + size, 0
            rows = _leaves(start, size).tolist()
        now = there
        ends.append(start + now)
    return np.array(ends, np.int64)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text; short ones and long ones are walked in runs of like length."""
    out = [""] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        longest = len(texts[order[at]])
        stop = at + (1 if longest > LONG else RUN // max(1, longest))
        for i, f in zip(order[at:stop], _walked([texts[i] for i in order[at:stop]])):
            out[i] = f
        at = stop
    return out


def _walked(texts: list[str]) -> Iterator[str]:
    """Texts sorted by falling length."""
    size = np.array([len(t) for t in texts])
    n = int(size[0])
    if n == 0:
        yield from ("" for _ in texts)
        return
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    scrambled = mix(codes.astype(U64) * U64(0x9E3779B97F4A7C15))
    kind = (scrambled >> U64(60)).astype(np.int32) % CLASSES
    symbol = (scrambled & U64(0xFFFF)).astype(np.int32) % len(SYMBOLS)
    first = np.cumsum(size) - size
    if n > LONG:
        ends = _walk_alone(kind)
    else:
        table = _shared(4 * n + 64)  # a walk takes two steps a character on average
        active = np.searchsorted(-size, -np.arange(n), "left")  # texts longer than i
        ends = np.empty(len(codes), np.int32)  # the step after the last on each character
        base = kind * (_SHARED["steps"] + 1)
        now = np.zeros(len(texts), np.int32)
        for i, k in enumerate(active.tolist()):
            place = first[:k] + i
            now[:k] = table[base[place] + now[:k]]
            ends[place] = now[:k]
    top = int(ends.max())
    sampled = [octave(b) for b in range((top - 1).bit_length())] if top > 1 else []
    sampled = np.concatenate([np.zeros(1, np.int64), *sampled])
    letters = np.frombuffer(SYMBOLS.encode(), np.uint8)
    for t in range(len(texts)):
        own = ends[first[t] : first[t] + size[t]]
        if not len(own):
            yield ""
            continue
        char = np.searchsorted(own, sampled[: int(np.searchsorted(sampled, own[-1], "right")) + SAMPLES], "right")
        inside = char < size[t]
        line = np.full(len(char), ord("-"), np.uint8)
        line[inside] = letters[symbol[first[t] + char[inside]]]
        yield line.tobytes().decode().rstrip("-")


@lru_cache(maxsize=None)  # n is at most SAMPLES for each octave
def _weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The octave of each of the first n samples, and the steps each stands for."""
    octaves, weight, b = [np.full(1, -1)], [np.ones(1)], 0
    while sum(map(len, octaves)) < n:
        k = min(1 << b, SAMPLES)
        octaves.append(np.full(k, b))
        weight.append(np.full(k, (1 << b) / k))
        b += 1
    return np.concatenate(octaves)[:n], np.concatenate(weight)[:n]


def likeness(x: str, y: str) -> float:
    """Estimated share of equal steps, less what chance gives: 0 to 1."""
    if x == y:
        return 1.0
    n = max(len(x), len(y))
    _, weight = _weights(n)
    a, b = (np.frombuffer(s.ljust(n, "-").encode(), np.uint8) for s in (x, y))
    share = float(weight[a == b].sum() / weight.sum())
    return max(0.0, (share - 1 / len(SYMBOLS)) / (1 - 1 / len(SYMBOLS)))


@lru_cache(maxsize=None)
def _picks(n: int, more: int, count: int, bits: int) -> tuple[int, np.ndarray]:
    """The samples of a fingerprint of n symbols, filled up to whole octaves, and the places that the bands take of them.

    Places depend on the number of octaves only, so that texts of like length sample the same steps.
    """
    octaves, _ = _weights(n)
    full = max(1, 1 + sum(min(1 << b, SAMPLES) for b in range(int(octaves[-1]) + more)))
    _, weight = _weights(full)
    draws = (mix(np.arange(count * bits, dtype=U64) + U64(0x5151)) >> U64(11)).astype(float) / (1 << 53)
    return full, np.searchsorted(np.cumsum(weight) / weight.sum(), draws, "right").clip(0, full - 1)


def bands(x: str, count: int = 48, bits: int = 14, more: int = 0) -> list[int]:
    """Keys of banded samples: each band takes ``bits`` samples (up to 16), spread by weight over the octaves before that in
    which the text ends; with ``more`` over so many more octaves.

    At a likeness of 0.8 two texts share one of 48 bands of 14 with a chance of 0.93, at 0.85 of 0.99.
    """
    if not x:
        return [0]
    full, places = _picks(len(x), more, count, bits)
    a = np.zeros(max(full, len(x)), U64)  # 4 bits a symbol, 0 beyond the end
    a[: len(x)] = np.frombuffer(x.encode(), np.uint8) & 15
    keys = (a[places].reshape(count, bits) << (U64(4) * np.arange(bits, dtype=U64))).sum(1, dtype=U64)
    return mix(mix(keys) + mix(np.arange(count, dtype=U64) + U64(full << 20))).view(np.int64).tolist()


@lru_cache(maxsize=None)
def _reaches(n: int) -> bool:
    """Whether a fingerprint of n symbols can be alike to one that ends before its last octave: what it has there is unequal."""
    full, _ = _picks(n, 0, 1, 1)
    weight = _weights(n)[1]
    return weight[:full].sum() >= (ALIKE * (1 - 1 / len(SYMBOLS)) + 1 / len(SYMBOLS)) * weight.sum() - 1e-9


def all_bands(x: str) -> list[int]:
    """Keys over the octaves up to that in which the text ends; also over those before it, where the other text of a pair of likeness
    ALIKE can end in them."""
    if x and _reaches(len(x)):
        return sorted({*bands(x), *bands(x, more=1)})
    return sorted(set(bands(x, more=1)))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many (or all) of the next text's first."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


COLUMNS = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_shared int"


def _followed(batches):
    """Rows (part, head, doc_id, text) in order; a part ends with the head of the next part, which only follows."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
    last: list[tuple] = []
    for b in batches:
        for i in range(0, len(b), 1000):
            part = b.slice(i, 1000)
            rows = last + list(zip(part.column("head").to_pylist(), part.column("doc_id").to_pylist(), (t or "" for t in part.column("text").to_pylist())))
            last = rows[-1:]
            pairs = [(d, t, f) for (head, d, t), (_, _, f) in zip(rows, rows[1:]) if not head]
            known = dict(zip(texts := list({t: 0 for _, t, f in pairs for t in (t, f)}), fingerprints(texts)))
            changed = [edited(t, f) for _, t, f in pairs]
            after = fingerprints(changed)
            out = [
                [d for d, _, _ in pairs], [len(t) for _, t, _ in pairs], changed, [known[t] for _, t, _ in pairs], after,
                [likeness(known[t], q) for (_, t, _), q in zip(pairs, after)], [likeness(known[t], known[f]) for _, t, f in pairs],
                [len(set(bands(known[t])).intersection(bands(q))) for (_, t, _), q in zip(pairs, after)],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], [c.split()[0] for c in COLUMNS.split(", ")])


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with fingerprints of each text and of its edited text, and likenesses; see COLUMNS.

    Rows are dealt into ranges of doc_id (at most PARTS; bounds are quantiles) and streamed in order, so the texts travel
    once; of each range only the first document travels, to the end of the one before.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    parts = min(PARTS, max(1, docs.count() // ROWS))
    cuts = sorted(set(docs.where("doc_id is not null").stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    shipped = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("long")
    def place(ids):
        import pandas as pd

        null = ids.isna().to_numpy()
        return pd.Series(np.where(null, -1, np.searchsorted(shipped.value, ids.fillna(0).to_numpy().astype(np.int64), "right")))

    ranges = docs.select("doc_id").withColumn("part", place("doc_id")).groupBy("part").agg(F.min("doc_id").alias("first"))
    known = [tuple(r) for r in ranges.orderBy("part").collect()]  # at most PARTS + 1
    if not known:
        return spark.createDataFrame([], COLUMNS)
    heads = spark.createDataFrame([(p, f) for (p, _), (_, f) in zip(known[-1:] + known[:-1], known)], "part long, first long")
    heads = docs.join(F.broadcast(heads), docs.doc_id.eqNullSafe(heads["first"]))
    heads = heads.groupBy("part").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("part", F.lit(1).alias("head"), F.lit(None).cast("long").alias("doc_id"), "text")
    rows = docs.select(place("doc_id").alias("part"), F.lit(0).alias("head"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).union(heads)
    return rows.repartition("part").sortWithinPartitions("part", "head", "doc_id", "text").select("head", "doc_id", "text").mapInArrow(_followed, COLUMNS)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with column fingerprint (replaced if there)."""
    names = [c for c in docs.columns if c != "fingerprint"]

    def run(batches):
        for b in batches:
            prints = fingerprints([t or "" for t in b.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(prints, pa.string())], [*names, "fingerprint"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(names).schema.fields)
    return docs.select(names).mapInArrow(run, f"{schema}, fingerprint string")


def _compared(least: float):
    """Links a, b of a tile of a band: nodes of different components whose likeness is ``least`` or over."""

    def run(rows: pa.Table) -> pa.Table:
        i, j, tile, node, component = (rows.column(c).to_numpy() for c in ("i", "j", "tile", "node", "component"))
        texts = rows.column("fingerprint").to_pylist()
        size = np.array([len(t) for t in texts])
        width = int(size.max())
        grid = np.frombuffer("".join(t.ljust(width, "-") for t in texts).encode(), np.uint8).reshape(len(texts), width)
        weight = _weights(max(1, width))[1][:width]
        upto = np.append(0.0, np.cumsum(weight))
        lower, upper = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        links = []
        for x in lower.tolist():
            y = upper[(component[upper] != component[x]) & ((i[0] < j[0]) | (upper > x))]
            n = np.maximum(size[x], size[y])
            share = ((grid[y] == grid[x]) @ weight - (upto[-1] - upto[n])) / np.maximum(upto[n], 1)
            likely = share >= least * (1 - 1 / len(SYMBOLS)) + 1 / len(SYMBOLS) - 1e-9
            links += [(node[x], node[z]) for z in y[likely].tolist() if likeness(texts[x], texts[z]) >= least]
        return pa.table({c: pa.array([link[k] for link in links], pa.int64()) for k, c in enumerate("ab")})

    return run


def _verified(least: float):
    def run(batches):
        for b in batches:
            pairs = zip(b.column("fingerprint").to_pylist(), b.column("other").to_pylist())
            alike = pa.array([likeness(x, y) >= least for x, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(alike)

    return run


def near_classes(prints: DataFrame, least: float = ALIKE) -> DataFrame:
    """node, component of the fingerprints of prints(node, fingerprint; a row each) that share a band with an alike one.

    Bands that a single fingerprint has go first, so that only keys travel for most. Then each band's members are verified
    against its least, a pair a member. Bands of three or more whose members are in different components after that are compared
    in full, in tiles of TILE members by TILE: time by the square of such a band, but only links are written.
    """
    from terrane.llm.components import connected

    if least < ALIKE:
        raise ValueError(f"bands find pairs of likeness {ALIKE} or over")

    def keyed(batches):
        for b in batches:
            keys = [all_bands(x) for x in b.column("fingerprint").to_pylist()]
            nodes = np.repeat(b.column("node").to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array([k for row in keys for k in row], pa.int64()), pa.array(nodes, pa.int64())], ["band", "node"])

    members = staged(prints.mapInArrow(keyed, "band long, node long"), "members")
    pivots = staged(members.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1").drop("n"), "pivots")
    met = staged(members.join(pivots, "band"), "met")
    pairs = met.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = pairs.join(prints.select(F.col("node").alias("a"), "fingerprint"), "a").join(prints.select(F.col("node").alias("b"), F.col("fingerprint").alias("other")), "b")
    links = staged(pairs.mapInArrow(_verified(least), "a long, b long"), "links")
    found = staged(connected(links), "components")
    placed = staged(met.join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")), "placed")
    mixed = placed.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y and n > 2")
    tiles = placed.join(mixed.select("band", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "band").join(prints, "node")
    tiles = tiles.withColumn("tile", F.pmod(F.xxhash64("node", F.lit(1)), "tiles").cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = tiles.select("band", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "component", "fingerprint")
    rest = staged(tiles.groupBy("band", "i", "j").applyInArrow(_compared(least), "a long, b long"), "rest")
    return found if rest.isEmpty() else connected(links.union(rest))


def near_documents(docs: DataFrame, least: float = ALIKE) -> DataFrame:
    """fingerprint, class_id: components of the distinct fingerprints of docs that share a band and are alike.

    Fingerprints without a like one are their own class.
    """
    prints = staged(fingerprint(docs).select("fingerprint").distinct().withColumn("node", F.xxhash64("fingerprint")), "prints")
    found = prints.join(near_classes(prints, least), "node", "left")
    return found.select("fingerprint", F.coalesce("component", "node").alias("class_id"))


def op4_edit_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses of each document, and near_class: the least doc_id of the documents that banding and
    verification link to it, itself included (null if none of them has one)."""
    found = with_next(documents(spark, sf_dir)).withColumn("edited_sha256", F.sha2("edited_text", 256))
    found = staged(found.drop("edited_text"), "found")
    prints = staged(found.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn("node", F.xxhash64("fingerprint")), "prints")
    classes = prints.join(near_classes(prints.select("node", "fingerprint")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = staged(classes.select("fingerprint", "least", "component"), "classes")
    least = classes.groupBy("component").agg(F.min("least").alias("near_class"))
    return found.join(classes.join(least, "component").select("fingerprint", "near_class"), "fingerprint", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bands_shared", "near_class"
    )


QUERIES = {"op4_edit_fingerprints": op4_edit_fingerprints}
