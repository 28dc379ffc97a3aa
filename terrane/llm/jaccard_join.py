"""N-gram Jaccard join by PartEnum signatures, exact, without comparing all pairs.

A document's set holds its distinct w-word shingles (hashed to 64 bits). Sets of like size share a *band*; within a band
the Jaccard bound becomes a bound k on the symmetric difference. The hash domain is cut into n1 first-level parts, each
into n2 second-level parts; in some first-level part two similar sets differ by at most k2 shingles, so all but k2 of its
second-level parts agree, and one of the enumerated subsets of n2 - k2 parts has the same signature on both sides.

A signature with up to LIMIT members gives all their pairs; a longer one gives each member's pair with the least. Pairs are
first held against a bound from small histograms of the sets (the distance of two histograms is never more than that of the
sets), which clears away documents that merely share a passage; the rest are verified on whole texts. Then the long
signatures are finished: a member takes part only if it has as many long signatures as any similar pair would have to share
there, and only signatures whose members still lie in different components are looked at. What is left is compared in full, in tiles of
bounded size that give links and no pairs; that step alone takes time by the square of a cluster of such texts.

Skew: equal sets are one node; each block of documents sends at most LIMIT + 1 members of a signature to its bucket, so one
held by a third of all documents stays small there. Similarity inside a component is not computed again.

Edge cases: null or blank text has an empty set, n_shingles 0, no links and its own doc_id as component; fewer than w words
are one shingle; repeated rows and equal texts are one node; a null doc_id counts last (its component is the smallest
non-null doc_id, if any); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import U64, byte_codes, documents, mix, prefix_hash, release, runs, span_hash, staged, trim, utf8
from terrane.llm.components import connected

CODES = byte_codes(9, fold_case=True)
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
RUN = 1 << 19  # bytes of text hashed at once
BLOCK = 4 << 20  # bytes of text whose signatures are pre-aggregated together
LIMIT = 8  # members of a signature of which all pairs are taken at once
TILE = 1024  # texts that are compared with as many others at once
CARRIED = 2 << 20  # shingles of a tile
COLUMNS = 1024  # shingles of a matrix
STRIP = 256  # texts of a tile whose similarities are judged at once


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts, A-Z folded; and where each text's words begin among them."""
    base, n = offsets[0], offsets[-1] - offsets[0]
    data = data[base : base + n]
    if not n:
        return np.empty(0, U64), np.zeros(len(offsets), np.int64)
    word = ~BLANK[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets - base] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (cut[:-1] | ~before))
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (cut[1:] | ~after)) + 1
    return span_hash(prefix_hash(data, CODES), starts, ends), np.searchsorted(starts, offsets - base)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    odd = [mix(np.array([i + 1], U64))[0] | U64(1) for i in range(width)]
    for i, j in runs(offsets, RUN):
        words, at = word_hashes(data, offsets[i : j + 1])
        n = len(words) - width + 1
        rolled = mix(sum(words[k : k + n] * odd[k] for k in range(width))) if n > 0 else words[:0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= width:
                x = np.sort(rolled[a : b - width + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x
            elif b > a:
                yield mix(np.array([sum(int(w) * int(o) for w, o in zip(words[a:b], odd)) + (b - a) & (1 << 64) - 1], U64))
            else:
                yield words[:0]


def set_key(x: np.ndarray) -> int:
    """The node of a set: equal sets, equal nodes."""
    return int(mix(np.array([int(mix(x ^ U64(0x51)).sum()) + len(x) & (1 << 64) - 1], U64)).view(np.int64)[0])


class Bands:
    """Size bands for a similarity of percent/100, and the enumeration used in each."""

    def __init__(self, percent: int):
        self.percent = percent

    def upper(self, size: int) -> int:
        """The largest size that a partner of a set of this size may have."""
        return size * 100 // self.percent

    @lru_cache(maxsize=None)  # noqa: B019
    def _bounds(self, upto: int) -> list[int]:
        low = [1]
        while low[-1] <= upto:
            low.append(self.upper(low[-1]) + 1)
        return low

    def labels(self, size: int) -> list[int]:
        """The bands in which a set of this size gives signatures: its own, and the next if a partner may be there."""
        low = self._bounds(1 << (size + 1).bit_length() + 1)
        own = int(np.searchsorted(low, size, "right")) - 1
        return [own, own + 1] if self.upper(size) >= low[own + 1] else [own]

    @lru_cache(maxsize=None)  # noqa: B019
    def plan(self, label: int) -> tuple[int, int, np.ndarray, int] | None:
        """n1, n2, the subsets as 0/1 rows, and how many first-level parts agree to within k2 at least; None: equal sets only."""
        low = [1]
        while len(low) <= label + 1:
            low.append(self.upper(low[-1]) + 1)
        most = low[label + 1] - 1
        k = 2 * most * (100 - self.percent) // (100 + self.percent)
        if k == 0:
            return None
        n1, n2, k2 = (1, k + 3, k) if k <= 4 else (k // 2 + 4 + k // 20, 3, 1)
        picks = np.array([[i in c for i in range(n2)] for c in combinations(range(n2), n2 - k2)], U64)
        return n1, n2, picks, n1 - k // (k2 + 1)


def signatures(x: np.ndarray, bands: Bands) -> list[tuple[np.ndarray, int, int]]:
    """All signatures of a sorted set: for each of its bands the signatures, the band's parity, and how many of them the set
    shares with any similar set of this band at least.

    A subset without shingles is left out, unless the set has so many empty ones that the parts that must agree could all
    be among them; then all are given. Two similar sets share a signature in either case.
    """
    if not len(x):
        return []
    out = []
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(x ^ U64(0x77)))))
    for label in bands.labels(len(x)):
        if (plan := bands.plan(label)) is None:
            continue
        n1, n2, picks, sure = plan
        cells = n1 * n2
        edges = (np.arange(1, cells, dtype=np.float64) * (2.0**64 / cells)).astype(U64)
        at = np.concatenate(([0], np.searchsorted(x, edges), [len(x)]))
        sums = (total[at[1:]] - total[at[:-1]]).reshape(n1, n2) @ picks.T
        full = (np.diff(at).reshape(n1, n2) @ picks.T.astype(np.int64)) > 0
        place = np.arange(sums.size, dtype=U64).reshape(sums.shape) + U64(label << 40)
        sig = mix(sums + mix(place))
        empty = int((~full).any(1).sum())
        out.append((sig[full], label & 1, sure - empty) if empty < sure else (sig.ravel(), label & 1, 1))
    return out


def histogram(x: np.ndarray) -> bytes | None:
    """Counts of a set's shingles in equal shares of the hash domain, about four to eight to each; None if one is over 255."""
    bits = max(0, len(x).bit_length() - 3)
    counts = np.bincount((x >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def least_distance(x: bytes, y: bytes) -> int:
    """A lower bound of the sets' symmetric difference."""
    a, b = (np.frombuffer(h, np.uint8).astype(np.int64) for h in (x, y))
    n = min(len(a), len(b))
    return int(np.abs(a.reshape(n, -1).sum(1) - b.reshape(n, -1).sum(1)).sum())


def _sets(width: int):
    """doc_id, n_shingles, node and histogram of each document."""

    def run(batches):
        for b in batches:
            rows = [(len(x), set_key(x) if len(x) else None, histogram(x)) for x in shingle_sets(*utf8(b.column("text")), width)]
            n, nodes, shapes = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(shapes, pa.binary())], ["doc_id", "n_shingles", "node", "shape"])

    return run


MET = "a long, b long, sig long, need int"


def _rows(bucket=None, blob=None, a=None, b=None, sig=None, need=None) -> pa.RecordBatch:
    n = len(blob if a is None else a)
    have = [(bucket, pa.int32()), (blob, pa.binary()), (a, pa.int64()), (b, pa.int64()), (sig, pa.int64()), (need, pa.int32())]
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in have], ["bucket", "blob", "a", "b", "sig", "need"])


def _emit(width: int, percent: int, buckets: int):
    """Per block: rows of long signatures, and for each bucket a packed list of (signature, member)."""

    def run(batches):
        bands = Bands(percent)
        for b in batches:
            data, offsets = utf8(b.column("text"))
            for i, j in runs(offsets, BLOCK):
                sets = {}
                for x in shingle_sets(data, offsets[i : j + 1], width):
                    if len(x) and (key := set_key(x)) not in sets:
                        sets[key] = signatures(x, bands)
                names = np.array(sorted(k for k, found in sets.items() if found), np.int64)
                if len(names):
                    yield from _packed(names, [sets[k] for k in names.tolist()], buckets)
                    trim()

    return run


def _ranks(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted signatures: each row's place among its signature's, and their number."""
    start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.append(start, len(sig)))
    return np.arange(len(sig)) - np.repeat(start, size), np.repeat(size, size)


def _long(sig: np.ndarray, member: np.ndarray, need: np.ndarray, rank: np.ndarray, size: np.ndarray, packed: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (member, least member, signature, need) of signatures with more than LIMIT members."""
    at = np.flatnonzero(size > LIMIT)
    if len(at):
        yield _rows(bucket=None if packed else (-1 - at % 64).astype(np.int32), a=member[at], b=member[at - rank[at]], sig=sig[at].view(np.int64), need=need[at])


def _packed(names: np.ndarray, found: list[list[tuple[np.ndarray, int, int]]], buckets: int) -> Iterator[pa.RecordBatch]:
    """A bucket is an equal share of the signatures' range; inside it 39 leading bits and the band's parity are kept, so
    that chance meetings stay a fixed small share of the signatures however many there are (pairs are verified in any case)."""
    share = (1 << 64) // buckets + 1
    sig = np.concatenate([x for one in found for x, _, _ in one])
    which = np.concatenate([np.full(len(x), w, np.uint8) for one in found for x, w, _ in one])
    own = np.repeat(np.arange(len(found)), [sum(len(x) for x, _, _ in one) for one in found])
    need = np.ones((len(found), 2), np.uint8)
    for k, one in enumerate(found):
        for _, w, n in one:
            need[k, w] = min(n, 255)
    bucket = sig // U64(share)
    sig = bucket << U64(40) | (sig - bucket * U64(share)) >> U64(max(0, share.bit_length() - 39)) << U64(1) | which
    order = np.argsort(sig, kind="stable")  # names are sorted, so members are too
    sig, own = sig[order], own[order]
    rank, size = _ranks(sig)
    yield from _long(sig, names[own], need[own, (sig & U64(1)).astype(int)], rank, size)
    sent = rank <= LIMIT
    sig, own = sig[sent], own[sent]
    at = np.searchsorted(sig, np.arange(buckets + 1, dtype=U64) << U64(40))
    full = np.flatnonzero(np.diff(at))
    blobs = []
    for k in full.tolist():
        members, local = np.unique(own[at[k] : at[k + 1]], return_inverse=True)
        local = local.astype(np.uint16 if len(members) <= 1 << 16 else np.uint32)
        lead = sig[at[k] : at[k + 1]].view(np.uint8).reshape(-1, 8)[:, :5]
        blobs.append(np.array([len(lead), len(members)], np.int64).tobytes() + names[members].tobytes() + need[members].tobytes() + local.tobytes() + lead.tobytes())
    for k in range(0, len(blobs), 512):
        yield _rows(bucket=full[k : k + 512].astype(np.int32), blob=blobs[k : k + 512])


def _unpacked(blob: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(blob, np.int64, 2).tolist()
    names, need = np.frombuffer(blob, np.int64, m, 16), np.frombuffer(blob, np.uint8, 2 * m, 16 + 8 * m).reshape(m, 2)
    kind = np.dtype(np.uint16 if m <= 1 << 16 else np.uint32)
    local = np.frombuffer(blob, kind, n, 16 + 10 * m)
    lead = np.zeros((n, 8), np.uint8)
    lead[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, 16 + 10 * m + kind.itemsize * n).reshape(-1, 5)
    lead = lead.view(U64).ravel()
    return lead, names[local], need[local, (lead & U64(1)).astype(int)]


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    """A bucket's pairs, and rows of its long signatures; those of a block pass."""
    trim()
    names = ["a", "b", "sig", "need"]
    if key[0].as_py() < 0:
        return table.select(names)
    sig, member, need = (np.concatenate(x) for x in zip(*(_unpacked(memoryview(x.as_buffer())) for x in table.column("blob"))))
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    many = np.flatnonzero(sig[1:] == sig[:-1])
    many = np.unique(np.concatenate((many, many + 1)))  # few signatures have several members
    sig, order = sig[many], order[many]
    member, need = member[order], need[order]
    order = np.lexsort((member, sig))
    sig, member, need = sig[order], member[order], need[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (member[1:] != member[:-1])
    sig, member, need = sig[new], member[new], need[new]
    rank, size = _ranks(sig) if len(sig) else (np.empty(0, int), np.empty(0, int))
    pairs = [np.empty((2, 0), np.int64)]
    for d in range(1, LIMIT):
        at = np.flatnonzero((rank >= d) & (size <= LIMIT))
        pairs.append(np.stack((member[at], member[at - d])))
    a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
    whole = sig + (U64(key[0].as_py()) << U64(40))
    return pa.Table.from_batches([x.select(names) for x in (_rows(a=a, b=b), *_long(whole, member, need, rank, size, True))])


def _near(percent: int):
    """Pairs that the histograms don't rule out."""

    def run(batches):
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("n_a", "n_b", "shape_a", "shape_b"))
            good = [
                100 * min(m, n) >= percent * max(m, n) and (x is None or y is None or (100 + percent) * least_distance(x, y) <= (100 - percent) * (m + n))
                for m, n, x, y in zip(*cols)
            ]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _similar(width: int, percent: int):
    """Pairs of texts whose sets are similar enough, by exact intersection."""

    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(shingle_sets(*utf8(b.column("text_a")), width), shingle_sets(*utf8(b.column("text_b")), width)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
            trim()

    return run


def _bodies(width: int):
    """node and text of each distinct set in a task."""

    def run(batches):
        seen = set()
        for b in batches:
            keys = [set_key(x) if len(x) else None for x in shingle_sets(*utf8(b.column("text")), width)]
            fresh = [k for k, key in enumerate(keys) if key is not None and not (key in seen or seen.add(key))]
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in fresh], pa.int64()), b.column("text").take(pa.array(fresh, pa.int64()))], ["node", "text"])

    return run


def _texts(docs: DataFrame, sets: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, text: a text for each node wanted."""
    chosen = sets.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("id")).select("id").distinct()
    texts = docs.join(chosen, docs.doc_id.eqNullSafe(chosen.id), "left_semi").select("text")
    bodies = texts.mapInArrow(_bodies(width), "node long, text string")
    bodies = staged(bodies.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "bodies")
    del chosen, texts
    release()
    return bodies


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) of nodes the similar ones."""
    shapes = sets.where("node is not null").groupBy("node").agg(F.max("n_shingles").alias("n"), F.max("shape").alias("shape"))
    for k in "ab":
        pairs = pairs.join(shapes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("shape").alias(f"shape_{k}")), k)
    near = staged(pairs.mapInArrow(_near(percent), "a long, b long"), "near")
    bodies = _texts(docs, sets, near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), width)
    a, b = (bodies.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return staged(near.join(a, "a").join(b, "b").mapInArrow(_similar(width, percent), "a long, b long").distinct(), "links")


def _unfinished(long: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """sig, node, component of long signatures whose members may be similar though in different components; None: none."""
    rows = long.join(nodes, "node", "left").select("sig", "node", "need", F.coalesce("component", "node").alias("component"))
    left = None
    while True:
        # A similar pair shares at least ``need`` signatures of a band; if these are all long, each of the two has so many.
        torn = rows.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sig")
        rows = rows.join(torn, "sig").withColumn("band", F.col("sig").bitwiseAND(F.lit(1)))
        enough = rows.groupBy("node", "band").agg(F.count("*").alias("n"), F.min("need").alias("least")).where("n >= least").select("node", "band")
        rows = staged(rows.join(enough, ["node", "band"]).drop("band"), "long")
        before, left = left, rows.count()
        if left == 0:
            return None
        if before is not None and left > 0.9 * before:
            return rows


def _tile(width: int, percent: int):
    """Links between components among two lists of texts: all intersections at once, as products of 0/1 matrices."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        if not len(left) or not len(right):
            return schema.empty_table()
        sides = []
        for side in (left, right):
            sets = list(shingle_sets(*utf8(side.column("text")), width))
            size = np.array([len(x) for x in sets])
            sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), size), size, side.column("node").to_numpy(), side.column("component").to_numpy()))
        common = np.intersect1d(sides[0][0], sides[1][0])
        places = []
        for x, row, _, _, _ in sides:
            at = np.searchsorted(common, x).clip(0, max(0, len(common) - 1))
            hit = common[at] == x if len(common) else np.zeros(len(x), bool)
            order = np.argsort(at[hit], kind="stable")
            places.append((at[hit][order], row[hit][order]))
        (_, _, m, a, in_a), (_, _, n, b, in_b) = sides
        both = np.zeros((len(m), len(n)), np.float32)
        for start in range(0, len(common), COLUMNS):
            parts = []
            for (at, row), size in zip(places, (len(m), len(n))):
                lo, hi = np.searchsorted(at, (start, start + COLUMNS))
                part = np.zeros((size, min(COLUMNS, len(common) - start)), np.float32)
                part[row[lo:hi], at[lo:hi] - start] = 1
                parts.append(part)
            both += parts[0] @ parts[1].T
        links = [np.empty((2, 0), np.int64)]
        for k in range(0, len(m), STRIP):
            own = slice(k, k + STRIP)
            good = (100 * both[own] >= percent * (m[own, None] + n[None, :] - both[own])) & (in_a[own, None] != in_b[None, :])
            i, j = np.nonzero(good)
            links.append(np.stack((i + k, j)))
        i, j = np.concatenate(links, axis=1)
        _, one = np.unique(np.stack((in_a[i], in_b[j])), axis=1, return_index=True)  # a link for two components is enough
        return pa.table([a[i[one]], b[j[one]]], schema=schema)

    return run


def _compared(docs: DataFrame, sets: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components among the members of long signatures, by comparing them in tiles.

    Members that long signatures connect form a cluster; in it texts are dealt by size into tiles of about TILE texts and CARRIED
    shingles, and tiles of like sizes meet. Every pair is compared, but pairs are never rows: a tile against a tile is a matrix
    product. A text travels once for each tile that its own meets, so a bounded number of times in a cluster of up to TILE.
    """
    least = rows.groupBy("sig").agg(F.min("node").alias("b"))
    clusters = connected(rows.join(least, "sig").select(F.col("node").alias("a"), "b").distinct()).withColumnRenamed("component", "cluster")
    wanted = rows.select("node", "component").distinct().join(clusters, "node")
    sizes = sets.where("node is not null").groupBy("node").agg(F.max("n_shingles").alias("n"))
    band = F.floor(2 * F.ln("n") / F.log(F.lit(100 / percent))).cast("int")
    wanted = staged(wanted.join(sizes, "node").withColumn("band", band), "wanted")
    many = wanted.groupBy("cluster", "band").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / CARRIED)).cast("int").alias("tiles"))
    wanted = wanted.drop("n")
    tiles = many.select("cluster", "band", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    x, y = (tiles.select("cluster", F.col("band").alias(f"band_{k}"), F.col("tile").alias(f"tile_{k}")) for k in "xy")
    ahead = F.col("band_y") - F.col("band_x")  # a partner is at most 100 / percent times as large: two bands, and one for rounding
    meet = x.join(y, "cluster").where(ahead.between(0, 3) & ((ahead > 0) | (F.col("tile_x") <= F.col("tile_y"))))
    texts = _texts(docs, sets, wanted.select("node"), width)
    dealt = wanted.join(texts, "node").join(many, ["cluster", "band"]).withColumn("tile", F.pmod(F.xxhash64("node", F.lit("tile")), F.col("tiles")).cast("int")).drop("tiles")
    key = ["cluster", "band_x", "tile_x", "band_y", "tile_y"]
    sides = (dealt.withColumnsRenamed({"band": f"band_{k}", "tile": f"tile_{k}"}).join(meet, ["cluster", f"band_{k}", f"tile_{k}"]).select(*(F.col(c).alias(c) for c in (*key, "node", "component", "text"))) for k in "xy")
    left, right = (s.groupBy(*key) for s in sides)  # aliased, as both sides come from one table
    return staged(left.cogroup(right).applyInArrow(_tile(width, percent), "a long, b long"), "tiled")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: documents joined by chains of links of Jaccard similarity >= percent / 100.

    See the module's text for edge cases. 64-bit hashes stand for shingles and sets.
    """
    docs = docs.select("doc_id", "text")
    sets = staged(docs.mapInArrow(_sets(width), "doc_id long, n_shingles long, node long, shape binary"), "sets")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(64, int(total // 1_500_000) + 1)
    emitted = docs.select("text").mapInArrow(_emit(width, percent, buckets), f"bucket int, blob binary, {MET}")
    met = staged(emitted.groupBy("bucket").applyInArrow(_meet, MET), "met")
    del emitted
    release()
    pairs = staged(met.where("a <> b").select("a", "b").distinct(), "pairs")
    links = _verified(docs, sets, pairs, width, percent)
    release()
    nodes = connected(links)
    long = staged(met.where("sig is not null").select("sig", F.col("a").alias("node"), "need").distinct(), "long")
    if not long.isEmpty() and (rest := _unfinished(long, nodes)) is not None:
        nodes = connected(links.union(_compared(docs, sets, rest, width, percent)))
    release()
    key = F.coalesce("component", "node", F.xxhash64("doc_id", F.lit("alone")))
    named = sets.join(nodes, "node", "left").select("doc_id", "n_shingles", key.alias("component"))
    least = staged(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")  # a large component can be split
    return named.join(least, "component").select("doc_id", "n_shingles", "component_id")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
