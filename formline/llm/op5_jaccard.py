"""N-gram Jaccard join: links between texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

1. Every text becomes a set of 64-bit shingle hashes. Texts with equal sets form a class; its smallest doc_id stands for it. Of a set that
   a task meets again, only the first row carries what the next steps read, so copies do not multiply it.
2. Candidates by prefix: in one fixed order of all shingles, the first common shingle of two sets of similarity t is among the first
   n - ceil(t n) + 1 of the larger and the first n - ceil(2 t n / (1 + t)) + 1 of the smaller. Any order is exact; this one puts shingles of
   rare words first, by counts of hashed words over the whole corpus in a table of fixed size, so passages that many documents share come
   last and hardly ever make candidates. Each class with a shingle is chained to the next smaller one that has it early, a chain
   breaks where sizes alone rule a link out, and the chains' connected components hold every link.
3. Chains also connect sets that merely share passages. Bitmaps of two to four bits a shingle, made with the sets, split each
   component again: sets stay together only if a path of pairs leads from one to the other whose bitmaps and sizes allow a link.
   No set travels for that.
4. In each group that is left, signature trees find the links: a leaf is a class, a node holds the OR of its classes' token
   bitmaps, at a resolution that grows with what lies below, and their largest and smallest size; leaves stand in order of their smallest
   hashes, so like lies with like. Two trees (or one with itself) are traversed together; a pair of nodes is pruned if the overlap that
   their bitmaps and sizes still allow is too small for any pair below. Leaf pairs that are left are compared exactly, connected or
   not, so every link is found.
5. Where it is found, a link counts for both classes by the rows of the other; a spanning forest of each unit of work gives the components. Every
   document gets the component and the number of links of its class.

A group whose content fits is a unit of work or part of one. A larger one is cut into bands of sizes and each band by hash into blocks; a unit is
a pair of blocks of one band or of two neighbouring ones, as other sizes have no links. No pairs of classes travel but those of forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import arrow_map, chunks, documents, materialize, settled, texts, type_of
from formline.llm.components import components

WORDS = 5
PERCENT = 80
#: Counters of hashed words, whatever the corpus; 4 bytes each.
COUNTERS = 1 << 20
#: Shingles of a block of sets, and of a block of bitmaps.
BLOCK, BITMAP_BLOCK = 1 << 19, 1 << 25
#: Bands of sizes: a link's sizes differ by a factor of 100 / PERCENT at most, less than this, so it lies in one band or two neighbours.
BAND = 1.26
FANOUT = 8
#: Sets that a task remembers; when they are full it forgets them all, and results do not depend on it.
MET = 1 << 20
#: Rows without texts that are broadcast at most, of some 150 bytes each; beyond, texts meet them by a shuffled join.
BROADCAST_ROWS = 200_000
#: Tree level whose node pairs are compared together: FANOUT ** DENSE classes a side.
DENSE = 2
#: Surviving leaf pairs of two nodes up to which each is compared by itself.
FEW = 24
#: Columns of a matrix product, and bytes of the bitmaps that are compared at once.
SLICE, AT_ONCE = 1 << 15, 16 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _word_hashes(raw: bytes) -> np.ndarray:
    words = raw.translate(_LOWER).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _rolled(w: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hashes of all windows of n words, or of the whole sequence if it is shorter."""
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(h)])
    return h


def shingles(raw: bytes) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; empty without words."""
    w = _word_hashes(raw)
    return np.unique(_rolled(w)) if len(w) else w


def fingerprint(h: np.ndarray, salt: int) -> int:
    return int(_mix(h + np.uint64(salt)).sum().view(np.int64)) if len(h) else 0


def word_counts(docs: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """How often the words of each hash bucket occur in all texts: one table of fixed size a task, summed part by part before it comes to the driver."""
    parts = 64

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for batch in it:
            for piece in chunks(batch):
                hashes = [_word_hashes(x) for x in texts(piece)]
                total += np.bincount((np.concatenate(hashes) & np.uint64(counters - 1)).astype(np.int64), minlength=counters)
        total = np.minimum(total, 2**32 - 1).astype("<u4").reshape(parts, -1)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "counts": pa.array([x.tobytes() for x in total], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(counters // parts, np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(x, "<u4")
        return pd.DataFrame({"part": pdf["part"][:1], "counts": [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]})

    schema = "part int, counts binary"
    # in two steps of 64 tasks' tables, and of the sums of 64 tasks
    some = docs.select("text").mapInArrow(settled(f), schema).withColumn("some", F.floor(F.spark_partition_id() / 64))
    once = some.groupBy("part", "some").applyInPandas(add, schema)
    rows = once.groupBy("part").applyInPandas(add, schema).collect()
    out = np.zeros((parts, counters // parts), "<u4")
    for r in rows:
        out[r["part"]] = np.frombuffer(r["counts"], "<u4")
    return out.reshape(-1)


def prefix_length(n: int) -> int:
    """Shingles of a set among which the first common one with a set of its size or smaller must be."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def index_length(n: int) -> int:
    """Shingles of a set among which the first common one with a set of its size or larger must be."""
    return n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1 if n else 0


def bitmap(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits (a power of two, 64 at least) of a set, by the low bits of its hashes. Halves ORed give the bitmap of half as many bits."""
    on = np.zeros(bits, np.uint8)
    on[(h & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(on, bitorder="little").view(np.uint64)


def _bits(n: int) -> int:
    return max(64, 1 << (2 * n - 1).bit_length())


def _fold(bitmaps: np.ndarray, words: int) -> np.ndarray:
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] | bitmaps[:, half:]
    return bitmaps


def sketches(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """The columns of docs but the text, and n, f1, f2 (fingerprint of the set) of every row, and of those whose set is new to the task prefix (shingle hashes, rarest first) and bits (bitmap)."""
    carry = [c for c in docs.columns if c != "text"]
    sent = docs.sparkSession.sparkContext.broadcast(counts)  # 4 * COUNTERS bytes
    met: set[tuple[int, int]] = set()

    def f(batch: pa.RecordBatch) -> dict:
        table = sent.value
        out: dict = {k: [] for k in ("n", "f1", "f2", "prefix", "bits")}
        for raw in texts(batch):
            w = _word_hashes(raw)
            n, f1, f2, prefix, bits = 0, 0, 0, None, None
            if len(w):
                all_h = _rolled(w)
                h, at = np.unique(all_h, return_index=True)
                n, f1, f2 = len(h), fingerprint(h, 1), fingerprint(h, 2)
                if (f1, f2) not in met:
                    if len(met) >= MET:
                        met.clear()
                    met.add((f1, f2))
                    seen = table[(w & np.uint64(len(table) - 1)).astype(np.int64)]
                    rarest = np.full(len(all_h), 2**32 - 1, np.uint32)
                    for k in range(min(WORDS, len(w))):
                        rarest = np.minimum(rarest, seen[k : k + len(all_h)])
                    # rarity by quarters of powers of two, then the hash: equal shingles have equal words and so equal places in the order
                    level = (4 * np.log2(rarest[at].astype(np.float64) + 1)).astype(np.int64)
                    prefix = h[np.lexsort((h, level))[: prefix_length(n)]].view(np.int64)
                    bits = bitmap(h, _bits(n)).tobytes()
            for k, x in zip(out, (n, f1, f2, prefix, bits), strict=True):
                out[k].append(x)
        return {c: batch.column(c) for c in carry} | out

    return arrow_map(docs, f, ", ".join(f"{c} {type_of(docs, c)}" for c in carry) + ", n long, f1 long, f2 long, prefix array<long>, bits binary")


def chains(sketch: DataFrame) -> DataFrame:
    """(a, b): fingerprints f1 of sets with a common prefix shingle: each and the next smaller one that has it in its index part, if their sizes allow a link.

    Rows come sorted and are read as a stream, so a shingle of any number of sets takes the memory of one row.
    """

    def f(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in it:
            t, k, c = (batch.column(x).to_numpy() for x in ("t", "k", "f1"))
            if not len(t):
                continue
            if last is not None:
                t, k, c = (np.concatenate([[x], y]) for x, y in zip(last, (t, k, c), strict=True))
            n, here = k >> 1, np.arange(len(t))
            upto = np.maximum.accumulate(np.where(k & 1, -1, here))  # the latest row in its index part
            before = np.append(-1, upto[:-1])
            y = np.flatnonzero(before >= 0)
            x = before[y]
            fits = (t[x] == t[y]) & (c[x] != c[y]) & (100 * n[x] >= PERCENT * n[y])
            last = None if upto[-1] < 0 else (t[upto[-1]], k[upto[-1]], c[upto[-1]])
            pairs = np.unique(np.stack([c[x[fits]], c[y[fits]]], axis=1), axis=0)
            yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    late = F.col("pos") > F.expr(f"n - (2 * {PERCENT} * n + {99 + PERCENT}) div {100 + PERCENT}")
    rows = sketch.select(F.posexplode("prefix").alias("pos", "t"), "n", "f1").select("t", (2 * F.col("n") + late.cast("int")).cast("int").alias("k"), "f1")
    return rows.repartition("t").sortWithinPartitions("t", "k", "f1").mapInArrow(settled(f), "a long, b long").distinct()


def units(members: DataFrame, most: int) -> DataFrame:
    """members(g, n, f1, f2, ...) with units, the units of work that each belongs to: structs of u (array of numbers) and side (0 or 1).

    u is [hash of g] for groups of up to most shingles, some sixteenth of most in a unit, and [g, band, block, band, block] for pairs of blocks of larger ones, whose smaller
    block is side 0. A row adds 50 to its shingles, for what it costs by itself.
    """
    weighed = members.withColumns({"w": F.col("n") + 50, "band": F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("long")})
    totals = weighed.groupBy("g").agg(F.sum("w").alias("total"))
    content = totals.agg(F.sum(F.when(F.col("total") <= most, F.col("total")))).first()[0] or 0
    parts = weighed.groupBy("g", "band").agg(F.sum("w").alias("w"))
    parts = parts.groupBy("g").agg(F.sum("w").alias("total"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("w") / most).alias("k")))).alias("parts"))  # a few dozen bands
    rows = weighed.join(parts, "g")
    own = F.pmod(F.xxhash64("f1", "f2"), F.try_element_at("parts", F.col("band")))

    def pairs(step: int) -> Column:
        blocks = F.coalesce(F.try_element_at("parts", F.col("band") + step), F.lit(0))
        here = F.array("g", "band", own)

        def unit(j: Column) -> Column:
            there = F.array("g", F.col("band") + step, j)
            first = F.lit(step > 0) if step else own <= j
            u = F.when(first, F.concat(here, F.slice(there, 2, 2))).otherwise(F.concat(there, F.slice(here, 2, 2)))
            return F.struct(u.alias("u"), F.when(first, 0).otherwise(1).alias("side"))

        return F.transform(F.when(blocks > 0, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array().cast("array<long>")), unit)

    small = F.array(F.struct(F.array(F.pmod(F.xxhash64("g"), F.lit(max(1, 16 * content // most)))).alias("u"), F.lit(0).alias("side")))
    found = F.when(F.col("total") <= most, small).otherwise(F.concat(pairs(-1), pairs(0), pairs(1)))
    return rows.select(*members.columns, found.alias("units"))


def together(bitmaps: list[bytes], sizes: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """A label for each set: sets that a path of pairs connects whose bitmaps and sizes allow a link share one. With sides, only pairs across count.

    Sets are walked in order of size against those up to a link's factor larger; pairs that share a label already are not looked at.
    """
    order = np.argsort(sizes, kind="stable")
    sizes, length = sizes[order], np.array([len(bitmaps[i]) // 8 for i in order])
    label, ends = np.arange(len(order)), np.searchsorted(PERCENT * sizes, 100 * sizes, side="right")
    side = None if side is None else side[order]
    # bitmaps of one length lie together, as lengths follow sizes
    begins = np.concatenate([[0], np.flatnonzero(np.diff(length)) + 1, [len(order)]])
    blocks = [np.frombuffer(b"".join(bitmaps[i] for i in order[lo:hi]), np.uint64).reshape(hi - lo, -1) for lo, hi in zip(begins[:-1], begins[1:], strict=True)]
    extra = np.concatenate([sizes[lo:hi] - np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x, lo, hi in zip(blocks, begins[:-1], begins[1:], strict=True)])
    for k, mine in enumerate(blocks):
        # the next length is twice this one, or no link leads there
        near = [(begins[k], mine, extra[begins[k] : begins[k + 1]])]
        if k + 1 < len(blocks) and blocks[k + 1].shape[1] == 2 * mine.shape[1]:
            half = _fold(blocks[k + 1], mine.shape[1])
            near.append((begins[k + 1], half, sizes[begins[k + 1] : begins[k + 2]] - np.bitwise_count(half).sum(axis=1, dtype=np.int64)))
        for i in range(begins[k], begins[k + 1]):
            merged = [label[i]]
            for first, theirs, more in near:
                lo, hi = max(i + 1, first), min(ends[i], first + len(theirs))
                at = lo + np.flatnonzero(label[lo:hi] != label[i])
                if side is not None:
                    at = at[side[at] != side[i]]
                for part in np.array_split(at, 1 + at.size * mine.shape[1] * 8 // AT_ONCE):
                    common = np.bitwise_count(theirs[part - first] & mine[i - begins[k]]).sum(axis=1, dtype=np.int64)
                    overlap = np.minimum(common + np.minimum(more[part - first], extra[i]), sizes[i])
                    merged += label[part[(100 + PERCENT) * overlap >= PERCENT * (sizes[i] + sizes[part])]].tolist()
            if len(merged) > 1 and len(found := set(merged)) > 1:
                label[np.isin(label, list(found)) if len(found) > 2 else (label == max(found))] = min(found)
    out = np.empty(len(order), np.int64)
    out[order] = order[label]
    return out


def refined(groups: DataFrame) -> DataFrame:
    """(f1, g): groups(g, n, f1, f2, bits) split by their bitmaps; sets that stay alone are left out."""
    dealt = units(groups, BITMAP_BLOCK).select("g", "n", "f1", "bits", F.explode("units").alias("_u")).select("g", "n", "f1", "bits", "_u.u", "_u.side")

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        large = len(pdf["u"].iat[0]) > 1
        own, found = large and pdf["u"].iat[0][1:3].tolist() == pdf["u"].iat[0][3:5].tolist(), []
        for _, part in pdf.groupby("g", sort=False):
            names, sides = part["f1"].to_numpy(), part["side"].to_numpy() if large and not own else None
            label = together(part["bits"].tolist(), part["n"].to_numpy(np.int64), sides)
            some = np.bincount(label, minlength=len(label))[label] > 1
            found.append(pd.DataFrame({"f1": names[some], "g": names[label[some]], "large": large}))
        return pd.concat(found)

    edges = materialize(dealt.groupBy("u").applyInPandas(f, "f1 long, g long, large boolean"), "op5-refined")
    small = edges.where("not large").select("f1", "g")
    if edges.where("large").isEmpty():
        return small
    return small.unionByName(components(edges.where("large"), "f1", "g", "op5-refined").select(F.col("node").alias("f1"), F.col("component").alias("g")))


class Tree:
    """A signature tree over sets in a given order: levels of (bitmaps, least size, most size, extra), leaves first.

    Leaves have bitmaps of the given number of bits; a level above has 16 to 32 bits for each distinct token of its largest node, so nodes of FANOUT
    unlike sets have fewer bits in common by chance than a link needs.
    """

    def __init__(self, sets: list[np.ndarray], least: int):
        low = high = np.array([len(s) for s in sets], np.int64)
        bits = np.stack([bitmap(s, least) for s in sets])
        # how many tokens each leaf has beyond one a bit: what two leaves may share beyond their common bits; finer bitmaps leave no more
        extra = low - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, low, high, extra)]
        while len(low) > 1:
            at = np.arange(0, len(low), FANOUT)
            sets = [np.unique(np.concatenate(sets[i : i + FANOUT])) for i in at]
            low, high, extra = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)
            most = max(least, 8 * _bits(max(map(len, sets))))
            self.levels.append((np.stack([bitmap(s, most) for s in sets]), low, high, extra))


class Groups:
    """Disjoint sets of leaf numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _possible(a: Tree, b: Tree, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether some pair of sets below nodes i of a and j of b may reach the similarity."""
    (bits_a, *rest_a), (bits_b, *rest_b) = a.levels[level], b.levels[level]
    low_a, high_a, extra_a = (x[i] for x in rest_a)
    low_b, high_b, extra_b = (x[j] for x in rest_b)
    words = min(bits_a.shape[1], bits_b.shape[1])
    bits_a, bits_b = _fold(bits_a, words), _fold(bits_b, words)
    parts = 1 + len(i) * words * 8 // AT_ONCE
    pairs = zip(np.array_split(i, parts), np.array_split(j, parts), strict=True)
    common = np.concatenate([np.bitwise_count(bits_a[x] & bits_b[y]).sum(axis=1, dtype=np.int64) for x, y in pairs])
    overlap = np.minimum(common + np.minimum(extra_a, extra_b), np.minimum(high_a, high_b))
    # at similarity t, overlap >= t / (1 + t) * (size + size), and sizes differ by t at most
    enough = (100 + PERCENT) * overlap >= PERCENT * (low_a + low_b)
    return enough & (100 * high_a >= PERCENT * low_b) & (100 * high_b >= PERCENT * low_a)


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many hashes two ascending sets share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


class _Node:
    """The sets of a node as rows over its distinct tokens."""

    def __init__(self, sets: list[np.ndarray]):
        self.row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.tokens, self.at = np.unique(np.concatenate(sets), return_inverse=True)
        self.n = len(sets)

    def overlaps(self, sets: list[np.ndarray]) -> np.ndarray:
        """Sizes of the intersections of the node's sets with others, by products of 0/1 matrices over SLICE common tokens at a time."""
        row, other = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(self.tokens, other), len(self.tokens) - 1)
        hit = self.tokens[at] == other
        used, column = np.unique(at[hit], return_inverse=True)
        row = row[hit]
        mine = np.full(len(self.tokens), -1, np.int64)
        mine[used] = np.arange(len(used))
        mine = mine[self.at]
        total = np.zeros((self.n, len(sets)), np.float32)
        for lo in range(0, len(used), SLICE):
            width = min(SLICE, len(used) - lo)
            a, b = np.zeros((self.n, width), np.float32), np.zeros((len(sets), width), np.float32)
            x, y = (mine >= lo) & (mine < lo + width), (column >= lo) & (column < lo + width)
            a[self.row[x], mine[x] - lo] = 1
            b[row[y], column[y] - lo] = 1
            total += a @ b.T
        return np.rint(total).astype(np.int64)


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """All links: pairs (i, j) of sets_a and sets_b (of sets_a alone if there is no sets_b, i < j)."""
    return [pair for some in _linked(sets_a, sets_b) for pair in zip(*(x.tolist() for x in some), strict=True)]


def _linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """linked(), as arrays of a pair of nodes each, so that a family's links never stand in memory at once. A tree holds the sets of one band of sizes."""

    def bands(sets: list[np.ndarray]) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                out.setdefault(int(math.log(len(s)) / math.log(BAND)), []).append(i)
        # like with like: the smallest hashes of similar sets are mostly the same
        return {band: sorted(at, key=lambda i: sets[i][:4].tolist()) for band, at in out.items()}

    left = bands(sets_a)
    right = left if sets_b is None else bands(sets_b)
    for band, at in sorted(left.items()):
        for other in (band, band + 1) if sets_b is None else (band - 1, band, band + 1):
            if (there := right.get(other)) is not None:
                own = sets_b is None and other == band
                for x, y in _traverse([sets_a[i] for i in at], None if own else [(sets_a if sets_b is None else sets_b)[j] for j in there]):
                    x, y = np.array(at)[x], np.array(there)[y]
                    yield (x, y) if sets_b is not None else (np.minimum(x, y), np.maximum(x, y))


def _traverse(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, pruned: dict[int, list[int]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of the sets of two bands (or of one) as arrays: levels are walked from the top, both trees in step, down to pairs of small nodes; their leaf
    pairs that bitmaps and sizes do not rule out are compared exactly. pruned takes numbers of node pairs by level: met and ruled out."""
    own = sets_b is None
    right = sets_a if own else sets_b
    if not sets_a or not right:
        return
    bits = 2 * min(_bits(max(map(len, sets_a))), _bits(max(map(len, right))))
    a = Tree(sets_a, bits)
    b = a if own else Tree(right, bits)
    depth = max(len(a.levels), len(b.levels), DENSE + 1)
    for t in {id(a): a, id(b): b}.values():
        t.levels += [t.levels[-1]] * (depth - len(t.levels))
    size_a, size_b = (np.array([len(x) for x in s], np.int64) for s in (sets_a, right))
    held: tuple[int, _Node] | None = None

    def children(tree: Tree, level: int, node: np.ndarray) -> np.ndarray:
        """The nodes below each node of a level, -1 where there are fewer than FANOUT."""
        below = len(tree.levels[level - 1][1])
        if below == len(tree.levels[level][1]):
            return node[:, None]
        out = node[:, None] * FANOUT + np.arange(FANOUT)
        return np.where(out < below, out, -1)

    def step(level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the level below that lie under pairs (i, j) and may hold links."""
        x, y = children(a, level, i), children(b, level, j)
        x, y = (z.reshape(-1) for z in np.broadcast_arrays(x[:, :, None], y[:, None, :]))
        met = (x >= 0) & (y >= 0)
        if own:
            met &= (x <= y) if level > 1 else (x < y)
        x, y = x[met], y[met]
        ok = _possible(a, b, level - 1, x, y) if len(x) else np.zeros(0, bool)
        if pruned is not None:
            count = pruned.setdefault(level - 1, [0, 0])
            count[0] += len(ok)
            count[1] += len(ok) - int(ok.sum())
        return x[ok], y[ok]

    stack = [(depth - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if level > DENSE:
            x, y = step(level, i, j)
            # by nodes of the left tree, so that its rows are set up once
            stack += [(level - 1, x[lo : lo + 64], y[lo : lo + 64]) for lo in range(0, len(x), 64)][::-1]
            continue
        for node, other in zip(i.tolist(), j.tolist(), strict=True):
            x, y = np.array([node]), np.array([other])
            for below in range(DENSE, 0, -1):
                x, y = step(below, x, y)
            if not len(x):
                continue
            if len(x) <= FEW:
                both = np.array([_overlap(sets_a[p], right[q]) for p, q in zip(x.tolist(), y.tolist(), strict=True)])
            else:
                if held is None or held[0] != node:
                    held = node, _Node(sets_a[node * FANOUT**DENSE : (node + 1) * FANOUT**DENSE])
                wanted, back = np.unique(y, return_inverse=True)
                both = held[1].overlaps([right[q] for q in wanted])[x - node * FANOUT**DENSE, back]
            hit = 100 * both >= PERCENT * (size_a[x] + size_b[y] - both)
            if hit.any():
                yield x[hit], y[hit]


def _links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between classes, from members(g, n, f1, f2, copies, one); one is the row (doc_id, t) of docs(doc_id, t, text) that stands for a class.

    Rows of two kinds: (a, b, null, null, null), links of classes f1 that connect all that is linked, and (null, null, f1, f2, n_links), how many rows
    a class is linked with in a unit. Every pair of classes of a group belongs to one unit, if its sizes allow a link.
    """
    dealt = units(members, BLOCK).select(F.col("one.doc_id").alias("_doc_id"), F.col("one.t").alias("_t"), "g", "f1", "f2", "copies", "units")
    dealt = materialize(dealt, "op5-units")
    few = dealt.count() <= BROADCAST_ROWS
    mine = docs.join(F.broadcast(dealt) if few else dealt, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("t") == F.col("_t")))

    def sets(batch: pa.RecordBatch) -> dict:
        found = [shingles(t) for t in texts(batch)]
        # t is 64 bits of the text, the fingerprints are 128 of its set
        right = [(fingerprint(h, 1), fingerprint(h, 2)) == f for h, f in zip(found, zip(batch.column("f1").to_pylist(), batch.column("f2").to_pylist(), strict=True), strict=True)]
        return {k: batch.column(k) for k in ("g", "f1", "f2", "copies", "units")} | {"s": [h.tobytes() if r else None for h, r in zip(found, right, strict=True)]}

    content = arrow_map(mine.select("text", "g", "f1", "f2", "copies", "units"), sets, "g long, f1 long, f2 long, copies long, units array<struct<u:array<long>,side:int>>, s binary").where("s is not null")
    content = content.select("g", "f1", "f2", "copies", "s", F.explode("units").alias("_u")).select("g", "f1", "f2", "copies", "s", "_u.u", "_u.side")

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        u = pdf["u"].iat[0]
        own = len(u) == 1 or u[1:3].tolist() == u[3:5].tolist()
        pdf = pdf.drop_duplicates(["f1", "f2"])  # the row that stands for a class may be there several times
        edges, counted = [], []
        for _, part in pdf.groupby("g", sort=False):
            part = part.sort_values("side", kind="stable")
            sets = [np.frombuffer(x, np.uint64) for x in part["s"]]
            rows, shift = part[["f1", "f2", "copies"]].to_numpy(np.int64), 0 if own else int((part["side"] == 0).sum())
            forest, tree, counts = Groups(len(rows)), [], np.zeros(len(rows), np.int64)
            for x, y in _linked(sets) if own else _linked(sets[:shift], sets[shift:]):
                y = y + shift
                np.add.at(counts, x, rows[y, 2])
                np.add.at(counts, y, rows[x, 2])
                tree += [(p, q) for p, q in zip(x.tolist(), y.tolist(), strict=True) if forest.join(p, q)]
            some = np.flatnonzero(counts)
            edges.append(rows[np.array(tree, np.int64).reshape(-1, 2), 0])
            counted.append(np.column_stack([rows[some, :2], counts[some]]))
        edges, counted = np.concatenate(edges), np.concatenate(counted)
        names = ["a", "b", "f1", "f2", "n_links"]
        return pd.concat([pd.DataFrame(edges, columns=names[:2], dtype="Int64"), pd.DataFrame(counted, columns=names[2:], dtype="Int64")])[names]

    return content.groupBy("u").applyInPandas(f, "a long, b long, f1 long, f2 long, n_links long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows are those of docs(doc_id, text, ...) without the text, with n, f1, f2 (the class; n is 0 without words), copies (rows of
    the class) and n_links (other rows that the row is linked with); links(a, b) are f1 of linked classes, as many as connect all that is linked."""
    docs = docs.withColumn("t", F.xxhash64("text"))
    sketch = materialize(sketches(docs, word_counts(docs)), "op5-sketches")
    key = ["f1", "f2", "n"]
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("one")
    found = sketch.where("n > 0").groupBy(*key).agg(one, F.count("*").alias("copies"), F.max("bits").alias("bits"))
    found = materialize(found, "op5-classes")
    candidates = components(chains(sketch), name="op5-candidates")
    groups = candidates.select(F.col("node").alias("f1"), F.col("component").alias("g")).join(found, "f1").select("g", *key, "bits")
    members = materialize(refined(groups).join(found, "f1").select("g", *key, "copies", "one"), "op5-members")
    links = materialize(_links(members, docs.select("doc_id", "t", "text")), "op5-links")
    counts = links.where("f1 is not null").groupBy("f1", "f2").agg(F.sum("n_links").alias("others"))
    rows = sketch.drop("prefix", "bits", "t").join(found.select(*key, "copies"), key, "left").join(counts, ["f1", "f2"], "left")
    n_links = F.when(F.col("n") == 0, 0).otherwise(F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
    return rows.withColumn("n_links", n_links).drop("others"), links.where("a is not null").select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links for every row of docs: the smallest doc_id that links lead to, itself included, and with how many other rows it is linked.

    doc_id is an integer. n_links counts rows, copies of the same set among them; it is 0 without words.

    Nulls: a null text is empty; texts without words have an empty set and are linked with nothing. A null doc_id stands for nothing: such a
    row has the component that its links lead to, or none (null). Rows with equal doc_id are one node. An empty table gives an empty result;
    other columns are not read.
    """
    rows, links = classes(docs.select("doc_id", "text"))
    rows = materialize(rows, "op5-rows")
    # rows of one doc_id that differ in their sets are one node as well
    several = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("f1").alias("a"), F.max("f1").alias("b")).where("a <> b")
    same = rows.where("n > 0").join(several, "doc_id").select(F.col("f1").alias("b"), "a").where("a <> b")
    found = components(links.unionByName(same), name="op5-components")
    rows = rows.join(found, F.col("f1") == F.col("node"), "left").withColumn("component", F.coalesce("component", "f1"))
    least = rows.where("n > 0").groupBy("component").agg(F.min("doc_id").cast("long").alias("component_id"))
    rows = rows.join(least, "component", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id").cast("long"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near duplicates: of the rows that links connect, the one with the smallest doc_id stays (null last, then by hashes of the whole row).

    Of rows that are equal in all columns one stays. Rows of one doc_id with different texts are rows of their own; texts without words, null ones among them, all
    stay. Columns may have any names. An empty table gives an empty result.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*columns).alias("row"), F.col("doc_id"), F.col("text"), F.xxhash64(*columns).alias("r1"), F.xxhash64(F.lit(WORDS), *columns).alias("r2"))
    rows, links = classes(named.select("doc_id", "text", "r1", "r2"))
    rows = materialize(rows.where("n > 0").select("doc_id", "r1", "r2", "f1"), "op5-rows")
    found = components(links, name="op5-components")
    rows = rows.join(found, F.col("f1") == F.col("node"), "left").withColumn("component", F.coalesce("component", "f1"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "r1", "r2")).alias("m"))
    rows = rows.join(first, "component")
    # each row that does not stay, and each that stays but is there several times
    kept = (F.col("r1") == F.col("m.r1")) & (F.col("r2") == F.col("m.r2"))
    marked = rows.groupBy(F.col("r1").alias("m1"), F.col("r2").alias("m2")).agg(F.max(kept).alias("kept"), F.count("*").alias("times")).where("not kept or times > 1")
    marked = materialize(marked, "op5-marked")
    few = marked.count() <= BROADCAST_ROWS
    out = named.join(F.broadcast(marked) if few else marked, (F.col("r1") == F.col("m1")) & (F.col("r2") == F.col("m2")), "left")
    stay = out.where("kept is null").select("row")
    if not marked.where("kept").isEmpty():
        stay = stay.unionByName(out.where("kept").dropDuplicates(["r1", "r2"]).select("row"))
    return stay.select("row.*")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_shingles, component_id."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
