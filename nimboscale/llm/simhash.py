"""SimHash near-dedup over a Gray-order hierarchical index.

1. Tasks hash the word shingles of whole texts to 64-bit fingerprints (numpy).
2. Equal fingerprints form one class; copies are never compared again.
3. Two fingerprints within ``radius`` bits agree in at least one of radius + 1
   bands. Each class enters the index once a band, rotated so that the band
   comes first: the band's value is the masked pattern of a top node, and only
   members of one top node can meet there.
4. Inside a top node, members stand in Gray rank order, in which neighbours
   share most bits. Every FANOUT neighbours are factored into a node that keeps
   the bits all of them share, and so on upwards. Pairs of nodes are followed
   downwards; the differences in their shared bits bound all pairs below, so a
   pair of groups beyond the radius is pruned whole. Where even the bits that
   vary cannot lead beyond the radius, the groups are joined whole.
5. A top node with more than ``most`` members (a large group of near copies) is
   first split by Spark: by the next eight bits into child nodes, and pairs of
   child nodes whose accumulated differences stay within the radius become
   tasks of their own, again split until they are small.
6. Tasks return a spanning forest of the links they find, never all pairs;
   components come from star contractions over the edge table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from nimboscale.operators.graph import connected_components
from nimboscale.session import discard, gathered, stored

WIDTH = 3
RADIUS = 3
MOST = 20_000
#: Members of a top node, as expected of random fingerprints, up to which short keys do.
NODE = 2000
#: Of the search for similar texts: words of a shingle, bits of candidates, likeness of links, members and shingles of a task.
SIMILAR_WIDTH, REACH, SIMILARITY, BLOCK_ROWS, BLOCK_HASHES = 5, 9, 0.8, 4000, 6_000_000
#: Likeness that the parities of two candidates must allow before they make a group.
LOOSE = 0.5
#: Of the prefix join: one text in SAMPLED names the common shingles, at most COMMON of them; members of a shingle in a task; shingles and distinct words held at once.
SAMPLED, COMMON, SHARE_ROWS, PIECE, KNOWN_WORDS = 16, 200_000, 1000, 1 << 19, 1 << 19
FANOUT = 16
CHUNK = 1 << 18


def majority(hashes: np.ndarray) -> np.int64:
    """SimHash: each bit that over half of the hashes (uint64) have; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0]


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Signed 64-bit SimHash of the shingles, repeats included, of the lower-cased (A-Z) words; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return 0
    if n < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return int(majority(np.fromiter((digest(s, 42) for s in shingles), np.uint64)))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(_id, _fp) of each row."""
    pairs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["_id", "_fp"])

    kind = pairs.schema["_id"].dataType.simpleString()
    return pairs.mapInArrow(run, f"_id {kind}, _fp long")


class WordHashes(dict):
    """XXH64 of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value


def lowered_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_set(words: list[bytes], known: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the shingles of ``width`` words; shorter texts have one, the whole sequence, or none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    m = max(1, n - width + 1)
    h = np.zeros(m, np.uint64)
    for j in range(min(width, n)):
        # Rotations between odd factors: the order of the words counts.
        h = (((h << np.uint64(23)) | (h >> np.uint64(41))) + own[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


# ---- the index inside a task ------------------------------------------------


class Forest:
    """Union of members 0..n-1; arrays of links are absorbed at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; level 0 holds the fingerprints themselves."""

    def __init__(self, fps: np.ndarray, depth: int):
        self.every = [fps]  # AND of the members below
        self.some = [fps]  # OR of them: a bit is shared where both agree
        for _ in range(depth):
            at = np.arange(0, len(self.every[-1]), FANOUT)
            self.every.append(np.bitwise_and.reduceat(self.every[-1], at))
            self.some.append(np.bitwise_or.reduceat(self.some[-1], at))

    def below(self, level: int, nodes: np.ndarray, to: int) -> tuple[np.ndarray, np.ndarray]:
        """First node of level ``to`` under each of ``nodes``, and how many there are."""
        span = FANOUT ** (level - to)
        first = nodes * span
        return first, np.minimum(first + span, len(self.every[to])) - first


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ..., count[0] of them, then those of first[1], ..."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def depth_for(n: int) -> int:
    depth = 0
    while n > FANOUT:
        n, depth = -(-n // FANOUT), depth + 1
    return depth


def search(a: GrayIndex, b: GrayIndex, shift: int, radius: int, forest: Forest) -> None:
    """Link members of a (0, 1, ...) and b (shift, shift + 1, ...) within ``radius``; b may be a, with shift 0.

    Both have the same depth. Pairs of nodes are followed depth first in chunks,
    so memory stays bounded.
    """
    top = len(a.every) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.every[top])), np.arange(len(b.every[top])), indexing="ij"))
    stack = [(top, i, j)]
    while stack:
        level, i, j = stack.pop()
        if a is b:
            i, j = i[i <= j], j[i <= j]
        if len(i) > CHUNK:
            half = len(i) // 2
            stack += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
            continue
        vary = (a.every[level][i] ^ a.some[level][i]) | (b.every[level][j] ^ b.some[level][j])
        differ = np.bitwise_count((a.every[level][i] ^ b.every[level][j]) & ~vary)
        near = differ <= radius
        whole = near & (differ + np.bitwise_count(vary) <= radius)
        if whole.any():  # any two members below are within the radius
            ends = []
            for index, nodes, off in ((a, i[whole], 0), (b, j[whole], shift)):
                first, count = index.below(level, nodes, 0)
                forest.link(np.repeat(first, count) + off, _runs(first, count) + off)
                ends.append(first + off)
            forest.link(*ends)
        i, j = i[near & ~whole], j[near & ~whole]
        if len(i) and level:
            # All pairs of the children: a's each repeated for each of b's.
            fa, na = a.below(level, i, level - 1)
            fb, nb = b.below(level, j, level - 1)
            left = _runs(fa, na)
            wide = np.repeat(nb, na)
            stack.append((level - 1, np.repeat(left, wide), _runs(np.repeat(fb, na), wide)))


def _unit_links(fps: np.ndarray, reps: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links, as ids, of one unit in Gray order; side 0: both, 1 and 2: the two child nodes."""
    forest = Forest(len(fps))
    if side[0] == 0:
        index = GrayIndex(fps, depth_for(len(fps)))
        search(index, index, 0, radius, forest)
    else:
        cut = int(np.searchsorted(side, 2))
        if cut in (0, len(side)):
            return reps[:0], reps[:0]
        depth = depth_for(max(cut, len(side) - cut))
        search(GrayIndex(fps[:cut], depth), GrayIndex(fps[cut:], depth), cut, radius, forest)
    moved = forest.root != np.arange(len(fps))
    return reps[moved], reps[forest.root[moved]]


def _links(radius: int):
    """Task function: rows sorted by (_band, _depth, _a, _b, _side, _rank) to links (src, dst)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: list[np.ndarray]):
            keys, side, fps, reps = rows[:4], rows[4], rows[5].view(np.uint64), rows[6]
            new = np.zeros(len(reps), bool)
            new[:1] = True
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(reps))
            # A unit that is one leaf of the index has nothing above it to prune: all such units at once.
            size = end - start
            leaf = (size > 1) & (size <= FANOUT) & (side[start] == 0)
            own = _runs(start[leaf], size[leaf])
            left = np.repeat(end[leaf], size[leaf]) - own - 1
            one, two = np.repeat(own, left), _runs(own + 1, left)
            near = np.bitwise_count(fps[one] ^ fps[two]) <= radius
            forest = Forest(len(reps))
            forest.link(one[near], two[near])
            moved = forest.root != np.arange(len(reps))
            found = [_unit_links(fps[s:e], reps[s:e], side[s:e], radius) for s, e in zip(start[~leaf], end[~leaf]) if e - s > 1]
            src = np.concatenate([reps[moved], *(f[0] for f in found)])
            dst = np.concatenate([reps[forest.root[moved]], *(f[1] for f in found)])
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = [np.concatenate(x) for x in zip(held, rows)] if held else rows
            # The last unit may go on in the next batch.
            same = np.ones(len(rows[0]), bool)
            for k in rows[:4]:
                same &= k == k[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = [x[cut:] for x in rows]
            if cut:
                yield flush([x[:cut] for x in rows])
        if held:
            yield flush(held)

    return run


# ---- the index over the cluster ---------------------------------------------


def _gray_rank(bits: Column) -> Column:
    """Position in the Gray sequence; shifted by 2**63 so that signed order is the unsigned one."""
    for step in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, step))
    return bits.bitwiseXOR(F.lit(-(1 << 63)))


def _split_units(units: DataFrame, most: int, radius: int) -> DataFrame:
    """Replace units of more than ``most`` rows by pairs of child nodes, eight bits further down."""
    key = ["_band", "_depth", "_a", "_b"]
    done: DataFrame | None = None
    while True:
        counts = units.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > most) & (F.col("_depth") <= 56))
        large = stored(counts.drop("_n"), "hot-nodes")
        if large.isEmpty():
            return units if done is None else done.unionByName(units)
        small = units.join(large, key, "left_anti")
        done = small if done is None else done.unionByName(small)
        masks = F.array(*[F.lit(m).cast("long") for m in range(256) if bin(m).count("1") <= radius])
        far = F.bit_count(F.col("_a").bitwiseXOR(F.col("_b")))
        fit = F.filter(masks, lambda m: F.bit_count(m) + far <= radius)
        child = F.expr("shiftrightunsigned(_rotated, 64 - (_depth + 8))")
        other = F.when(F.col("_side") == 2, F.col("_a")).otherwise(F.col("_b"))
        spread = (
            units.join(large, key)
            .withColumn("_mask", F.explode(fit))
            .withColumn("_own", child)
            .withColumn("_other", F.shiftleft(other, 8).bitwiseXOR(F.col("_own").bitwiseAND(F.lit(255))).bitwiseXOR(F.col("_mask")))
        )
        first = F.when(F.col("_side") == 0, F.col("_own") <= F.col("_other")).otherwise(F.col("_side") == 1)
        units = stored(
            spread.select(
                "_band",
                (F.col("_depth") + 8).alias("_depth"),
                F.when(first, F.col("_own")).otherwise(F.col("_other")).alias("_a"),
                F.when(first, F.col("_other")).otherwise(F.col("_own")).alias("_b"),
                F.when((F.col("_side") == 0) & (F.col("_own") == F.col("_other")), 0).when(first, 1).otherwise(2).alias("_side"),
                "_rotated",
                "_rank",
                "_fp",
                "_rep",
            ),
            "hot-units",
        )


def _indexed(entries: DataFrame, width: int, radius: int, most: int) -> DataFrame:
    """Links from index entries (_band, _rotated, _fp, _rep), whose first ``width`` rotated bits name the top node."""
    top = F.shiftrightunsigned("_rotated", 64 - width)
    units = entries.select(
        "_band", F.lit(width).alias("_depth"), top.alias("_a"), top.alias("_b"), F.lit(0).alias("_side"), "_rotated", _gray_rank(F.col("_rotated")).alias("_rank"), "_fp", "_rep"
    )
    units = _split_units(units, most, radius)
    key = ["_band", "_depth", "_a", "_b"]
    kind = entries.schema["_rep"].dataType.simpleString()
    return (
        units.repartition(*key)
        .sortWithinPartitions(*key, "_side", "_rank")
        .select(*key, "_side", "_fp", "_rep")
        .mapInArrow(_links(radius), f"src {kind}, dst {kind}")
    )


def key_bands(n: int, plans: tuple[tuple[int, int], ...], most: int = NODE) -> tuple[int, int]:
    """The first (bands, bands of a key) of ``plans`` whose top nodes hold at most ``most`` of ``n`` random fingerprints; else the last."""
    return next(((b, k) for b, k in plans if n <= most << (64 * k // b)), plans[-1])


def band_links(classes: DataFrame, radius: int, bands: int, kept: int, most: int = MOST) -> DataFrame:
    """Links (src, dst) between ``_rep`` of classes (_fp, _rep) within ``radius`` bits that agree in ``kept`` of ``bands`` bands.

    A class enters the index once for each choice of ``kept`` bands, with those
    bits first. Up to bands - kept differing bits leave such a choice alike, so
    nothing within that many bits is missed.
    """
    cuts = [64 * i // bands for i in range(bands + 1)]
    tables = list(combinations(range(bands), kept))
    width = min(cuts[b + 1] - cuts[b] for b in range(bands)) * kept

    # Where the bits of a table come from and go to, by place: looked up, since an expression for every table makes code that takes the driver long to compile.
    moves = []
    for chosen in tables:
        moves.append([])
        left = 64
        for b in [*chosen, *(b for b in range(bands) if b not in chosen)]:
            size = cuts[b + 1] - cuts[b]
            left -= size
            moves[-1].append((cuts[b], (1 << size) - 1 if size < 64 else -1, left))

    def moved(place: int) -> Column:
        off, mask, to = (F.lit([table[place][k] for table in moves]).cast(kind)[F.col("_band")] for k, kind in enumerate(("array<int>", "array<bigint>", "array<int>")))
        return F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.col("_fp"), off).bitwiseAND(mask), to)

    turned = reduce(Column.bitwiseOR, map(moved, range(bands)))
    entries = classes.select("_fp", "_rep", F.explode(F.sequence(F.lit(0), F.lit(len(tables) - 1))).alias("_band")).withColumn("_rotated", turned)
    return _indexed(entries, width, radius, most)


def near_links(classes: DataFrame, radius: int = RADIUS, most: int = MOST, n: int | None = None) -> DataFrame:
    """Links (src, dst) between ``_rep`` of classes (_fp, _rep) that connect whatever lies within ``radius`` bits.

    With ``n``, the number of classes, keys grow with it: one of radius + 1
    bands, two of radius + 2, three of radius + 3. Nodes stay small, so few are
    ever split, and what is found is the same.
    """
    plans = tuple((radius + k, k) for k in (1, 2, 3))
    return band_links(classes, radius, *key_bands(n or 0, plans), most)


def wide_links(classes: DataFrame, radius: int = REACH, most: int = MOST, n: int | None = None) -> DataFrame:
    """Links within ``radius`` bits between classes that agree in two of eight bands (28 keys of 16 bits); of five, where there are too many (ten of 24).

    Up to six (three) differing bits always leave two bands alike; beyond that a
    pair may be missed, and is left to the prefix join.
    """
    return band_links(classes, radius, *key_bands(n or 0, ((8, 2), (5, 2))), most)


# ---- exact check of candidate groups ----------------------------------------


def _similar_forest(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Root of each set under links of Jaccard likeness ``least`` or more, exactly; two empty sets are alike.

    Postings of every hash give the overlaps of one set with all others at
    once. A set is compared only with those not reached yet.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), size)
    _, word = np.unique(np.concatenate(sets) if size.sum() else np.zeros(0, np.int64), return_inverse=True)
    order = np.argsort(word, kind="stable")
    posting = owner[order]
    count = np.bincount(word)
    first = np.cumsum(count) - count
    start = np.cumsum(size) - size
    root, left = np.arange(n), np.ones(n, bool)
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        todo = [seed]
        while todo and left.any():
            p = todo.pop()
            own = word[start[p] : start[p] + size[p]]
            shared = np.bincount(posting[_runs(first[own], count[own])], minlength=n) if len(own) else np.zeros(n, np.int64)
            union = size + size[p] - shared
            alike = left & (shared + 1e-9 >= least * union)
            found = np.flatnonzero(alike)
            root[found], left[found] = seed, False
            todo += found.tolist()
    return root


def verified_links(members: DataFrame, least: float = SIMILARITY, block: int = BLOCK_ROWS, hashes: int = BLOCK_HASHES) -> DataFrame:
    """Links (src, dst) between members (_group, _rep, _set) of a group whose sets are alike by ``least``: a spanning forest.

    A group of up to ``block`` members with ``hashes`` shingles is one task. A
    larger one is cut into blocks of about half as many, and every pair of its
    blocks is a task, so that tasks stay small and every pair meets in some task.
    """
    sizes = members.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.size("_set")).alias("_h")).where("_n > 1")
    share = F.greatest(F.col("_n") / block, F.col("_h") / hashes)
    parts = F.when(share <= 1, 1).otherwise(F.ceil(2 * share)).cast("int")
    own = F.pmod(F.xxhash64("_rep"), F.col("_parts")).cast("int")
    dealt = members.join(sizes.withColumn("_parts", parts), "_group").withColumn("_own", own)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = dealt.select("_group", F.least("_own", "_other").alias("_one"), F.greatest("_own", "_other").alias("_two"), "_rep", "_set")
    kind = members.schema["_rep"].dataType.simpleString()

    def check(table: pa.Table) -> pa.Table:
        reps = table.column("_rep").to_numpy()
        order = np.argsort(reps, kind="stable")
        listed = table.column("_set").combine_chunks()
        sets = [listed[int(i)].values.to_numpy(zero_copy_only=False) for i in order]
        reps = reps[order]
        root = _similar_forest(sets, least)
        moved = root != np.arange(len(reps))
        return pa.table({"src": reps[moved], "dst": reps[root[moved]]})

    return dealt.groupBy("_group", "_one", "_two").applyInArrow(check, f"src {kind}, dst {kind}")


def _common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles (uint64) that more than two of a sample of the texts hold, the most frequent if there are too many.

    Only speed depends on them: the prefix join is exact under any order of the
    shingles that is the same for all sets.
    """
    some = docs.where(F.pmod(F.xxhash64("_raw"), F.lit(SAMPLED)) == 0).select("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(lowered_words(text.as_py()), known, width).view(np.int64))], ["_h"])

    counts = some.mapInArrow(run, "_h long").groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 2")
    top = counts.orderBy(F.desc("_n"), "_h").limit(COMMON).select("_h").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def _described(sets: list[np.ndarray], common: np.ndarray, least: float) -> list[pa.Array]:
    """Of some sorted sets: sizes, prefixes and parities.

    The prefix holds the first shingles of the set, common ones last, of which
    two alike sets share one or more. The parity is that of the shingles in each
    of 512 cells, doubled up to the size of the set, a bit each in whole numbers:
    two sets differ in at least as many shingles as these differ in bits.
    """
    n = np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(n)])
    value = np.concatenate(sets)
    doc = np.repeat(np.arange(len(n)), n)
    seat = np.minimum(np.searchsorted(common, value), max(len(common) - 1, 0))
    late = common[seat] == value if len(common) else np.zeros(len(value), bool)
    in_order = value[np.argsort(2 * doc + late, kind="stable")]
    keep = np.where(n > 0, n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, 0)
    first = in_order[np.arange(len(value)) - at[doc] < keep[doc]]
    cells = 512 << np.ceil(np.log2(np.maximum(n, 512) / 512)).astype(np.int64)
    seats = np.concatenate([[0], np.cumsum(cells)])
    odd = (np.bincount(seats[doc] + (value & (cells - 1).astype(np.uint64)[doc]).astype(np.int64), minlength=seats[-1]) & 1).astype(np.uint8)
    odd = np.packbits(odd).view(np.int64)
    ends = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
    return [
        pa.array(n, pa.int64()),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(first.view(np.int64))),
        pa.ListArray.from_arrays(pa.array((seats // 64).astype(np.int32)), pa.array(odd)),
    ]


def _portions(batches: Iterator[pa.RecordBatch], text: int, width: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], list[np.ndarray]]]:
    """Slices of the batches of about PIECE shingles, one row at least, with each row's words and shingle set."""
    known = WordHashes()
    for batch in batches:
        first, words, sets, held = 0, [], [], 0
        for i, value in enumerate(batch.column(text)):
            words.append(lowered_words(value.as_py()))
            sets.append(shingle_set(words[-1], known, width))
            held += len(words[-1])
            if held >= PIECE or i == batch.num_rows - 1:
                yield batch.slice(first, i + 1 - first), words, sets
                first, words, sets, held = i + 1, [], [], 0


def _worded(docs: DataFrame, common: np.ndarray, width: int, least: float) -> DataFrame:
    """(_id, _raw, _digest, _fp, _n, _prefix, _odd) of rows (_id, _raw, _text): digest of the words, fingerprint of the distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, sets in _portions(batches, 2, width):
            digests = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in words]
            fps = np.array([majority(x) for x in sets], np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(fps), *_described(sets, common, least)]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_raw", "_digest", "_fp", "_n", "_prefix", "_odd"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_id {kind}, _raw binary, _digest binary, _fp long, _n long, _prefix array<long>, _odd array<long>")


def _bits_apart(a: Column, b: Column) -> Column:
    """Differing bits of two parities; one of twice as many cells is folded first. Alike sets never differ by more."""
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), F.shiftright(F.size(x), 1)), F.slice(x, F.shiftright(F.size(x), 1) + 1, F.shiftright(F.size(x), 1)), lambda p, q: p.bitwiseXOR(q))
    a, b = F.when(F.size(a) > F.size(b), half(a)).otherwise(a), F.when(F.size(b) > F.size(a), half(b)).otherwise(b)
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, y: x + y)


def _may_be_alike(n_a: Column, n_b: Column, apart: Column, least: float) -> Column:
    """Whether sets of these sizes, whose parities are so many bits apart, can be alike: never false for alike ones."""
    needed = F.ceil((n_a + n_b) * (least / (1 + least)) - 1e-6)
    return (F.least(n_a, n_b) >= F.greatest(n_a, n_b) * least - 1e-6) & (apart <= n_a + n_b - 2 * needed)


def _thinned(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (_a, _b, _n_a, _n_b) of distinct pairs (_a, _b) of classes that sizes and parities leave."""
    brief = lambda tag: classes.select(*[F.col(c).alias(f"{c}{tag}") for c in ("_class", "_n", "_odd")])
    pairs = pairs.join(brief("_a"), F.col("_a") == F.col("_class_a")).join(brief("_b"), F.col("_b") == F.col("_class_b"))
    return pairs.where(_may_be_alike(F.col("_n_a"), F.col("_n_b"), _bits_apart(F.col("_odd_a"), F.col("_odd_b")), least)).select("_a", "_b", "_n_a", "_n_b")


def prefix_pairs(classes: DataFrame, groups: DataFrame, least: float = SIMILARITY, share: int = SHARE_ROWS) -> DataFrame:
    """Pairs (_a, _b, _n_a, _n_b) of classes (_class, _n, _prefix, _odd) in different ``groups`` (_class, _group; others are alone) that may be alike: no pair alike by ``least`` is missing.

    Two such sets share a shingle among the first n - ceil(least * n) + 1 of
    each, in any common order. Pairs that meet there within the length, position
    and parity bounds are kept, all without loss. The largest group of a shingle
    is not compared with itself: what stands outside it meets all, so a shingle
    of one large group of near copies costs no more than its strays. More than
    ``share`` strays of a shingle are dealt into parts, each a key of its own.
    """
    rows = classes.join(gathered(groups), "_class", "left").withColumn("_group", F.coalesce("_group", "_class"))
    every_fourth = lambda k: F.filter("_odd", lambda x, i: i % 4 == k)
    folded = [F.aggregate(every_fourth(k), F.lit(0).cast("bigint"), lambda x, y: x.bitwiseXOR(y)).alias(f"_odd{k}") for k in range(4)]
    # Most shingles stand in one group only: the rest of a row comes to those that are left.
    shared = rows.select("_group", F.explode("_prefix").alias("_h")).groupBy("_h").agg(F.min("_group").alias("_low"), F.max("_group").alias("_high"))
    shared = stored(shared.where("_low <> _high").select("_h"), "shared-shingles", release=True)
    brief = rows.select("_class", "_group", F.col("_n").cast("int").alias("_n"), *folded)
    met = rows.select("_class", F.posexplode("_prefix").alias("_at", "_h")).join(gathered(shared), "_h").join(brief, "_class")
    met = stored(met, "shared-rows", release=True)
    discard(shared)
    counts = met.groupBy("_h", "_group").agg(F.count(F.lit(1)).alias("_k"))
    held = counts.groupBy("_h").agg(F.sum("_k").alias("_df"), F.max(F.struct("_k", "_group")).alias("_big"))
    held = stored(held.select("_h", F.col("_big._group").alias("_big"), F.ceil((F.col("_df") - F.col("_big._k")) / share).cast("int").alias("_parts")), "shingle-groups", release=True)
    dealt = stored(met.join(gathered(held), "_h"), "prefix-rows", release=True)
    discard(met, held)
    a = dealt.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).alias("a")
    b = dealt.where("_group <> _big").withColumn("_part", F.pmod(F.xxhash64("_class"), F.col("_parts")).cast("int")).alias("b")
    both = F.col("a._n") + F.col("b._n")
    need = F.ceil(both * (least / (1 + least)) - 1e-6)
    can = F.least("a._at", "b._at") + F.least(F.col("a._n") - F.col("a._at"), F.col("b._n") - F.col("b._at"))
    apart = sum((F.bit_count(F.col(f"a._odd{k}").bitwiseXOR(F.col(f"b._odd{k}"))) for k in range(4)), F.lit(0))
    meet = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("_h", "_part")]
    # Two strays meet twice.
    once = (F.col("a._group") == F.col("a._big")) | (F.col("a._class") < F.col("b._class"))
    pairs = a.join(b, [*meet, F.col("a._group") != F.col("b._group"), once, can >= need, _may_be_alike(F.col("a._n"), F.col("b._n"), apart, least)])
    pairs = pairs.select(F.least("a._class", "b._class").alias("_a"), F.greatest("a._class", "b._class").alias("_b")).distinct()
    pairs = stored(_thinned(pairs, classes, least), "prefix-pairs", release=True)
    discard(dealt)
    return pairs


def _picked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs (_id, _raw, ...) joined with ``wanted`` (_own, _of, _times, ...) by id and digest, one for each."""
    hit = docs.join(gathered(wanted), (F.col("_id") == F.col("_own")) & (F.col("_raw") == F.col("_of")))
    if wanted.where("_times > 1").isEmpty():
        return hit
    return hit.where("_times = 1").unionByName(hit.where("_times > 1").dropDuplicates(["_own", "_of"]))


def _raw_digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def _similar(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, reach: int, most: int) -> DataFrame:
    """(_own, _of, _times, _component) of each distinct id and text (by ``_raw_digest``) of rows with an id: how often it occurs, the least of its group."""
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), _raw_digest(text_col).alias("_raw"), F.col(text_col).cast("string").alias("_text"))
    made = stored(_worded(docs, _common_shingles(docs, width), width, similarity), "similar-rows")
    same = [F.first(c).alias(c) for c in ("_fp", "_n", "_prefix", "_odd")]
    classes = made.groupBy("_digest").agg(F.min(F.struct("_id", "_raw")).alias("_least"), *same)
    classes = stored(classes.withColumn("_class", F.monotonically_increasing_id()), "similar-classes", release=True)
    rows = made.groupBy(F.col("_id").alias("_own"), F.col("_raw").alias("_of")).agg(F.first("_digest").alias("_digest"), F.count(F.lit(1)).alias("_times"))
    rows = stored(rows.join(classes.select("_digest", "_class"), "_digest").drop("_digest"), "similar-ids", release=True)
    discard(made)
    # Candidates by fingerprint: links of the index, and equal fingerprints. Only those that their parities show to have much in
    # common make groups: fingerprints that are near by chance do not chain texts together.
    prints = stored(classes.groupBy("_fp").agg(F.min("_class").alias("_rep")), "similar-prints", release=True)
    close = wide_links(prints, reach, most, prints.count()).select(F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b"))
    equal = classes.join(prints, "_fp").where("_class > _rep").select(F.col("_rep").alias("_a"), F.col("_class").alias("_b"))
    close = _thinned(close.unionByName(equal).distinct(), classes, min(LOOSE, similarity))
    groups = stored(connected_components(close, "_a", "_b").select(F.col("node").alias("_class"), F.col("component").alias("_group")), "similar-groups", release=True)
    # Candidates that fingerprints miss.
    pairs = prefix_pairs(classes, groups, similarity)
    # Exact likeness of both kinds.
    wanted = groups.select("_class").unionByName(pairs.select(F.col("_a").alias("_class"))).unionByName(pairs.select(F.col("_b").alias("_class")))
    heads = classes.select("_class", F.col("_least._id").alias("_own"), F.col("_least._raw").alias("_of")).join(wanted.distinct(), "_class")
    heads = heads.join(rows.drop("_class"), ["_own", "_of"]).join(groups, "_class", "left")
    heads = stored(heads.withColumn("_group", F.coalesce("_group", "_class")), "similar-heads", release=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, sets in _portions(batches, 2, width):
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed], ["_rep", "_group", "_set"])

    sets = stored(_picked(docs, heads).select("_class", "_group", "_text").mapInArrow(run, "_rep long, _group long, _set array<long>"), "similar-sets", release=True)
    links = verified_links(sets, similarity)
    full = lambda tag: sets.select(F.col("_rep").alias(f"_rep{tag}"), F.col("_set").alias(f"_set{tag}"))
    checked = pairs.join(full("_a"), F.col("_a") == F.col("_rep_a")).join(full("_b"), F.col("_b") == F.col("_rep_b"))
    shared = F.size(F.array_intersect("_set_a", "_set_b"))
    alike = shared + 1e-9 >= similarity * (F.col("_n_a") + F.col("_n_b") - shared)
    links = links.unionByName(checked.where(alike).select(F.col("_a").alias("src"), F.col("_b").alias("dst")))
    found = connected_components(links).withColumnRenamed("node", "_class")
    discard(sets, pairs, heads, groups, prints)
    labels = rows.join(found, "_class", "left").withColumn("component", F.coalesce("component", "_class"))
    # Stored apart, so that the join can split a component of very many rows.
    least = stored(labels.groupBy("component").agg(F.min(F.struct("_own", "_of")).alias("_component")), "similar-least", release=True)
    out = stored(labels.join(gathered(least), "component").select("_own", "_of", "_times", "_component"), "similar", release=True)
    discard(rows, classes)
    return out


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SIMILAR_WIDTH, similarity: float = SIMILARITY, reach: int = REACH, most: int = MOST
) -> DataFrame:
    """(id, component_id): groups of texts whose sets of ``width``-word shingles have a Jaccard likeness of ``similarity`` or more.

    SimHash fingerprints of the distinct shingles find most candidates cheaply:
    the Gray-order index links those within ``reach`` bits. Links whose sizes and
    parities rule a likeness of LOOSE out go, so that fingerprints near by
    chance chain no texts together; the rest make groups. An exact prefix
    join finds the pairs of different groups that may be alike. Inside groups and
    for those pairs likeness is computed exactly, over the distinct shingles of
    whole texts. Only texts of the same lower-cased words skip the comparison.

    Edge cases: texts without words are alike. Rows with a null id have no
    group. Rows of one id may differ in text: each belongs to its own text's
    group. Repeated rows get the same group. An empty table gives an empty table.
    """
    found = _similar(docs, id_col, text_col, width, similarity, reach, most)
    own = docs.select(F.col(id_col).alias("_id"), _raw_digest(text_col).alias("_raw"))
    return own.join(found, (F.col("_id") == F.col("_own")) & (F.col("_raw") == F.col("_of")), "left").select(F.col("_id").alias(id_col), F.col("_component._own").alias("component_id"))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, most: int = MOST
) -> DataFrame:
    """(id, fingerprint, component_id) of every row; ids are integers.

    Fingerprints within ``radius`` bits are linked; component_id is the smallest
    id reachable, the row's own included.

    Edge cases: texts without words (null, empty, blank) have fingerprint zero
    and are linked like any other. Rows with a null id get a fingerprint, link
    nothing, and take the component of their own fingerprint if a row with an id
    has it, else null. Repeated rows are one class. An empty table gives an
    empty table.
    """
    if not 0 <= radius <= 7:
        raise ValueError("radius must be 0 to 7: more bands of fewer bits would not prune")
    made = stored(fingerprints(docs, id_col, text_col, width), "simhash")
    classes = stored(made.where("_id IS NOT NULL").groupBy("_fp").agg(F.min("_id").alias("_rep")), "simhash-classes")
    components = connected_components(near_links(classes, radius, most, classes.count()))
    labels = (
        classes.join(components, F.col("_rep") == F.col("node"), "left")
        .select(F.col("_fp").alias("_class"), F.coalesce("component", "_rep").alias("component_id"))
    )
    return made.join(labels, F.col("_fp") == F.col("_class"), "left").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SIMILAR_WIDTH, similarity: float = SIMILARITY, reach: int = REACH, most: int = MOST
) -> DataFrame:
    """The rows of ``docs`` less all but one of each group in ``similar_groups``: that of the smallest id stays, and of its texts that of the smallest digest.

    Edge cases: rows with a null id all stay. Of repeated rows of id and text
    one stays. An id with several unlike texts stays once for each of them.
    Columns are unchanged. An empty table gives an empty table.
    """
    found = _similar(docs, id_col, text_col, width, similarity, reach, most)
    first = (F.col("_component._own") == F.col("_own")) & (F.col("_component._of") == F.col("_of"))
    # Most rows stay; only what goes, or stays once, is named.
    fate = stored(found.select("_own", "_of", first.alias("_nb_stays"), "_times").where("_times > 1 OR NOT _nb_stays"), "near-copies", release=True)
    discard(found)
    fate = fate.select(F.col("_own").alias("_nb_own"), F.col("_of").alias("_nb_of"), "_nb_stays")
    marked = docs.withColumn("_nb_raw", _raw_digest(text_col))
    marked = marked.join(gathered(fate), (F.col(id_col) == F.col("_nb_own")) & (F.col("_nb_raw") == F.col("_nb_of")), "left")
    once = marked.where("_nb_stays IS NULL")
    if not fate.where("_nb_stays").isEmpty():
        once = once.unionByName(marked.where("_nb_stays").dropDuplicates(["_nb_own", "_nb_of"]))
    return once.select(*docs.columns)


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from nimboscale.session import table

    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
