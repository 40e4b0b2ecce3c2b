"""Suffix-array dedup: drop long passages that an earlier document holds, by run-length indexes.

Plan. Every string of ``length`` bytes has an anchor, the least hash among its
``ANCHOR``-byte parts, so equal strings have equal anchors, and neighbouring
strings mostly share theirs. Texts are packed into batches; each batch gives its
anchors once, and a sort by anchor tells which occur in more than one text, and
where first. That first place, in blocks, is the key by which stretches of text
are brought together: copies of a passage keep whole stretches, and a string is
always beside all its equals. For each group of keys a task builds a run-length
Burrows-Wheeler transform with sampled run ends of the distinct stretches and
streams those of later documents through it, whose matching statistics mark
every string that a document of smaller id holds. Equal stretches are reduced to the
least id before anything is gathered, and keys with more text than a task
should hold are split further, by longer anchors and at last by string. Nothing grows
with the number of documents that share a passage but the rows that say so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from nimboscale.llm.text import without
from nimboscale.session import gathered, stored, table

#: Bytes of text a batch; a longer text is alone.
BATCH_BYTES = 4_000_000
#: Places of so many bits of bytes count as one when stretches are brought together: copies keep whole stretches of them, edited only here and there.
BLOCK_BITS = 9
#: Bits of a block's number in a batch; what lies beyond, in a longer text, counts as its last block.
PLACE_BITS = 13
#: Distinct bytes of one key that go to one task; keys with more are split by anchor, then by string.
HOT_BYTES = 2_000_000
#: Distinct bytes that a task indexes together.
GROUP_BYTES = 1_000_000
#: Strings that one lane streams; longer stretches become several lanes.
LANE = 512
#: Strings of one stretch; longer ones are cut, whatever they hold.
MOST_STRINGS = 1 << 18
#: Batches' spans up to this size are broadcast.
SMALL_BYTES = 32_000_000

OUT = ("n_bytes", "n_removed", "n_spans", "kept")
#: Length of an anchor in that of a string: the shorter, the fewer anchors a text has; longer ones tell apart what shorter ones have by chance.
ANCHOR_SHARE, LONG_ANCHOR_SHARE = 0.4, 0.7
#: Strings whose anchors are computed at once.
CHUNK = 1 << 16
#: Symbols that are compared at once.
WORD = 5
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser of uint64 values."""
    x = x + U64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> U64(shift))) * U64(factor)
    return x ^ (x >> U64(31))


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` bytes of ``data``, from those of half the width."""
    whole = None  # hash of the parts put together so far, of `have` bytes
    have, size = 0, 1
    part, power = mixed(np.arange(256, dtype=U64))[data], U64(0xA0761D6478BD642F)
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                # part * power of what is already there keeps the order of parts apart.
                n = len(data) - have - size + 1
                whole = part[:n] if whole is None else whole[size : size + n] + part[:n] * mixed(U64(have + 1).reshape(1))
                have += size
            size *= 2
            if size > width:
                return mixed(whole)
            part = part[: -(size // 2)] * power + part[size // 2 :]
            power = power * power


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchor_runs(data: np.ndarray, ends: np.ndarray, length: int, share: float = ANCHOR_SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text, start, strings): runs of neighbouring strings of ``length`` bytes with one anchor, of a ``share`` of their bytes; texts end at ``ends``."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(U64), none, none, none
    width = max(1, int(length * share))
    anchor = np.empty(len(data) - length + 1, U64)
    for at in range(0, len(anchor), CHUNK):  # as much as caches hold
        some = anchor[at : at + CHUNK]
        some[:] = _least(_hashes(data[at : at + len(some) + length - 1], width), length - width + 1)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= ends[text]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new & inside)
    counts = np.add.reduceat(inside.astype(np.int64), at) if len(at) else none
    return anchor[at], text[at], at, counts


class RunIndex:
    """Run-length Burrows-Wheeler transform of texts, with sampled run ends, for matches of up to ``length`` bytes.

    Suffixes are ordered by their first ``length`` bytes, then by text. Rows that
    agree in those are a group: following a byte backwards from any row of a
    group leads to the one group that begins with that byte, so the samples
    of run ends and of group heads answer what texts hold a match.
    """

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        sizes = np.array([len(t) for t in texts])
        self.ends = np.cumsum(sizes + 1) - 1  # a separator after each text
        n = int(self.ends[-1]) + 1
        self.symbols = symbols = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.ends] = False
        symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        self.text = np.repeat(np.arange(len(texts)), sizes + 1)
        self.left = left = self.ends[self.text] - np.arange(n)  # bytes up to the separator

        def ahead(values: np.ndarray, by: int) -> np.ndarray:
            # Past the end of a text there is nothing, which sorts first.
            out = np.zeros(n, values.dtype)
            out[: n - by] = values[by:]
            out[left < by] = 0
            return out

        def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(key)
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
            rank[self.ends] = 0
            return rank, order

        have = min(WORD, length)
        key = symbols
        for by in range(1, WORD):
            key = key << 9 | ahead(symbols, by)
        #: The next WORD symbols of each place, for comparing several at once.
        self.words = np.concatenate([key, np.zeros(length + WORD, np.int64)])
        rank, _ = ranked(key >> 9 * (WORD - have))
        while have < length:
            by = min(have, length - have)
            rank, _ = ranked(rank * (n + 1) + ahead(rank, by))
            have += by
        # Texts come in the order of their documents, so position breaks ties.
        order = np.argsort(rank * n + np.arange(n))
        sorted_rank = rank[order]
        head = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
        self.group = np.cumsum(head) - 1  # of each row
        self.sample = order[np.flatnonzero(head)]  # first place of each group
        last = symbols[order - 1]
        last[self.text[order - 1] != self.text[order]] = 0
        cuts = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        self.run_start, self.run_symbol = cuts, last[cuts]
        run_size = np.diff(np.append(cuts, n))
        self.run = np.repeat(np.arange(len(cuts)), run_size)  # of each row
        self.head_sample, self.tail_sample = order[cuts], order[cuts + run_size - 1]
        self.tail_row = cuts + run_size - 1
        # Runs by symbol; the row that each run's first row follows to.
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        self.lead = np.empty(len(cuts), np.int64)
        self.lead[by_symbol] = np.cumsum(run_size[by_symbol]) - run_size[by_symbol]
        self.runs_of, self.first_run = by_symbol, np.searchsorted(self.run_symbol[by_symbol], np.arange(258))
        self.in_order = self.run_symbol[by_symbol] * len(cuts) + by_symbol

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` have in common, up to ``most``."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            apart = self.words[a[live] + out[live]] ^ self.words[b[live] + out[live]]
            # Whole symbols before the highest bit that differs; exact in a float, which holds 45 bits.
            out[live] += (9 * WORD - np.frexp(apart.astype(np.float64))[1]) // 9
            live = live[(apart == 0) & (out[live] < most[live])]
        return np.minimum(np.minimum(out, most), np.minimum(self.left[a], self.left[b]))

    def stream(self, lanes: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of all lanes at once, last byte first: (lanes, place in them, length of the match there, a row of its group)."""
        size = np.array([len(x) for x in lanes])
        by_size = np.argsort(-size, kind="stable")
        size = size[by_size]
        flat = np.frombuffer(b"".join(lanes), np.uint8)
        stop = np.cumsum([len(x) for x in lanes])[by_size]
        row, long = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
        for step in range(int(size.max(initial=0))):
            m = int(np.searchsorted(-size, -step, side="left"))  # lanes with a byte left
            c = flat[stop[:m] - 1 - step].astype(np.int64) + 1
            now = row[:m]
            run = self.run[now]
            other = np.flatnonzero(self.run_symbol[run] != c)
            if len(other):
                self._jump(other, c[other], run, now, long)
            # A byte that no text has ends every match.
            row[:m] = np.where(run < 0, 0, self.lead[run] + now - self.run_start[run])
            long[:m] = np.where(run < 0, 0, np.minimum(long[:m] + 1, self.length))
            yield by_size[:m], size[:m] - 1 - step, long[:m], row[:m]

    def _jump(self, lanes, c, run, now, long) -> None:
        """Move lanes whose run has another symbol to the end of the run before or the start of the run after that has it."""
        # Runs of the symbol before and after the present one, by their order among all runs of that symbol.
        first, past = self.first_run[c], self.first_run[c + 1]
        after = np.searchsorted(self.in_order, c * len(self.run_start) + run[lanes])
        has_before, has_after = after > first, after < past
        up = self.runs_of[np.maximum(after - 1, 0)]
        down = self.runs_of[np.minimum(after, len(self.runs_of) - 1)]
        here, most = self.sample[self.group[now[lanes]]], long[lanes]
        share_up = np.where(has_before, self.common(here, self.tail_sample[up], np.where(has_before, most, 0)), -1)
        share_down = np.where(has_after, self.common(here, self.head_sample[down], np.where(has_after, most, 0)), -1)
        take_up = share_up >= share_down
        found = has_before | has_after
        target = np.where(take_up, up, down)
        run[lanes] = np.where(found, target, -1)
        now[lanes] = np.where(take_up, self.tail_row[target], self.run_start[target])
        long[lanes] = np.maximum(np.where(take_up, share_up, share_down), 0)


def spans_of(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(marked.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def earlier_strings(keys: np.ndarray, texts: list[bytes], rank: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(text, from, to): the strings of each text that a text of smaller rank holds. Equal strings have equal keys.

    Only what may be held elsewhere is indexed. Of each key the texts of the largest
    rank need no index and those of the smallest no streaming.
    """
    owner, start, pieces = _likely(texts, rank, length)
    found = _earlier(keys[owner], pieces, rank[owner], length) if len(pieces) else []
    return [(int(owner[i]), int(start[i]) + a, int(start[i]) + b) for i, a, b in found]


def _likely(texts: list[bytes], rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text, start, bytes): the stretches of strings whose first and last two thirds both occur in texts of different ranks."""
    width = max(1, length * 2 // 3)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(data) - width + 1]
    parts = _hashes(data, width)
    order = np.argsort(parts)
    sorted_parts, ranks = parts[order], rank[text[order]]
    first = np.flatnonzero(np.concatenate([[True], sorted_parts[1:] != sorted_parts[:-1]]))
    shared = np.minimum.reduceat(ranks, first) != np.maximum.reduceat(ranks, first)
    both = np.empty(len(parts), bool)
    both[order] = np.repeat(shared, np.diff(np.append(first, len(parts))))
    n = len(data) - length + 1
    keep = both[:n] & both[length - width :] & (np.arange(n) + length <= ends[text[:n]])
    new = keep & ~np.concatenate([[False], keep[:-1] & (text[1:n] == text[: n - 1])])
    at = np.flatnonzero(new)
    count = np.add.reduceat(keep.astype(np.int64), at) if len(at) else at
    owner = text[at]
    return owner, at - (ends - sizes)[owner], [data[a : a + c + length - 1].tobytes() for a, c in zip(at.tolist(), count.tolist())]


def _earlier(keys: np.ndarray, texts: list[bytes], rank: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    order = np.argsort(rank, kind="stable")
    low, high = (pd.Series(rank).groupby(keys).transform(how).to_numpy() for how in ("min", "max"))
    indexed = [i for i in order if rank[i] < high[i]]
    if not indexed:
        return []
    index = RunIndex([texts[i] for i in indexed], length)
    least = rank[np.array(indexed)][index.text[index.sample]]
    lanes = [(i, at) for i in order if rank[i] > low[i] for at in range(0, len(texts[i]) - length + 1, LANE)]
    whose, start = np.array(lanes).T
    marks = {i: np.zeros(len(texts[i]) - length + 1, bool) for i in set(whose.tolist())}
    offsets = np.cumsum([0, *(len(m) for m in marks.values())])
    base = dict(zip(marks, offsets))
    flat = np.zeros(int(offsets[-1]), bool)
    to = np.array([base[i] for i in whose.tolist()]) + start
    for lane, place, long, row in index.stream([texts[i][at : at + LANE + length - 1] for i, at in lanes]):
        hit = np.flatnonzero(long >= length)
        if len(hit):
            hit = hit[least[index.group[row[hit]]] < rank[whose[lane[hit]]]]
            flat[to[lane[hit]] + place[hit]] = True
    out = []
    for i, at in base.items():
        for a, b in zip(*spans_of(flat[at : at + len(marks[i])])):
            out.append((i, int(a), int(b)))
    return out


def pack_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(batch, ids, ends, data): compressed texts of some megabytes a row, in the order they are read; no exchange."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        codec = pa.Codec("zstd")
        held, bytes_held = [], 0

        def row() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            data = b"".join(b for h in held for b in h[1])
            ends = np.cumsum([len(b) for h in held for b in h[1]])
            return pa.RecordBatch.from_pydict({
                "batch": pa.array([number], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                "ends": pa.array([ends.astype("<i8").tobytes()], pa.binary()), "data": pa.array([codec.compress(data, asbytes=True)], pa.binary()),
            })

        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            done = 0
            for i, text in enumerate(texts):
                bytes_held += len(text)
                if bytes_held >= BATCH_BYTES or i + 1 == len(texts):
                    held.append((batch.column(0).slice(done, i + 1 - done), texts[done : i + 1]))
                    done = i + 1
                if bytes_held >= BATCH_BYTES:
                    yield row()
                    number, held, bytes_held = number + 1, [], 0
        if held:
            yield row()

    return rows.mapInArrow(pack, f"batch bigint, ids array<{kind}>, ends binary, data binary")


def _unpacked(row: dict) -> tuple[list, np.ndarray, bytes]:
    ends = np.frombuffer(row["ends"], "<i8")
    return row["ids"], ends, pa.Codec("zstd").decompress(row["data"], int(ends[-1]), asbytes=True)


def shared_anchors(packed: DataFrame, length: int) -> DataFrame:
    """(batch, anchor, key): anchors that at least two texts hold, in every batch that has them; key is their first place, in blocks."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, ends, data = _unpacked(row)
                anchor, text, start, _ = anchor_runs(np.frombuffer(data, np.uint8), ends, length)
                order = np.argsort(anchor, kind="stable")
                anchor, text, start = anchor[order], text[order], start[order]
                if not len(anchor):
                    continue
                first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                last = np.append(first[1:], len(anchor)) - 1
                # Place in blocks, and whether two texts of the batch have it already.
                where = row["batch"] << PLACE_BITS + 1 | np.minimum(start[first] >> BLOCK_BITS, (1 << PLACE_BITS) - 1) << 1 | (text[first] != text[last])
                yield pa.RecordBatch.from_pydict({"anchor": anchor[first].view(np.int64), "place": where})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by anchor and place: the first row of an anchor has its key, and waits until a second shows that it is shared.
        held = None  # anchor, its first place, whether that row is out already
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, place = (c.to_numpy() for c in batch.columns)
            new = np.concatenate([[held is None or anchor[0] != held[0]], anchor[1:] != anchor[:-1]])
            group = np.cumsum(new) - new[0]
            firsts = place[new] if new[0] else np.concatenate([[held[1]], place[new]])
            size = np.bincount(group)
            shared = (size > 1) | (np.bincount(group, place & 1) > 0)
            if not new[0]:
                shared[0] = True
                if not held[2]:
                    yield pa.RecordBatch.from_pydict({"batch": [held[1] >> PLACE_BITS + 1], "anchor": [held[0]], "key": [held[1] >> 1]})
            take = shared[group]
            yield pa.RecordBatch.from_pydict({"batch": place[take] >> PLACE_BITS + 1, "anchor": anchor[take], "key": firsts[group[take]] >> 1})
            held = (int(anchor[-1]), int(firsts[-1]), bool(shared[-1]))

    rows = packed.mapInArrow(anchors, "anchor bigint, place bigint")
    # Anchors are hashes: their partitions are even, and one anchor has at most a row a batch.
    return rows.repartition("anchor").sortWithinPartitions("anchor", "place").mapInArrow(meet, "batch bigint, anchor bigint, key bigint")


def shared_stretches(packed: DataFrame, anchors: DataFrame, length: int, id_type: str) -> DataFrame:
    """(batch, row, id, start, key, bytes): stretches of the texts whose strings have shared anchors of one key."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["batch", "row", "id", "start", "key", "bytes"]
        columns: list[list] = [[] for _ in names]
        if right.num_rows:
            known, keys = right.column("anchor").to_numpy(), right.column("key").to_numpy()
            order = np.argsort(known)
            known, keys = known[order], keys[order]
            for row in left.to_pylist():
                ids, ends, data = _unpacked(row)
                anchor, text, start, strings = anchor_runs(np.frombuffer(data, np.uint8), ends, length)
                slot = np.minimum(np.searchsorted(known, anchor.view(np.int64)), len(known) - 1)
                hit = known[slot] == anchor.view(np.int64)
                hit &= np.array([i is not None for i in ids], bool)[text]
                text, start, strings, key = text[hit], start[hit], strings[hit], keys[slot[hit]]
                if not len(text):
                    continue
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1] + strings[:-1]) | (start[1:] // MOST_STRINGS != start[:-1] // MOST_STRINGS)
                first = np.flatnonzero(new)
                total = np.add.reduceat(strings, first)
                begin = start[first] - np.concatenate([[0], ends])[text[first]]
                columns[0] += [row["batch"]] * len(first)
                columns[1] += text[first].tolist()
                columns[2] += [ids[t] for t in text[first].tolist()]
                columns[3] += begin.tolist()
                columns[4] += key[first].tolist()
                columns[5] += [data[a : a + n + length - 1] for a, n in zip(start[first].tolist(), total.tolist())]
        kinds = [pa.int64(), pa.int32(), left.schema.field("ids").type.value_type, pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return packed.groupBy("batch").cogroup(anchors.groupBy("batch")).applyInArrow(cut, f"batch bigint, row int, id {id_type}, start bigint, key bigint, bytes binary")


def _finer(owners: DataFrame, length: int, by_string: bool) -> DataFrame:
    """Pieces (owner, owner_digest, id, start, strings, key[, digest]) of hot stretches (key, digest, first, bytes), without their bytes: one for each run of a longer anchor, or for each string with its digest."""
    kind = owners.schema["first"].dataType.simpleString()
    names = ["owner", "owner_digest", "id", "start", "strings", "key", *["digest"] * by_string]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v.as_buffer()) for v in batch.column(3)], np.int64)
            for some in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_BYTES)) + 1):
                part = batch.slice(some[0], len(some)) if len(some) else batch.slice(0, 0)
                if not part.num_rows:
                    continue
                data = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8)
                ends = np.cumsum(sizes[some])
                begins = ends - sizes[some]
                if by_string:
                    both = [_hashes(data if k == 0 else data ^ 0x5A, length) for k in (0, 1)]
                    whose = np.repeat(np.arange(len(some)), sizes[some])[: len(both[0])]
                    at = np.flatnonzero(np.arange(len(both[0])) + length <= ends[whose])
                    key, whose, n = both[0][at], whose[at], np.ones(len(at), np.int64)
                else:
                    key, whose, at, n = anchor_runs(data, ends, length, LONG_ANCHOR_SHARE)
                for first in range(0, len(at), 100_000):
                    cut = slice(first, first + 100_000)
                    own = [part.column(j).take(pa.array(whose[cut])) for j in range(3)]
                    columns = [*own, pa.array(at[cut] - begins[whose[cut]]), pa.array(n[cut]), pa.array(key[cut].view(np.int64))]
                    if by_string:
                        columns.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(at[cut]), [None, pa.py_buffer(np.ascontiguousarray(both[1][at[cut]]).tobytes())]).cast(pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)

    return owners.select("key", "digest", F.col("first").alias("id"), "bytes").mapInArrow(split, f"owner bigint, owner_digest binary, id {kind}, start bigint, strings bigint, key bigint" + ", digest binary" * by_string)


def _judged(pieces: DataFrame, length: int, level: int = 0) -> DataFrame:
    """(key, digest, first, spans): the distinct stretches, their least id, and which of their strings an id below that holds.

    ``pieces`` has id, key and bytes, and equal strings have equal keys. ``spans``
    is null where there is none.
    """
    digest = F.unhex(F.md5("bytes"))
    distinct = pieces.select("key", digest.alias("digest"), "id", "bytes").groupBy("key", "digest").agg(F.min("id").alias("first"), F.first("bytes").alias("bytes"))
    distinct = stored(distinct, "stretches", release=True)
    sizes = distinct.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("size"), F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes.where("n > 1").select("key", "size"), "key-sizes")
    whole, hot = sizes.agg(F.sum(F.when(F.col("size") <= HOT_BYTES, F.col("size"))), F.sum((F.col("size") > HOT_BYTES).cast("int"))).first()
    spans = "array<struct<a:bigint,b:bigint>>"
    groups = max(1, -(-(whole or 0) // GROUP_BYTES))
    cold = distinct.join(sizes.where(F.col("size") <= HOT_BYTES).select("key"), "key", "left_semi")

    def judge(table: pa.Table) -> pa.Table:
        first = table.column("first").to_pandas()
        rank = first.rank(method="dense").to_numpy().astype(np.int64)
        found = earlier_strings(table.column("key").to_numpy(), table.column("bytes").to_pylist(), rank, length)
        by_text: dict[int, list] = {}
        for i, a, b in found:
            by_text.setdefault(i, []).append({"a": a, "b": b})
        at = pa.array(list(by_text), pa.int64())
        return pa.table([table.column("key").take(at), table.column("digest").take(at), pa.array(list(by_text.values()), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["key", "digest", "spans"])

    found = cold.groupBy((F.xxhash64("key") % F.lit(groups)).alias("group")).applyInArrow(judge, f"key bigint, digest binary, spans {spans}")
    if hot:
        owners = distinct.join(sizes.where(F.col("size") > HOT_BYTES).select("key"), "key", "left_semi")
        mine = _finer(owners, length, level > 0)
        if level == 0:
            # Longer anchors tell most of what a short one has by chance apart: only those of several stretches go on, and only then with their bytes.
            several = mine.groupBy("key").agg(F.min("owner_digest").alias("_a"), F.max("owner_digest").alias("_b")).where("_a < _b").select("key")
            mine = stored(mine.join(gathered(stored(several, "long-anchors", release=True)), "key", "left_semi"), "finer-stretches", release=True)
            whole = owners.select(F.col("key").alias("owner"), F.col("digest").alias("owner_digest"), "bytes")
            cut = F.expr(f"substring(bytes, cast(start + 1 as int), cast(strings + {length - 1} as int))")
            mine = stored(mine.join(whole, ["owner", "owner_digest"]).withColumn("bytes", cut), "finer-bytes", release=True)
            known = _judged(mine.select("id", "key", "bytes"), length, 1)
            mine = mine.withColumn("digest", F.unhex(F.md5("bytes"))).drop("bytes")
        else:
            # A key and digest are one string now: what its least id does not hold first is held by a smaller one.
            mine = stored(mine, "strings", release=True)
            known = mine.groupBy("key", "digest").agg(F.min("id").alias("first")).withColumn("spans", F.lit(None).cast(spans))
        held = mine.join(known, ["key", "digest"]).select("owner", "owner_digest", F.inline(_held(F.col("id"), F.col("strings"), F.col("start"))))
        found = found.unionByName(held.groupBy(F.col("owner").alias("key"), F.col("owner_digest").alias("digest")).agg(F.collect_list(F.struct(F.col("a"), F.col("b"))).alias("spans")))
    return distinct.select("key", "digest", "first").join(found, ["key", "digest"], "left")


def _held(id_, strings, start):
    """Spans (a, b) of the owner's strings that a smaller id holds, of one piece of it: all, if the piece's least id is smaller, else what the index found."""
    whole = F.array(F.struct(start.alias("a"), (start + strings).alias("b")))
    part = F.transform("spans", lambda s: F.struct((s["a"] + start).alias("a"), (s["b"] + start).alias("b")))
    return F.when(id_ > F.col("first"), whole).otherwise(part)


def held_before(packed: DataFrame, length: int, id_type: str) -> DataFrame:
    """(batch, spans): for each batch the bytes of its texts that a smaller id holds, as int32 triples (row, from, to) in order."""
    stretches = stored(shared_stretches(packed, shared_anchors(packed, length), length, id_type), "shared-stretches", release=True)
    known = _judged(stretches, length)
    mine = stretches.select("batch", "row", "id", "start", "key", F.unhex(F.md5("bytes")).alias("digest"), (F.octet_length("bytes") - length + 1).alias("strings"))
    held = mine.join(known, ["key", "digest"]).select("batch", "row", F.inline(_held(F.col("id"), F.col("strings"), F.col("start"))))

    def merge(rows: pa.Table) -> pa.Table:
        row, a, b = (rows.column(c).to_numpy().astype(np.int64) for c in ("row", "a", "b"))
        order = np.lexsort((a, row))
        row, a, b = row[order], a[order], b[order] + length - 1
        # Ends only grow along a text; texts are kept apart by an offset.
        far = int(b.max()) + 1
        reach = np.maximum.accumulate(b + row * far)
        new = np.concatenate([[True], (a + row * far)[1:] > reach[:-1]])
        last = np.append(np.flatnonzero(new)[1:], len(row)) - 1
        triples = np.column_stack([row[new], a[new], reach[last] - row[last] * far])
        return pa.table([rows.column("batch").slice(0, 1), pa.array([triples.astype("<i8").tobytes()], pa.binary())], ["batch", "spans"])

    return held.groupBy("batch").applyInArrow(merge, "batch bigint, spans binary")


def drop_earlier_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): each text less the bytes covered by a string of ``length`` bytes that also starts in a document of smaller id.

    Texts are their UTF-8 bytes and ``kept`` is binary, since a span may end inside a
    character. Strings are judged on the input: what another document loses still counts.

    Edge cases: a null text is empty; texts shorter than ``length`` lose nothing. Rows
    with a null id keep all bytes and take nothing from others. Rows that repeat an
    id are parts of one document: they lose nothing to each other. Ids may be of any type with an
    order. Other columns, whatever their names, do not matter. An empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    packed = stored(pack_texts(docs, id_col, text_col), "packed-texts")
    spans = stored(held_before(packed, length, kind), "held-spans", release=True)
    size = spans.agg(F.sum(F.octet_length("spans"))).first()[0] or 0
    joined = packed.join(F.broadcast(spans) if size <= SMALL_BYTES else spans, "batch", "left").select("ids", "ends", "data", "spans")
    names = [id_col, *OUT]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, ends, data = _unpacked(row)
                begins = np.concatenate([[0], ends[:-1]])
                triples = np.frombuffer(row["spans"] or b"", "<i8").reshape(-1, 3)
                size, removed, count = ends - begins, np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
                np.add.at(removed, triples[:, 0], triples[:, 2] - triples[:, 1])
                np.add.at(count, triples[:, 0], 1)
                kept, at = [], 0
                for t, (a, b) in enumerate(zip(begins.tolist(), ends.tolist())):
                    parts, now = [], a
                    for _, x, y in triples[at : at + int(count[t])].tolist():
                        parts.append(data[now : a + x])
                        now = a + y
                    at += int(count[t])
                    kept.append(b"".join([*parts, data[now:b]]))
                ids = batch.column(0).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(removed), pa.array(count), pa.array(kept, pa.binary())], names)

    return joined.mapInArrow(strip, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_earlier_strings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Strings as pairs of hex digits, every one with the least document that has it.
OP13_SQL = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM bytes WHERE length(h) >= 100)
),
least AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
held AS (SELECT doc_id, i FROM strings JOIN least USING (s) WHERE doc_id > first),
marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM held
),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY ALL),
around AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM spans),
cut AS (
  SELECT d.doc_id, any_value(h) AS h, coalesce(sum(b - a), 0) AS n_removed, count(a) AS n_spans,
         coalesce(substr(any_value(h), 1, 2 * min(a)) || string_agg(substr(h, 2 * b + 1, 2 * (coalesce(next, length(h) // 2) - b)), '' ORDER BY a), any_value(h)) AS kept
  FROM bytes d LEFT JOIN around USING (doc_id) GROUP BY d.doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM cut
"""
