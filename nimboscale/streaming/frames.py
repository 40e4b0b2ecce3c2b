"""Streaming: frame windows with late data, and linking as frames arrive, whole or scattered over batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def windowed(events: DataFrame, time: str = "ts", every: str = "30 minutes", late: str | None = None, value: str = "value", by: str = "event_type") -> DataFrame:
    """Count and sum in tumbling windows; with ``late`` a watermark, so that the same plan runs on a stream."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if late else rows
    out = rows.groupBy(F.window(time, every).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


LINKS = "event string, frame int, feature int, cell long"
STATE = "last_frame int, features array<int>, cells array<long>, pixels array<array<int>>, next long"


def _linked(parents: dict[int, set], owner: dict[int, int], here: dict[int, set], fresh: int) -> tuple[dict[int, int], int]:
    """Cells of a frame's features ``here`` (pixels by feature) after the frame before: that of the parent which is mutually best by overlap, else a new one."""
    over = {(p, c): len(a & b) for p, a in parents.items() for c, b in here.items() if a & b}
    child = {p: min((-n, c) for (q, c), n in over.items() if q == p)[1] for p in {q for q, _ in over}}
    parent = {c: min((-n, p) for (p, d), n in over.items() if d == c)[1] for c in {d for _, d in over}}
    named = {}
    for c in sorted(here):
        p = parent.get(c)
        if p is not None and child[p] == c:
            named[c] = owner[p]
        else:
            named[c], fresh = fresh, fresh + 1
    return named, fresh


def link_frames(segments: DataFrame, width: int) -> DataFrame:
    """Cells of a stream of segmented frames (event, frame, y, x, feature), one state an event.

    A frame is linked to the frame before it only: a child takes the cell of the
    parent with which it is mutually best by overlap (ties to the smaller id),
    else a new one. The state is the last frame's segments. Rows of a frame must
    arrive in one batch; frames that come after a later one are skipped.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        last, features, cells, pixels, fresh = state.get if state.exists else (-(1 << 30), [], [], [], 1)
        parents = dict(zip(features, (set(p) for p in pixels)))
        owner = dict(zip(features, cells))
        for frame, part in sorted(rows.groupby("frame"), key=lambda x: x[0]):
            if frame <= last:
                continue
            here = {int(f): set((g["y"] * width + g["x"]).tolist()) for f, g in part.groupby("feature")}
            before = parents if frame == last + 1 else {}
            named, fresh = _linked(before, owner, here, fresh)
            parents, owner, last = here, named, int(frame)
            yield pd.DataFrame({"event": key[0], "frame": last, "feature": list(named), "cell": list(named.values())})
        names = list(parents)
        state.update((last, names, [owner[n] for n in names], [sorted(parents[n]) for n in names], fresh))

    return segments.groupBy("event").applyInPandasWithState(step, LINKS, STATE, "append", "NoTimeout")


BUFFERED = "event string, frame int, feature int, cell bigint, late boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Linker(StatefulProcessor):
    """State of an event: the last closed frame's features, and the pixels of the frames that still wait for theirs."""

    def __init__(self, width: int, seen_ms: int, dead_ms: int):
        # The watermark lies ``seen_ms`` behind the time up to which frames are closed.
        self.width, self.seen_ms, self.dead_ms = width, seen_ms, dead_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "last int, last_ms bigint, features array<int>, cells array<bigint>, pixels array<array<int>>, next bigint")
        self.waiting = handle.getMapState("waiting", "frame int", "ms bigint, features array<int>, pixels array<int>")

    def _last(self) -> int:
        return self.closed.get()[0] if self.closed.exists() else -(1 << 31)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self._last()
        for pdf in rows:
            for frame, part in pdf.groupby("frame"):
                frame = int(frame)
                if frame <= last:
                    seen = sorted(set(part["feature"].tolist()))
                    yield pd.DataFrame({"event": key[0], "frame": frame, "feature": seen, "cell": pd.array([None] * len(seen), "Int64"), "late": True})
                    continue
                ms = int(part["ms"].max())
                before = self.waiting.getValue((frame,)) if self.waiting.containsKey((frame,)) else (ms, [], [])
                pixels = (part["y"] * self.width + part["x"]).astype(int).tolist()
                self.waiting.updateValue((frame,), (max(ms, before[0]), [*before[1], *part["feature"].astype(int).tolist()], [*before[2], *pixels]))
                self.handle.registerTimer(ms - self.seen_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() + self.seen_ms
        ready = sorted((k[0], v) for k, v in self.waiting.iterator() if v[0] <= now)
        last, last_ms, features, cells, pixels, fresh = self.closed.get() if self.closed.exists() else (-(1 << 31), 0, [], [], [], 1)
        parents, owner = dict(zip(features, (set(p) for p in pixels))), dict(zip(features, cells))
        for frame, (ms, whose, where) in ready:
            here: dict[int, set] = {}
            for f, p in zip(whose, where):
                here.setdefault(f, set()).add(p)
            owner, fresh = _linked(parents if frame == last + 1 else {}, owner, here, fresh)
            parents, last, last_ms = here, frame, ms
            self.waiting.removeKey((frame,))
            yield pd.DataFrame({"event": key[0], "frame": frame, "feature": list(owner), "cell": pd.array(list(owner.values()), "Int64"), "late": False})
        if ready:
            names = list(parents)
            self.closed.update((last, last_ms, names, [owner[n] for n in names], [sorted(parents[n]) for n in names], fresh))
            self.handle.registerTimer(last_ms - self.seen_ms + self.dead_ms)
        elif self.closed.exists() and last_ms + self.dead_ms <= now and not any(True for _ in self.waiting.iterator()):
            # The event is over: only that its frames are closed stays known.
            self.closed.update((last, last_ms, [], [], [], fresh))

    def close(self) -> None:
        pass


def link_scattered_frames(segments: DataFrame, width: int, late_minutes: int, seen_minutes: int = 1440, dead_minutes: int = 1440) -> DataFrame:
    """(event, frame, feature, cell, late) of a stream of segment pixels (event, time, frame, y, x, feature), a frame's rows in any number of batches.

    A frame is closed in the batch after rows ``late_minutes`` past its own time have come, and is then linked to the
    frame before as in ``link_frames``: results do not depend on how rows fall into
    batches. Features of a frame that is closed already come out with ``late`` set and without a
    cell, for ``seen_minutes`` more; what is older still Spark drops and counts. The pixels of
    an event that has closed no frame for ``dead_minutes`` are dropped. Frames of an event have times in
    their order. Needs the RocksDB state store (``ROCKS``).
    """
    rows = segments.withColumn("ms", F.unix_millis("time")).withWatermark("time", f"{late_minutes + seen_minutes} minutes")
    linker = _Linker(width, seen_minutes * 60_000, dead_minutes * 60_000)
    return rows.groupBy("event").transformWithStateInPandas(linker, BUFFERED, "append", "eventTime")
