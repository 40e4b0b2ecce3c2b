"""From raw bytes to checked frames: decode, quality, gap fill, order, area crop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from nimboscale.operators import regions


def frame_quality(px: DataFrame, value: str, low: float, high: float, most_missing: float, most_odd: float, digits: int = 9) -> DataFrame:
    """Missing share, out-of-range share of the valid pixels (1 where none is), extremes and status of each frame; NaN counts as missing."""
    v = F.when(~F.isnan(value), F.col(value))
    odd = ((v > high) | (v < low)).cast("double")
    out = px.groupBy("frame").agg(F.avg(v.isNull().cast("double")).alias("m"), F.coalesce(F.avg(odd), F.lit(1.0)).alias("o"), F.min(v).alias("low"), F.max(v).alias("high"))
    status = F.when((F.col("m") > most_missing) | (F.col("o") > most_odd), "QC_FAIL").otherwise("OK")
    return out.select(
        "frame", F.round("m", digits).alias("missing_frac"), F.round("o", digits).alias("out_of_range_frac"),
        F.round("low", 7).alias("low"), F.round("high", 7).alias("high"), status.alias("status"),
    )


def missing_shares(raw: DataFrame, filled: DataFrame, value: str = "v") -> DataFrame:
    """(frame, raw_missing, residual_missing, gapfilled): shares of pixels missing before and after filling, and filled; ``filled`` has gapfilled."""
    before = raw.groupBy("frame").agg(F.avg(F.col(value).isNull().cast("double")).alias("raw_missing"))
    after = filled.groupBy("frame").agg(F.avg(F.col(value).isNull().cast("double")).alias("residual_missing"), F.avg(F.col("gapfilled").cast("double")).alias("gapfilled"))
    return before.join(after, "frame")


def event_quality(raw: DataFrame, filled: DataFrame, cells: DataFrame, event_below: float, frames: int, least_deep: float, long: int, value: str = "v") -> DataFrame:
    """One row on an event's pixels inside its domain: missing before and after filling, filled, deep frames and areas, cells, suitability.

    ``cells`` has a row a cell and frame; a cell of ``long`` frames or more is a long one.
    The event is suitable with ``frames`` frames of which ``least_deep`` have a pixel under
    ``event_below``.
    """
    shares = missing_shares(raw, filled, value).agg(F.max("raw_missing").alias("raw_missing_max"), F.max("residual_missing").alias("residual_missing_max"), F.avg("gapfilled").alias("gapfilled_mean"))
    deep = filled.groupBy("frame").agg(F.count_if(F.col(value) < event_below).alias("_deep"), F.count(F.lit(1)).alias("_all"))
    share = F.col("_deep") / F.col("_all").cast("double")
    deep = deep.agg(F.count(F.lit(1)).alias("n_frames"), F.avg((F.col("_deep") > 0).cast("double")).alias("deep_frames"), F.avg(share).alias("deep_area_mean"), F.max(share).alias("deep_area_max"))
    spans = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("_n") >= long).alias("n_long_cells"))
    # One row each.
    out = deep.crossJoin(F.broadcast(shares)).crossJoin(F.broadcast(spans))
    return out.withColumn("suitable", (F.col("n_frames") == frames) & (F.col("deep_frames") >= least_deep))


def monotonic(df: DataFrame, by: list[str], order: str, time: str) -> DataFrame:
    """Whether times strictly grow along ``order``; single rows do."""
    step = df.withColumn("_prev", F.lag(time).over(Window.partitionBy(*by).orderBy(order)))
    return step.groupBy(*by).agg(F.coalesce(F.bool_and(F.col(time) > F.col("_prev")), F.lit(True)).alias("monotonic"))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive (south, north, west, east); null coordinates are outside."""
    return F.coalesce(lat.between(box[0], box[1]) & lon.between(box[2], box[3]), F.lit(False))


def decode_counts(raw: bytes, rows: int, cols: int, offset: float = 75.0) -> np.ndarray:
    """(2, rows, cols) float32 from counts, south up; 255 is missing."""
    if len(raw) != 2 * rows * cols:
        raise ValueError(f"{len(raw)} bytes, not {2 * rows * cols}")
    counts = np.frombuffer(raw, np.uint8).reshape(2, rows, cols)[:, ::-1]
    return np.where(counts == 255, np.nan, counts.astype(np.float32) + np.float32(offset))


def decode_frames(files: DataFrame, rows: int, cols: int, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Pixels (path, field, y, x, v) of binary files (path, content), cropped to [y0, y1) x [x0, x1) inside the task.

    Content may be compress(1) output, which is told by its first bytes. A file
    of another length raises. Missing is null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yy, xx = (a.ravel() for a in np.meshgrid(np.arange(*y), np.arange(*x), indexing="ij"))
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                raw = unpack_z(content) if content[:2] == b"\x1f\x9d" else content
                fields = decode_counts(raw, rows, cols)
                for k in range(2):
                    part = fields[k, slice(*y), slice(*x)].ravel()
                    yield pd.DataFrame({"path": path, "field": k, "y": yy, "x": xx, "v": pd.array(np.where(np.isnan(part), 0, part), dtype="Float32").copy()}).assign(
                        v=lambda d, p=part: d["v"].mask(np.isnan(p))
                    )

    return files.select("path", "content").mapInPandas(run, "path string, field int, y int, x int, v float")


def unpack_z(data: bytes) -> bytes:
    """Expand compress(1) output: LZW codes of 9 to 16 bits, low bits first, in groups of eight codes."""
    if data[:2] != b"\x1f\x9d":
        raise ValueError("not compress(1) output")
    most, blocks = data[2] & 31, bool(data[2] & 128)
    total, at, width = 8 * (len(data) - 3), 0, 9
    first = 257 if blocks else 256
    table = [bytes([i]) for i in range(256)] + [b""] * (first - 256)
    out: list[bytes] = []
    last = b""
    start = 0  # of the codes of this width; they come in groups of eight
    view = memoryview(data)[3:]
    while at + width <= total:
        low = at >> 3
        code = int.from_bytes(view[low : low + 4], "little") >> (at & 7) & ((1 << width) - 1)
        at += width
        if blocks and code == 256:
            at = start + -(-(at - start) // (8 * width)) * 8 * width
            start, width, last = at, 9, b""
            del table[first:]
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("broken LZW data")
        out.append(word)
        if last and len(table) < 1 << most:
            table.append(last + word[:1])
            if len(table) == 1 << width and width < most:
                at = start + -(-(at - start) // (8 * width)) * 8 * width
                start, width = at, width + 1
        last = word
    return b"".join(out)


def raster_of(pdf: pd.DataFrame, value: str, shape: tuple[int, int]) -> np.ndarray:
    out = np.full(shape, np.nan)
    out[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pd.to_numeric(pdf[value]).to_numpy(dtype=float, na_value=np.nan)
    return out


def gap_fill(px: DataFrame, height: int, width: int, value: str = "v", most: int = 4) -> DataFrame:
    """(frame, y, x, value, gapfilled); see ``regions.gap_fill``."""
    return regions.gap_fill(px, value, most)
