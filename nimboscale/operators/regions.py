"""Connected regions of rasters without a frame in one task: run-length labelling, detection, gap filling, contours.

A mask becomes runs of pixels along its rows (one window each row), runs that
touch in the next row become edges, and ``graph.connected_components`` contracts
them. Work grows with pixels and runs, whatever a frame's size. Rows and columns
are numbered below 2^17, frames below 2^28.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from nimboscale.operators.graph import connected_components
from nimboscale.session import discard, stored

#: Bits of a row or column in a pixel's code.
BITS = 17
#: Columns of one join key when runs of neighbouring rows meet.
STRIP = 64
#: Levels of one raster that are labelled together.
MOST_LEVELS = 64


def _code(frame: Column, y: Column, x: Column) -> Column:
    """Number of a pixel; of the pixels of a frame the first in scan order has the smallest."""
    part = lambda c, bits: F.shiftleft(c.cast("bigint"), bits)
    return part(frame, 2 * BITS) + part(y, BITS) + x.cast("bigint")


def runs_of(mask: DataFrame) -> DataFrame:
    """``mask``, rows (frame, y, x, ...) of distinct pixels, with ``x0``: where the pixel's run along its row begins."""
    row = Window.partitionBy("frame", "y")
    at = F.col("x") - F.row_number().over(row.orderBy("x"))
    return mask.withColumn("_run", at).withColumn("x0", F.min("x").over(Window.partitionBy("frame", "y", "_run"))).drop("_run")


def touching(runs: DataFrame, diagonal: bool) -> DataFrame:
    """(src, dst): pixel codes of runs (frame, y, x0, x1) that touch in neighbouring rows, by side or, with ``diagonal``, by corner."""
    d = 1 if diagonal else 0
    strips = lambda low, high: F.explode(F.sequence(F.floor(low / STRIP).cast("int"), F.floor(high / STRIP).cast("int")))
    a = runs.select("frame", (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), strips(F.col("x0") - d, F.col("x1") + d).alias("_s"))
    b = runs.select("frame", "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"), strips(F.col("x0"), F.col("x1")).alias("_s"))
    met = a.join(b, ["frame", "y", "_s"]).where((F.col("b0") <= F.col("a1") + d) & (F.col("b1") >= F.col("a0") - d))
    return met.select(_code(F.col("frame"), F.col("y") - 1, F.col("a0")).alias("src"), _code(F.col("frame"), F.col("y"), F.col("b0")).alias("dst")).distinct()


def labelled_runs(mask: DataFrame, diagonal: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pixels, runs): the pixels of ``mask`` with ``x0``, stored, and (frame, y, x0, x1, region) of their runs.

    ``region`` is the code of the region's first pixel in scan order, unique over frames.
    """
    pixels = stored(runs_of(mask), "mask-pixels")
    runs = stored(pixels.groupBy("frame", "y", "x0").agg(F.max("x").alias("x1")), "mask-runs")
    code = _code(F.col("frame"), F.col("y"), F.col("x0"))
    found = connected_components(touching(runs, diagonal)).select(F.col("node").alias("_code"), F.col("component").alias("region"))
    named = runs.withColumn("_code", code).join(found, "_code", "left").withColumn("region", F.coalesce("region", "_code")).drop("_code")
    return pixels, stored(named, "regions")


def regions(mask: DataFrame, diagonal: bool = False) -> DataFrame:
    """``mask``, rows (frame, y, x, ...) of distinct pixels, with their connected ``region``: the code of its first pixel in scan order.

    Pixels touch by sides, with ``diagonal`` by corners too. Regions of any size and
    shape; an empty mask gives an empty table. Codes are (frame, y, x) from bits 34, 17
    and 0; ``detect`` takes frames below 2^22.
    """
    pixels, runs = labelled_runs(mask, diagonal)
    return pixels.join(runs.drop("x1"), ["frame", "y", "x0"]).drop("x0")


def smooth(px: DataFrame, sigma: float, value: str = "v") -> DataFrame:
    """(frame, y, x, value): Gaussian means over valid pixels, along rows and then columns; missing stays missing.

    ``px`` has a row for every pixel. Two exchanges, whatever the width.
    """
    import math

    half = max(1, int(3 * sigma + 0.5))
    weight = {k: math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)}

    def along(df: DataFrame, fixed: str, moving: str) -> DataFrame:
        line = Window.partitionBy("frame", fixed).orderBy(moving)
        near = lambda c, k: F.coalesce(F.lag(c, k).over(line) if k > 0 else F.lead(c, -k).over(line) if k < 0 else F.col(c), F.lit(0.0))
        return df.withColumns({c: sum((near(c, k) * w for k, w in weight.items()), F.lit(0.0)) for c in ("_sum", "_weight")})

    rows = px.select("frame", "y", "x", F.col(value).isNotNull().alias("_ok"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_sum"), F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0).alias("_weight"))
    rows = along(along(rows, "y", "x"), "x", "y")
    return rows.select("frame", "y", "x", F.when(F.col("_ok") & (F.col("_weight") > 0), F.col("_sum") / F.greatest("_weight", F.lit(1e-12))).alias(value))


def detect(px: DataFrame, thresholds: list[float], least: int | list[int] = 4, sigma: float = 0.0, value: str = "v") -> DataFrame:
    """(frame, feature, cy, cx, threshold, pixels): regions below thresholds; a region of a colder one replaces the warmer ones around it.

    Of each threshold the side-connected regions of at least ``least`` pixels (a
    number, or one for each threshold) are taken; a region with a taken region of
    a colder threshold inside is left out. Centres are weighted by the depth below
    the threshold. Features are numbered from 1 in a frame, by centre to nine decimals, then
    threshold and first pixel, so that numbers do not hang on the order of sums. Missing pixels
    (null) are above every threshold.
    """
    sizes = [least] * len(thresholds) if isinstance(least, int) else list(least)
    if len(sizes) != len(thresholds):
        raise ValueError("as many least sizes as thresholds")
    if len(thresholds) > MOST_LEVELS:
        raise ValueError(f"at most {MOST_LEVELS} thresholds")
    px = smooth(px, sigma, value) if sigma else px.select("frame", "y", "x", F.col(value).cast("double").alias(value))
    levels = sorted(zip(thresholds, sizes), reverse=True)  # warmest first
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("t"), F.lit(s).alias("s")) for i, (t, s) in enumerate(levels)])
    # Each level of a frame is a raster of its own; they are labelled together.
    mask = px.where(F.col(value) < float(levels[0][0])).withColumn("_l", F.explode(F.filter(listed, lambda x: F.col(value) < x["t"])))
    mask = mask.select((F.col("frame") * MOST_LEVELS + F.col("_l.i")).cast("int").alias("frame"), "y", "x", (F.col("_l.t") - F.col(value)).alias("_w"), F.col("_l.s").alias("_least"))
    pixels, runs = labelled_runs(mask)
    weighted = lambda c: F.when(F.sum("_w") > 0, F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).otherwise(F.avg(c))
    sums = pixels.join(runs, ["frame", "y", "x0"]).groupBy("frame", "region").agg(F.count(F.lit(1)).cast("int").alias("pixels"), weighted("y").alias("cy"), weighted("x").alias("cx"), F.max("_least").alias("_least"))
    taken = stored(sums.where("pixels >= _least"), "taken-regions")
    # The first pixel of a taken region lies in one run of every warmer level.
    whole, level = F.expr(f"frame div {MOST_LEVELS}"), F.pmod("frame", F.lit(MOST_LEVELS))
    y, x = F.shiftright("region", BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"), F.col("region").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    firsts = taken.select(whole.alias("_f"), level.alias("_inner"), y.alias("y"), x.alias("_x"), F.floor(x / STRIP).cast("int").alias("_s"))
    around = runs.select(whole.alias("_f"), level.alias("_outer"), "y", "x0", "x1", F.col("region"), F.explode(F.sequence(F.floor(F.col("x0") / STRIP).cast("int"), F.floor(F.col("x1") / STRIP).cast("int"))).alias("_s"))
    replaced = firsts.join(around, ["_f", "y", "_s"]).where("_outer < _inner AND _x BETWEEN x0 AND x1").select("region").distinct()
    kept = taken.join(replaced, "region", "left_anti").withColumns({"_t": F.get(listed, level)["t"], "frame": whole.cast("int")})
    number = F.row_number().over(Window.partitionBy("frame").orderBy(F.round("cy", 9), F.round("cx", 9), "_t", "region"))
    return kept.select("frame", number.alias("feature"), "cy", "cx", F.col("_t").alias("threshold"), "pixels")


def neighbours(cells: DataFrame) -> DataFrame:
    """Cells (frame, y, x, ...), each as ``ty``, ``tx``, at its eight neighbours' places."""
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    moved = cells.withColumnsRenamed({"y": "ty", "x": "tx"}).withColumn("_d", around)
    return moved.withColumns({"y": F.col("ty") + F.col("_d.a"), "x": F.col("tx") + F.col("_d.b")}).drop("_d")


def gap_fill(px: DataFrame, value: str = "v", most: int = 4, passes: int = 4) -> DataFrame:
    """(frame, y, x, value, gapfilled): missing regions of at most ``most`` pixels become means of valid neighbours, pass by pass.

    ``px`` has a row for every pixel, null where missing. Regions touch by corners too.
    Only pixels of small regions, and what is around them, take part in the passes.
    """
    px = px.select("frame", "y", "x", F.col(value).cast("double").alias(value))
    pixels, runs = labelled_runs(px.where(F.col(value).isNull()).select("frame", "y", "x"), diagonal=True)
    sizes = runs.groupBy("region").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_n"))
    few = runs.join(sizes.where(F.col("_n") <= most), "region").select("frame", "y", "x0")
    small = stored(pixels.join(few, ["frame", "y", "x0"], "left_semi").select("frame", "y", "x"), "small-gaps")
    around = neighbours(small).join(px.where(F.col(value).isNotNull()), ["frame", "y", "x"]).groupBy("frame", F.col("ty").alias("y"), F.col("tx").alias("x"))
    now = small.join(around.agg(F.sum(value).alias("_sum"), F.count(value).alias("_n")), ["frame", "y", "x"], "left")
    now = stored(now.select("frame", "y", "x", F.coalesce("_sum", F.lit(0.0)).alias("_sum"), F.coalesce("_n", F.lit(0)).alias("_n"), F.lit(None).cast("double").alias("_new")), "gap-pass")
    for _ in range(passes):
        # What an earlier pass filled counts as valid now.
        made = neighbours(now.where("_new IS NULL").select("frame", "y", "x")).join(now.where("_new IS NOT NULL").select("frame", "y", "x", "_new"), ["frame", "y", "x"])
        made = made.groupBy("frame", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum("_new").alias("_s"), F.count(F.lit(1)).alias("_k"))
        total, count = F.col("_sum") + F.coalesce("_s", F.lit(0.0)), F.col("_n") + F.coalesce("_k", F.lit(0))
        after = stored(now.join(made, ["frame", "y", "x"], "left").select("frame", "y", "x", "_sum", "_n", F.coalesce("_new", F.when(count > 0, total / count)).alias("_new")), "gap-pass")
        discard(now)
        now = after
        if now.where("_new IS NULL").isEmpty():
            break
    filled = now.where("_new IS NOT NULL").select("frame", "y", "x", "_new")
    out = px.join(filled, ["frame", "y", "x"], "left")
    return out.select("frame", "y", "x", F.coalesce(value, "_new").alias(value), F.col("_new").isNotNull().alias("gapfilled"))


def contour_segments(px: DataFrame, level: float, value: str = "v") -> DataFrame:
    """(frame, src, dst, y, x): marching squares between pixel centres; from the crossing ``src`` at (y, x) the contour goes on to ``dst``.

    A crossing lies on the side of a square, between two neighbouring centres, one
    below ``level`` and one not, at the place of linear interpolation. Its number is
    twice the code of the upper or left centre, plus one on a side down. The colder part
    is to the left of each segment, y down, so that every crossing is left once. A square of four
    crossings joins its cold corners if the mean of the four is cold. Squares with
    a missing corner have no segment: contours may end there, and at the raster's edge.
    """
    row, col = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")
    v = F.col(value).cast("double")
    px = px.select("frame", "y", "x", v.alias("a"))
    right = px.withColumn("b", F.when(F.lead("x").over(row) == F.col("x") + 1, F.lead("a").over(row)))
    below = lambda c: F.when(F.lead("y").over(col) == F.col("y") + 1, F.lead(c).over(col))
    square = right.withColumns({"d": below("a"), "c": below("b")}).where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL")
    cold = {k: F.col(k) < level for k in "abcd"}
    square = square.withColumn("_case", sum((cold[k].cast("int") * n for k, n in zip("abcd", (1, 2, 4, 8))), F.lit(0))).where("_case NOT IN (0, 15)")
    code = _code(F.col("frame"), F.col("y"), F.col("x"))
    share = lambda p, q: (F.lit(level) - F.col(p)) / (F.col(q) - F.col(p))
    side = {
        "top": (2 * code, F.col("y").cast("double"), F.col("x") + share("a", "b")),
        "left": (2 * code + 1, F.col("y") + share("a", "d"), F.col("x").cast("double")),
        "bottom": (2 * (code + (1 << BITS)), F.col("y") + 1.0, F.col("x") + share("d", "c")),
        "right": (2 * (code + 1) + 1, F.col("y") + share("b", "c"), F.col("x") + 1.0),
    }
    seg = lambda p, q: F.struct(side[p][0].alias("src"), side[q][0].alias("dst"), side[p][1].alias("y"), side[p][2].alias("x"))
    # Entry and exit side of each case, corners a b c d as bits 1 2 4 8, cold to the left.
    ways = {1: [("left", "top")], 2: [("top", "right")], 3: [("left", "right")], 4: [("right", "bottom")], 6: [("top", "bottom")], 7: [("left", "bottom")],
            8: [("bottom", "left")], 9: [("bottom", "top")], 11: [("bottom", "right")], 12: [("right", "left")], 13: [("right", "top")], 14: [("top", "left")]}
    apart = {5: [("left", "top"), ("right", "bottom")], 10: [("top", "right"), ("bottom", "left")]}
    joined = {5: [("left", "bottom"), ("right", "top")], 10: [("top", "left"), ("bottom", "right")]}
    made = F.array().cast("array<struct<src:bigint,dst:bigint,y:double,x:double>>")
    for case, pairs in ways.items():
        made = F.when(F.col("_case") == case, F.array(*[seg(*p) for p in pairs])).otherwise(made)
    middle = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 < level
    for case in apart:
        made = F.when((F.col("_case") == case) & middle, F.array(*[seg(*p) for p in joined[case]])).when(F.col("_case") == case, F.array(*[seg(*p) for p in apart[case]])).otherwise(made)
    return square.select("frame", F.inline(made))


def chained(segments: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(frame, line, ord, closed, y, x): segments in order along their contours, by pointer doubling.

    ``line`` is the contour's smallest crossing, where a closed one begins; an open one
    begins where nothing leads to. The last crossing of an open contour, which only a ``dst`` names,
    is left out. Every round doubles the stretch that each crossing knows and is stored.
    """
    # Towards the beginning: where each crossing comes from, over how many steps, and the smallest crossing on the way.
    named = connected_components(segments.select("src", "dst")).select(F.col("node").alias("src"), F.col("component").alias("_low"))
    given = segments.join(named, "src")
    into = segments.select(F.col("dst").alias("src"), F.col("src").alias("_from"))
    heads = given.join(into, "src", "left")
    closed = heads.groupBy("_low").agg(F.every(F.col("_from").isNotNull()).alias("closed"))
    heads = heads.join(closed, "_low")
    # A closed contour is cut before its smallest crossing.
    begin = F.col("_from").isNull() | (F.col("closed") & (F.col("src") == F.col("_low")))
    now = stored(heads.select("frame", "src", "y", "x", F.col("_low").alias("line"), "closed", F.when(~begin, F.col("_from")).alias("_back"), F.when(begin, 0).otherwise(1).cast("bigint").alias("ord")), "contours")
    for _ in range(max_rounds):
        if now.where("_back IS NOT NULL").isEmpty():
            break
        far = now.select(F.col("src").alias("_back"), F.col("_back").alias("_further"), F.col("ord").alias("_more"))
        after = stored(now.join(far, "_back", "left").select("frame", "src", "y", "x", "line", "closed", F.col("_further").alias("_back"), (F.col("ord") + F.coalesce("_more", F.lit(0))).alias("ord")), "contours")
        discard(now)
        now = after
    else:
        raise RuntimeError(f"contours of more than 2^{max_rounds} crossings")
    return now.select("frame", "line", "ord", "closed", "y", "x")


def contour_areas(chains: DataFrame) -> DataFrame:
    """(frame, line, crossings, area) of closed contours; positive around cold ground, negative around a hole in it."""
    line = Window.partitionBy("frame", "line").orderBy("ord")
    whole = Window.partitionBy("frame", "line").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(line), F.first(c).over(whole))
    turned = chains.where("closed").withColumn("_a", F.col("y") * after("x") - F.col("x") * after("y"))
    return turned.groupBy("frame", "line").agg(F.count(F.lit(1)).alias("crossings"), (F.sum("_a") / 2).alias("area"))
