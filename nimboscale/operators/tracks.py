"""Objects in frames: statistics, overlap linking, lifecycles and audits, all relational.

Frames are keys, not loops: links of all frame pairs come from one equi-join,
chains from pointer jumping, families from connected components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from nimboscale.functions.scalars import bearing_deg, geodesic, haversine_km
from nimboscale.operators.graph import connected_components
from nimboscale.operators.quantile import with_quantiles
from nimboscale.operators.verify import ratio
from nimboscale.session import stored


def segment_stats(segment: DataFrame, px: DataFrame, value: str = "v", core: float = -0.2, pixel_area: float = 4.0) -> DataFrame:
    """Area, coldest value, cold-core area and plain centroid of each (frame, feature)."""
    met = segment.join(px.select("frame", "y", "x", value), ["frame", "y", "x"])
    return met.groupBy("frame", "feature").agg(
        (F.count(F.lit(1)) * pixel_area).alias("area"), F.min(value).alias("coldest"),
        (F.count_if(F.col(value) < core) * pixel_area).alias("core_area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"),
    )


def cold_centroid(segment: DataFrame, px: DataFrame, reference: float, value: str = "v") -> DataFrame:
    """Centroid weighted by max(0, reference - value); the plain one where all weights are zero."""
    met = segment.join(px.select("frame", "y", "x", value), ["frame", "y", "x"])
    w = F.when(F.col(value).isNotNull(), F.greatest(F.lit(0.0), F.lit(reference) - F.col(value))).otherwise(0.0)
    met = met.withColumn("_w", w)
    centre = lambda c: F.when(F.sum("_w") > 0, F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).otherwise(F.avg(c))
    return met.groupBy("frame", "feature").agg(centre("y").alias("cy"), centre("x").alias("cx"))


def overlaps(segment: DataFrame, dy=0, dx=0, least: float = 0.0) -> DataFrame:
    """Edges (frame, parent, child, overlap_px, overlap_frac) between consecutive frames.

    Parents are moved by (dy, dx), numbers or columns of ``segment``. The
    fraction is of the smaller segment; edges under ``least`` are left out.
    """
    size = segment.groupBy("frame", "feature").agg(F.count(F.lit(1)).alias("n"))
    parent = segment.select("frame", F.col("feature").alias("parent"), (F.col("y") + dy).cast("int").alias("y"), (F.col("x") + dx).cast("int").alias("x"))
    child = segment.select((F.col("frame") - 1).alias("frame"), F.col("feature").alias("child"), "y", "x")
    edges = parent.join(child, ["frame", "y", "x"]).groupBy("frame", "parent", "child").agg(F.count(F.lit(1)).alias("overlap_px"))
    edges = edges.join(size.select("frame", F.col("feature").alias("parent"), F.col("n").alias("_np")), ["frame", "parent"])
    edges = edges.join(size.select((F.col("frame") - 1).alias("frame"), F.col("feature").alias("child"), F.col("n").alias("_nc")), ["frame", "child"])
    frac = F.col("overlap_px") / F.least("_np", "_nc").cast("double")
    return edges.withColumn("overlap_frac", frac).where(F.col("overlap_frac") >= least).select("frame", "parent", "child", "overlap_px", "overlap_frac")


def link_audit(segment: DataFrame, links: DataFrame, shift: DataFrame | None = None) -> DataFrame:
    """How well the segments of each link (frame, parent, child) meet: areas, overlaps, better candidates.

    Adds ``area_ratio`` (child by parent), ``linked_frac`` (overlap by the smaller
    segment) and ``better_other`` (another child overlaps the parent more). With
    ``shift`` (frame, feature, dy, dx) the columns ``moved_frac`` and
    ``moved_better_other`` say the same of the moved parent, null where it has no
    shift. Links of a segment without pixels are left out.
    """
    size = stored(segment.groupBy("frame", "feature").agg(F.count(F.lit(1)).alias("n")), "sizes")
    link = links.select("frame", "parent", "child").join(size.select("frame", F.col("feature").alias("parent"), F.col("n").alias("_np")), ["frame", "parent"])
    link = link.join(size.select((F.col("frame") - 1).alias("frame"), F.col("feature").alias("child"), F.col("n").alias("_nc")), ["frame", "child"])
    keys = ["frame", "parent", "child"]

    def measured(edges: DataFrame, frac: str, other: str, known: DataFrame) -> DataFrame:
        met = known.join(edges.select("frame", "parent", F.col("child").alias("_to"), "overlap_px"), ["frame", "parent"], "left")
        own = F.coalesce(F.max(F.when(F.col("_to") == F.col("child"), F.col("overlap_px"))), F.lit(0))
        best = F.coalesce(F.max(F.when(F.col("_to") != F.col("child"), F.col("overlap_px"))), F.lit(0))
        return met.groupBy(*keys, "_np", "_nc").agg((own / F.least("_np", "_nc")).alias(frac), (best > own).alias(other))

    out = measured(overlaps(segment), "linked_frac", "better_other", link)
    if shift is not None:
        shifts = shift.select("frame", "feature", "dy", "dx").dropna()
        moved = segment.join(shifts, ["frame", "feature"], "left")
        known = link.join(shifts.select("frame", F.col("feature").alias("parent")), ["frame", "parent"], "left_semi")
        out = out.join(measured(overlaps(moved, F.col("dy"), F.col("dx")), "moved_frac", "moved_better_other", known).drop("_np", "_nc"), keys, "left")
    return out.withColumn("area_ratio", F.col("_nc") / F.col("_np")).drop("_np", "_nc")


def marked_best(edges: DataFrame) -> DataFrame:
    """Flags: best child of its parent and best parent of its child; more overlap first, then the smaller id."""
    of = lambda own, other: F.row_number().over(Window.partitionBy("frame", own).orderBy(F.col("overlap_px").desc(), other)) == 1
    return edges.withColumns({"best_child": of("parent", "child"), "best_parent": of("child", "parent")})


def link_events(edges: DataFrame) -> DataFrame:
    """``kind`` of each edge: CONTINUE (best both ways), MERGE (the parent's best child), SPLIT (the child's best parent), else null."""
    kind = F.when(F.col("best_child") & F.col("best_parent"), "CONTINUE").when(F.col("best_child"), "MERGE").when(F.col("best_parent"), "SPLIT")
    return marked_best(edges).withColumn("kind", kind)


def _kinds(edges: DataFrame) -> DataFrame:
    """``edges`` as ``link_events`` gives them; those that have their kinds already, best from a stored table, are taken as they are."""
    return edges if "kind" in edges.columns else link_events(edges)


def chains(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(frame, feature, root_frame, root): pointer jumping along continuations (frame, parent, child) doubles the reach each round."""
    node = links.select((F.col("frame") + 1).alias("frame"), F.col("child").alias("feature"), F.col("frame").alias("root_frame"), F.col("parent").alias("root"))
    now = stored(node, "chains")
    for _ in range(max_rounds):
        up = now.select(F.col("frame").alias("root_frame"), F.col("feature").alias("root"), F.col("root_frame").alias("_f"), F.col("root").alias("_r"))
        after = now.join(up, ["root_frame", "root"], "left").withColumn("_moved", F.col("_f").isNotNull())
        after = stored(after.select("frame", "feature", F.coalesce("_f", "root_frame").alias("root_frame"), F.coalesce("_r", "root").alias("root"), "_moved"), "chains")
        now = after.drop("_moved")
        if after.where("_moved").isEmpty():
            return now
    raise RuntimeError("chains did not settle")


def assign_tracks(segment: DataFrame, edges: DataFrame) -> DataFrame:
    """(frame, feature, cell): ids in the order of the chains' first (frame, feature), from 1; call with all frames.

    Roots are numbered by a global order over chains: counts by root frame give
    each frame its first number, so no task sorts all roots.
    """
    linked = _kinds(edges).where("kind = 'CONTINUE'")
    rooted = chains(linked.select("frame", "parent", "child"))
    nodes = segment.select("frame", "feature").distinct().join(rooted, ["frame", "feature"], "left")
    nodes = nodes.select("frame", "feature", F.coalesce("root_frame", "frame").alias("root_frame"), F.coalesce("root", "feature").alias("root"))
    roots = nodes.select("root_frame", "root").distinct()
    counts = roots.groupBy("root_frame").agg(F.count(F.lit(1)).alias("_n"))
    # One row a frame.
    first = counts.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("root_frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("root_frame").orderBy("root"))
    named = roots.join(first, "root_frame").select("root_frame", "root", (F.col("_first") + rank).cast("long").alias("cell"))
    return nodes.join(named, ["root_frame", "root"]).select("frame", "feature", "cell")


def families(tracks: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell, family): cells that merges or splits join, under their smallest cell."""
    events = _kinds(edges).where("kind IN ('MERGE', 'SPLIT')")
    parent = tracks.select("frame", F.col("feature").alias("parent"), F.col("cell").alias("src"))
    child = tracks.select((F.col("frame") - 1).alias("frame"), F.col("feature").alias("child"), F.col("cell").alias("dst"))
    joined = events.join(parent, ["frame", "parent"]).join(child, ["frame", "child"]).select("src", "dst")
    found = connected_components(joined)
    return tracks.select("cell").distinct().join(found.withColumnRenamed("node", "cell"), "cell", "left").select("cell", F.coalesce("component", "cell").alias("family"))


def genealogy(tracks: DataFrame, edges: DataFrame) -> DataFrame:
    """(frame, kind, from_cell, into_cell, overlap_frac) of merges and splits, at the child's frame."""
    events = _kinds(edges).where("kind IN ('MERGE', 'SPLIT')")
    parent = tracks.select("frame", F.col("feature").alias("parent"), F.col("cell").alias("from_cell"))
    child = tracks.select((F.col("frame") - 1).alias("frame"), F.col("feature").alias("child"), F.col("cell").alias("into_cell"))
    out = events.join(parent, ["frame", "parent"]).join(child, ["frame", "child"])
    return out.select((F.col("frame") + 1).alias("frame"), "kind", "from_cell", "into_cell", "overlap_frac")


# ---- steps and lifecycles ---------------------------------------------------


def by_cell(order: str = "frame"):
    return Window.partitionBy("cell").orderBy(order)


def steps(pos: DataFrame) -> DataFrame:
    """Displacements from the previous row of a cell; ``dframe`` is the frame gap."""
    w = by_cell()
    out = pos.withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w), "dframe": F.col("frame") - F.lag("frame").over(w)})
    return out.where(F.col("dframe").isNotNull()).withColumn("dist", F.hypot("dx", "dy"))


def turns(pos: DataFrame, least: float) -> DataFrame:
    """Consecutive steps, both at least ``least`` long, with the cosine between them.

    The previous step is the previous row of the steps that are one frame long.
    """
    one = steps(pos).where("dframe = 1")
    w = by_cell()
    prev = one.withColumns({"_px": F.lag("dx").over(w), "_py": F.lag("dy").over(w), "_pd": F.lag("dist").over(w)})
    fit = prev.where((F.col("dist") >= least) & (F.col("_pd") >= least))
    return fit.withColumn("cos", (F.col("dx") * F.col("_px") + F.col("dy") * F.col("_py")) / (F.col("dist") * F.col("_pd")))


def movement(fixes: DataFrame, time: str = "frame", seconds: float = 1800.0, sphere: bool = False) -> DataFrame:
    """Speed in km/h and heading between consecutive (lat, lon) of a cell, on the ellipsoid or the display sphere; null at the first."""
    w = by_cell(time)
    la, lo = F.lag("lat").over(w), F.lag("lon").over(w)
    hours = (F.col(time) - F.lag(time).over(w)) * (seconds / 3600)
    out = fixes.withColumns({"_la": la, "_lo": lo, "_h": hours})
    if not sphere:
        out = out.withColumn("_g", geodesic(F.col("_la"), F.col("_lo"), F.col("lat"), F.col("lon")))
        return out.withColumns({"speed_kmh": F.try_divide(F.col("_g.km"), F.col("_h")), "heading_deg": F.col("_g.azimuth")}).drop("_la", "_lo", "_h", "_g")
    km = haversine_km(F.col("_la"), F.col("_lo"), F.col("lat"), F.col("lon"))
    return out.withColumns({"speed_kmh": F.try_divide(km, F.col("_h")), "heading_deg": F.when(km > 0, bearing_deg(F.col("_la"), F.col("_lo"), F.col("lat"), F.col("lon")))}).drop("_la", "_lo", "_h")


def rates(rows: DataFrame, per: float = 1.0) -> DataFrame:
    """Changes per ``per`` frames of min_bt and core area, and the relative change of area (null from a zero area)."""
    w = by_cell()
    gap = F.col("frame") - F.lag("frame").over(w)
    scale = F.lit(per) / gap
    before = F.lag("area").over(w)
    return rows.withColumns({
        "d_min_bt": (F.col("min_bt") - F.lag("min_bt").over(w)) * scale,
        "d_core": (F.col("core") - F.lag("core").over(w)) * scale,
        "area_change_frac": F.try_divide((F.col("area") - before).cast("double"), F.nullif(before, F.lit(0)).cast("double")) * scale,
    })


def phases(rows: DataFrame, warming: float, mature_below: float, steady: float, start_below: float, cooling: float) -> DataFrame:
    """``phase`` of each row from its rates; the first rule that holds speaks, else the last phase persists, at first Unclassified.

    Decaying: warming by ``warming`` or more while the core shrinks. Mature:
    colder than ``mature_below`` with an area change of at most ``steady``.
    Developing: cooling and growing. Initiation, in a cell's first two rows:
    colder than ``start_below`` and cooling by ``cooling`` (negative) or more.
    Null rates make no rule hold.
    """
    w = by_cell()
    d, a = F.col("d_min_bt"), F.col("area_change_frac")
    rule = (
        F.when((d >= warming) & (F.col("d_core") < 0), "Decaying")
        .when((F.col("min_bt") < mature_below) & (F.abs(a) <= steady), "Mature")
        .when((d < 0) & (a > 0), "Developing")
        .when((F.col("_n") <= 2) & (F.col("min_bt") < start_below) & (d <= cooling), "Initiation")
    )
    out = rows.withColumn("_n", F.row_number().over(w)).withColumn("_rule", rule)
    kept = F.last("_rule", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("phase", F.coalesce(kept, F.lit("Unclassified"))).drop("_n", "_rule")


def cell_summary(rows: DataFrame, minutes: int = 30) -> DataFrame:
    """One row a cell from (cell, frame, x, y, min_bt, area, core, d_min_bt, phase); x and y are metres.

    Net motion is from the first to the last position, over the ellipsoid where
    the rows have ``lat`` and ``lon``; cells of one frame have none. Step speeds
    are ``speed_kmh`` where given, else planar. ``touches_missing`` and
    ``family`` add frames touching missing data and the family's cells.
    """
    w, at = by_cell(), F.struct
    if "speed_kmh" not in rows.columns:
        hours = (F.col("frame") - F.lag("frame").over(w)) * (minutes / 60)
        rows = rows.withColumn("speed_kmh", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) / 1000 / hours)
    located = [c for c in ("lat", "lon") if c in rows.columns]
    seen = F.transform(F.array_sort(F.collect_list(at("frame", "phase"))), lambda s: s["phase"])
    more = [F.count_if("touches_missing").alias("frames_touching_missing")] if "touches_missing" in rows.columns else []
    more += [F.min("family").alias("family")] if "family" in rows.columns else []
    out = rows.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        ((F.max("frame") - F.min("frame")) * minutes).alias("lifetime_min"), F.min("min_bt").alias("min_bt"), F.max("area").alias("max_area"), F.max("core").alias("max_core"),
        F.percentile("area", 0.5).alias("median_area"), F.percentile("speed_kmh", 0.5).alias("median_step_speed"), F.min("d_min_bt").alias("largest_cooling"),
        F.min_by(at("x", "y", *located), "frame").alias("_a"), F.max_by(at("x", "y", *located), "frame").alias("_b"), F.array_join(F.array_distinct(seen), ",").alias("phases_seen"), *more,
    )
    dx, dy = F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")
    length, heading = F.hypot(dx, dy), F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))
    if located:
        out = out.withColumn("_g", geodesic(F.col("_a.lat"), F.col("_a.lon"), F.col("_b.lat"), F.col("_b.lon")))
        length, heading = F.col("_g.km") * 1000, F.col("_g.azimuth")
    out = out.withColumns({f"{n}_{c}": F.col(f"_{t}.{c}") for n, t in (("start", "a"), ("end", "b")) for c in ("x", "y", *located)})
    out = out.withColumns({"net_displacement": length, "net_speed": F.try_divide(length / 1000, F.col("lifetime_min") / 60), "net_heading": F.when(F.col("lifetime_min") > 0, heading)}).drop("_a", "_b", "_g")
    if "family" in rows.columns:
        out = out.join(out.groupBy("family").agg(F.count(F.lit(1)).alias("family_size")), "family")
    return out


def with_age(rows: DataFrame, minutes: int = 30) -> DataFrame:
    """Age since the first frame, and whether the row is the cell's last."""
    w = Window.partitionBy("cell")
    return rows.withColumns({"age_min": (F.col("frame") - F.min("frame").over(w)) * minutes, "ends_next": F.col("frame") == F.max("frame").over(w)})


def flow_consistency(one: DataFrame, u: str, v: str) -> DataFrame:
    """Correlation of steps with a flow along each axis, and medians of step, flow and difference lengths."""
    rows = one.withColumns({"_flow": F.hypot(u, v), "_diff": F.hypot(F.col("dx") - F.col(u), F.col("dy") - F.col(v))})
    both = rows.agg(F.corr("dx", u).alias("corr_x"), F.corr("dy", v).alias("corr_y"))
    return with_quantiles(both, rows, [], {"median_step": ("dist", 0.5), "median_flow": ("_flow", 0.5), "median_diff": ("_diff", 0.5)})


def suspicious(one: DataFrame, least: float, far: float) -> DataFrame:
    """Score of a cell: long steps plus reversals over steps."""
    w = by_cell()
    prev = one.withColumns({"_px": F.lag("dx").over(w), "_py": F.lag("dy").over(w), "_pd": F.lag("dist").over(w)})
    back = (F.col("dist") >= least) & (F.col("_pd") >= least) & (F.col("dx") * F.col("_px") + F.col("dy") * F.col("_py") < 0)
    return prev.groupBy("cell").agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(back).alias("reversals"), F.count_if(F.col("dist") > far).alias("jumps"), F.max("dist").alias("longest")
    ).withColumn("score", F.col("reversals") + 2 * F.col("jumps"))


def suspicious_links(one: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """Problem score of a cell: reversals, better candidates and links without overlap.

    ``one`` holds steps of one frame (cell, frame, dx, dy, dist); ``links`` has
    (cell, better_other, linked_frac) of ``link_audit``. Cells without links count none.
    """
    w = by_cell()
    prev = one.withColumns({"_px": F.lag("dx").over(w), "_py": F.lag("dy").over(w), "_pd": F.lag("dist").over(w)})
    back = (F.col("dist") >= least) & (F.col("_pd") >= least) & (F.col("dx") * F.col("_px") + F.col("dy") * F.col("_py") < 0)
    per = prev.groupBy("cell").agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(back).alias("reversals"), F.max("dist").alias("max_step"), F.min("frame").alias("first_frame"))
    met = links.groupBy("cell").agg(F.count(F.lit(1)).alias("seg_links"), F.count_if("better_other").alias("id_switch_candidates"), F.count_if(F.col("linked_frac") == 0).alias("zero_overlap_links"))
    out = per.join(met, "cell", "left").fillna(0, ["seg_links", "id_switch_candidates", "zero_overlap_links"])
    return out.withColumn("problem_score", F.col("reversals") + F.col("id_switch_candidates") + F.col("zero_overlap_links"))


def motion_at(points: DataFrame, motion: DataFrame, height: int, width: int) -> DataFrame:
    """``points`` (frame, y, x, ...) with (u, v) of ``motion`` (frame, y, x, u, v) at the nearest pixel, clipped to the grid; null without motion."""
    near = lambda c, n: F.greatest(F.lit(0), F.least(F.rint(c).cast("int"), F.lit(n - 1)))
    dealt = points.withColumns({"_iy": near("y", height), "_ix": near("x", width)})
    field = motion.select("frame", F.col("y").alias("_iy"), F.col("x").alias("_ix"), "u", "v")
    return dealt.join(field, ["frame", "_iy", "_ix"], "left").drop("_iy", "_ix")


def parent_motion(parents: DataFrame, segment: DataFrame, motion: DataFrame, height: int, width: int) -> DataFrame:
    """``parents`` (frame, feature, y, x, ...) with the mean (u, v) over their segment, or at their position if they have no segment."""
    inside = segment.join(motion.select("frame", "y", "x", "u", "v"), ["frame", "y", "x"]).groupBy("frame", "feature").agg(F.avg("u").alias("_u"), F.avg("v").alias("_v"))
    # The position speaks only for parents without any segment pixel.
    cut = segment.select("frame", "feature").distinct().withColumn("_cut", F.lit(True))
    met = motion_at(parents, motion, height, width).join(inside, ["frame", "feature"], "left").join(cut, ["frame", "feature"], "left")
    pick = lambda c: F.when(F.col("_cut"), F.col(f"_{c}")).otherwise(F.col(c))
    return met.withColumns({"u": pick("u"), "v": pick("v")}).drop("_u", "_v", "_cut")


def field_forecasts(pos: DataFrame, motion: DataFrame, leads: list[int], height: int, width: int) -> DataFrame:
    """Every fix (cell, frame, y, x) moved by the motion field of its own frame, held for all leads, as ``object_forecasts`` rows.

    Frames without a motion field issue nothing.
    """
    issue = motion_at(pos.select("cell", "frame", "y", "x"), motion, height, width).where("u IS NOT NULL")
    issue = issue.withColumn("lead", F.explode(F.array(*[F.lit(n) for n in leads]))).withColumn("_valid", F.col("frame") + F.col("lead"))
    met = issue.join(pos.select("cell", F.col("frame").alias("_valid"), F.col("x").alias("ox"), F.col("y").alias("oy")), ["cell", "_valid"], "left")
    err = F.hypot(F.col("x") + F.col("lead") * F.col("u") - F.col("ox"), F.col("y") + F.col("lead") * F.col("v") - F.col("oy"))
    return met.select("cell", F.col("frame").alias("issue"), "lead", F.lit("field_advection").alias("method"), F.col("ox").isNotNull().alias("survived"), err.alias("err"))


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the corners of the convex hull; points that are not finite are kept."""
    order = np.lexsort((y, x))
    fine = np.isfinite(x[order]) & np.isfinite(y[order])
    odd, order = order[~fine], order[fine]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
    order = order[new]
    px, py, kept = x[order].tolist(), y[order].tolist(), set()
    for way in (range(len(order)), range(len(order) - 1, -1, -1)):
        chain: list[int] = []
        for k in way:
            while len(chain) > 1:
                i, j = chain[-2:]
                if (px[j] - px[i]) * (py[k] - py[i]) - (py[j] - py[i]) * (px[k] - px[i]) > 0:
                    break
                chain.pop()
            chain.append(k)
        kept |= set(chain)
    return np.concatenate([order[sorted(kept)], odd]).astype(np.int64)


def _points(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return part.column("x").to_numpy(), part.column("y").to_numpy()


def _corners(part: pa.Table) -> pa.Table:
    return part.take(pa.array(_hull(*_points(part))))


def _widest(by: list[str], block: int = 1024):
    def run(part: pa.Table) -> pa.Table:
        part = _corners(part)
        x, y = _points(part)
        far = [np.hypot(x[i : i + block, None] - x, y[i : i + block, None] - y).max() for i in range(0, len(x), block)]
        return part.slice(0, 1).select(by).append_column("spread", pa.array([float(np.max(far))]))

    return run


def pairwise_spread(rows: DataFrame, by: list[str], small: int = 64, part: int = 50_000) -> DataFrame:
    """Largest distance between two members (x, y) of a group; groups of one are left out.

    Exact at any size. Groups of up to ``small`` members compare all of them.
    Larger ones are dealt into parts of about ``part`` members; the corners of
    the parts' convex hulls give the group's hull, whose corners are compared.
    """
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    few = rows.join(n.where(F.col("_n") <= small).drop("_n"), by, "left_semi").select(*by, "x", "y")
    # At most ``small`` points a group.
    far = F.transform(F.col("_m"), lambda a: F.array_max(F.transform(F.col("_m"), lambda b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))))
    few = few.groupBy(*by).agg(F.collect_list(F.struct("x", "y")).alias("_m")).select(*by, F.array_max(far).alias("spread"))
    many = rows.join(n.where(F.col("_n") > small), by).where("x IS NOT NULL AND y IS NOT NULL")
    many = many.select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.expr(f"cast(pmod(xxhash64(x, y), ceil(_n / {part})) AS int)").alias("_part"))
    corners = many.groupBy(*by, "_part").applyInArrow(_corners, many.schema)
    keys = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by]
    wide = corners.groupBy(*by).applyInArrow(_widest(by), ", ".join([*keys, "spread double"]))
    known = n.where("_n > 1").where(" AND ".join(f"`{k}` IS NOT NULL" for k in by))
    return known.join(few.unionByName(wide), by, "left").select(*by, F.col("_n").alias("members"), "spread")


def object_forecasts(pos: DataFrame, leads: list[int], window: int = 2) -> DataFrame:
    """Persistence and extrapolation of every fix, matched to the cell's fix at frame + lead.

    The velocity is over ``window`` frames, else over one; frames may be absent,
    so it is looked up by frame, not by row. Fixes without either are left out
    for both methods. ``survived`` is false and the error null where the cell has
    no fix then.
    """
    at = lambda n, tag: pos.select("cell", (F.col("frame") + n).alias("frame"), F.col("x").alias(f"_x{tag}"), F.col("y").alias(f"_y{tag}"))
    known = pos.join(at(window, "w"), ["cell", "frame"], "left").join(at(1, "o"), ["cell", "frame"], "left")
    u = F.coalesce((F.col("x") - F.col("_xw")) / window, F.col("x") - F.col("_xo"))
    v = F.coalesce((F.col("y") - F.col("_yw")) / window, F.col("y") - F.col("_yo"))
    issue = known.withColumns({"u": u, "v": v}).where("u IS NOT NULL").select("cell", F.col("frame").alias("issue"), "x", "y", "u", "v", F.explode(F.array(*[F.lit(n) for n in leads])).alias("lead"))
    seen = pos.select("cell", F.col("frame").alias("_valid"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    met = issue.withColumn("_valid", F.col("issue") + F.col("lead")).join(seen, ["cell", "_valid"], "left")
    out = None
    for method, du, dv in (("persistence", F.lit(0.0), F.lit(0.0)), ("extrapolation", F.col("u"), F.col("v"))):
        err = F.hypot(F.col("x") + F.col("lead") * du - F.col("ox"), F.col("y") + F.col("lead") * dv - F.col("oy"))
        part = met.select("cell", "issue", "lead", F.lit(method).alias("method"), F.col("ox").isNotNull().alias("survived"), err.alias("err"))
        out = part if out is None else out.unionByName(part)
    return out


def forecast_summary(fc: DataFrame) -> DataFrame:
    fc = stored(fc, "forecasts")
    sums = fc.groupBy("method", "lead").agg(
        F.count(F.lit(1)).alias("n"), F.count("err").alias("n_scored"), F.avg(F.col("survived").cast("double")).alias("survival"), F.avg("err").alias("mean"), F.count_distinct("cell").alias("cells")
    )
    return with_quantiles(sums, fc, ["method", "lead"], {"p25": ("err", 0.25), "median": ("err", 0.5), "p75": ("err", 0.75)})


def paired(fc: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """On the rows that both methods score: share where b is closer, and the median difference."""
    wide = fc.groupBy("cell", "issue", *keys).pivot("method", [a, b]).agg(F.first("err")).dropna(subset=[a, b])
    wide = stored(wide.withColumn("_diff", F.col(b) - F.col(a)), "paired")
    sums = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(b) < F.col(a)).cast("double")).alias("closer"))
    return with_quantiles(sums, wide, keys, {"median_diff": ("_diff", 0.5)})


def ar1(rows: DataFrame, by: list[str], x: str, nxt: str) -> DataFrame:
    """Sum of x times next over sum of x squared, on complete pairs."""
    both = rows.where(F.col(x).isNotNull() & F.col(nxt).isNotNull())
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ratio(F.sum(F.col(x) * F.col(nxt)), F.sum(F.col(x) * F.col(x))).alias("phi"))
