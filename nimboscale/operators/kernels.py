"""Sequential raster kernels, each a grouped function on one frame, one issue or one subnet.

A frame's size is fixed, so a task's memory is too, however many frames there
are. Results are not those of any particular tracking library bit for bit.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from nimboscale.operators import regions
from nimboscale.operators.graph import connected_components, minimum_spanning_forest
from nimboscale.operators.preprocess import raster_of
from nimboscale.session import stored

# ---- detection ------------------------------------------------------------------


def detect(px: DataFrame, height: int, width: int, thresholds: list[float], least: int | list[int] = 4, sigma: float = 1.0, value: str = "v") -> DataFrame:
    """(frame, feature, cy, cx, threshold, pixels) by run-length regions, after Gaussian smoothing; see ``regions.detect``."""
    return regions.detect(px, thresholds, least, sigma, value)


def flooded(field: np.ndarray, seeds: list[tuple[int, int, int]], below: float) -> np.ndarray:
    """Watershed: seeds (row, col, label) grow over pixels under ``below``, coldest first; first come, first kept."""
    label = np.zeros(field.shape, int)
    heap: list[tuple[float, int, int, int, int]] = []
    for n, (i, j, k) in enumerate(seeds):
        if field[i, j] < below:
            heapq.heappush(heap, (float(field[i, j]), n, i, j, k))
    turn = len(seeds)
    while heap:
        _, _, i, j, k = heapq.heappop(heap)
        if label[i, j]:
            continue
        label[i, j] = k
        for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
            if 0 <= a < field.shape[0] and 0 <= b < field.shape[1] and not label[a, b] and field[a, b] < below:
                turn += 1
                heapq.heappush(heap, (float(field[a, b]), turn, a, b, k))
    return label


def watershed(px: DataFrame, features: DataFrame, height: int, width: int, below: float, value: str = "v") -> DataFrame:
    """(frame, y, x, feature) of the pixels that a feature's flood reaches."""

    def run(key, pdf: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        field = raster_of(pdf, value, (height, width))
        at = [(min(height - 1, max(0, round(s.cy))), min(width - 1, max(0, round(s.cx))), int(s.feature)) for s in seeds.sort_values("feature").itertuples()]
        label = flooded(field, at, below)
        y, x = np.nonzero(label)
        return pd.DataFrame({"frame": np.full(len(y), key[0]), "y": y, "x": x, "feature": label[y, x]})

    pixels = px.select("frame", "y", "x", value).groupBy("frame")
    return pixels.cogroup(features.select("frame", "feature", "cy", "cx").groupBy("frame")).applyInPandas(run, "frame int, y int, x int, feature int")


def distance(dy: Column, dx: Column) -> Column:
    """Square root of the sum of squares, as SQL writes it, so that ties and the reach fall alike."""
    return F.sqrt(dy * dy + dx * dx)


def link_nearest(features: DataFrame, reach: float) -> DataFrame:
    """(frame, parent, child, dist): pairs of consecutive frames within ``reach``, closest first, each feature once.

    Greedy by distance inside a pair of frames; candidates come from an
    equi-join on cells as wide as the reach, so far pairs are never made.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    a = features.select("frame", F.col("feature").alias("parent"), "cy", "cx", cell("cy").alias("gy"), cell("cx").alias("gx"))
    near = F.sequence(F.lit(-1), F.lit(1))
    a = a.withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near)).withColumns({"gy": F.col("gy") + F.col("_i"), "gx": F.col("gx") + F.col("_j")})
    b = features.select((F.col("frame") - 1).alias("frame"), F.col("feature").alias("child"), F.col("cy").alias("_cy"), F.col("cx").alias("_cx"), cell("cy").alias("gy"), cell("cx").alias("gx"))
    dist = distance(F.col("cy") - F.col("_cy"), F.col("cx") - F.col("_cx"))
    pairs = a.join(b, ["frame", "gy", "gx"]).select("frame", "parent", "child", dist.alias("dist")).where(F.col("dist") <= reach)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, keep = set(), set(), []
        for r in pdf.sort_values(["dist", "parent", "child"]).itertuples(index=False):
            if r.parent not in left and r.child not in right:
                left.add(r.parent)
                right.add(r.child)
                keep.append(r)
        return pd.DataFrame(keep, columns=pdf.columns)

    return pairs.groupBy("frame").applyInPandas(choose, pairs.schema)


def candidate_links(features: DataFrame, later: DataFrame, reach: float, gap: int = 1) -> DataFrame:
    """(frame, parent, child, dist): features and those ``gap`` frames after them within ``reach``, by cells as wide as the reach."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    near = F.sequence(F.lit(-1), F.lit(1))
    a = features.select("frame", F.col("feature").alias("parent"), "cy", "cx", cell("cy").alias("gy"), cell("cx").alias("gx"))
    a = a.withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near)).withColumns({"gy": F.col("gy") + F.col("_i"), "gx": F.col("gx") + F.col("_j")})
    b = later.select((F.col("frame") - gap).alias("frame"), F.col("feature").alias("child"), F.col("cy").alias("_cy"), F.col("cx").alias("_cx"), cell("cy").alias("gy"), cell("cx").alias("gx"))
    dist = distance(F.col("cy") - F.col("_cy"), F.col("cx") - F.col("_cx"))
    return a.join(b, ["frame", "gy", "gx"]).select("frame", "parent", "child", dist.alias("dist")).where(F.col("dist") <= reach)


def least_cost(cost: dict[int, dict[int, float]], alone: float) -> dict[int, int]:
    """Child of each linked parent, at the least sum of costs, an unlinked parent costing ``alone``: shortest augmenting paths, one parent at a time."""
    owner: dict[int, int] = {}
    taken: dict[int, int] = {}
    at_parent, at_child = dict.fromkeys(cost, 0.0), {}
    for start in sorted(cost):
        # Distances by costs less potentials, which stay non-negative; a parent may end the path by giving its child up.
        far, before, heap, done = {}, {}, [], set()
        best, end, reached = None, None, {start: 0.0}

        def leave(p, d):
            nonlocal best, end
            give_up = d + alone - at_parent[p]
            if best is None or give_up < best - 1e-12:
                best, end = give_up, ("parent", p)
            for c, w in cost[p].items():
                if taken.get(p) == c:
                    continue
                step = d + w - at_parent[p] - at_child.get(c, 0.0)
                if c not in far or step < far[c] - 1e-12:
                    far[c], before[c] = step, p
                    heapq.heappush(heap, (step, c))

        leave(start, 0.0)
        while heap:
            d, c = heapq.heappop(heap)
            if c in done or d > far[c]:
                continue
            if best is not None and d >= best - 1e-12:
                break
            done.add(c)
            if c not in owner:
                best, end = d, ("child", c)
                break
            reached[owner[c]] = d
            leave(owner[c], d)
        for p, d in reached.items():
            at_parent[p] += best - d
        for c in done:
            at_child[c] = at_child.get(c, 0.0) - (best - far[c])
        kind, at = end
        if kind == "parent":
            # ``at`` ends unlinked; what it had goes to the parent before it on the path.
            if at == start:
                continue
            c = taken.pop(at)
        else:
            c = at
        while True:
            p = before[c]
            had = taken.get(p)
            taken[p], owner[c] = c, p
            if p == start:
                break
            c = had
    return taken


#: Candidate pairs that one call of the solver takes, whole subnets at a time.
SOLVED = 20_000


def subnets(pairs: DataFrame) -> DataFrame:
    """Candidate pairs (frame, parent, child, dist) with ``_net``, the connected component they belong to, stored."""
    number = lambda feature, side: F.col("frame").cast("bigint") * (1 << 32) + F.col(feature).cast("bigint") * 2 + side
    named = pairs.withColumns({"_u": number("parent", 0), "_v": number("child", 1)})
    net = connected_components(named, "_u", "_v").select(F.col("node").alias("_u"), F.col("component").alias("_net"))
    return stored(named.join(net, "_u").select("frame", "parent", "child", "dist", "_net"), "subnets")


def least_links(nets: DataFrame, reach: float) -> DataFrame:
    """(frame, parent, child, dist) of the links of least total cost of every subnet (``subnets``); many subnets share a call of the solver."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        costs: dict[int, dict[int, dict[int, float]]] = {}
        rows = list(zip(pdf["_net"].tolist(), pdf["parent"].tolist(), pdf["child"].tolist(), pdf["dist"].tolist()))
        for n, p, c, d in rows:
            costs.setdefault(n, {}).setdefault(p, {})[c] = d * d
        chosen = {n: least_cost(cost, reach * reach) for n, cost in costs.items()}
        return pdf.loc[[chosen[n].get(p) == c for n, p, c, _ in rows], ["frame", "parent", "child", "dist"]]

    parts = max(1, -(-nets.count() // SOLVED))
    dealt = nets.withColumn("_part", F.pmod(F.xxhash64("_net"), F.lit(parts)))
    return dealt.groupBy("_part").applyInPandas(solve, nets.drop("_net").schema)


def link_optimal(features: DataFrame, reach: float, memory: int = 0) -> DataFrame:
    """(frame, parent, child, gap, dist): links of least total cost between features of consecutive frames.

    A link costs its squared distance, a feature left without a child the squared
    ``reach``. Features fall into subnets, the connected components of the
    candidate pairs, and each is solved by itself, exactly. With ``memory``, what ended without a
    child then meets what began without a parent two frames on, and so on to ``memory`` + 1.
    A subnet stays in one task: it holds features that candidates chain together, not a frame.
    """
    links, ends, starts = None, features, features
    for gap in range(1, memory + 2):
        found = least_links(subnets(stored(candidate_links(ends, starts, reach, gap), "candidate-links")), reach)
        found = stored(found.select("frame", "parent", "child", F.lit(gap).alias("gap"), "dist"), "links")
        links = found if links is None else links.unionByName(found)
        if gap <= memory:
            ends = stored(ends.join(found.select("frame", F.col("parent").alias("feature")), ["frame", "feature"], "left_anti"), "link-ends")
            starts = stored(starts.join(found.select((F.col("frame") + gap).alias("frame"), F.col("child").alias("feature")), ["frame", "feature"], "left_anti"), "link-starts")
    return links


def end_links(tracks: DataFrame, reach: float, gap: int = 1) -> DataFrame:
    """(src, dst, length) of cells one of which ends within ``reach`` of another's start or course, ``gap`` frames apart at most; the least distance of each pair."""
    ends = tracks.groupBy("cell").agg(F.max("frame").alias("frame"), F.max_by(F.struct("cy", "cx"), "frame").alias("at"))
    ends = ends.select(F.col("cell").alias("src"), F.explode(F.sequence(F.col("frame"), F.col("frame") + gap)).alias("frame"), "at.cy", "at.cx")
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    near = F.sequence(F.lit(-1), F.lit(1))
    a = ends.withColumns({"gy": cell("cy"), "gx": cell("cx")}).withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near))
    a = a.withColumns({"gy": F.col("gy") + F.col("_i"), "gx": F.col("gx") + F.col("_j")})
    b = tracks.select(F.col("cell").alias("dst"), "frame", F.col("cy").alias("_cy"), F.col("cx").alias("_cx"), cell("cy").alias("gy"), cell("cx").alias("gx"))
    met = a.join(b, ["frame", "gy", "gx"]).where(F.col("src") != F.col("dst"))
    length = F.hypot(F.col("cy") - F.col("_cy"), F.col("cx") - F.col("_cx"))
    return met.withColumn("length", length).where(F.col("length") <= reach).groupBy("src", "dst").agg(F.min("length").alias("length"))


def end_forest(tracks: DataFrame, reach: float, gap: int = 1) -> DataFrame:
    """(src, dst, weight): the merge and split links kept, a minimum spanning forest of ``end_links`` by length."""
    return minimum_spanning_forest(end_links(tracks, reach, gap), weight="length")


# ---- motion and extrapolation --------------------------------------------------------


def _half(a: np.ndarray) -> np.ndarray:
    h, w = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
    return a[:h, :w].reshape(h // 2, 2, w // 2, 2).mean((1, 3))


def sampled(field: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values; missing outside the grid and where a needed corner is missing."""
    h, w = field.shape
    inside = (y >= 0) & (y <= h - 1) & (x >= 0) & (x <= w - 1)
    i, j = np.clip(np.floor(y).astype(int), 0, max(0, h - 2)), np.clip(np.floor(x).astype(int), 0, max(0, w - 2))
    a, b = y - i, x - j
    i2, j2 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    out = np.zeros(y.shape)
    for weight, value in (((1 - a) * (1 - b), field[i, j]), ((1 - a) * b, field[i, j2]), (a * (1 - b), field[i2, j]), (a * b, field[i2, j2])):
        out += np.where(weight > 1e-12, weight * value, 0.0)
    return np.where(inside, out, np.nan)


def motion_between(first: np.ndarray, second: np.ndarray, levels: int = 3, rounds: int = 6, block: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) in pixels a step on blocks: pyramid Lucas-Kanade on two fields without missing values.

    Each block solves the structure tensor of its window; blocks without
    texture take the mean of the others.
    """
    pyramid = [(first, second)]
    for _ in range(levels - 1):
        if min(pyramid[-1][0].shape) < 4 * 4:
            break
        pyramid.append((_half(pyramid[-1][0]), _half(pyramid[-1][1])))
    u = v = 0.0
    fu = fv = None
    for k, (a, b) in reversed(list(enumerate(pyramid))):
        u, v = (0.0, 0.0) if fu is None else (2 * u, 2 * v)
        h, w = a.shape
        yy, xx = np.meshgrid(np.arange(h, dtype=float), np.arange(w, dtype=float), indexing="ij")
        size = max(4, block) if k == 0 else max(h, w)
        rows, cols = -(-h // size), -(-w // size)
        fu, fv = np.full((rows, cols), u), np.full((rows, cols), v)
        for _ in range(rounds):
            mu, mv = (np.repeat(np.repeat(f, size, 0), size, 1)[:h, :w] for f in (fu, fv))
            moved = sampled(b, yy + mv, xx + mu)
            gy, gx = np.gradient(a)
            dt = moved - a
            ok = ~np.isnan(dt)

            def total(q):
                q = np.where(ok, q, 0.0)
                q = np.pad(q, ((0, rows * size - h), (0, cols * size - w)))
                return q.reshape(rows, size, cols, size).sum((1, 3))

            xx2, yy2, xy, xt, yt = total(gx * gx), total(gy * gy), total(gx * gy), total(gx * dt), total(gy * dt)
            det = xx2 * yy2 - xy * xy
            good = det > 1e-6 * np.maximum(1e-30, (xx2 + yy2) ** 2)
            du = np.where(good, -(yy2 * xt - xy * yt) / np.where(good, det, 1), 0)
            dv = np.where(good, -(xx2 * yt - xy * xt) / np.where(good, det, 1), 0)
            fu, fv = fu + np.clip(du, -2, 2), fv + np.clip(dv, -2, 2)
            if good.any() and not good.all():
                fu, fv = np.where(good, fu, fu[good].mean()), np.where(good, fv, fv[good].mean())
        u, v = float(np.median(fu)), float(np.median(fv))
    h, w = first.shape
    size = max(4, block)
    return tuple(np.repeat(np.repeat(f, size, 0), size, 1)[:h, :w] for f in (fu, fv))


def advected(field: np.ndarray, u: np.ndarray, v: np.ndarray, steps: int) -> list[np.ndarray]:
    """Fields at 1 .. steps by backward trajectories along a fixed motion; inflow is missing."""
    yy, xx = np.meshgrid(np.arange(field.shape[0], dtype=float), np.arange(field.shape[1], dtype=float), indexing="ij")
    y, x, out = yy.copy(), xx.copy(), []
    for _ in range(steps):
        # Midpoint rule; beyond the edge the nearest motion holds.
        at = lambda f, a, b: sampled(f, np.clip(a, 0, f.shape[0] - 1), np.clip(b, 0, f.shape[1] - 1))
        my, mx = y - at(v, y, x) / 2, x - at(u, y, x) / 2
        y, x = y - at(v, my, mx), x - at(u, my, mx)
        out.append(sampled(field, y, x))
    return out


def _mean_motion(parts: dict[int, np.ndarray], k: int, frames: int, reference: float) -> tuple[np.ndarray, np.ndarray]:
    cold = {f: np.nan_to_num(np.maximum(0.0, reference - a)) for f, a in parts.items()}
    pairs = [motion_between(cold[f], cold[f + 1]) for f in range(k - frames + 1, k)]
    return np.mean([p[0] for p in pairs], 0), np.mean([p[1] for p in pairs], 0)


def motion_fields(px: DataFrame, height: int, width: int, reference: float, frames: int = 3, value: str = "v") -> DataFrame:
    """(frame, y, x, u, v): the motion that ``extrapolate`` uses at each issue frame, in pixels a step, as a table to look steps up in."""
    dealt = px.select("frame", "y", "x", value, F.explode(F.sequence(F.col("frame"), F.col("frame") + frames - 1)).alias("issue"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["issue"].iloc[0])
        parts = {int(f): raster_of(g, value, (height, width)) for f, g in pdf.groupby("frame")}
        if set(parts) != set(range(k - frames + 1, k + 1)):
            return pd.DataFrame({n: pd.Series([], dtype=float) for n in ("frame", "y", "x", "u", "v")})
        u, v = _mean_motion(parts, k, frames, reference)
        yy, xx = (a.ravel() for a in np.meshgrid(np.arange(height), np.arange(width), indexing="ij"))
        return pd.DataFrame({"frame": k, "y": yy, "x": xx, "u": u.ravel(), "v": v.ravel()})

    return dealt.groupBy("issue").applyInPandas(run, "frame int, y int, x int, u double, v double")


def extrapolate(px: DataFrame, height: int, width: int, leads: list[int], reference: float, frames: int = 3, value: str = "v") -> DataFrame:
    """(issue, lead, y, x, forecast, tendency, speed): motion of the coldness over the last frames, then semi-Lagrangian advection.

    An issue reads its own frame and the ``frames - 1`` before it, never a later
    one; the tendency is the last change of the field, moved along. Issues
    without all those frames give nothing.
    """
    issue = F.explode(F.sequence(F.col("frame"), F.col("frame") + frames - 1))
    dealt = px.select("frame", "y", "x", value, issue.alias("issue"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["issue"].iloc[0])
        parts = {int(f): raster_of(g, value, (height, width)) for f, g in pdf.groupby("frame")}
        names = ["issue", "lead", "y", "x", "forecast", "tendency", "speed"]
        if set(parts) != set(range(k - frames + 1, k + 1)):
            return pd.DataFrame({n: pd.Series([], dtype=float) for n in names})
        u, v = _mean_motion(parts, k, frames, reference)
        moved = advected(parts[k], u, v, max(leads))
        drift = advected(parts[k] - parts[k - 1], u, v, max(leads))
        yy, xx = (a.ravel() for a in np.meshgrid(np.arange(height), np.arange(width), indexing="ij"))
        none = lambda a: pd.Series(a.ravel()).astype("Float64").mask(np.isnan(a.ravel()))
        return pd.concat([pd.DataFrame({"issue": k, "lead": n, "y": yy, "x": xx, "forecast": none(moved[n - 1]), "tendency": none(drift[n - 1]), "speed": np.hypot(u, v).ravel()}) for n in leads])

    return dealt.groupBy("issue").applyInPandas(run, "issue int, lead int, y int, x int, forecast double, tendency double, speed double")


#: Names and order of the predictors. Stored samples and models go by them.
FEATURES = [
    "lead_min", "adv_bt", "adv_frac11", "adv_frac31", "adv_min11", "adv_valid_frac31", "pers_bt", "pers_frac31", "pers_min11", "tend30",
    "adv_tend", "adv_tend_mean31", "speed_px", "dom_cold_frac", "dom_cold_change60", "valid_hour_sin", "valid_hour_cos",
]


def issue_features(px: DataFrame, forecast: DataFrame, event: float, minutes: int = 30, value: str = "v") -> DataFrame:
    """(issue, lead, y, x) with the predictors FEATURES of every pixel; nothing after the issue is read but the clock.

    ``adv_*``: the moved field, its event shares in 11 and 31 pixel boxes, its
    box minimum, its valid share, and the moved tendency; ``pers_*``: the issue's
    own field; ``dom_*``: the frame's cold share and its change over two frames.
    """
    import math

    from nimboscale.operators.raster import box

    # All boxes of a table share its two exchanges; shares are of the full box, so nulls and what lies outside count as no event.
    hit = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    share_of = lambda c, size: F.col(c) / F.lit(float(size * size))
    now = box(px.select("frame", "y", "x", value).withColumn("_e", hit(F.col(value) < event)), 11, _f31=("sum", "_e", 31), pers_min11=("min", value))
    now = now.withColumn("pers_frac31", share_of("_f31", 31))
    last = px.select((F.col("frame") + 1).alias("frame"), "y", "x", F.col(value).alias("_last"))
    now = now.join(last, ["frame", "y", "x"], "left").withColumn("tend30", F.col(value) - F.col("_last"))
    now = now.select(F.col("frame").alias("issue"), "y", "x", F.col(value).alias("pers_bt"), "pers_frac31", "pers_min11", "tend30")
    # The box operators' frame is a forecast's (issue, lead) here.
    fc = forecast.withColumns({"frame": F.struct("issue", "lead")}).drop("issue", "lead")
    fc = fc.withColumns({"_e": hit(F.col("forecast") < event), "_ok": hit(F.col("forecast").isNotNull()), "_one": hit(F.col("tendency").isNotNull())})
    fc = box(fc, 31, _f11=("sum", "_e", 11), _f31=("sum", "_e"), _v31=("sum", "_ok"), adv_min11=("min", "forecast", 11), _sum=("sum", "tendency"), _count=("sum", "_one"))
    fc = fc.select("frame.*", "y", "x", "forecast", "tendency", "speed", "adv_min11", share_of("_f11", 11).alias("adv_frac11"), share_of("_f31", 31).alias("adv_frac31"),
                   share_of("_v31", 31).alias("adv_valid_frac31"), F.try_divide("_sum", F.col("_count").cast("double")).alias("adv_tend_mean31"))
    share = px.groupBy(F.col("frame").alias("issue")).agg(F.coalesce(F.avg(F.when(F.col(value).isNotNull(), (F.col(value) < event).cast("double"))), F.lit(0.0)).alias("dom_cold_frac"))
    before = share.select((F.col("issue") + 2).alias("issue"), F.col("dom_cold_frac").alias("_before"))
    share = share.join(before, "issue", "left").withColumn("dom_cold_change60", F.col("dom_cold_frac") - F.col("_before"))
    turn = F.pmod((F.col("issue") + F.col("lead")) * minutes, F.lit(1440)) * (2 * math.pi / 1440)
    named = fc.join(now, ["issue", "y", "x"]).join(share, "issue").withColumns({
        "lead_min": (F.col("lead") * minutes).cast("double"), "adv_bt": F.col("forecast"), "adv_tend": F.col("tendency"), "speed_px": F.col("speed"),
        "valid_hour_sin": F.sin(turn), "valid_hour_cos": F.cos(turn),
    })
    return named.select("issue", "lead", "y", "x", *FEATURES)
