"""Run-length regions, detection, gap filling, links, forests and contours against small brute-force versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimboscale.operators import kernels as K, regions as R
from nimboscale.operators.graph import minimum_spanning_forest
from tests.test_engine import grid


def flood(mask, diagonal):
    """{pixel: first pixel in scan order of its region}."""
    left, out = {tuple(p) for p in np.argwhere(mask).tolist()}, {}
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for start in sorted(left):
        if start in out:
            continue
        todo = [start]
        out[start] = start
        while todo:
            y, x = todo.pop()
            for a, b in steps:
                p = (y + a, x + b)
                if p in left and p not in out:
                    out[p] = start
                    todo.append(p)
    return out


def spiral(n):
    """A one-pixel path that winds inwards: one long region of many runs."""
    mask, y, x, dy, dx = np.zeros((n, n), bool), 0, 0, 0, 1
    mask[0, 0] = True
    for step in [n - 1, n - 1, n - 1] + [k for k in range(n - 3, 0, -2) for _ in (0, 1)]:
        for _ in range(step):
            y, x = y + dy, x + dx
            mask[y, x] = True
        dy, dx = dx, -dy
    return mask


@pytest.mark.parametrize("diagonal", [False, True])
def test_regions_equal_floods(spark, diagonal):
    rng = np.random.default_rng(4)
    masks = [rng.random((30, 150)) < 0.55, spiral(31), np.ones((5, 200), bool), np.zeros((3, 3), bool)]
    rows = [(t, y, x) for t, m in enumerate(masks) for y, x in np.argwhere(m).tolist()]
    got = R.regions(spark.createDataFrame(rows, "frame int, y int, x int"), diagonal).collect()
    low = (1 << R.BITS) - 1
    seen = {(r.frame, r.y, r.x): (r.region >> R.BITS & low, r.region & low) for r in got}
    assert len(seen) == len(rows) and all(r.region >> 2 * R.BITS == r.frame for r in got)
    for t, m in enumerate(masks):
        for p, first in flood(m, diagonal).items():
            assert seen[(t, *p)] == first


def test_detection_equals_nested_floods(spark):
    rng = np.random.default_rng(5)
    fields = [rng.normal(250, 10, (24, 40)), np.where(rng.random((24, 40)) < 0.2, np.nan, rng.normal(250, 10, (24, 40)))]
    levels, least = [252.0, 246.0, 240.0], [6, 3, 2]
    got = sorted((r.frame, round(r.cy, 6), round(r.cx, 6), r.threshold, r.pixels) for r in R.detect(grid(spark, fields), levels, least).collect())
    want = []
    for t, f in enumerate(fields):
        kept = []
        for level, few in sorted(zip(levels, least), reverse=True):
            groups = {}
            for p, first in flood(np.nan_to_num(f, nan=np.inf) < level, False).items():
                groups.setdefault(first, []).append(p)
            new = [(level, set(ps)) for ps in groups.values() if len(ps) >= few]
            kept = [k for k in kept if not any(k[1] & n[1] for n in new)] + new
        for level, ps in kept:
            w = [level - f[p] for p in ps]
            want.append((t, round(sum(p[0] * k for p, k in zip(ps, w)) / sum(w), 6), round(sum(p[1] * k for p, k in zip(ps, w)) / sum(w), 6), level, len(ps)))
    assert got == sorted(want)
    numbers = [(r.frame, r.feature) for r in R.detect(grid(spark, fields), levels, least).orderBy("frame", "cy", "cx").collect()]
    assert all(n == m for (_, n), m in zip([x for x in numbers if x[0] == 0], itertools.count(1)))


def test_smoothing_means_over_valid_pixels(spark):
    f = np.full((9, 9), 5.0)
    f[4, 4] = np.nan
    f[0, 0] = 14.0
    got = {(r.y, r.x): r.v for r in R.smooth(grid(spark, [f]), 1.0).collect()}
    k = [math.exp(-0.5 * d * d) for d in range(4)]
    assert got[4, 4] is None and got[8, 8] == pytest.approx(5) and got[3, 4] == pytest.approx(5)
    assert got[0, 0] == pytest.approx(5 + 9 / sum(k) ** 2)


def test_gaps_of_any_size(spark):
    f = np.arange(400.0).reshape(20, 20)
    f[2, 2] = f[3, 3] = f[4, 2] = np.nan  # touch by corners: one gap of three
    f[10, 10] = f[10, 11] = f[10, 12] = f[11, 11] = f[9, 11] = np.nan  # five: too large
    f[:, 19] = np.nan
    got = {(r.y, r.x): (r.v, r.gapfilled) for r in R.gap_fill(grid(spark, [f])).collect()}
    around = [f[a, b] for a in (1, 2, 3) for b in (1, 2, 3) if not np.isnan(f[a, b])]
    assert got[2, 2] == (pytest.approx(np.mean(around)), True) and got[3, 3][1] and got[4, 2][1]
    assert got[10, 11] == (None, False) and got[5, 19] == (None, False) and got[0, 0] == (0.0, False)
    assert sum(g for _, g in got.values()) == 3 and len(got) == 400
    # A gap without any valid neighbour stays; one reached only through what was filled is filled in a later pass.
    alone = np.full((2, 2), np.nan)
    line = np.array([[1.0, np.nan, np.nan, np.nan]])
    out = {(r.frame, r.y, r.x): r.v for r in R.gap_fill(grid(spark, [alone]).unionByName(grid(spark, [line]).withColumn("frame", F.lit(1)))).collect()}
    assert out[0, 0, 0] is None and [out[1, 0, x] for x in range(4)] == [1.0, 1.0, 1.0, 1.0]


def cost_of(links, cost, reach):
    return sum(cost[p, c] for p, c in links) + (len({p for p, _ in cost}) - len(links)) * reach * reach


def test_least_cost_equals_all_assignments():
    rng = random.Random(7)
    for _ in range(150):
        parents, children = rng.randint(1, 6), rng.randint(1, 6)
        cost = {(p, c): round(rng.random() * 9, 2) for p in range(parents) for c in range(children) if rng.random() < 0.6}
        if not cost:
            continue
        nested = {}
        for (p, c), w in cost.items():
            nested.setdefault(p, {})[c] = w
        got = K.least_cost(nested, 9.0)
        assert len(set(got.values())) == len(got) and all((p, c) in cost for p, c in got.items())
        known = sorted(nested)
        best = math.inf
        for choice in itertools.product(*[[None, *nested[p]] for p in known]):
            used = [c for c in choice if c is not None]
            if len(set(used)) == len(used):
                best = min(best, sum(9.0 if c is None else nested[p][c] for p, c in zip(known, choice)))
        assert sum(nested[p][c] for p, c in got.items()) + 9.0 * (len(known) - len(got)) == pytest.approx(best)


def test_links_where_the_closest_first_is_wrong(spark):
    """Two features move right by 2; the closest pair is the wrong one."""
    rows = [(0, 1, 0.0, 0.0), (0, 2, 0.0, 3.0), (1, 1, 0.0, 2.0), (1, 2, 0.0, 5.0), (0, 9, 50.0, 50.0), (2, 7, 50.0, 51.0)]
    df = spark.createDataFrame(rows, "frame int, feature int, cy double, cx double")
    greedy = {(r.parent, r.child) for r in K.link_nearest(df, 4.0).collect()}
    best = {(r.frame, r.parent, r.child, r.gap) for r in K.link_optimal(df, 4.0).collect()}
    assert greedy == {(2, 1)} and best == {(0, 1, 1, 1), (0, 2, 2, 1)}
    assert {(r.frame, r.parent, r.child, r.gap) for r in K.link_optimal(df, 4.0, memory=1).collect()} == best | {(0, 9, 7, 2)}


def test_spanning_forest_equals_kruskal(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(120), rng.randrange(120), rng.choice([1.0, 2.0, 2.5, 7.0])) for _ in range(260)]
    edges += [(i, i + 1, 0.5) for i in range(200, 260)] + [(5, 5, 0.1), (None, 3, 1.0), (3, 4, None)]
    got = {(r.src, r.dst, r.weight) for r in minimum_spanning_forest(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()}
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    want = set()
    for w, a, b in sorted({(w, min(a, b), max(a, b)) for a, b, w in edges if a is not None and w is not None and a != b}):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, w))
    assert got == want
    assert minimum_spanning_forest(spark.createDataFrame([], "src long, dst long, weight double")).count() == 0


def test_contours_of_known_shapes(spark):
    f = np.full((7, 9), 10.0)
    f[3, 3] = 0.0  # a lone cold pixel: four crossings half way, a diamond of area one half
    cone = np.hypot(*np.meshgrid(np.arange(41) - 20.0, np.arange(41) - 20.0, indexing="ij"))
    ring = np.where(cone < 5, 20.0, cone)  # a hole in the cold ground
    edge = np.tile(np.arange(6.0), (5, 1))  # a straight open contour
    segments = R.contour_segments(grid(spark, [f]), 5.0)
    chains = R.chained(segments)
    rows = chains.orderBy("ord").collect()
    assert [(r.y, r.x) for r in rows] == [(2.5, 3.0), (3.0, 2.5), (3.5, 3.0), (3.0, 3.5)] and all(r.closed for r in rows)
    assert R.contour_areas(chains).first()["area"] == pytest.approx(0.5)
    areas = sorted(r["area"] for r in R.contour_areas(R.chained(R.contour_segments(grid(spark, [ring]), 12.0))).collect())
    assert len(areas) == 2 and areas[1] == pytest.approx(math.pi * 144, rel=0.01) and -90 < areas[0] < -60
    line = R.chained(R.contour_segments(grid(spark, [edge]), 2.5)).orderBy("ord").collect()
    assert not any(r.closed for r in line) and {r.x for r in line} == {2.5} and [r.ord for r in line] == list(range(len(line)))


def test_random_contours_close_and_have_the_floods_signs(spark):
    """Interior contours are closed; outer ones number the cold regions, inner ones the holes."""
    rng = np.random.default_rng(11)
    f = np.pad(rng.normal(0, 1, (18, 26)), 2, constant_values=9.0)
    chains = R.chained(R.contour_segments(grid(spark, [f]), 0.0))
    areas = R.contour_areas(chains).collect()
    assert chains.where("NOT closed").count() == 0
    cold = f < 0
    # Cold squares' corners join where the middle is cold: regions lie between the side-connected and the corner-connected ones.
    outer = sum(r["area"] > 0 for r in areas)
    assert len(set(flood(cold, True).values())) <= outer <= len(set(flood(cold, False).values()))
    order = chains.groupBy("line").agg(F.count("ord").alias("n"), F.count_distinct("ord").alias("k"), F.max("ord").alias("m")).collect()
    assert all(r.n == r.k == r.m + 1 for r in order)


def test_scattered_frames_close_by_time_and_late_rows_show(spark, tmp_path):
    from nimboscale.streaming.frames import ROCKS, link_scattered_frames

    schema = "event string, time timestamp, frame int, y int, x int, feature int"
    base = 1_700_000_000
    row = lambda frame, y, x, feature: ("e", base + frame * 1800, frame, y, x, feature)
    batches = [
        [row(0, 1, 1, 5), row(1, 1, 1, 7)],  # frame 0 is not whole yet
        [row(0, 1, 2, 5), row(0, 5, 5, 6), row(1, 1, 2, 7)],
        [row(3, 0, 0, 1)],  # lets frames 0 and 1 be closed with the next batch
        [row(3, 0, 1, 1)],
        [row(1, 9, 9, 8), row(2, 1, 1, 4), row(0, 3, 3, 2)],  # frames 0 and 1 are closed, 2 is not
        [row(60, 0, 0, 1)],
        [row(61, 0, 0, 1)],
    ]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event string, time long, frame int, y int, x int, feature int")
        df.withColumn("time", F.timestamp_seconds("time")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        flow = link_scattered_frames(stream, 16, 60)
        flow.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    got = {(r.frame, r.feature): (r.cell, r.late) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got[0, 5] == (1, False) and got[0, 6] == (2, False) and got[1, 7] == (1, False)
    assert got[1, 8] == (None, True) and got[0, 2] == (None, True)
    assert got[2, 4] == (1, False) and got[3, 1] == (3, False)
