"""Operators of the gridded engine: golden values, invariants, causality."""

import gzip
import math
import os
import shutil
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from nimboscale.functions import scalars as S
from nimboscale.operators import kernels as K, ml, preprocess as P, products, raster as R, resample as B, tracks as T, verify as V
from nimboscale.operators.graph import connected_components
from nimboscale.plans import standins
from nimboscale.sources import io


def grid(spark, fields):
    rows = [(t, y, x, None if np.isnan(v) else float(v)) for t, f in enumerate(fields) for (y, x), v in np.ndenumerate(np.asarray(f, float))]
    return spark.createDataFrame(rows, "frame int, y int, x int, v double")


def as_array(df, value, shape, frame=0):
    out = np.full(shape, np.nan)
    for r in df.where(F.col("frame") == frame).collect():
        out[r.y, r.x] = np.nan if r[value] is None else r[value]
    return out


def test_contingency_golden(spark):
    df = spark.createDataFrame([(a, b, c) for a, b, c in zip([1, 1, 0, 0, 1], [1, 0, 1, 0, 1], [1, 1, 1, 1, 0])], "f int, o int, ok int")
    flags = df.withColumns({"f": F.col("f") == 1, "o": F.col("o") == 1})
    r = V.cat_scores(V.contingency(flags, [], "f", "o", F.col("ok") == 1)).first()
    assert (r.H, r.M, r.F, r.CN, r.pod, r.far, r.bias) == (1, 1, 1, 1, 0.5, 0.5, 1.0) and r.csi == pytest.approx(1 / 3)
    none = V.cat_scores(V.contingency(flags.limit(0), [], "f", "o")).first()
    assert none.csi is None and none.bias is None


def test_box_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    f = rng.normal(size=(9, 11))
    f[rng.random(f.shape) < 0.2] = np.nan
    px = grid(spark, [f]).withColumn("e", F.col("v") < 0)
    for n in (3, 4, 5):
        lo, hi = R.offsets(n)
        frac, low, mean = (as_array(d, c, f.shape) for d, c in ((R.box_fraction(px, "e", n), "fraction"), (R.box_min(px, "v", n), "box_min"), (R.box_mean(px, "v", n), "box_mean")))
        for (y, x), _ in np.ndenumerate(f):
            part = f[max(0, y + lo) : y + hi + 1, max(0, x + lo) : x + hi + 1]
            assert frac[y, x] == pytest.approx((part < 0).sum() / n**2)
            if np.isnan(part).all():
                assert np.isnan(low[y, x]) and np.isnan(mean[y, x])
            else:
                assert low[y, x] == np.nanmin(part) and mean[y, x] == pytest.approx(np.nanmean(part))


def test_fss_golden(spark):
    def fss(a, b):
        one = lambda m: R.box_fraction(grid(spark, [m]).withColumn("e", F.col("v") > 0), "e", 3).select("y", "x", "fraction")
        j = one(a).withColumnRenamed("fraction", "pf").join(one(b).withColumnRenamed("fraction", "po"), ["y", "x"])
        return V.fss(j, [], "pf", "po").first().fss

    a, b = np.zeros((20, 20)), np.zeros((20, 20))
    a[5:8, 5:8], b[15:18, 15:18] = 1, 1
    assert fss(a, a) == pytest.approx(1.0) and fss(a, b) == pytest.approx(0.0)


def test_shifted_iou_golden(spark):
    def iou(a, b, dy, dx, shape):
        one = lambda m: spark.createDataFrame([(0, int(y), int(x)) for y, x in zip(*np.nonzero(m))], "k int, y int, x int")
        r = R.shifted_iou(one(a), one(b), ["k"], dy, dx, *shape).first()
        return None if r is None else r.iou

    a, b = np.zeros((6, 6)), np.zeros((6, 6))
    a[1:3, 1:3], b[2:4, 3:5] = 1, 1
    assert iou(a, b, 1, 2, (6, 6)) == 1.0 and iou(a, b, 0, 0, (6, 6)) == 0.0 and iou(a, b, 6, 0, (6, 6)) == 0.0
    assert iou(a, a * 0, 9, 9, (6, 6)) is None


def test_overlap_links_golden(spark):
    def seg(blocks):
        return spark.createDataFrame([(t, y, x, f) for t, f, ys, xs in blocks for y in range(*ys) for x in range(*xs)], "frame int, y int, x int, feature int")

    two = seg([(0, 1, (0, 4), (0, 4)), (0, 2, (0, 4), (6, 10)), (1, 1, (0, 4), (0, 10)), (2, 1, (0, 4), (0, 5)), (2, 2, (0, 4), (6, 9))])
    edges = T.overlaps(two, least=0.2)
    cells = {(r.frame, r.feature): r.cell for r in T.assign_tracks(two, edges).collect()}
    assert cells[0, 1] == cells[1, 1] == cells[2, 1] == 1 and cells[0, 2] == 2 and cells[2, 2] == 3
    kinds = sorted((r.frame, r.kind, r.from_cell, r.into_cell) for r in T.genealogy(T.assign_tracks(two, edges), edges).collect())
    assert kinds == [(1, "MERGE", 2, 1), (2, "SPLIT", 1, 3)]
    assert {r.family for r in T.families(T.assign_tracks(two, edges), edges).collect()} == {1}
    apart = seg([(0, 1, (0, 2), (0, 2)), (1, 1, (6, 8), (6, 8))])
    assert T.overlaps(apart).count() == 0 and T.assign_tracks(apart, T.overlaps(apart)).agg(F.count_distinct("cell")).first()[0] == 2
    edge = seg([(0, 1, (0, 4), (0, 5)), (1, 1, (3, 7), (4, 9))])
    assert T.overlaps(edge, least=0.2).count() == 0 and T.overlaps(edge, least=0.05).first().overlap_px == 1
    moved = seg([(0, 1, (0, 3), (0, 3)), (1, 2, (0, 3), (5, 8))])
    assert T.overlaps(moved).count() == 0 and T.overlaps(moved, 0, 5).first().child == 2


def test_links_are_causal(spark):
    seg = standins.segments(standins.pixels(spark, "/root/testdata/sf0.001"))
    past = lambda s: {(r.frame, r.feature): r.cell for r in T.assign_tracks(s, T.overlaps(s, 0, 1, 0.05)).where("frame <= 4").collect()}
    assert past(seg) == past(seg.where("frame <= 4 OR x % 2 = 0"))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_components_equal_union_find(spark, pairs):
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src int, dst int")).collect()}
    assert got == {a: find(a) for a in root}


def test_centroid_golden(spark):
    v = np.full((5, 5), 244.0)
    v[2, 4] = 200
    seg = spark.createDataFrame([(0, 2, x, 1) for x in range(5)], "frame int, y int, x int, feature int")
    r = T.cold_centroid(seg, grid(spark, [v]), 245.0).first()
    assert r.cy == 2.0 and r.cx > 3.5
    r = T.cold_centroid(seg, grid(spark, [np.full((5, 5), 250.0)]), 245.0).first()
    assert (r.cy, r.cx) == (2.0, 2.0)


def test_zigzag_golden(spark):
    def share(xs):
        pos = spark.createDataFrame([(1, t, 1000.0 * x, 0.0) for t, x in enumerate(xs)], "cell int, frame int, x double, y double")
        return T.turns(pos, 4000).agg(F.avg((F.col("cos") < 0).cast("double"))).first()[0]

    assert share([0, 10, 20, 30]) == 0.0 and share([0, 10, 0, 10]) == 1.0


def test_phase_rules(spark):
    rules = (5.0, 221.0, 0.2, 273.0, -4.0)
    rows = [(0, 265.0, 100, 0), (1, 240.0, 200, 0), (2, 215.0, 360, 400), (3, 214.0, 378, 420), (4, 222.0, 265, 120)]
    df = spark.createDataFrame([(1, *r) for r in rows] + [(2, 0, 280.0, 10, 0), (2, 1, 260.0, 8, 0), (2, 2, 261.0, 0, 0), (2, 3, 255.0, 5, 0)], "cell int, frame int, min_bt double, area long, core long")
    made = T.phases(T.rates(df), *rules)
    got = {c: [r.phase for r in made.where(F.col("cell") == c).orderBy("frame").collect()] for c in (1, 2)}
    assert got[1] == ["Unclassified", "Developing", "Developing", "Mature", "Decaying"]
    assert got[2] == ["Unclassified", "Initiation", "Initiation", "Initiation"]
    seen = {r.cell: r.phases_seen for r in T.cell_summary(made.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})).collect()}
    assert seen == {1: "Unclassified,Developing,Mature,Decaying", 2: "Unclassified,Initiation"}


def test_qc_and_time_golden(spark):
    ok, hot, gap = np.full((4, 4), 280.0), np.full((4, 4), 280.0), np.full((4, 4), 280.0)
    hot[0, 0], gap[:2] = 400, np.nan
    got = {r.frame: r.status for r in P.frame_quality(grid(spark, [ok, hot, gap]), "v", 170.0, 330.0, 0.05, 0.0).collect()}
    assert got == {0: "OK", 1: "QC_FAIL", 2: "QC_FAIL"}
    half, none = np.array([[100.0, 280.0], [np.nan, np.nan]]), np.full((2, 2), np.nan)
    assert [r.out_of_range_frac for r in P.frame_quality(grid(spark, [half, none]), "v", 170.0, 330.0, 0.05, 0.0).orderBy("frame").collect()] == [0.5, 1.0]
    t = spark.createDataFrame([(1, 0, 0), (1, 1, 30), (2, 0, 30), (2, 1, 30), (3, 0, 5)], "k int, i int, t int")
    assert {r.k: r.monotonic for r in P.monotonic(t, ["k"], "i", "t").collect()} == {1: True, 2: False, 3: True}


def test_decode_golden(spark, tmp_path):
    raw = np.zeros((2, 6, 8), np.uint8)
    raw[0, 0, 0], raw[0, -1, 0] = 200, 255
    with pytest.raises(ValueError):
        P.decode_counts(bytes(10), 6, 8)
    back = P.decode_counts(raw.tobytes(), 6, 8)
    assert back[0, -1, 0] == 275.0 and np.isnan(back[0, 0, 0]) and back[1, 5, 5] == 75.0
    (tmp_path / "merg_2026050109_4km-pixel").write_bytes(raw.tobytes())
    px = io.read_hourly(spark, f"file://{tmp_path}", 6, 8, (0, 6), (0, 3))
    assert px.count() == 2 * 6 * 3 and px.where("v IS NULL").count() == 1
    assert sorted(str(r.time)[11:16] for r in px.select("time").distinct().collect()) == ["09:00", "09:30"]
    assert [r.name for r in io.window_files(spark, "2026-05-01 22:10:00", "2026-05-02 00:30:00").orderBy("time").collect()][-1] == "merg_2026050200_4km-pixel"


def lzw_z(data, most=16):
    """compress(1) writer for tests: groups of eight codes at each width, no clears."""
    table, out, width, group, prev = {bytes([i]): i for i in range(256)}, bytearray(b"\x1f\x9d" + bytes([0x80 | most])), 9, [], b""
    size = 257

    def flush():
        bits = sum(c << (k * width) for k, c in enumerate(group))
        out.extend(bits.to_bytes(-(-len(group) * width // 8), "little"))
        group.clear()

    def put(code):
        group.append(code)
        if len(group) == 8:
            flush()

    read = 257
    for k, b in enumerate(data):
        word = prev + bytes([b])
        if word in table:
            prev = word
            continue
        put(table[prev])
        if size < 1 << most:
            table[word] = size
            size += 1
        if len(out) > 3 or group:
            read = size - 1  # the reader is one entry behind
        if read >= 1 << width and width < most:
            if group:
                group.extend([0] * (8 - len(group)))
                flush()
            width += 1
        prev = bytes([b])
    if prev:
        put(table[prev])
    if group:
        flush()
    return bytes(out)


def test_unpack_z(tmp_path):
    rng = np.random.default_rng(3)
    for data in (b"", b"aaaaaaaaaaaaaaaaaaa", b"abc" * 1000, rng.integers(0, 4, 30000).astype(np.uint8).tobytes()):
        packed = lzw_z(data)
        try:  # gzip reads compress(1) files too: the test's writer is held against it
            known = subprocess.run(["gzip", "-dc"], input=packed, capture_output=True, timeout=20)
        except FileNotFoundError:
            known = None
        if known and known.returncode == 0:
            assert known.stdout == data
        assert P.unpack_z(packed) == data
    with pytest.raises(ValueError):
        P.unpack_z(gzip.compress(b"x"))


def test_gap_fill(spark):
    f = np.arange(100.0).reshape(10, 10)
    f[2, 2] = f[2, 3] = np.nan
    f[5:9, 5:9] = np.nan
    out = P.gap_fill(grid(spark, [f]), 10, 10)
    got = as_array(out, "v", f.shape)
    assert not np.isnan(got[2, 2]) and np.isnan(got[5:9, 5:9]).all() and out.where("gapfilled").count() == 2
    rest = ~np.isnan(f)
    assert (got[rest] == f[rest]).all()


def test_geodesy_golden(spark):
    one = spark.range(1)
    g = one.select(S.geodesic(F.lit(30.0), F.lit(78.0), F.lit(31.0), F.lit(78.0)).alias("g"), S.geodesic(F.lit(30.0), F.lit(78.0), F.lit(30.0), F.lit(78.0)).alias("z"),
                   S.geodesic(F.lit(31.0), F.lit(79.0), F.lit(30.0), F.lit(78.0)).alias("a"), S.geodesic(F.lit(30.0), F.lit(78.0), F.lit(31.0), F.lit(79.0)).alias("b")).first()
    assert g.g.km == pytest.approx(110.9, abs=0.5) and g.g.azimuth == pytest.approx(0, abs=0.1) and g.z.km == pytest.approx(0, abs=1e-9) and g.z.azimuth is None
    assert g.a.km == pytest.approx(g.b.km)
    lat, lon = S.destination(F.lit(30.0), F.lit(78.0), F.lit(90.0), F.lit(100.0))
    r = one.select(lat.alias("lat"), lon.alias("lon")).first()
    assert r.lon > 78.9 and abs(r.lat - 30) < 0.05
    x, y = S.laea(F.lit(27.5), F.lit(81.25), 30.0, 78.0)
    p = one.select(x.alias("x"), y.alias("y"))
    la, lo = S.laea_inverse(F.col("x"), F.col("y"), 30.0, 78.0)
    r = p.select("x", "y", la.alias("la"), lo.alias("lo")).first()
    assert r.la == pytest.approx(27.5, abs=1e-7) and r.lo == pytest.approx(81.25, abs=1e-7)
    d = one.select(S.geodesic(F.lit(30.0), F.lit(78.0), F.lit(27.5), F.lit(81.25))["km"].alias("d")).first().d
    assert math.hypot(r.x, r.y) / 1000 == pytest.approx(d, rel=2e-3)
    assert one.select(S.mercator_inverse(S.mercator(F.lit(33.3))).alias("m")).first().m == pytest.approx(33.3)


def test_codes_and_labels(spark):
    one = spark.range(1)
    r = one.select(S.from_code(F.lit(75), 1.0, 160.0).alias("bt"), S.from_code(F.lit(125), 250.0, 0.0).alias("p"), S.from_code(F.lit(255), 1.0, 160.0).alias("none"),
                   *[S.probability_bin(F.lit(p)).alias(n) for n, p in (("a", 0.05), ("b", 0.1), ("c", 0.55), ("d", 0.95))],
                   S.to_code(F.lit(2.5), 1.0, 0.0).alias("even"), S.lead_label(F.lit(120)).alias("l2"), S.lead_label(F.lit(90)).alias("l90"),
                   S.local_time(F.lit("2026-05-01 23:30:00").cast("timestamp") + F.expr("interval 60 minutes")).alias("local")).first()
    assert (r.bt, r.p, r.none, r.a, r.b, r.c, r.d, r.even, r.l2, r.l90, r.local) == (235.0, 0.5, None, -1, 0, 2, 4, 2, "T+2h", "T+1.5h", "06:00")


def test_extrapolation_recovers_motion_and_is_causal(spark):
    yy, xx = np.meshgrid(np.arange(40.0), np.arange(48.0), indexing="ij")
    blob = lambda t: 270 - 60 * np.exp(-((yy - 15 - t) ** 2 + (xx - 14 - 2 * t) ** 2) / 50)
    fields = [blob(t) for t in range(5)]
    u, v = K.motion_between(270 - fields[0], 270 - fields[1])
    at = fields[0] < 240
    assert abs(np.mean(u[at]) - 2) < 0.4 and abs(np.mean(v[at]) - 1) < 0.4
    px = grid(spark, fields)
    fc = K.extrapolate(px, 40, 48, [1, 2], 270.0).where("issue = 2").collect()
    made = {n: np.full((40, 48), np.nan) for n in (1, 2)}
    for r in fc:
        made[r.lead][r.y, r.x] = np.nan if r.forecast is None else r.forecast
    still = np.nanmean(np.abs(fields[2] - fields[4]))
    assert np.nanmean(np.abs(made[2] - fields[4])) < 0.6 * still
    other = grid(spark, [*fields[:3], fields[0], fields[0]])
    again = K.extrapolate(other, 40, 48, [1, 2], 270.0).where("issue = 2")
    assert again.exceptAll(K.extrapolate(px, 40, 48, [1, 2], 270.0).where("issue = 2")).count() == 0


def test_detection_and_watershed(spark):
    f = np.full((20, 24), 280.0)
    f[3:8, 3:8], f[12:17, 14:20] = 250, 230
    f[14, 16] = 200
    found = K.detect(grid(spark, [f]), 20, 24, [273, 253, 235], 3, 0.5)
    got = {r.feature: (round(r.cy), round(r.cx), r.threshold) for r in found.collect()}
    assert sorted(v[2] for v in got.values()) == [235.0, 253.0] and (5, 5, 253.0) in got.values()
    seg = K.watershed(grid(spark, [f]), found, 20, 24, 245.0)
    assert seg.count() == 30
    nxt = found.withColumn("frame", F.lit(1)).withColumn("cx", F.col("cx") + 1)
    assert {r.dist for r in K.link_nearest(found.unionByName(nxt), 3.0).collect()} == {1.0}


def test_sample_weights_and_bootstrap(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, "event").when(F.col("id") % 3 == 0, "near").otherwise("far").alias("s"))
    got = B.stratified_sample(df, ["s"], "id", {"event": 150, "near": 150, "far": 60}, "s", 1).groupBy("s").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect()
    want = {r.s: r.n for r in df.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(r.w == pytest.approx(want[r.s]) and r.n in (150, 60) for r in got)
    units = B.replicate_units(spark, 5, 10, 4, 2).collect()
    assert len(units) == 50 and all(0 <= r.unit < 10 for r in units)
    rows = spark.createDataFrame([(i, "m", 2, 1, 1) for i in range(24)], "unit int, k string, H int, M int, F int")
    reps = B.bootstrap_sums(rows, "unit", ["k"], ["H", "M", "F"], 30, 24, 6, 3)
    assert {r.csi for r in reps.select((F.col("H") / (F.col("H") + F.col("M") + F.col("F"))).alias("csi")).collect()} == {0.5}
    p = B.permuted(df.withColumn("v", F.col("id") * 2), "v", "id", 4, 300)
    assert p.count() == 5000 and p.select(F.sum("v")).first()[0] == df.select(F.sum(F.col("id") * 2)).first()[0] and p.where("v = 2 * id").count() < 50


@pytest.mark.parametrize("units", [48, 64, 100, 150, 1024])
def test_bootstrap_spread_follows_theory(spark, units):
    """Replicates of a mean spread as independent draws do, whatever the number of units; both generators."""
    reps, values = 3000, [math.sqrt((i * 7919) % 101) for i in range(units)]
    rows = spark.createDataFrame([(i, v, 1) for i, v in enumerate(values)], "unit int, v double, n int")
    mean = sum(values) / units
    theory = math.sqrt(sum((v - mean) ** 2 for v in values)) / units
    for sums in (B.bootstrap_sums(rows, "unit", [], ["v", "n"], reps, units, 1, 3), B.poisson_sums(rows, "unit", [], ["v", "n"], reps, 3)):
        r = sums.select((F.col("v") / F.col("n")).alias("m")).agg(F.stddev_pop("m").alias("sd"), F.avg("m").alias("mean"), F.count_distinct("m").alias("k")).first()
        # The Poisson total varies, which adds a part in the number of units.
        assert abs(r["sd"] / theory - 1) < 0.05 + 1.0 / units and abs(r["mean"] - mean) < 4 * theory / math.sqrt(reps) + theory / units and r["k"] > 0.9 * reps


def test_draws_are_alike_and_independent(spark):
    draws = B.replicate_units(spark, 1000, 48, 12, 5).groupBy("rep").agg(F.sort_array(F.collect_list("unit")).alias("u"))
    assert draws.select("u").distinct().count() > 950
    one = B.replicate_units(spark, 400, 100, 1, 6)
    counts = [r["count"] for r in one.groupBy("unit").count().collect()]
    assert len(counts) == 100 and sum((c - 400) ** 2 / 400 for c in counts) < 160  # chi squared of 99 degrees
    w = spark.range(200_000).select(B.poisson_one(1, F.col("id")).alias("w")).groupBy("w").count().collect()
    share = {r["w"]: r["count"] / 200_000 for r in w}
    assert all(abs(share.get(k, 0) - math.exp(-1) / math.factorial(k)) < 0.004 for k in range(6))
    kept = sorted(r["id"] for r in B.stratified_sample(spark.range(4096).withColumn("s", F.lit("a")), ["s"], "id", {"a": 1024}, "s", 2).collect())
    gaps = [b - a for a, b in zip(kept, kept[1:])]
    assert len(set(gaps)) > 10  # no lattice


def test_bias_product_and_rollups(spark):
    rows = spark.createDataFrame([(1, 5, 7, 6, 4, 3), (1, 6, 3, 2, 5, 4), (2, 4, 4, 4, 8, 8)], "k int, a0 int, af int, afv int, aod int, aov int")
    for r in V.bias_factors(rows, ["k"]).collect():
        assert r.edge * r.area * r.intensity == pytest.approx(r.bias_v, rel=1e-12)


def test_isotonic_and_guards(spark):
    v = spark.createDataFrame([(0.1, 0, 1.0, 0), (0.2, 1, 2.0, 0), (0.3, 0, 1.0, 0), (0.4, 1, 1.0, 0), (0.3, 1, 1.0, 9)], "p double, y int, w double, b int")
    got = {(r.b, r.p): r.calibrated for r in ml.calibrated(v.where("b = 0"), v, "p", "y", "w", "b", [0, 1]).collect()}
    assert got[0, 0.1] == 0 and got[0, 0.2] == pytest.approx(2 / 3) and got[0, 0.3] == pytest.approx(2 / 3) and got[0, 0.4] == 1 and got[9, 0.3] is None
    days = lambda *d: spark.createDataFrame([(x,) for x in d], "d string").select(F.to_date("d").alias("day"))
    leak = ml.leaks(days("2026-05-01", "2026-05-10"), days("2026-05-12", "2026-05-13"), days("2026-05-12"), "day", 1)
    assert {str(r.day) for r in leak.collect()} == {"2026-05-12", "2026-05-13"}
    with pytest.raises(Exception, match="day not allowed"):
        ml.guarded(days("2026-05-12"), leak, "day").collect()
    assert ml.guarded(days("2026-05-01"), leak, "day").count() == 1


def test_model_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), None if i % 7 == 0 else float(i % 5), int(i % 40 > 20), 1.0 + i % 2) for i in range(200)], "a double, b double, y int, w double")
    stage, model, losses = ml.fit_boosted(rows.where("a % 2 = 0"), rows.where("a % 2 = 1"), ["a", "b"], "y", "w", rounds=4)
    assert model.getNumTrees == losses.index(min(losses)) + 1
    seal = ml.save_model(stage, model, f"file://{tmp_path}/m", {"rounds": 4})
    s, m, card = ml.load_model(spark, f"file://{tmp_path}/m", seal)
    assert card == {"rounds": 4} and ml.scored(rows, s, m, ["a", "b"]).exceptAll(ml.scored(rows, stage, model, ["a", "b"])).count() == 0
    with pytest.raises(ValueError):
        ml.load_model(spark, f"file://{tmp_path}/m", "0")


def test_rest_works_without_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={**os.environ, "PYTHONPATH": str(tmp_path / "r")}, check=True, timeout=120)


def test_digests_and_products(spark):
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("c", bytearray(b"3"))], "path string, content binary")
    rec = files.where("path <> 'c'").select("path", F.when(F.col("path") == "a", F.sha2("content", 256)).otherwise("x").alias("sha256"))
    assert {r.path: r.status for r in products.digest_check(files, rec, "path", "content").collect()} == {"a": "OK", "b": "DIFFERS", "c": "UNRECORDED"}
    assert products.verified_only(files.where("path = 'a'"), rec, "path", "content").count() == 1
    with pytest.raises(Exception, match="differs"):
        products.verified_only(files, rec, "path", "content").collect()
    seg = spark.createDataFrame([(1, y, x) for y in range(3) for x in range(3) if (y, x) != (1, 1)], "k int, y int, x int")
    rings = products.rings(seg, ["k"]).first().rings
    assert len(rings) == 2 and sorted(len(r) for r in rings) == [5, 5]


def test_near_places_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform((-62, 10), (62, 14), (60, 2)))], "i int, lat double, lon double")
    pl = spark.createDataFrame([(f"p{i}", i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform((-62, 10), (62, 14), (400, 2)))], "place string, place_id int, lat double, lon double")
    got = {r.i: (r.place, round(r.km, 6)) for r in products.nearest_place(pts, pl, ["i"], 120.0, sphere=True).collect()}
    all_ = pts.crossJoin(pl.select("place", "place_id", F.col("lat").alias("a"), F.col("lon").alias("b"))).withColumn("km", S.haversine_km(F.col("lat"), F.col("lon"), F.col("a"), F.col("b"))).where("km <= 120")
    want = {r.i: (r.place, round(r.km, 6)) for r in all_.groupBy("i").agg(F.min_by("place", F.struct("km", "place_id")).alias("place"), F.min("km").alias("km")).collect()}
    assert got == want and len(want) > 10


def test_pairwise_spread_of_large_groups(spark):
    rng = np.random.default_rng(6)
    pts = rng.normal(size=(500, 2))
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in pts], "g int, x double, y double")
    true = max(np.hypot(*(a - b)) for a in pts for b in pts)
    assert 0.998 * true <= T.pairwise_spread(df, ["g"]).first().spread <= true + 1e-9


@pytest.mark.parametrize("part", [40, 50_000])
def test_pairwise_spread_is_exact_at_any_size(spark, part):
    rng = np.random.default_rng(16)
    turn = rng.uniform(0, 2 * math.pi, 1500)
    sets = {0: 4000 * np.stack([np.cos(turn), np.sin(turn)], 1), 1: rng.uniform(0, 3000, (65, 2)), 2: rng.integers(0, 9, (300, 2)) * [1.0, 0.0], 3: np.ones((70, 2))}
    sets |= {4 + k: rng.normal(size=(90, 2)) * 1000 for k in range(8)} | {20: rng.normal(size=(5, 2))}
    df = spark.createDataFrame([(g, float(a), float(b)) for g, p in sets.items() for a, b in p], "g int, x double, y double")
    got = {r.g: (r.members, r.spread) for r in T.pairwise_spread(df, ["g"], part=part).collect()}
    want = {g: np.hypot(p[:, None, 0] - p[:, 0], p[:, None, 1] - p[:, 1]).max() for g, p in sets.items()}
    assert {g: m for g, (m, _) in got.items()} == {g: len(p) for g, p in sets.items()}
    assert all(abs(got[g][1] - want[g]) <= 1e-9 for g in sets)


def test_io_round_trips(spark, tmp_path):
    px = grid(spark, [[[1.004, np.nan], [3.0, 250.0]]]).withColumn("event", F.lit("e"))
    io.write_cube(px, f"file://{tmp_path}/cube", ["event", "frame"])
    back = io.read_parquet(spark, f"file://{tmp_path}/cube")
    assert back.where("event = 'e' AND v IS NULL").count() == 1 and back.count() == 4
    packed = io.unpack_forecast(io.pack_forecast(px, "v"), "v")
    assert packed.join(px.withColumnRenamed("v", "w"), ["frame", "y", "x"]).where("abs(v - w) > 0.00501").count() == 0
    codes = io.tile_rows(io.tile_codes(px, 1.0, 0.0), 3).orderBy("y").collect()
    assert [bytes(r.codes) for r in codes] == [bytes([1, 255, 255]), bytes([3, 250, 255])]
    png = products.png_tiles(io.tile_rows(io.tile_codes(px, 1.0, 0.0), 2), 2, 2).first().png
    at = bytes(png).index(b"IDAT")
    assert zlib.decompressobj().decompress(bytes(png)[at + 4 :]) == bytes([0, 1, 255, 0, 3, 250])
    io.write_csv(px.drop("event"), f"file://{tmp_path}/csv")
    assert io.read_csv(spark, f"file://{tmp_path}/csv", "frame int, y int, x int, v double").where("v = 250").count() == 1
    st_ = spark.createDataFrame([("q1", "A"), ("q2", "B")], "query string, name string")
    hit = spark.createDataFrame([("q1", 1.0, 2.0, "d")], "query string, lat double, lon double, osm_display_name string")
    assert {r.name: r.status for r in io.geocoded(st_, hit).collect()} == {"A": "OK", "B": "NOT_FOUND"}
    done = spark.createDataFrame([("e",)], "event string").withColumn("config_hash", F.sha2(F.lit("c1"), 256))
    assert io.only_new(px, done, ["event"], F.lit("c1")).count() == 0 and io.only_new(px, done, ["event"], F.lit("c2")).count() == 4


def test_streamed_links_equal_batch(spark):
    from nimboscale.plans.kernel_queries import SPAN, streamed_links

    sf = "/root/testdata/sf0.001"
    seg = standins.segments(standins.pixels(spark, sf))
    batch = {}
    for k in {r.frame // SPAN for r in seg.select("frame").distinct().collect()}:
        own = seg.where(f"frame div {SPAN} = {k}")
        batch |= {(f"e{k}", r.frame, r.feature): r.cell for r in T.assign_tracks(own, T.overlaps(own)).collect()}
    assert {(r.event, r.frame, r.feature): r.cell for r in streamed_links(spark, sf).collect()} == batch


def test_quantiles_of_endless_values(spark):
    from nimboscale.operators.quantile import exact_quantiles

    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, inf)] + [("b", v) for v in (-inf, -inf, 5.0, inf)] + [("c", v) for v in (1.0, nan, inf)], "g string, v double")
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], {"low": ("v", 0.0), "mid": ("v", 0.5), "high": ("v", 1.0)}).collect()}
    assert (got["a"]["low"], got["a"]["mid"], got["a"]["high"]) == (1.0, 2.0, inf)
    assert (got["b"]["low"], got["b"]["mid"], got["b"]["high"]) == (-inf, -inf, inf)
    assert got["c"]["low"] == 1.0 and got["c"]["mid"] == inf and math.isnan(got["c"]["high"])


def test_exact_quantiles(spark):
    from nimboscale.operators.quantile import exact_quantiles

    rng = np.random.default_rng(2)
    rows = [("a", float(v), None) for v in rng.normal(0, 3, 501)] + [("b", 2.0, 1.0)] * 40 + [("b", -2.0, None), ("b", 0.0, None), (None, 7.5, 1e300), (None, None, None), ("c", None, None)]
    rows += [("d", float(v), float(v) ** 3) for v in range(-6, 8)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    want = {"lo": ("v", 0.1), "mid": ("v", 0.5), "top": ("v", 1.0), "other": ("w", 0.75)}
    got = {r.g: r for r in exact_quantiles(df, ["g"], want).collect()}
    truth = {r.g: r for r in df.groupBy("g").agg(*[F.percentile(c, q).alias(n) for n, (c, q) in want.items()]).collect()}
    assert set(got) == {"a", "b", None, "d"}
    for g, r in got.items():
        for n in want:
            assert r[n] == truth[g][n] or math.isclose(r[n], truth[g][n], rel_tol=1e-12)


def test_sample_breaks_ties(spark):
    rows = [(i % 40, "event", i) for i in range(400)]
    one = spark.createDataFrame(rows, "id long, s string, y int").repartition(1)
    many = one.orderBy(F.col("y").desc()).repartition(7)
    got = [sorted((r.id, r.y, r.weight) for r in B.stratified_sample(d, ["s"], "id", {"event": 55}, "s", 1, ties=["y"]).collect()) for d in (one, many)]
    assert got[0] == got[1] and len(got[0]) == 55 and math.isclose(sum(w for *_, w in got[0]), 400)


def test_numbered_in_ranges(spark):
    df = spark.range(0, 3000, 3).withColumnRenamed("id", "k").repartition(5)
    assert all(r.k == 3 * r.n for r in B.numbered(df, "k", "n", rows=70).collect())


def test_places_across_the_date_line_and_poles(spark):
    pts = spark.createDataFrame([(0, 10.0, 179.99), (1, 10.0, -179.99), (2, 89.95, 10.0), (3, -89.9, -170.0)], "i int, lat double, lon double")
    pl = spark.createDataFrame([("w", 1, 10.0, -179.995), ("e", 2, 10.2, 179.9), ("n", 3, 89.9, -170.0), ("s", 4, -89.95, 10.0)], "place string, place_id int, lat double, lon double")
    got = {r.i: r.place for r in products.nearest_place(pts, pl, ["i"], 50.0, sphere=True).collect()}
    assert got == {0: "w", 1: "w", 2: "n", 3: "s"}


def test_features_without_segments(spark):
    from nimboscale.operators import raster

    px = grid(spark, [np.arange(25, dtype=float).reshape(5, 5)])
    features = spark.createDataFrame([(0, 1, 2.5, 2.5), (0, 2, 0.0, 4.4), (0, 3, 4.0, 4.0)], "frame int, feature int, cy double, cx double")
    segment = spark.createDataFrame([(0, 4, 4, 3)], "frame int, y int, x int, feature int")
    got = {r.feature: (r.min_bt, r.area) for r in raster.unsegmented(features, segment, px).collect()}
    assert got == {1: (6.0, 0.0), 2: (3.0, 0.0)}


def test_largest_issue_needs_an_outcome(spark):
    df = spark.createDataFrame([(0, 5), (1, 7), (2, 7), (3, 9), (4, 1)], "frame int, area long")
    got = [tuple(V.largest_issue(df, n).first()) for n in (0, 2, 4, 5)]
    assert got == [(3, 9), (1, 7), (0, 5), (None, None)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3 and set(e.oracle_sql()) <= set(e.queries())


def test_event_pipeline(spark, tmp_path):
    """A moving cold disc, from raw files to cells, forecasts and scores."""
    from nimboscale.plans.event_pipeline import Event, Source, run_event

    rows, cols = 60, 70
    raw = tmp_path / "raw"
    raw.mkdir()
    yy, xx = np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij")
    for hour in range(3):
        fields = []
        for half in range(2):
            t = 2 * hour + half
            bt = 290 - 90 * np.exp(-((yy - 30) ** 2 + (xx - 24 - 2 * t) ** 2) / 60.0)
            fields.append(np.clip(bt - 75, 0, 254).astype(np.uint8)[::-1])
        (raw / f"merg_20260501{hour:02d}_4km-pixel").write_bytes(np.stack(fields).tobytes())
    source = Source(rows, cols, 28.0, 76.0, 0.036, 0.036)
    settings_ = tmp_path / "event.yaml"
    settings_.write_text("name: t\nstart: '2026-05-01 00:00:00'\nbox: [28.3, 29.8, 76.4, 78.2]\nresolution_m: 4000\nleads: [1, 2]\nscales: [5]\n")
    out = run_event(spark, f"file://{raw}", f"file://{tmp_path}/out", source, Event.read(str(settings_)), until=6)
    assert {r.status for r in out["frame_quality"].collect()} == {"OK"} and out["frame_quality"].count() == 6
    life = out["lifecycle"].orderBy("frame").collect()
    assert {r.cell for r in life} == {1} and len(life) == 6
    speeds = [r.speed_kmh for r in life[1:]]
    east = 2 * 0.036 * 111.32 * math.cos(math.radians(29.1)) / 0.5
    assert all(abs(s - east) < 0.25 * east for s in speeds) and all(60 < r.heading_deg < 120 for r in life[1:])
    score = {(r.method, r.lead): r.csi for r in out["scores"].collect()}
    assert score["extrapolation", 2] > score["persistence", 2] + 0.1
    n = {(r.method, r.lead): r.H + r.M + r.F + r.CN for r in out["scores"].collect()}
    assert n["extrapolation", 1] == n["persistence", 1]
    assert out["fss"].count() == 4 and out["genealogy"].count() == 0
    met = {(r.method, r.lead): r.fss_5 for r in out["metrics"].collect()}
    assert len(met) == 4 and met["extrapolation", 2] > met["persistence", 2]
    audit = out["track_audit"].first()
    assert (audit.cells, audit.steps, audit.seg_links, audit.zero_overlap, audit.better_other) == (1, 5, 5, 0.0, 0.0)
    assert audit.median_diff < 0.35 * audit.median_step
    errors = {r.method: r.e for r in out["object_forecasts"].where("lead = 2 AND issue >= 2").groupBy("method").avg("err").withColumnRenamed("avg(err)", "e").collect()}
    assert errors["field_advection"] < 0.6 * errors["persistence"]
    assert out["suspicious"].first().problem_score == 0 and out["motion"].select("frame").distinct().count() == 4


def test_probability_scores_share_pixels(spark):
    from nimboscale.plans.kernel_queries import probability_scores

    rows = probability_scores(spark, "/root/testdata/sf0.001").collect()
    n = {}
    for r in rows:
        n.setdefault((r["mask"], r.lead), set()).add(r.n)
        assert r.H + r.M + r.F + r.CN == r.n
    assert all(len(v) == 1 for v in n.values()) and {r.method for r in rows} == {"persistence", "advection", "neighbourhood", "ml", "climatology"}
    bss = {(r.method, r["mask"], r.lead): r.bss for r in rows}
    assert abs(bss["climatology", "V", 1]) < 1e-9 and bss["ml", "V", 1] > bss["persistence", "V", 1]
    assert all(max(n["D", k]) >= max(n["V", k]) for k in (1, 2))


def test_link_audit_golden(spark):
    """A parent of four pixels, its linked child one row on, and another child over it."""
    seg = spark.createDataFrame(
        [(0, 0, x, 1) for x in range(4)] + [(1, 1, x, 11) for x in range(8)] + [(1, 0, x, 12) for x in range(2)] + [(0, 9, 9, 2)], "frame int, y int, x int, feature int"
    )
    links = spark.createDataFrame([(0, 1, 11), (0, 2, 11), (0, 7, 11)], "frame int, parent int, child int")
    shift = spark.createDataFrame([(0, 1, 1, 0), (0, 2, None, None)], "frame int, feature int, dy int, dx int")
    got = {r.parent: r for r in T.link_audit(seg, links, shift).collect()}
    assert set(got) == {1, 2}
    one, two = got[1], got[2]
    assert (one.area_ratio, one.linked_frac, one.better_other, one.moved_frac, one.moved_better_other) == (2.0, 0.0, True, 1.0, False)
    assert (two.linked_frac, two.better_other, two.moved_frac, two.moved_better_other) == (0.0, False, None, None)
    plain = T.link_audit(seg, links)
    assert "moved_frac" not in plain.columns and plain.count() == 2
    assert T.link_audit(seg, links.limit(0), shift).count() == 0


def test_parent_motion_of_segment_or_position(spark):
    motion = spark.createDataFrame([(0, y, x, float(x), float(10 * y)) for y in range(3) for x in range(3)], "frame int, y int, x int, u double, v double")
    seg = spark.createDataFrame([(0, 0, 0, 1), (0, 2, 2, 1)], "frame int, y int, x int, feature int")
    parents = spark.createDataFrame([(0, 1, 9.0, 9.0), (0, 2, 1.2, -4.0), (5, 3, 0.0, 0.0)], "frame int, feature int, y double, x double")
    got = {r.feature: (r.u, r.v) for r in T.parent_motion(parents, seg, motion, 3, 3).collect()}
    assert got == {1: (1.0, 10.0), 2: (0.0, 10.0), 3: (None, None)}


def test_rings_simplified_and_located(spark):
    stair = spark.createDataFrame([(1, y, x) for y in range(6) for x in range(y + 1)] + [(2, 20, 20)], "id int, y int, x int")
    full = {r.id: r.rings for r in products.rings(stair, ["id"]).collect()}
    less = {r.id: r.rings for r in products.rings(stair, ["id"], 1.0, 4).collect()}
    assert len(full[1][0]) == 15 and len(less[1][0]) in (4, 5) and less[1][0][0] == less[1][0][-1]
    assert {tuple(p) for p in less[1][0]} <= {tuple(p) for p in full[1][0]}
    assert less[2] == []
    at = products.located_rings(products.rings(stair, ["id"]), 100.0, 0.0, 2.0, lambda x, y: (y / 10, x / 10)).where("id = 2").first()
    assert [13.9, 3.9] in [list(p) for p in at.rings[0]]


def test_manifest_keeps_latest(spark, tmp_path):
    path = f"file://{tmp_path}/manifest"
    rows = lambda *r: spark.createDataFrame(list(r), "file string, sha256 string, bytes long")
    io.record_files(rows(("a", "1", 5), ("b", "2", 6)), path)
    io.record_files(rows(("a", "3", 7)), path)
    now = io.recorded_files(spark, path)
    assert {(r.file, r.sha256, r.bytes) for r in now.collect()} == {("a", "3", 7), ("b", "2", 6)}
    assert [r.file for r in io.unrecorded(rows(("a", "1", 5), ("b", "2", 6), ("c", "9", 1)), now).orderBy("file").collect()] == ["a", "c"]
