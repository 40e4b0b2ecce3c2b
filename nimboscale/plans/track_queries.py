"""Object tracking, lifecycle and object-forecast queries on the stand-ins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from nimboscale.operators import tracks as T
from nimboscale.plans.registry import query
from nimboscale.plans.standins import HEIGHT, PLACES, POS, PX, SEG, WIDTH, pixels, places, positions, segments
from nimboscale.session import stored

# Each parent's tile is one label a frame; edges are between tiles of consecutive frames, moved one pixel.
EDGES = f"""{PX}, {SEG},
size AS (SELECT frame, feature, count(*) AS n FROM seg GROUP BY ALL),
e0 AS (SELECT a.frame, a.feature AS parent, b.feature AS child, count(*) AS overlap_px FROM seg a JOIN seg b ON b.frame = a.frame + 1 AND b.y = a.y AND b.x = a.x + 1 GROUP BY ALL),
edges AS (SELECT e.*, overlap_px / least(p.n, c.n)::DOUBLE AS overlap_frac FROM e0 e JOIN size p ON p.frame = e.frame AND p.feature = e.parent
  JOIN size c ON c.frame = e.frame + 1 AND c.feature = e.child WHERE overlap_px / least(p.n, c.n)::DOUBLE >= 0.05),
best AS (SELECT *, row_number() OVER (PARTITION BY frame, parent ORDER BY overlap_px DESC, child) = 1 AS bc,
  row_number() OVER (PARTITION BY frame, child ORDER BY overlap_px DESC, parent) = 1 AS bp FROM edges),
kinds AS (SELECT *, CASE WHEN bc AND bp THEN 'CONTINUE' WHEN bc THEN 'MERGE' WHEN bp THEN 'SPLIT' END AS kind FROM best)"""
TRACKS = """nodes AS (SELECT DISTINCT frame, feature FROM seg),
walk AS (
  SELECT n.frame, n.feature, n.frame AS rf, n.feature AS rr FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM kinds k WHERE k.kind = 'CONTINUE' AND k.frame + 1 = n.frame AND k.child = n.feature)
  UNION ALL
  SELECT w.frame + 1, k.child, w.rf, w.rr FROM walk w JOIN kinds k ON k.kind = 'CONTINUE' AND k.frame = w.frame AND k.parent = w.feature
),
named AS (SELECT rf, rr, row_number() OVER (ORDER BY rf, rr) AS cell FROM (SELECT DISTINCT rf, rr FROM walk)),
tracks AS (SELECT w.frame, w.feature, n.cell FROM walk w JOIN named n USING (rf, rr))"""


def _edges(spark, sf_dir):
    seg = segments(pixels(spark, sf_dir))
    return seg, T.overlaps(seg, 0, 1, 0.05)


def _tracks(spark, sf_dir):
    seg, edges = _edges(spark, sf_dir)
    edges = stored(T.link_events(edges), "links")
    return seg, edges, T.assign_tracks(seg, edges)


@query(f"""WITH {PX}, {SEG} SELECT frame, feature, count(*) * 4.0::DOUBLE AS area, round(min(v), 7) AS coldest, count(*) FILTER (WHERE v < -0.2) * 4.0::DOUBLE AS core_area,
  round(avg(y), 6) AS cy, round(avg(x), 6) AS cx FROM seg JOIN px USING (frame, y, x) GROUP BY frame, feature""")
def segment_stats(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return T.segment_stats(segments(px), px).select("frame", "feature", "area", F.round("coldest", 7).alias("coldest"), "core_area", F.round("cy", 6).alias("cy"), F.round("cx", 6).alias("cx"))


@query(f"""WITH {PX}, {SEG}, w AS (SELECT frame, feature, y, x, coalesce(greatest(0.0, -0.16 - v), 0.0)::DOUBLE AS w FROM seg JOIN px USING (frame, y, x))
SELECT frame, feature, round(CASE WHEN sum(w) > 0 THEN sum(y * w) / sum(w) ELSE avg(y) END, 6) AS cy, round(CASE WHEN sum(w) > 0 THEN sum(x * w) / sum(w) ELSE avg(x) END, 6) AS cx FROM w GROUP BY ALL""")
def coldness_centroid(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return T.cold_centroid(segments(px), px, -0.16).select("frame", "feature", F.round("cy", 6).alias("cy"), F.round("cx", 6).alias("cx"))


@query(f"WITH {EDGES} SELECT frame, parent, child, overlap_px, round(overlap_frac, 9) AS overlap_frac FROM edges")
def segment_overlap_edges(spark, sf_dir):
    return _edges(spark, sf_dir)[1].withColumn("overlap_frac", F.round("overlap_frac", 9))


@query(f"""WITH {PX}, {SEG}, m AS (SELECT frame, feature, y + frame % 2 AS y, x + feature % 3 - 1 AS x FROM seg)
SELECT m.frame, m.feature AS parent, b.feature AS child, count(*) AS overlap_px FROM m JOIN seg b ON b.frame = m.frame + 1 AND b.y = m.y AND b.x = m.x GROUP BY ALL""")
def flow_shifted_overlap(spark, sf_dir):
    seg = segments(pixels(spark, sf_dir))
    return T.overlaps(seg, F.col("frame") % 2, F.col("feature") % 3 - 1).drop("overlap_frac")


@query(f"WITH {EDGES} SELECT frame, parent, child, overlap_px FROM kinds WHERE kind = 'CONTINUE'")
def mutual_best_links(spark, sf_dir):
    return T.link_events(_edges(spark, sf_dir)[1]).where("kind = 'CONTINUE'").select("frame", "parent", "child", "overlap_px")


@query(f"WITH RECURSIVE {EDGES}, {TRACKS} SELECT frame, feature, cell FROM tracks")
def track_ids(spark, sf_dir):
    return _tracks(spark, sf_dir)[2]


@query(f"""WITH RECURSIVE {EDGES}, {TRACKS}
SELECT k.frame + 1 AS frame, kind, p.cell AS from_cell, c.cell AS into_cell, round(overlap_frac, 9) AS overlap_frac FROM kinds k
JOIN tracks p ON p.frame = k.frame AND p.feature = k.parent JOIN tracks c ON c.frame = k.frame + 1 AND c.feature = k.child WHERE kind IN ('MERGE', 'SPLIT')""")
def merge_split_events(spark, sf_dir):
    _, edges, tracks = _tracks(spark, sf_dir)
    return T.genealogy(tracks, edges).withColumn("overlap_frac", F.round("overlap_frac", 9))


@query(f"""WITH RECURSIVE {EDGES}, {TRACKS}, links AS (
  SELECT p.cell AS a, c.cell AS b FROM kinds k JOIN tracks p ON p.frame = k.frame AND p.feature = k.parent JOIN tracks c ON c.frame = k.frame + 1 AND c.feature = k.child WHERE kind IN ('MERGE', 'SPLIT')
), sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT cell AS a, cell AS b FROM tracks UNION SELECT r.a, l.b FROM reach r JOIN sym l ON l.a = r.b),
fam AS (SELECT a AS cell, min(b) AS family FROM reach GROUP BY a)
SELECT cell, family, count(*) OVER (PARTITION BY family) AS family_size FROM fam""")
def families(spark, sf_dir):
    _, edges, tracks = _tracks(spark, sf_dir)
    fam = T.families(tracks, edges)
    return fam.join(fam.groupBy("family").agg(F.count(F.lit(1)).alias("family_size")), "family").select("cell", "family", "family_size")


@query(f"""WITH RECURSIVE {EDGES}, {TRACKS}, ev AS (
  SELECT k.frame + 1 AS frame, p.cell AS a, c.cell AS b FROM kinds k JOIN tracks p ON p.frame = k.frame AND p.feature = k.parent JOIN tracks c ON c.frame = k.frame + 1 AND c.feature = k.child WHERE kind IN ('MERGE', 'SPLIT')
), u AS (SELECT a AS cell, frame FROM ev UNION ALL SELECT b, frame FROM ev), n AS (SELECT cell, frame, count(*) AS n FROM u GROUP BY ALL),
t AS (SELECT t.cell, t.frame, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT cell, frame FROM tracks) t LEFT JOIN n USING (cell, frame))
SELECT cell, frame, CAST(sum(n) OVER (PARTITION BY cell ORDER BY frame) AS BIGINT) AS events_so_far, (frame - min(frame) OVER (PARTITION BY cell)) * 30 AS age_min FROM t""")
def events_so_far(spark, sf_dir):
    _, edges, tracks = _tracks(spark, sf_dir)
    g = T.genealogy(tracks, edges)
    n = g.select("frame", F.explode(F.array("from_cell", "into_cell")).alias("cell")).groupBy("cell", "frame").agg(F.count(F.lit(1)).alias("n"))
    rows = tracks.select("cell", "frame").distinct().join(n, ["cell", "frame"], "left").fillna({"n": 0})
    aged = T.with_age(rows)
    return aged.withColumn("events_so_far", F.sum("n").over(T.by_cell().rangeBetween(Window.unboundedPreceding, 0))).select("cell", "frame", "events_so_far", "age_min")


STEPS = f"""{POS}, st0 AS (
  SELECT cell, frame, x, y, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, frame - lag(frame) OVER w AS dframe FROM pos WINDOW w AS (PARTITION BY cell ORDER BY frame)
), st AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist FROM st0 WHERE dframe IS NOT NULL), one AS (SELECT * FROM st WHERE dframe = 1),
tn AS (SELECT *, lag(dx) OVER w AS px, lag(dy) OVER w AS py, lag(dist) OVER w AS pd FROM one WINDOW w AS (PARTITION BY cell ORDER BY frame))"""


@query(f"WITH {STEPS} SELECT cell, frame, round(dx, 3) + 0.0 AS dx, round(dy, 3) + 0.0 AS dy, dframe, round(dist, 3) AS dist FROM st")
def track_steps(spark, sf_dir):
    s = T.steps(positions(spark, sf_dir))
    return s.select("cell", "frame", (F.round("dx", 3) + 0.0).alias("dx"), (F.round("dy", 3) + 0.0).alias("dy"), "dframe", F.round("dist", 3).alias("dist"))


@query(f"""WITH {STEPS} SELECT count(*) AS n, round(avg(CASE WHEN dx * px + dy * py < 0 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS zigzag FROM tn WHERE dist >= 4000 AND pd >= 4000""")
def zigzag_fraction(spark, sf_dir):
    t = T.turns(positions(spark, sf_dir), 4000)
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("cos") < 0).cast("double")), 9).alias("zigzag"))


@query(f"""WITH {STEPS}, f AS (SELECT one.*, CAST(cell % 7 - 3 AS DOUBLE) * 1000 AS u, CAST(frame % 5 - 2 AS DOUBLE) * 1000 AS v FROM one)
SELECT count(*) AS n, round(corr(dx, u), 7) AS corr_x, round(corr(dy, v), 7) AS corr_y, round(quantile_cont(dist, 0.5), 4) AS median_step,
  round(quantile_cont(sqrt(u * u + v * v), 0.5), 4) AS median_flow, round(quantile_cont(sqrt((dx - u) * (dx - u) + (dy - v) * (dy - v)), 0.5), 4) AS median_diff FROM f""")
def flow_consistency(spark, sf_dir):
    one = T.steps(positions(spark, sf_dir)).where("dframe = 1").withColumns({"u": (F.col("cell") % 7 - 3) * 1000.0, "v": (F.col("frame") % 5 - 2) * 1000.0})
    stats = T.flow_consistency(one, "u", "v").crossJoin(F.broadcast(one.agg(F.count(F.lit(1)).alias("n"))))  # one row each
    return stats.select("n", *[F.round(c, d).alias(c) for c, d in (("corr_x", 7), ("corr_y", 7), ("median_step", 4), ("median_flow", 4), ("median_diff", 4))])


FIX = f"""{POS}, fix AS (SELECT cell, frame, 20 + (cell * 13 % 300) / 30.0::DOUBLE + x / 100000 AS lat, 70 + (cell * 29 % 400) / 40.0::DOUBLE + y / 100000 AS lon FROM pos),
fl AS (SELECT *, radians(lag(lat) OVER w) AS la, radians(lag(lon) OVER w) AS lo, (frame - lag(frame) OVER w) * 0.5::DOUBLE AS h, radians(lat) AS lb, radians(lon) AS ln FROM fix WINDOW w AS (PARTITION BY cell ORDER BY frame)),
km AS (SELECT *, 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0, pow(sin((lb - la) / 2), 2) + cos(la) * cos(lb) * pow(sin((ln - lo) / 2), 2)))) AS km,
  degrees(atan2(sin(ln - lo) * cos(lb), cos(la) * sin(lb) - sin(la) * cos(lb) * cos(ln - lo))) AS bd FROM fl)"""


def _fixes(spark, sf_dir):
    p = positions(spark, sf_dir)
    return p.select("cell", "frame", (20 + (F.col("cell") * 13 % 300) / 30.0 + F.col("x") / 100000).alias("lat"), (70 + (F.col("cell") * 29 % 400) / 40.0 + F.col("y") / 100000).alias("lon"))


@query(f"""WITH {FIX} SELECT cell, frame, round(km / h, 5) AS speed_kmh, round(CASE WHEN km > 0 THEN CASE WHEN bd < 0 THEN bd + 360 ELSE bd END END, 5) AS heading_deg FROM km""")
def movement_speed_heading(spark, sf_dir):
    return T.movement(_fixes(spark, sf_dir), sphere=True).select("cell", "frame", F.round("speed_kmh", 5).alias("speed_kmh"), F.round("heading_deg", 5).alias("heading_deg"))


# Vincenty's inverse formula on WGS84; its rounds are those of the recursion.
_F = "(1 / 298.257223563::DOUBLE)"
VINCENTY = f"""{FIX}, u AS (SELECT cell, frame, h, ln - lo AS l, atan(tan(la) * (1 - {_F})) AS u1, atan(tan(lb) * (1 - {_F})) AS u2 FROM fl),
vi AS (SELECT cell, frame, h, l, u1, u2, l AS x, 0.0::DOUBLE AS s, 0.0::DOUBLE AS ss, 1.0::DOUBLE AS cs, 0.0::DOUBLE AS c2a, 0.0::DOUBLE AS cm, 0 AS k FROM u
  UNION ALL SELECT cell, frame, h, l, u1, u2, l + (1 - c) * {_F} * sa * (s + c * ss * (cm + c * cs * (2 * cm * cm - 1))), s, ss, cs, c2a, cm, k + 1 FROM (
    SELECT *, {_F} / 16 * c2a * (4 + {_F} * (4 - 3 * c2a)) AS c, coalesce(cs - 2 * sin(u1) * sin(u2) / nullif(c2a, 0), 0) AS cm FROM (
      SELECT *, 1 - sa * sa AS c2a, atan2(ss, cs) AS s FROM (SELECT *, coalesce(cos(u1) * cos(u2) * sin(x) / nullif(ss, 0), 0) AS sa FROM (
        SELECT cell, frame, h, l, u1, u2, x, k, sqrt(pow(cos(u2) * sin(x), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(x), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(x) AS cs FROM vi WHERE k < 8))))),
vd AS (SELECT *, 6378137.0::DOUBLE * (1 - {_F}) AS b, c2a * (1 / pow(1 - {_F}, 2) - 1) AS q FROM vi WHERE k = 8),
ve AS (SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS ba, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS bb FROM vd),
vf AS (SELECT *, b * ba * (s - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) / 1000 AS km, degrees(atan2(cos(u2) * sin(x), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(x))) AS az FROM ve)"""


@query(f"WITH RECURSIVE {VINCENTY} SELECT cell, frame, round(km / h, 5) AS speed_kmh, round(CASE WHEN ss > 0 THEN CASE WHEN az < 0 THEN az + 360 ELSE az END END, 5) AS heading_deg FROM vf")
def geodesic_movement(spark, sf_dir):
    """Steps on the ellipsoid."""
    return T.movement(_fixes(spark, sf_dir)).select("cell", "frame", F.round("speed_kmh", 5).alias("speed_kmh"), F.round("heading_deg", 5).alias("heading_deg"))


RATES = f"""{POS}, rt AS (SELECT *, (min_bt - lag(min_bt) OVER w) / (frame - lag(frame) OVER w) AS d_min_bt,
  ((area - lag(area) OVER w)::DOUBLE / nullif(lag(area) OVER w, 0)) / (frame - lag(frame) OVER w) AS acf, (core - lag(core) OVER w)::DOUBLE / (frame - lag(frame) OVER w) AS d_core, row_number() OVER w AS n FROM pos WINDOW w AS (PARTITION BY cell ORDER BY frame)),
rule AS (SELECT *, CASE WHEN d_min_bt >= 2 AND d_core < 0 THEN 'Decaying' WHEN min_bt < 285 AND abs(acf) <= 0.1 THEN 'Mature'
  WHEN d_min_bt < 0 AND acf > 0 THEN 'Developing' WHEN n <= 2 AND min_bt < 295 AND d_min_bt <= -1 THEN 'Initiation' END AS r FROM rt),
ph AS (SELECT *, coalesce(last_value(r IGNORE NULLS) OVER (PARTITION BY cell ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Unclassified') AS phase FROM rule)"""


def _phased(spark, sf_dir):
    return T.phases(T.rates(positions(spark, sf_dir)), 2.0, 285.0, 0.1, 295.0, -1.0)


@query(f"WITH {RATES} SELECT cell, frame, round(d_min_bt, 6) + 0.0 AS d_min_bt, round(acf, 6) + 0.0 AS area_change_frac, round(d_core, 6) + 0.0 AS d_core FROM rt")
def lifecycle_rates(spark, sf_dir):
    r = T.rates(positions(spark, sf_dir))
    return r.select("cell", "frame", (F.round("d_min_bt", 6) + 0.0).alias("d_min_bt"), (F.round("area_change_frac", 6) + 0.0).alias("area_change_frac"), (F.round("d_core", 6) + 0.0).alias("d_core"))


@query(f"WITH {RATES} SELECT cell, frame, phase FROM ph")
def phase_labels(spark, sf_dir):
    return _phased(spark, sf_dir).select("cell", "frame", "phase")


@query(f"""WITH {RATES} SELECT cell, count(*) AS n_frames, min(frame) AS first_frame, max(frame) AS last_frame, (max(frame) - min(frame)) * 30 AS lifetime_min, round(min(min_bt), 6) AS min_bt, max(area) AS max_area,
  quantile_cont(area, 0.5) AS median_area, max(core) AS max_core, round(arg_min(x, frame), 3) AS start_x, round(arg_min(y, frame), 3) AS start_y, round(arg_max(x, frame), 3) AS end_x, round(arg_max(y, frame), 3) AS end_y,
  round(quantile_cont(speed, 0.5), 6) AS median_step_speed, round(min(d_min_bt), 6) AS largest_cooling, round(sqrt(pow(arg_max(x, frame) - arg_min(x, frame), 2) + pow(arg_max(y, frame) - arg_min(y, frame), 2)), 3) AS net_displacement,
  round(sqrt(pow(arg_max(x, frame) - arg_min(x, frame), 2) + pow(arg_max(y, frame) - arg_min(y, frame), 2)) / 1000 / nullif((max(frame) - min(frame)) * 0.5::DOUBLE, 0), 6) AS net_speed,
  CASE WHEN max(frame) > min(frame) THEN round((degrees(atan2(arg_max(x, frame) - arg_min(x, frame), arg_max(y, frame) - arg_min(y, frame))) + 360) % 360, 6) END AS net_heading FROM (
  SELECT *, sqrt(pow(x - lag(x) OVER c, 2) + pow(y - lag(y) OVER c, 2)) / 1000 / ((frame - lag(frame) OVER c) * 0.5::DOUBLE) AS speed FROM ph WINDOW c AS (PARTITION BY cell ORDER BY frame)) GROUP BY cell""")
def cell_summary(spark, sf_dir):
    s = T.cell_summary(_phased(spark, sf_dir)).drop("phases_seen")
    places = {"net_displacement": 3, "start_x": 3, "start_y": 3, "end_x": 3, "end_y": 3}
    return s.withColumns({c: F.round(c, places.get(c, 6)) for c in ("net_displacement", "start_x", "start_y", "end_x", "end_y", "min_bt", "median_step_speed", "largest_cooling", "net_speed", "net_heading")})


@query(f"""WITH {RATES}, f AS (SELECT cell, phase, min(frame) AS f FROM ph GROUP BY ALL) SELECT cell, string_agg(phase, ',' ORDER BY f) AS phases_seen FROM f GROUP BY cell""")
def phases_seen(spark, sf_dir):
    return T.cell_summary(_phased(spark, sf_dir)).select("cell", "phases_seen")


@query(f"""WITH {RATES}, o AS (SELECT *, lead(min_bt) OVER w - min_bt AS nxt, frame = max(frame) OVER (PARTITION BY cell) AS ends FROM ph WINDOW w AS (PARTITION BY cell ORDER BY frame))
SELECT phase, count(*) AS n, round(avg(nxt), 6) AS mean_next, round(stddev_samp(nxt), 6) AS sd_next, round(avg(CASE WHEN ends THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS ends_rate FROM o GROUP BY phase""")
def phase_outcomes(spark, sf_dir):
    o = T.with_age(_phased(spark, sf_dir)).withColumn("nxt", F.lead("min_bt").over(T.by_cell()) - F.col("min_bt"))
    return o.groupBy("phase").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("nxt"), 6).alias("mean_next"), F.round(F.stddev_samp("nxt"), 6).alias("sd_next"), F.round(F.avg(F.col("ends_next").cast("double")), 9).alias("ends_rate")
    )


FC = f"""{POS}, iss AS (
  SELECT p.cell, p.frame AS issue, l.lead, p.x, p.y, coalesce((p.x - w.x) / 2, p.x - o.x) AS u, coalesce((p.y - w.y) / 2, p.y - o.y) AS v, s.x AS ox, s.y AS oy
  FROM pos p CROSS JOIN (VALUES (1), (2), (4)) l(lead) LEFT JOIN pos w ON w.cell = p.cell AND w.frame = p.frame - 2 LEFT JOIN pos o ON o.cell = p.cell AND o.frame = p.frame - 1
  LEFT JOIN pos s ON s.cell = p.cell AND s.frame = p.frame + l.lead
  WHERE w.cell IS NOT NULL OR o.cell IS NOT NULL
), fc AS (
  SELECT cell, issue, lead, 'persistence' AS method, ox IS NOT NULL AS survived, sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)) AS err FROM iss UNION ALL
  SELECT cell, issue, lead, 'extrapolation', ox IS NOT NULL, sqrt((x + lead * u - ox) * (x + lead * u - ox) + (y + lead * v - oy) * (y + lead * v - oy)) FROM iss)"""


@query(f"""WITH {FC} SELECT method, lead, count(*) AS n, count(err) AS n_scored, round(avg(CASE WHEN survived THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS survival, round(avg(err), 3) AS mean,
  round(quantile_cont(err, 0.25), 3) AS p25, round(quantile_cont(err, 0.5), 3) AS median, round(quantile_cont(err, 0.75), 3) AS p75, count(DISTINCT cell) AS cells FROM fc GROUP BY method, lead""")
def object_forecast_errors(spark, sf_dir):
    s = T.forecast_summary(T.object_forecasts(positions(spark, sf_dir), [1, 2, 4]))
    return s.withColumns({"survival": F.round("survival", 9)} | {c: F.round(c, 3) for c in ("mean", "p25", "median", "p75")})


@query(f"""WITH {FC}, w AS (SELECT cell, issue, lead, max(err) FILTER (WHERE method = 'persistence') AS a, max(err) FILTER (WHERE method = 'extrapolation') AS b FROM fc GROUP BY ALL)
SELECT lead, count(*) AS n, round(avg(CASE WHEN b < a THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS closer, round(quantile_cont(b - a, 0.5), 3) AS median_diff FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY lead""")
def paired_comparison_pivot(spark, sf_dir):
    p = T.paired(T.object_forecasts(positions(spark, sf_dir), [1, 2, 4]), ["lead"], "persistence", "extrapolation")
    return p.withColumns({"closer": F.round("closer", 9), "median_diff": F.round("median_diff", 3)})


@query(f"""WITH {STEPS} SELECT cell, count(*) AS steps, count(*) FILTER (WHERE dist >= 4000 AND pd >= 4000 AND dx * px + dy * py < 0) AS reversals, count(*) FILTER (WHERE dist > 60000) AS jumps, round(max(dist), 3) AS longest,
  count(*) FILTER (WHERE dist >= 4000 AND pd >= 4000 AND dx * px + dy * py < 0) + 2 * count(*) FILTER (WHERE dist > 60000) AS score FROM tn GROUP BY cell ORDER BY score DESC, cell LIMIT 15""")
def suspicious_tracks_top15(spark, sf_dir):
    s = T.suspicious(T.steps(positions(spark, sf_dir)).where("dframe = 1"), 4000, 60000)
    return s.orderBy(F.col("score").desc(), "cell").limit(15).withColumn("longest", F.round("longest", 3))


@query(f"""WITH {POS}, g AS (SELECT cell % 40 AS family, frame, x, y FROM pos), n AS (SELECT family, frame, count(*) AS members FROM g GROUP BY ALL),
d AS (SELECT a.family, a.frame, max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS spread FROM g a JOIN g b USING (family, frame) GROUP BY ALL)
SELECT family, frame, members, round(spread, 3) AS spread FROM d JOIN n USING (family, frame) WHERE members > 1""")
def family_pairwise_spread(spark, sf_dir):
    rows = positions(spark, sf_dir).withColumn("family", F.col("cell") % 40)
    return T.pairwise_spread(rows, ["family", "frame"]).withColumn("spread", F.round("spread", 3))


@query(f"""WITH {STEPS}, s AS (SELECT o.cell, o.frame, p.area > 1 AS child, q.area > 1 AS parent FROM one o JOIN pos p USING (cell, frame) JOIN pos q ON q.cell = o.cell AND q.frame = o.frame - 1)
SELECT parent, child, count(*) AS n FROM s GROUP BY parent, child""")
def step_kind_matrix(spark, sf_dir):
    p = positions(spark, sf_dir)
    w = T.by_cell()
    s = p.withColumns({"pa": F.lag("area").over(w), "pf": F.lag("frame").over(w)}).where("frame - pf = 1")
    return s.groupBy((F.col("pa") > 1).alias("parent"), (F.col("area") > 1).alias("child")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EDGES}, c AS (SELECT frame, parent, child AS linked, overlap_px FROM kinds WHERE kind = 'CONTINUE')
SELECT c.frame, c.parent, c.overlap_px AS linked_px, coalesce(max(e.overlap_px) FILTER (WHERE e.child <> c.linked), 0) AS best_other_px FROM c JOIN edges e ON e.frame = c.frame AND e.parent = c.parent GROUP BY ALL""")
def link_overlap_audit(spark, sf_dir):
    e = T.link_events(_edges(spark, sf_dir)[1])
    c = e.where("kind = 'CONTINUE'").select("frame", "parent", F.col("child").alias("linked"), F.col("overlap_px").alias("linked_px"))
    return c.join(e, ["frame", "parent"]).groupBy("frame", "parent", "linked_px").agg(F.coalesce(F.max(F.when(F.col("child") != F.col("linked"), F.col("overlap_px"))), F.lit(0)).alias("best_other_px"))


MOVED = "mo AS (SELECT frame, y, x, 8 * v AS u, -4 * v AS w FROM px)"
SHIFT = f"""{MOVED}, sh AS (SELECT frame, feature, CAST(round_even(avg(w), 0) AS INT) AS dy, CAST(round_even(avg(u), 0) AS INT) AS dx FROM seg JOIN mo USING (frame, y, x) GROUP BY ALL),
lk AS (SELECT frame, parent, child FROM kinds WHERE kind = 'CONTINUE'),
me AS (SELECT s.frame, s.feature AS parent, b.feature AS child, count(*) AS px FROM seg s JOIN sh USING (frame, feature) JOIN seg b ON b.frame = s.frame + 1 AND b.y = s.y + sh.dy AND b.x = s.x + sh.dx GROUP BY ALL),
pe AS (SELECT a.frame, a.feature AS parent, b.feature AS child, count(*) AS px FROM seg a JOIN seg b ON b.frame = a.frame + 1 AND b.y = a.y AND b.x = a.x GROUP BY ALL),
own AS (SELECT l.*, p.n AS np, c.n AS nc, coalesce((SELECT px FROM pe e WHERE (e.frame, e.parent, e.child) = (l.frame, l.parent, l.child)), 0) AS o,
  coalesce((SELECT max(px) FROM pe e WHERE e.frame = l.frame AND e.parent = l.parent AND e.child <> l.child), 0) AS b, coalesce((SELECT px FROM me e WHERE (e.frame, e.parent, e.child) = (l.frame, l.parent, l.child)), 0) AS mo,
  coalesce((SELECT max(px) FROM me e WHERE e.frame = l.frame AND e.parent = l.parent AND e.child <> l.child), 0) AS mb
  FROM lk l JOIN size p ON p.frame = l.frame AND p.feature = l.parent JOIN size c ON c.frame = l.frame + 1 AND c.feature = l.child),
la AS (SELECT frame, parent, child, nc / np::DOUBLE AS area_ratio, o / least(np, nc)::DOUBLE AS linked_frac, b > o AS better_other, mo / least(np, nc)::DOUBLE AS moved_frac, mb > mo AS moved_better_other FROM own)"""
CENTRES = "ce AS (SELECT t.cell, t.frame, avg(s.y) AS y, avg(s.x) AS x FROM tracks t JOIN seg s USING (frame, feature) GROUP BY t.cell, t.frame)"


def _motion(px):
    """A stand-in motion field, from the raster's own values."""
    return px.select("frame", "y", "x", (8 * F.col("v")).alias("u"), (-4 * F.col("v")).alias("v"))


def _link_audit(spark, sf_dir):
    px = pixels(spark, sf_dir)
    seg, edges, tracks = _tracks(spark, sf_dir)
    parents = seg.groupBy("frame", "feature").agg(F.avg("y").alias("y"), F.avg("x").alias("x"))
    flow = T.parent_motion(parents, seg, _motion(px), HEIGHT, WIDTH)
    shift = flow.select("frame", "feature", F.rint("v").cast("int").alias("dy"), F.rint("u").cast("int").alias("dx"))
    return seg, tracks, T.link_audit(seg, edges.where("kind = 'CONTINUE'"), shift)


def _centres(seg, tracks):
    return tracks.join(seg, ["frame", "feature"]).groupBy("cell", "frame").agg(F.avg("y").alias("y"), F.avg("x").alias("x"))


@query(f"WITH {EDGES}, {SHIFT} SELECT frame, parent, child, round(area_ratio, 9) AS area_ratio, round(linked_frac, 9) AS linked_frac, better_other, round(moved_frac, 9) AS moved_frac, moved_better_other FROM la")
def segment_link_audit(spark, sf_dir):
    a = _link_audit(spark, sf_dir)[2]
    return a.select("frame", "parent", "child", F.round("area_ratio", 9).alias("area_ratio"), F.round("linked_frac", 9).alias("linked_frac"), "better_other", F.round("moved_frac", 9).alias("moved_frac"), "moved_better_other")


@query(f"""WITH {EDGES}, {SHIFT} SELECT count(*) AS seg_links, round(avg(CASE WHEN linked_frac = 0 AND moved_frac = 0 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS zero_overlap, round(avg(CASE WHEN better_other THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS better_other,
  round(avg(CASE WHEN area_ratio > 2 OR area_ratio < 0.5 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS area_jump FROM la""")
def segment_link_summary(spark, sf_dir):
    from nimboscale.operators.audit import link_summary

    return link_summary(_link_audit(spark, sf_dir)[2]).withColumns({c: F.round(c, 9) for c in ("zero_overlap", "better_other", "area_jump")})


@query(f"""WITH RECURSIVE {EDGES}, {TRACKS}, {SHIFT}, {CENTRES},
s0 AS (SELECT cell, frame, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM ce WINDOW w AS (PARTITION BY cell ORDER BY frame)), s1 AS (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM s0 WHERE dx IS NOT NULL),
s2 AS (SELECT *, lag(dx) OVER w AS px, lag(dy) OVER w AS py, lag(d) OVER w AS pd FROM s1 WINDOW w AS (PARTITION BY cell ORDER BY frame)),
a AS (SELECT cell, count(*) AS n_steps, count(*) FILTER (WHERE d >= 0.5 AND pd >= 0.5 AND dx * px + dy * py < 0) AS reversals, round(max(d), 6) AS max_step, min(frame) AS first_frame FROM s2 GROUP BY cell),
l AS (SELECT t.cell, count(*) AS seg_links, count(*) FILTER (WHERE better_other) AS id_switch_candidates, count(*) FILTER (WHERE linked_frac = 0) AS zero_overlap_links FROM la JOIN tracks t ON t.frame = la.frame AND t.feature = la.parent GROUP BY t.cell)
SELECT cell, n_steps, reversals, max_step, first_frame, coalesce(seg_links, 0) AS seg_links, coalesce(id_switch_candidates, 0) AS id_switch_candidates, coalesce(zero_overlap_links, 0) AS zero_overlap_links,
  reversals + coalesce(id_switch_candidates, 0) + coalesce(zero_overlap_links, 0) AS problem_score FROM a LEFT JOIN l USING (cell) ORDER BY problem_score DESC, n_steps DESC, cell LIMIT 15""")
def suspicious_links_top15(spark, sf_dir):
    seg, tracks, audited = _link_audit(spark, sf_dir)
    links = audited.join(tracks.withColumnRenamed("feature", "parent"), ["frame", "parent"])
    one = T.steps(_centres(seg, tracks)).where("dframe = 1")
    return T.suspicious_links(one, links, 0.5).orderBy(F.col("problem_score").desc(), F.col("n_steps").desc(), "cell").limit(15).withColumn("max_step", F.round("max_step", 6))


@query(f"""WITH RECURSIVE {EDGES}, {TRACKS}, {MOVED}, {CENTRES}, i AS (SELECT c.*, m.u, m.w, l.lead FROM ce c JOIN mo m ON m.frame = c.frame AND m.y = CAST(round_even(c.y, 0) AS INT) AND m.x = CAST(round_even(c.x, 0) AS INT) CROSS JOIN (VALUES (1), (2)) l(lead)),
f AS (SELECT i.*, o.x IS NOT NULL AS survived, sqrt(pow(i.x + lead * u - o.x, 2) + pow(i.y + lead * w - o.y, 2)) AS err FROM i LEFT JOIN ce o ON o.cell = i.cell AND o.frame = i.frame + lead)
SELECT lead, count(*) AS n, count(err) AS n_scored, round(avg(CASE WHEN survived THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS survival, round(avg(err), 6) AS mean, round(quantile_cont(err, 0.5), 6) AS median FROM f GROUP BY lead""")
def field_advection_errors(spark, sf_dir):
    seg, _, tracks = _tracks(spark, sf_dir)
    fc = T.field_forecasts(stored(_centres(seg, tracks), "centres"), _motion(pixels(spark, sf_dir)), [1, 2], HEIGHT, WIDTH)
    return T.forecast_summary(fc).select("lead", "n", "n_scored", F.round("survival", 9).alias("survival"), F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query(f"""WITH {FIX}, {PLACES}, near AS (SELECT f.cell, f.frame, p.place, 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians(p.lat - f.lat) / 2), 2) + cos(radians(f.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - f.lon) / 2), 2)))) AS km, p.place_id
  FROM fix f CROSS JOIN places p)
SELECT cell, frame, arg_min(place, km * 1000000 + place_id / 1000000.0) AS place, round(min(km), 5) AS km FROM near WHERE km <= 50 GROUP BY cell, frame""")
def station_proximity_50km(spark, sf_dir):
    from nimboscale.operators.products import nearest_place

    return nearest_place(_fixes(spark, sf_dir), places(spark, sf_dir), ["cell", "frame"], 50.0, sphere=True).withColumn("km", F.round("km", 5))


_POINT = "CAST(s_suppkey * 17 % 50 AS INT) AS y, CAST(s_suppkey * 23 % 64 AS INT) AS x"


@query(f"""WITH {PX}, pt AS (SELECT s_name AS place, {_POINT} FROM supplier),
w AS (SELECT px.frame, place, max(px.v + 0.5) AS p_max FROM pt JOIN px ON abs(px.y - pt.y) <= 5 AND abs(px.x - pt.x) <= 5 GROUP BY ALL),
i AS (SELECT a.frame AS issue, l.lead, a.place, b.p_max FROM w a CROSS JOIN (VALUES (1), (2)) l(lead) JOIN w b ON b.place = a.place AND b.frame = a.frame + l.lead WHERE b.p_max >= 0.86)
SELECT issue, place, min(lead) * 30 AS lead_min, round(arg_min(p_max, lead), 7) AS p_max, 'demo/' || issue || '/L' || min(lead) * 30 || '#' || regexp_replace(place, '[^A-Za-z0-9]', '-', 'g') AS alert_id FROM i GROUP BY issue, place""")
def place_window_alerts(spark, sf_dir):
    from nimboscale.operators.products import window_alerts
    from nimboscale.session import table

    k = F.col("s_suppkey")
    pt = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("place"), (k * 17 % HEIGHT).cast("int").alias("y"), (k * 23 % WIDTH).cast("int").alias("x"))
    px = pixels(spark, sf_dir).withColumn("p", F.col("v") + 0.5)
    return window_alerts(pt, px, "p", 5, [1, 2], 0.86, "demo").withColumn("p_max", F.round("p_max", 7))


@query(f"""WITH {POS}, n AS (SELECT cell, frame, min_bt - 250 AS x, lead(min_bt - 250) OVER (PARTITION BY cell ORDER BY frame) AS nxt FROM pos)
SELECT cell, count(*) AS n, round(sum(x * nxt) / sum(x * x), 7) AS phi FROM n WHERE x IS NOT NULL AND nxt IS NOT NULL GROUP BY cell""")
def ar1_by_cell(spark, sf_dir):
    p = positions(spark, sf_dir).withColumn("dev", F.col("min_bt") - 250)
    return T.ar1(p.withColumn("nxt", F.lead("dev").over(T.by_cell())), ["cell"], "dev", "nxt").withColumn("phi", F.round("phi", 7))
