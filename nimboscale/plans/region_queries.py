"""Queries of run-length regions, detection, links and contours on the stand-in raster, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nimboscale.operators import kernels as K, regions as R
from nimboscale.plans.registry import query
from nimboscale.plans.standins import EVENT, HEIGHT, PX, WIDTH, pixels
from nimboscale.plans.track_queries import CENTRES, EDGES, TRACKS

LEVELS, LEAST, REACH = [-0.05, -0.1, -0.15], 4, 6.0


def features(spark, sf_dir):
    found = K.detect(pixels(spark, sf_dir), HEIGHT, WIDTH, LEVELS, LEAST, 0.0)
    return found.withColumns({c: F.round(c, 6) for c in ("cy", "cx")})


FEATURES = f"""{PX}, side(a, b) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)), lv(i, t) AS (VALUES {", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(LEVELS))}),
mk AS (SELECT frame, i, t, y, x, t - v AS w FROM px JOIN lv ON v < t),
rc AS (SELECT frame, i, y, x, y AS ty, x AS tx FROM mk UNION SELECT r.frame, r.i, r.y, r.x, n.y, n.x FROM rc r CROSS JOIN side JOIN mk n ON n.frame = r.frame AND n.i = r.i AND n.y = r.ty + a AND n.x = r.tx + b),
rg AS (SELECT frame, i, y, x, min(ty * 1000 + tx) AS region FROM rc GROUP BY ALL),
sz AS (SELECT frame, i, region, any_value(t) AS t, count(*) AS pixels, sum(w * y) / sum(w) AS cy, sum(w * x) / sum(w) AS cx FROM rg JOIN mk USING (frame, i, y, x) GROUP BY ALL HAVING count(*) >= {LEAST}),
inner_ AS (SELECT DISTINCT o.frame, o.i, o.region FROM rg o JOIN rg n ON n.frame = o.frame AND n.y = o.y AND n.x = o.x AND n.i > o.i JOIN sz z ON z.frame = n.frame AND z.i = n.i AND z.region = n.region),
ft AS (SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY cy, cx, t) AS INT) AS feature, round(cy, 6) AS cy, round(cx, 6) AS cx, t AS threshold, CAST(pixels AS INT) AS pixels
  FROM sz ANTI JOIN inner_ USING (frame, i, region))"""


@query(f"WITH RECURSIVE {FEATURES} SELECT frame, feature, cy, cx, threshold, pixels FROM ft")
def detected_features(spark, sf_dir):
    """Regions below nested thresholds, the coldest of each nest."""
    return features(spark, sf_dir)


CANDIDATES = f"cd AS (SELECT a.frame, a.feature AS parent, b.feature AS child, sqrt(pow(a.cy - b.cy, 2) + pow(a.cx - b.cx, 2)) AS dist FROM ft a JOIN ft b ON b.frame = a.frame + 1 WHERE sqrt(pow(a.cy - b.cy, 2) + pow(a.cx - b.cx, 2)) <= {{reach}})"


@query(f"""WITH RECURSIVE {FEATURES}, {CANDIDATES.format(reach=REACH)},
od AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY dist, parent, child) AS k FROM cd),
wk AS (SELECT frame, 0::BIGINT AS k, CAST([] AS INT[]) AS ps, CAST([] AS INT[]) AS cs, false AS keep, 0 AS parent, 0 AS child, 0.0::DOUBLE AS dist FROM od WHERE k = 1
  UNION ALL SELECT o.frame, o.k, CASE WHEN f THEN list_append(ps, o.parent) ELSE ps END, CASE WHEN f THEN list_append(cs, o.child) ELSE cs END, f, o.parent, o.child, o.dist
  FROM (SELECT w.ps, w.cs, o.*, NOT list_contains(w.ps, o.parent) AND NOT list_contains(w.cs, o.child) AS f FROM wk w JOIN od o ON o.frame = w.frame AND o.k = w.k + 1) o)
SELECT frame, parent, child, round(dist, 6) AS dist FROM wk WHERE keep""")
def nearest_feature_links(spark, sf_dir):
    """Closest pairs first, each feature once."""
    return K.link_nearest(features(spark, sf_dir), REACH).withColumn("dist", F.round("dist", 6))


NEAR = 3.0


@query(f"""WITH RECURSIVE {FEATURES}, {CANDIDATES.format(reach=NEAR)},
link AS (SELECT a.frame, a.parent, b.parent AS other FROM cd a JOIN cd b ON b.frame = a.frame AND b.child = a.child),
nr AS (SELECT frame, parent, parent AS other FROM cd UNION SELECT n.frame, n.parent, l.other FROM nr n JOIN link l ON l.frame = n.frame AND l.parent = n.other),
nets AS (SELECT frame, parent, min(other) AS net FROM nr GROUP BY ALL),
par AS (SELECT frame, parent, net, row_number() OVER (PARTITION BY frame, net ORDER BY parent) AS k FROM nets),
opt AS (SELECT frame, parent, child, dist * dist AS cost FROM cd UNION ALL SELECT DISTINCT frame, parent, NULL, {NEAR * NEAR} FROM cd),
asg AS (SELECT frame, net, 0::BIGINT AS k, CAST([] AS INT[]) AS used, 0.0::DOUBLE AS cost FROM par WHERE k = 1
  UNION ALL SELECT a.frame, a.net, p.k, CASE WHEN o.child IS NULL THEN a.used ELSE list_append(a.used, o.child) END, a.cost + o.cost
  FROM asg a JOIN par p ON p.frame = a.frame AND p.net = a.net AND p.k = a.k + 1 JOIN opt o ON o.frame = p.frame AND o.parent = p.parent WHERE o.child IS NULL OR NOT list_contains(a.used, o.child)),
sz2 AS (SELECT frame, net, max(k) AS parents FROM par GROUP BY ALL)
SELECT frame, count(*) AS subnets, sum(parents)::BIGINT AS parents, round(sum(cost), 5) AS cost FROM (
  SELECT a.frame, a.net, any_value(parents) AS parents, min(a.cost) AS cost FROM asg a JOIN sz2 s ON s.frame = a.frame AND s.net = a.net AND a.k = s.parents GROUP BY a.frame, a.net) GROUP BY frame""")
def optimal_link_costs(spark, sf_dir):
    """Least total cost of linking each frame to the next, over subnets; the SQL tries every assignment."""
    from nimboscale.session import stored

    found = stored(features(spark, sf_dir), "features")
    nets = K.subnets(stored(K.candidate_links(found, found, NEAR), "candidate-links"))
    counted = nets.groupBy("frame").agg(F.count_distinct("_net").alias("subnets"), F.count_distinct("parent").alias("parents"))
    links = K.least_links(nets, NEAR)
    linked = links.groupBy("frame").agg(F.count(F.lit(1)).alias("_k"), F.sum(F.col("dist") * F.col("dist")).alias("_sum"))
    total = F.coalesce("_sum", F.lit(0.0)) + (F.col("parents") - F.coalesce("_k", F.lit(0))) * NEAR * NEAR
    return counted.join(linked, "frame", "left").select("frame", "subnets", "parents", F.round(total, 5).alias("cost"))


@query(f"""WITH RECURSIVE {PX}, near AS (SELECT a, b FROM (VALUES (-1), (0), (1)) i(a) CROSS JOIN (VALUES (-1), (0), (1)) j(b) WHERE a <> 0 OR b <> 0), gap AS (SELECT frame, y, x FROM pm WHERE v IS NULL OR v > 0.1),
reach AS (SELECT frame, y, x, y AS ty, x AS tx FROM gap UNION SELECT r.frame, r.y, r.x, g.y, g.x FROM reach r CROSS JOIN near JOIN gap g ON g.frame = r.frame AND g.y = r.ty + near.a AND g.x = r.tx + near.b),
named AS (SELECT frame, y, x, min(ty * 1000 + tx) AS region FROM reach GROUP BY ALL), sizes AS (SELECT frame, region, count(*) AS pixels, max(y) - min(y) + 1 AS height FROM named GROUP BY ALL)
SELECT frame, count(*) AS regions, max(pixels) AS largest, max(height) AS tallest, CAST(sum(pixels * pixels) AS BIGINT) AS weight FROM sizes GROUP BY frame""")
def gap_region_sizes(spark, sf_dir):
    """Corner-connected regions of missing or warm pixels, of any size."""
    px = pixels(spark, sf_dir, True).where("v IS NULL OR v > 0.1").select("frame", "y", "x")
    sizes = R.regions(px, diagonal=True).groupBy("frame", "region").agg(F.count(F.lit(1)).alias("pixels"), (F.max("y") - F.min("y") + 1).alias("height"))
    return sizes.groupBy("frame").agg(F.count(F.lit(1)).alias("regions"), F.max("pixels").alias("largest"), F.max("height").alias("tallest"), F.sum(F.col("pixels") * F.col("pixels")).alias("weight"))


@query(f"""WITH {PX}, sq AS (SELECT p.frame, p.y, p.x, p.v AS a, q.v AS b, r.v AS c, s.v AS d FROM pm p JOIN pm q ON q.frame = p.frame AND q.y = p.y AND q.x = p.x + 1
  JOIN pm r ON r.frame = p.frame AND r.y = p.y + 1 AND r.x = p.x + 1 JOIN pm s ON s.frame = p.frame AND s.y = p.y + 1 AND s.x = p.x WHERE p.v + q.v + r.v + s.v IS NOT NULL),
k AS (SELECT *, CAST(a < {EVENT} AS INT) + CAST(b < {EVENT} AS INT) + CAST(c < {EVENT} AS INT) + CAST(d < {EVENT} AS INT) AS n, (a < {EVENT}) = (c < {EVENT}) AND (b < {EVENT}) = (d < {EVENT}) AND (a < {EVENT}) <> (b < {EVENT}) AS saddle FROM sq),
side AS (SELECT DISTINCT * FROM (SELECT frame, y::DOUBLE AS y, x + ({EVENT} - a) / (b - a) AS x FROM k WHERE (a < {EVENT}) <> (b < {EVENT}) UNION ALL SELECT frame, y + 1.0, x + ({EVENT} - d) / (c - d) FROM k WHERE (c < {EVENT}) <> (d < {EVENT})
  UNION ALL SELECT frame, y + ({EVENT} - a) / (d - a), x::DOUBLE FROM k WHERE (a < {EVENT}) <> (d < {EVENT}) UNION ALL SELECT frame, y + ({EVENT} - b) / (c - b), x + 1.0 FROM k WHERE (b < {EVENT}) <> (c < {EVENT})))
SELECT s.frame, segments, crossings, my, mx FROM (SELECT frame, CAST(sum(CASE WHEN saddle THEN 2 WHEN n BETWEEN 1 AND 3 THEN 1 ELSE 0 END) AS BIGINT) AS segments FROM k GROUP BY frame) s
JOIN (SELECT frame, count(*) AS crossings, round(avg(y), 6) AS my, round(avg(x), 6) AS mx FROM side GROUP BY frame) c USING (frame)""")
def contour_crossings(spark, sf_dir):
    """Segments of the event contour, its crossings and their mean place, on the raster with gaps."""
    from nimboscale.session import stored

    seg = stored(R.contour_segments(pixels(spark, sf_dir, True), EVENT), "contour-segments")
    # The last crossing of an open contour is named by what leads to it; its place is its side's, met from either square.
    chains = R.chained(seg)
    ends = seg.join(seg.select(F.col("src").alias("dst")), "dst", "left_anti").select("frame", "dst")
    placed = ends.select("frame", *_place(F.col("dst"))).join(pixels(spark, sf_dir, True).select("frame", "y", "x", F.col("v").alias("a")), ["frame", "y", "x"])
    other = pixels(spark, sf_dir, True).select("frame", F.col("y").alias("oy"), F.col("x").alias("ox"), F.col("v").alias("b"))
    placed = placed.withColumns({"oy": F.col("y") + F.col("down"), "ox": F.col("x") + 1 - F.col("down")}).join(other, ["frame", "oy", "ox"])
    share = (F.lit(EVENT) - F.col("a")) / (F.col("b") - F.col("a"))
    last = placed.select("frame", (F.col("y") + F.col("down") * share).alias("y"), (F.col("x") + (1 - F.col("down")) * share).alias("x"))
    every = chains.select("frame", "y", "x").unionByName(last).groupBy("frame").agg(F.count(F.lit(1)).alias("crossings"), F.round(F.avg("y"), 6).alias("my"), F.round(F.avg("x"), 6).alias("mx"))
    return seg.groupBy("frame").agg(F.count(F.lit(1)).alias("segments")).join(every, "frame")


def _place(side):
    """Upper or left centre of a side, and whether the side goes down from it."""
    code, low = F.shiftright(side, 1), (1 << R.BITS) - 1
    return [F.shiftright(code, R.BITS).bitwiseAND(F.lit(low)).cast("int").alias("y"), code.bitwiseAND(F.lit(low)).cast("int").alias("x"), side.bitwiseAND(F.lit(1)).cast("int").alias("down")]


@query(f"""WITH RECURSIVE {EDGES}, {TRACKS}, {CENTRES}, en AS (SELECT cell, max(frame) AS frame, arg_max(y, frame) AS y, arg_max(x, frame) AS x FROM ce GROUP BY cell),
el AS (SELECT e.cell AS a, c.cell AS b, sqrt(pow(e.y - c.y, 2) + pow(e.x - c.x, 2)) AS d FROM en e JOIN ce c ON c.frame IN (e.frame, e.frame + 1) AND c.cell <> e.cell WHERE sqrt(pow(e.y - c.y, 2) + pow(e.x - c.x, 2)) <= 6),
ed AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, round(min(d), 6) AS weight FROM el GROUP BY ALL),
od AS (SELECT *, row_number() OVER (ORDER BY weight, src, dst) AS k FROM ed),
both_ AS (SELECT src AS u, dst AS v, k FROM od UNION ALL SELECT dst, src, k FROM od),
rc AS (SELECT k AS edge, src AS node FROM od UNION SELECT r.edge, b.v FROM rc r JOIN both_ b ON b.u = r.node AND b.k < r.edge)
SELECT src, dst, weight FROM od WHERE NOT EXISTS (SELECT 1 FROM rc WHERE rc.edge = od.k AND rc.node = od.dst)""")
def track_end_forest(spark, sf_dir):
    """Links between cells one of which ends near another: a minimum spanning forest by distance."""
    from nimboscale.operators.graph import minimum_spanning_forest
    from nimboscale.plans.track_queries import _tracks

    seg, _, tracks = _tracks(spark, sf_dir)
    centres = seg.groupBy("frame", "feature").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    links = K.end_links(tracks.join(centres, ["frame", "feature"]), 6.0).withColumn("length", F.round("length", 6))
    return minimum_spanning_forest(links, weight="length")
