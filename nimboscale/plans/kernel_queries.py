"""Queries of the frame kernels on the stand-in raster; those that SQL can say have their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nimboscale.operators import kernels as K, preprocess as P, products, verify as V
from nimboscale.operators.graph import connected_components
from nimboscale.operators.raster import against
from nimboscale.plans.region_queries import features
from nimboscale.plans.registry import query
from nimboscale.plans.standins import EVENT, HEIGHT, PX, SEG, WIDTH, pixels, segments
from nimboscale.plans.track_queries import CENTRES, EDGES, TRACKS

_PASS = """f{b} AS (SELECT f.frame, f.y, f.x, coalesce(f.v, m.v) AS v FROM f{a} f LEFT JOIN (
  SELECT t.frame, t.y, t.x, avg(n.v) AS v FROM small t CROSS JOIN near JOIN f{a} n ON n.frame = t.frame AND n.y = t.y + near.a AND n.x = t.x + near.b GROUP BY ALL) m ON m.frame = f.frame AND m.y = f.y AND m.x = f.x)"""
GAPS = f"""{PX}, near AS (SELECT a, b FROM (VALUES (-1), (0), (1)) i(a) CROSS JOIN (VALUES (-1), (0), (1)) j(b) WHERE a <> 0 OR b <> 0), gap AS (SELECT frame, y, x FROM pm WHERE v IS NULL),
reach AS (SELECT frame, y, x, y AS ty, x AS tx FROM gap UNION SELECT r.frame, r.y, r.x, g.y, g.x FROM reach r CROSS JOIN near JOIN gap g ON g.frame = r.frame AND g.y = r.ty + near.a AND g.x = r.tx + near.b),
small AS (SELECT frame, y, x FROM reach GROUP BY ALL HAVING count(*) <= 4), f0 AS (SELECT frame, y, x, v FROM pm), {", ".join(_PASS.format(a=k, b=k + 1) for k in range(4))}"""


@query(f"""WITH RECURSIVE {GAPS} SELECT frame, count(*) FILTER (WHERE v IS NOT NULL AND small.y IS NOT NULL) AS filled, count(*) FILTER (WHERE v IS NULL) AS missing, round(avg(v), 6) AS mean
FROM f4 LEFT JOIN small USING (frame, y, x) GROUP BY frame""")
def gap_filled_frames(spark, sf_dir):
    """Missing and filled pixels of each frame, and the mean after filling."""
    out = P.gap_fill(pixels(spark, sf_dir, True), HEIGHT, WIDTH)
    return out.groupBy("frame").agg(F.count_if("gapfilled").alias("filled"), F.count_if(F.col("v").isNull()).alias("missing"), F.round(F.avg("v"), 6).alias("mean"))


@query()
def watershed_segments(spark, sf_dir):
    seg = K.watershed(pixels(spark, sf_dir), features(spark, sf_dir), HEIGHT, WIDTH, -0.02)
    return seg.groupBy("frame", "feature").agg(F.count(F.lit(1)).alias("pixels"))


@query(f"""WITH RECURSIVE {EDGES}, {TRACKS}, {CENTRES}, en AS (SELECT cell, max(frame) AS frame, arg_max(y, frame) AS y, arg_max(x, frame) AS x FROM ce GROUP BY cell),
el AS (SELECT DISTINCT e.cell AS a, c.cell AS b FROM en e JOIN ce c ON c.frame IN (e.frame, e.frame + 1) AND c.cell <> e.cell AND sqrt(pow(e.y - c.y, 2) + pow(e.x - c.x, 2)) <= 6),
sy AS (SELECT a, b FROM el UNION SELECT b, a FROM el), re AS (SELECT a AS node, a AS other FROM sy UNION SELECT r.node, s.b FROM re r JOIN sy s ON s.a = r.other)
SELECT node, min(other) AS component FROM re GROUP BY node""")
def track_end_groups(spark, sf_dir):
    """Cells grouped where one ends near another, on the tile tracks' centres."""
    from nimboscale.plans.track_queries import _tracks

    seg, _, tracks = _tracks(spark, sf_dir)
    centres = seg.groupBy("frame", "feature").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    return connected_components(K.end_links(tracks.join(centres, ["frame", "feature"]), 6.0))


@query()
def extrapolated_contingency(spark, sf_dir):
    px = pixels(spark, sf_dir)
    fc = K.extrapolate(px, HEIGHT, WIDTH, [1, 2], 0.0).withColumn("frame", F.col("issue") + F.col("lead"))
    rows = against(fc, px).where("forecast IS NOT NULL").withColumns({"fc": F.col("forecast") < EVENT, "obs": F.col("observed") < EVENT})
    return V.cat_scores(V.contingency(rows, ["lead"], "fc", "obs"))


@query()
def forecast_predictors(spark, sf_dir):
    px = pixels(spark, sf_dir)
    rows = K.issue_features(px, K.extrapolate(px, HEIGHT, WIDTH, [1, 2], 0.0), EVENT)
    return rows.groupBy("issue", "lead").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in K.FEATURES])


@query(f"""WITH {PX}, s AS (SELECT frame, CAST(1 + frame * 100 + (y // 10) * 10 + (x // 8) AS INT) AS feature, y, x FROM px WHERE v < {EVENT})
SELECT frame, feature, count(*) AS pixels, CAST(4 * count(*) - 2 * (count(*) FILTER (WHERE r) + count(*) FILTER (WHERE d)) AS BIGINT) AS perimeter FROM (
  SELECT a.*, EXISTS (SELECT 1 FROM s b WHERE b.frame = a.frame AND b.feature = a.feature AND b.y = a.y AND b.x = a.x + 1) AS r,
    EXISTS (SELECT 1 FROM s b WHERE b.frame = a.frame AND b.feature = a.feature AND b.y = a.y + 1 AND b.x = a.x) AS d FROM s a) GROUP BY ALL""")
def contour_rings(spark, sf_dir):
    """Boundary length of each segment from its rings, against counted pixel sides."""
    seg = segments(pixels(spark, sf_dir))
    side = lambda r: F.aggregate(F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.abs(a[0] - b[0]) + F.abs(a[1] - b[1])), F.lit(0.0), lambda t, x: t + x)
    ring = products.rings(seg, ["frame", "feature"]).select("frame", "feature", F.aggregate("rings", F.lit(0.0), lambda t, r: t + side(r)).cast("long").alias("perimeter"))
    return ring.join(seg.groupBy("frame", "feature").agg(F.count(F.lit(1)).alias("pixels")), ["frame", "feature"]).select("frame", "feature", "pixels", "perimeter")


SPAN = 8
STREAMED = f"""{PX}, {SEG}, e0 AS (SELECT a.frame, a.feature AS parent, b.feature AS child, count(*) AS n FROM seg a JOIN seg b ON b.frame = a.frame + 1 AND b.y = a.y AND b.x = a.x AND b.frame // {SPAN} = a.frame // {SPAN} GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY frame, parent ORDER BY n DESC, child) = 1 AS bc, row_number() OVER (PARTITION BY frame, child ORDER BY n DESC, parent) = 1 AS bp FROM e0),
nodes AS (SELECT DISTINCT frame, feature FROM seg),
walk AS (SELECT n.frame, n.feature, n.frame AS rf, n.feature AS rr FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM best k WHERE bc AND bp AND k.frame + 1 = n.frame AND k.child = n.feature)
  UNION ALL SELECT w.frame + 1, k.child, w.rf, w.rr FROM walk w JOIN best k ON bc AND bp AND k.frame = w.frame AND k.parent = w.feature),
named AS (SELECT rf, rr, row_number() OVER (PARTITION BY rf // {SPAN} ORDER BY rf, rr) AS cell FROM (SELECT DISTINCT rf, rr FROM walk))"""


@query(f"WITH RECURSIVE {STREAMED} SELECT 'e' || (w.frame // {SPAN}) AS event, w.frame, w.feature, n.cell FROM walk w JOIN named n USING (rf, rr)")
def streamed_links(spark, sf_dir):
    """Cells from the stateful stream, run to its end over the stored tile segments; an event is SPAN frames."""
    import uuid

    from nimboscale.session import new_shared_path
    from nimboscale.streaming.frames import link_frames

    seg = segments(pixels(spark, sf_dir)).select(F.concat(F.lit("e"), F.expr(f"frame div {SPAN}")).alias("event"), "frame", "y", "x", "feature")
    path = new_shared_path(spark, "stream-in")
    seg.write.parquet(path)
    name, check, out = f"links_{uuid.uuid4().hex}", new_shared_path(spark, "stream-state"), new_shared_path(spark, "stream-out")
    flow = link_frames(spark.readStream.schema(seg.schema).parquet(path), WIDTH)
    run = flow.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)


@query(f"WITH RECURSIVE {STREAMED} SELECT 'e' || (w.frame // {SPAN}) AS event, w.frame, w.feature, n.cell, false AS late FROM walk w JOIN named n USING (rf, rr)")
def scattered_links(spark, sf_dir):
    """Cells from the stateful stream where every frame's rows come in several batches, in no order; a far later row closes the last frames."""
    import uuid

    from nimboscale.session import new_shared_path
    from nimboscale.streaming.frames import ROCKS, link_scattered_frames

    # An event's clock is its own: the watermark is one for all events, so none may run ahead of the others by more than rows may be late.
    time = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame") % SPAN * 1800)
    seg = segments(pixels(spark, sf_dir)).select(F.concat(F.lit("e"), F.expr(f"frame div {SPAN}")).alias("event"), time.alias("time"), "frame", "y", "x", "feature")
    path = new_shared_path(spark, "scattered-in")
    for part in range(3):
        seg.where(F.pmod(F.xxhash64("y", "x"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(path)
    end = seg.select("event").distinct().select("event", F.timestamp_seconds(F.lit(1_900_000_000)).alias("time"), F.lit(1 << 30).alias("frame"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(0).alias("feature"))
    end.coalesce(1).write.mode("append").parquet(path)
    name, check, out = f"links_{uuid.uuid4().hex}", new_shared_path(spark, "stream-state"), new_shared_path(spark, "stream-out")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        flow = link_scattered_frames(spark.readStream.schema(seg.schema).option("maxFilesPerTrigger", 1).parquet(path), WIDTH, 30 * 1440)
        flow.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).queryName(name).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(out)


@query()
def probability_scores(spark, sf_dir):
    """Five methods on identical pixels: trained on even issues, scored on odd ones."""
    from nimboscale.plans import probability as pr
    from nimboscale.session import stored

    rows = stored(pr.labelled_pixels(pixels(spark, sf_dir, True), EVENT, HEIGHT, WIDTH, [1, 2], 0.0), "predictors")
    sample = stored(pr.dataset(rows), "sample")
    even, odd = sample.where("issue % 2 = 0"), sample.where("issue % 2 = 1")
    _, _, _, calibrate = pr.train(even, odd, rounds=5)
    scored = stored(calibrate(rows.where("issue % 2 = 1")), "scored")
    return pr.evaluate(scored, pr.climatology(even), EVENT)["scores"].select("method", "mask", "lead", "n", *V.COUNTS, "csi", "bs", "bss")
