"""Audit, lifecycle-reliability and selection queries on the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from nimboscale.operators import audit as A, raster as R, tracks as T, verify as V
from nimboscale.operators.quantile import with_quantiles
from nimboscale.plans.registry import query
from nimboscale.plans.score_queries import SCRAMBLED
from nimboscale.plans.standins import EVENT, POS, PX, SC, SEG, pixels, positions, scores, segments
from nimboscale.plans.track_queries import EDGES, RATES, STEPS, TRACKS, _phased, _tracks
from nimboscale.session import stored, table


@query(f"WITH {POS}, n AS (SELECT cell, count(*) AS n FROM pos GROUP BY cell) SELECT cell, frame FROM pos JOIN n USING (cell) WHERE n >= 42")
def stub_filter(spark, sf_dir):
    return A.long_enough(positions(spark, sf_dir), 42).select("cell", "frame")


@query(f"""WITH RECURSIVE {EDGES}, {TRACKS}, ev AS (
  SELECT k.frame + 1 AS frame, p.cell AS a, c.cell AS b FROM kinds k JOIN tracks p ON p.frame = k.frame AND p.feature = k.parent JOIN tracks c ON c.frame = k.frame + 1 AND c.feature = k.child WHERE kind IN ('MERGE', 'SPLIT')
), g AS (SELECT frame, a AS cell FROM ev UNION SELECT frame, b FROM ev), ar AS (SELECT frame, feature, count(*) AS area FROM seg GROUP BY ALL),
r AS (SELECT t.cell, t.frame, a.area, g.cell IS NOT NULL AS gen FROM tracks t JOIN ar a USING (frame, feature) LEFT JOIN g ON g.cell = t.cell AND g.frame = t.frame),
d AS (SELECT *, ln(area) - lag(ln(area)) OVER w AS d FROM r WINDOW w AS (PARTITION BY cell ORDER BY frame)),
p AS (SELECT *, lead(d) OVER w AS nxt, lead(gen) OVER w AS ng FROM d WINDOW w AS (PARTITION BY cell ORDER BY frame))
SELECT count(*) AS n, round(sum(d * nxt) / sum(d * d), 7) AS phi FROM p WHERE NOT gen AND ng = false AND d IS NOT NULL AND nxt IS NOT NULL""")
def clean_step_ar1(spark, sf_dir):
    seg, edges, tracks = _tracks(spark, sf_dir)
    area = seg.groupBy("frame", "feature").agg(F.count(F.lit(1)).alias("area"))
    rows = A.genealogy_flag(tracks.join(area, ["frame", "feature"]), T.genealogy(tracks, edges))
    return T.ar1(A.clean_pairs(A.log_steps(rows, "area", "d"), "d"), [], "d", "nxt").withColumn("phi", F.round("phi", 7))


@query(f"""WITH {STEPS}, sp AS (SELECT cell, max(frame) - min(frame) + 1 AS span, count(*) AS n FROM pos GROUP BY cell)
SELECT (SELECT count(*) FROM sp) AS cells, (SELECT CAST(sum(n) AS BIGINT) FROM sp) AS rows, (SELECT count(*) FROM sp WHERE span >= 4) AS long_cells, count(*) AS steps,
  round(quantile_cont(dist, 0.5), 3) AS median_step, round(quantile_cont(dist, 0.9), 3) AS p90_step, round(avg(CASE WHEN dframe = 1 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS unbroken FROM st""")
def track_audit_summary(spark, sf_dir):
    p = positions(spark, sf_dir)
    return A.audit_summary(T.steps(p), p).withColumns({"median_step": F.round("median_step", 3), "p90_step": F.round("p90_step", 3), "unbroken": F.round("unbroken", 9)})


@query(f"""WITH {POS}, c AS (SELECT *, abs(core - lag(core) OVER (PARTITION BY cell ORDER BY frame)) > 0 AS c FROM pos)
SELECT count(*) AS n, round(avg(CASE WHEN c THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS changed, round(quantile_cont(min_bt, 0.5) FILTER (WHERE c), 6) AS median_changed, round(quantile_cont(min_bt, 0.5) FILTER (WHERE NOT c), 6) AS median_same FROM c WHERE c IS NOT NULL""")
def threshold_change_share(spark, sf_dir):
    return A.change_share(positions(spark, sf_dir), "core", "min_bt").withColumns({"changed": F.round("changed", 9), "median_changed": F.round("median_changed", 6), "median_same": F.round("median_same", 6)})


@query(f"""WITH RECURSIVE {EDGES}, {TRACKS}, u AS (SELECT frame, feature FROM tracks WHERE cell IN (SELECT cell FROM tracks GROUP BY cell HAVING count(*) >= 3)),
m AS (SELECT p.frame, s.feature, u.feature IS NOT NULL AS ok FROM px p LEFT JOIN seg s USING (frame, y, x) LEFT JOIN u ON u.frame = s.frame AND u.feature = s.feature WHERE p.v < -0.1)
SELECT frame, count(*) AS n, round(count(feature) / count(*)::DOUBLE, 9) AS segmented, round(count(*) FILTER (WHERE ok) / count(*)::DOUBLE, 9) AS usable FROM m GROUP BY frame""")
def coverage_shares(spark, sf_dir):
    seg, _, tracks = _tracks(spark, sf_dir)
    cold = pixels(spark, sf_dir).where("v < -0.1").select("frame", "y", "x")
    return A.coverage(cold, seg, A.long_enough(tracks, 3)).withColumns({"segmented": F.round("segmented", 9), "usable": F.round("usable", 9)})


@query(f"""WITH {POS}, g AS (SELECT cell % 40 AS family, frame, x, y FROM pos), d AS (SELECT a.family, a.frame, max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS spread, count(*) AS k FROM g a JOIN g b USING (family, frame) GROUP BY ALL)
SELECT count(*) AS n, round(quantile_cont(spread, 0.5), 3) AS median, round(quantile_cont(spread, 0.9), 3) AS p90, round(max(spread), 3) AS largest FROM d WHERE k > 1""")
def family_spread_stats(spark, sf_dir):
    s = T.pairwise_spread(positions(spark, sf_dir).withColumn("family", F.col("cell") % 40), ["family", "frame"])
    s = stored(s, "spreads")
    out = with_quantiles(s.agg(F.count(F.lit(1)).alias("n"), F.max("spread").alias("largest")), s, [], {"median": ("spread", 0.5), "p90": ("spread", 0.9)})
    return out.select("n", *[F.round(c, 3).alias(c) for c in ("median", "p90", "largest")])


@query(f"""WITH {RATES}, s AS (SELECT cell, min(min_bt) AS coldest, (max(frame) - min(frame)) * 30 AS lifetime FROM ph GROUP BY cell)
SELECT cell, round(coldest, 6) AS coldest, lifetime FROM s WHERE coldest < 290 AND lifetime >= 120 ORDER BY coldest, lifetime DESC, cell LIMIT 1""")
def selected_lifecycle_cell(spark, sf_dir):
    s = T.cell_summary(_phased(spark, sf_dir)).select("cell", F.col("min_bt").alias("coldest"), F.col("lifetime_min").alias("lifetime"))
    return s.where("coldest < 290 AND lifetime >= 120").orderBy("coldest", F.col("lifetime").desc(), "cell").limit(1).withColumn("coldest", F.round("coldest", 6))


@query(f"""WITH {SC}, c AS (SELECT method, lead, issue, max(p) AS p FROM sc WHERE lead = 60 GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY method ORDER BY coalesce(p, -1) DESC, issue) AS INT) AS rk FROM c)
SELECT method, issue, round(p, 6) AS p, rk FROM r WHERE rk <= 5""")
def top_five_by_probability(spark, sf_dir):
    from pyspark.sql import Window

    c = scores(spark, sf_dir).where("lead = 60").groupBy("method", "issue").agg(F.max("p").alias("p"))
    rk = F.row_number().over(Window.partitionBy("method").orderBy(F.coalesce("p", F.lit(-1.0)).desc(), "issue"))
    return c.withColumn("rk", rk).where("rk <= 5").select("method", "issue", F.round("p", 6).alias("p"), "rk")


@query(f"""WITH {PX}, a AS (SELECT *, sum(CASE WHEN v < {EVENT} THEN 1 ELSE 0 END) OVER (PARTITION BY frame, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM px),
b AS (SELECT frame, y, x, sum(s) OVER (PARTITION BY frame, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 25.0::DOUBLE AS f FROM a)
SELECT p.frame AS issue, round(1 - sum((p.f - o.f) * (p.f - o.f)) / (sum(p.f * p.f) + sum(o.f * o.f)), 8) AS fss FROM b p JOIN b o ON o.frame = p.frame + 1 AND o.y = p.y AND o.x = p.x GROUP BY p.frame""")
def fss_per_issue(spark, sf_dir):
    b = R.box_fraction(pixels(spark, sf_dir).withColumn("e", F.col("v") < EVENT), "e", 5).select("frame", "y", "x", "fraction")
    return V.fss(R.against(R.persistence(b, [1], "fraction"), b, "fraction"), ["issue"], "forecast", "observed").withColumn("fss", F.round("fss", 8))


@query(f"""WITH {PX}, f AS (SELECT frame, count(*) FILTER (WHERE v < {EVENT}) AS area, avg(CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS missing, min(v) AS low FROM pm GROUP BY frame)
SELECT count(*) AS frames, round(avg(CASE WHEN low < -0.3 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS deep_share, round(avg(area), 6) AS mean_area, max(area) AS max_area, round(avg(missing), 9) AS missing,
  count(*) >= 8 AND avg(CASE WHEN low < -0.3 THEN 1.0::DOUBLE ELSE 0.0 END) >= 0.5 AS suitable FROM f""")
def event_qc_summary(spark, sf_dir):
    f = pixels(spark, sf_dir, True).groupBy("frame").agg(F.count_if(F.col("v") < EVENT).alias("area"), F.avg(F.col("v").isNull().cast("double")).alias("missing"), F.min("v").alias("low"))
    deep = F.avg((F.col("low") < -0.3).cast("double"))
    return f.agg(F.count(F.lit(1)).alias("frames"), F.round(deep, 9).alias("deep_share"), F.round(F.avg("area"), 6).alias("mean_area"), F.max("area").alias("max_area"), F.round(F.avg("missing"), 9).alias("missing"),
                 ((F.count(F.lit(1)) >= 8) & (deep >= 0.5)).alias("suitable"))


@query(f"SELECT event_id, event_type FROM events ORDER BY {SCRAMBLED('event_id', 21)}, event_id LIMIT 200")
def random_row_sample(spark, sf_dir):
    return A.random_rows(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 200, 21)


@query(f"""WITH {SC}, m AS (SELECT method, lead, avg(p) - avg(o) AS d, stddev_samp(p - o) / sqrt(count(*)) AS se FROM sc GROUP BY ALL)
SELECT method, lead, CASE WHEN d - 2 * se > 0 THEN 'above' WHEN d + 2 * se < 0 THEN 'below' ELSE 'neither' END AS class FROM m""")
def interval_classes(spark, sf_dir):
    m = scores(spark, sf_dir).groupBy("method", "lead").agg((F.avg("p") - F.avg("o")).alias("d"), (F.stddev_samp(F.col("p") - F.col("o")) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return A.interval_class(m.withColumns({"low": F.col("d") - 2 * F.col("se"), "high": F.col("d") + 2 * F.col("se")}), "low", "high").select("method", "lead", "class")


@query(f"""WITH {PX}, {SEG}, c AS (SELECT frame, feature, CAST(round_even(avg(y), 0) AS INT) AS y, CAST(round_even(avg(x), 0) AS INT) AS x FROM seg GROUP BY ALL)
SELECT c.frame, c.feature, round(max(p.v), 7) AS max_value FROM c JOIN px p ON p.frame = c.frame AND abs(p.y - c.y) <= 2 AND abs(p.x - c.x) <= 2 GROUP BY ALL""")
def cell_window_max(spark, sf_dir):
    c = segments(pixels(spark, sf_dir)).groupBy("frame", "feature").agg(F.rint(F.avg("y")).cast("int").alias("y"), F.rint(F.avg("x")).cast("int").alias("x"))
    return R.window_extreme(c, pixels(spark, sf_dir), "v", 2, ["frame", "feature"]).withColumn("max_value", F.round("max_value", 7))


@query(f"""WITH {SC} SELECT method, count(*) AS n, round(avg(CASE WHEN extract('month' FROM issue) IN (6, 7, 8) THEN p END), 8) AS summer, round(avg(CASE WHEN lead IN (30, 60, 120, 180) THEN p END), 8) AS reporting FROM sc GROUP BY method""")
def reporting_leads(spark, sf_dir):
    s = scores(spark, sf_dir)
    return s.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.month("issue").isin(6, 7, 8), F.col("p"))), 8).alias("summer"), F.round(F.avg(F.when(F.col("lead").isin(30, 60, 120, 180), F.col("p"))), 8).alias("reporting"))
