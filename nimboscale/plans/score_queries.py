"""Score, resampling, learning and product queries on the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from nimboscale.functions import scalars as S
from nimboscale.operators import ml, products, resample as B, verify as V
from nimboscale.operators.quantile import with_quantiles
from nimboscale.plans.registry import query
from nimboscale.plans.standins import PLACES, POS, PX, SC, pixels, places, scores
from nimboscale.session import stored, table

COUNTED = """count(*) FILTER (WHERE fc AND obs) AS H, count(*) FILTER (WHERE NOT fc AND obs) AS M, count(*) FILTER (WHERE fc AND NOT obs) AS F, count(*) FILTER (WHERE NOT fc AND NOT obs) AS CN"""
CLIM = 0.4
CT = f"ct AS (SELECT method, event, lead, {COUNTED} FROM sc GROUP BY ALL)"


def _counts(spark, sf_dir):
    return V.contingency(scores(spark, sf_dir), ["method", "event", "lead"], "fc", "obs")


@query(f"""WITH {SC}, {CT} SELECT event, method, lead, CAST(GROUPING(event) * 4 + GROUPING(method) * 2 + GROUPING(lead) AS BIGINT) AS level, CAST(sum(H) AS BIGINT) AS H, CAST(sum(M) AS BIGINT) AS M, CAST(sum(F) AS BIGINT) AS F, CAST(sum(CN) AS BIGINT) AS CN
FROM ct GROUP BY GROUPING SETS ((event, method, lead), (method, lead), (method))""")
def contingency_rollup_grouping_sets(spark, sf_dir):
    return V.roll_up(_counts(spark, sf_dir), [["event", "method", "lead"], ["method", "lead"], ["method"]], ["H", "M", "F", "CN"])


@query(f"""WITH {SC} SELECT method, lead, count(*) AS n, round(sum((p - o) * (p - o)), 5) AS brier_sum, round(sum(({CLIM} - o) * ({CLIM} - o)), 5) AS brier_clim_sum,
round(sum((p - o) * (p - o)) / count(*), 8) AS bs, round(1 - sum((p - o) * (p - o)) / sum(({CLIM} - o) * ({CLIM} - o)), 8) AS bss FROM sc GROUP BY method, lead""")
def brier_skill(spark, sf_dir):
    b = V.brier(scores(spark, sf_dir).withColumn("c", F.lit(CLIM)), ["method", "lead"], "p", "o", "c")
    return b.withColumns({"brier_sum": F.round("brier_sum", 5), "brier_clim_sum": F.round("brier_clim_sum", 5), "bs": F.round("bs", 8), "bss": F.round("bss", 8)})


REL = """bins AS (SELECT method, lead, CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, sum(p) AS sum_p, sum(o) AS sum_o FROM sc GROUP BY ALL),
rel AS (SELECT k.method, k.lead, CAST(b.i AS INT) AS bin, coalesce(n, 0) AS n, coalesce(sum_p, 0) AS sum_p, coalesce(sum_o, 0) AS sum_o
  FROM (SELECT DISTINCT method, lead FROM sc) k CROSS JOIN range(10) b(i) LEFT JOIN bins ON bins.method = k.method AND bins.lead = k.lead AND bins.bin = b.i)"""


def _reliability(spark, sf_dir):
    return V.reliability(scores(spark, sf_dir), ["method", "lead"], "p", "o")


@query(f"WITH {SC}, {REL} SELECT method, lead, bin, n, round(sum_p, 4) AS sum_p, round(sum_o, 4) AS sum_o FROM rel")
def reliability_bins(spark, sf_dir):
    return _reliability(spark, sf_dir).withColumns({"sum_p": F.round("sum_p", 4), "sum_o": F.round("sum_o", 4)})


LB = "CASE WHEN lead BETWEEN 30 AND 30 THEN 0 WHEN lead BETWEEN 60 AND 60 THEN 1 WHEN lead BETWEEN 90 AND 120 THEN 2 WHEN lead BETWEEN 150 AND 360 THEN 3 END"
#: First and last lead of each bin, minutes.
BINS = [(30, 30), (60, 60), (90, 120), (150, 360)]


@query(f"""WITH {SC}, {REL}, m AS (SELECT method, CAST({LB} AS INT) AS lead_bin, bin, sum(n) AS n, sum(sum_p) AS sp, sum(sum_o) AS so FROM rel GROUP BY ALL)
SELECT method, lead_bin, round(sum(abs(sp - so)) / sum(n), 8) AS ece, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY method, lead_bin""")
def ece_by_lead_bin(spark, sf_dir):
    binned = _reliability(spark, sf_dir).withColumn("lead_bin", V.lead_bin(F.col("lead"), BINS))
    return V.expected_calibration_error(binned, ["method", "lead_bin"]).withColumn("ece", F.round("ece", 8))


@query(f"""WITH {SC}, m AS (SELECT method, lead, 'D' AS mask, {COUNTED} FROM sc GROUP BY ALL UNION ALL SELECT method, lead, 'V', {COUNTED} FROM sc WHERE p < 0.8 GROUP BY ALL)
SELECT method, lead, {', '.join(f"CAST(sum(CASE WHEN mask = 'D' THEN {c} ELSE 0 END) - sum(CASE WHEN mask = 'V' THEN {c} ELSE 0 END) AS BIGINT) AS {c}" for c in ('H', 'M', 'F', 'CN'))} FROM m GROUP BY method, lead""")
def edge_only_scores(spark, sf_dir):
    s = scores(spark, sf_dir)
    d = V.contingency(s, ["method", "lead"], "fc", "obs").withColumn("mask", F.lit("D"))
    v = V.contingency(s, ["method", "lead"], "fc", "obs", F.col("p") < 0.8).withColumn("mask", F.lit("V"))
    return V.edge_only(d.unionByName(v), ["method", "lead"], "mask", ["H", "M", "F", "CN"])


@query(f"""WITH {SC}, c AS (SELECT method, lead, count(*) FILTER (WHERE fc AND obs) / count(*) FILTER (WHERE fc OR obs)::DOUBLE * max(1 - lead / 300.0::DOUBLE) AS csi FROM sc GROUP BY method, lead),
r AS (SELECT *, csi > 0.1 AS ok, first_value(csi) OVER w AS c1, min(CASE WHEN csi > 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY method ORDER BY lead) AS held FROM c WINDOW w AS (PARTITION BY method ORDER BY lead))
SELECT method, coalesce(max(lead) FILTER (WHERE held = 1), 0) AS useful_to, CAST(sum(held) AS BIGINT) AS useful_leads, min(lead) FILTER (WHERE csi <= 0.5 * c1) AS half_lead, round(-var_pop(lead) FILTER (WHERE lead <= 180) / covar_pop(ln(csi), lead) FILTER (WHERE lead <= 180), 5) AS e_folding FROM r GROUP BY method""")
def skill_decay(spark, sf_dir):
    c = V.contingency(scores(spark, sf_dir), ["method", "lead"], "fc", "obs")
    c = c.withColumn("csi", V.ratio(F.col("H"), F.col("H") + F.col("M") + F.col("F")) * (1 - F.col("lead") / 300.0)).withColumn("ok", F.col("csi") > 0.1)
    return V.skill_decay(c, ["method"], "lead", "csi", "ok").withColumn("e_folding", F.round("e_folding", 5))


@query(f"""WITH {SC}, e AS (SELECT event, lead, avg(o) - avg(p) AS v FROM sc GROUP BY ALL)
SELECT lead, count(v) AS events, round(avg(v), 8) AS mean, round(min(v), 8) AS least, round(max(v), 8) AS largest, count(*) FILTER (WHERE v > 0) AS positive FROM e GROUP BY lead""")
def cross_event_signcount(spark, sf_dir):
    e = scores(spark, sf_dir).groupBy("event", "lead").agg((F.avg("o") - F.avg("p")).alias("v"))
    return V.across_events(e, ["lead"], "v").withColumns({c: F.round(c, 8) for c in ("mean", "least", "largest")})


@query(f"""WITH {SC}, c AS (SELECT method, lead, count(*) FILTER (WHERE fc AND obs) AS h FROM sc GROUP BY ALL)
SELECT lead, arg_max(method, h * 1000 - CASE method WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS best, max(h) AS hits FROM c GROUP BY lead""")
def best_method_by_lead(spark, sf_dir):
    rank = F.when(F.col("method") == "A", 0).when(F.col("method") == "N", 1).otherwise(2)
    return _counts(spark, sf_dir).groupBy("method", "lead").agg(F.sum("H").alias("h")).groupBy("lead").agg(F.max_by("method", F.struct(F.col("h"), -rank)).alias("best"), F.max("h").alias("hits"))


@query(f"""WITH {SC}, b AS (SELECT method, CAST(floor(extract('day' FROM issue) / 6) * 6 AS INT) AS low, {COUNTED} FROM sc GROUP BY ALL)
SELECT method, printf('%02d-%02d', low, low + 6) AS block, H, M, F, CN FROM b""")
def block_scores(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("block", S.hour_block(F.dayofmonth("issue")))
    return V.contingency(s, ["method", "block"], "fc", "obs")


@query(f"""WITH {SC}, i AS (SELECT method, lead, issue, avg(p) AS q FROM sc GROUP BY ALL)
SELECT method, lead, count(*) AS issues, round(quantile_cont(q, 0.25), 8) AS p25, round(quantile_cont(q, 0.75), 8) AS p75 FROM i GROUP BY method, lead""")
def issue_iqr_band(spark, sf_dir):
    i = scores(spark, sf_dir).groupBy("method", "lead", "issue").agg(F.avg("p").alias("q"))
    i = stored(i, "issue-means")
    out = with_quantiles(i.groupBy("method", "lead").agg(F.count(F.lit(1)).alias("issues")), i, ["method", "lead"], {"p25": ("q", 0.25), "p75": ("q", 0.75)})
    return out.withColumns({c: F.round(c, 8) for c in ("p25", "p75")})


# ---- sampling -----------------------------------------------------------------

SCRAMBLED = lambda k, seed: f"md5('{seed}:' || CAST({k} AS VARCHAR))"
#: Most rows of a stratum.
CAPS = {"event": 150, "near": 150, "far": 60}
ROWS = """mlrows AS (SELECT l_orderkey * 8 + l_linenumber AS pixel, CAST(l_linenumber * 30 AS INT) AS lead, CASE WHEN l_tax > 0.065 THEN 'event' WHEN l_discount > 0.055 THEN 'near' ELSE 'far' END AS stratum, CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS y FROM lineitem)"""
SAMPLE = f"""smp AS (SELECT *, n / least(n, cap)::DOUBLE AS weight FROM (SELECT *, count(*) OVER (PARTITION BY lead, stratum) AS n, row_number() OVER (PARTITION BY lead, stratum ORDER BY {SCRAMBLED('pixel', 5)}, pixel, y) AS rk,
  CASE stratum WHEN 'event' THEN 150 WHEN 'near' THEN 150 ELSE 60 END AS cap FROM mlrows) WHERE rk <= cap)"""


def _sample(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    rows = t.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pixel"), (F.col("l_linenumber") * 30).cast("int").alias("lead"),
        F.when(F.col("l_tax") > 0.065, "event").when(F.col("l_discount") > 0.055, "near").otherwise("far").alias("stratum"), (F.col("l_quantity") > 30).cast("int").alias("y"),
    )
    return B.stratified_sample(rows, ["lead", "stratum"], "pixel", CAPS, "stratum", 5, ties=["y"])


@query(f"WITH {ROWS}, {SAMPLE} SELECT lead, stratum, count(*) AS kept, CAST(round(sum(weight)) AS BIGINT) AS population, CAST(sum(pixel % 1000) AS BIGINT) AS checksum FROM smp GROUP BY lead, stratum")
def stratified_ipw_sample_totals(spark, sf_dir):
    return _sample(spark, sf_dir).groupBy("lead", "stratum").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("weight")).cast("long").alias("population"), F.sum(F.col("pixel") % 1000).alias("checksum"))


@query(f"WITH {ROWS}, {SAMPLE} SELECT lead, round(sum(y * weight) / sum(weight), 8) AS base_rate FROM smp GROUP BY lead")
def weighted_base_rate_by_lead(spark, sf_dir):
    return _sample(spark, sf_dir).groupBy("lead").agg(F.round(F.sum(F.col("y") * F.col("weight")) / F.sum("weight"), 8).alias("base_rate"))


@query(f"""WITH {SC} SELECT method, round(-sum((lead / 30) * (o * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - o) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))) / sum(lead / 30), 6) AS loss FROM sc GROUP BY method""")
def weighted_logloss(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("method").agg(F.round(ml.log_loss(F.col("p"), F.col("o"), F.col("lead") / 30), 6).alias("loss"))


UNITS, REPS, BLOCK = 48, 1000, 12
#: The draws of the SQL form are its own: what must agree is the estimate, its spread by theory, and that the replicates follow it.
LAW = """count(*) >= 0.9 * {reps} AND abs(stddev_pop({v}) / any_value(sd) - 1) < 0.15 AS spread_fits,
  abs(quantile_cont({v}, 0.025) - (any_value({e}) - 1.96 * any_value(sd))) < 0.4 * any_value(sd) AS low_fits,
  abs(quantile_cont({v}, 0.975) - (any_value({e}) + 1.96 * any_value(sd))) < 0.4 * any_value(sd) AS high_fits,
  count(DISTINCT {v}) >= 0.5 * {reps} AS resampled"""


def _law(reps, by: list[str], value: str, theory):
    """(by..., estimate, sd, spread_fits, low_fits, high_fits, resampled): do the replicates of ``value`` have the spread ``sd`` around ``estimate``."""
    seen = reps.groupBy(*by).agg(F.stddev_pop(value).alias("_sd"), F.count(value).alias("_n"), F.count_distinct(value).alias("_distinct"))
    ends = B.interval(reps, by, value)
    out = theory.join(seen, by).join(ends, by) if by else theory.crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(ends))
    near = lambda end, sign: F.abs(F.col(end) - (F.col("estimate") + sign * 1.96 * F.col("sd"))) < 0.4 * F.col("sd")
    return out.select(
        *by, F.round("estimate", 8).alias("estimate"), F.round("sd", 8).alias("sd"), ((F.col("_n") >= 0.9 * REPS) & (F.abs(F.col("_sd") / F.col("sd") - 1) < 0.15)).alias("spread_fits"),
        near("low", -1).alias("low_fits"), near("high", 1).alias("high_fits"), (F.col("_distinct") >= 0.5 * REPS).alias("resampled"),
    )


@query(f"""WITH {SC}, u AS (SELECT CAST(datediff('day', DATE '1990-01-01', issue) % {UNITS} AS INT) AS unit, method, {COUNTED} FROM sc GROUP BY ALL),
e AS (SELECT method, sum(H) / sum(H + M + F)::DOUBLE AS csi, sum(H + M + F)::DOUBLE AS t FROM u GROUP BY method),
inf AS (SELECT method, unit, (H - csi * (H + M + F)) / t AS v FROM u JOIN e USING (method)),
b AS (SELECT method, s, coalesce(sum(v), 0) AS v FROM (SELECT method, v, unnest([(unit + {UNITS} - k) % {UNITS} for k in range({BLOCK})]) AS s FROM inf) GROUP BY ALL),
theory AS (SELECT method, any_value(csi) AS csi, sqrt({UNITS // BLOCK} * sum(b.v * b.v) / {UNITS}) AS sd FROM b JOIN e USING (method) GROUP BY method),
draws AS (SELECT i // {UNITS // BLOCK} AS rep, CAST(hash(i, 'blocks') % {UNITS} AS INT) AS s FROM range({REPS * UNITS // BLOCK}) t(i)),
times AS (SELECT rep, (s + k) % {UNITS} AS unit, count(*) AS times FROM draws CROSS JOIN range({BLOCK}) b(k) GROUP BY ALL),
r AS (SELECT rep, method, sum(H * times) / sum((H + M + F) * times)::DOUBLE AS v FROM u JOIN times USING (unit) GROUP BY ALL)
SELECT method, round(any_value(csi), 8) AS estimate, round(any_value(sd), 8) AS sd, {LAW.format(v='v', e='csi', reps=REPS)} FROM r JOIN theory USING (method) GROUP BY method""")
def block_bootstrap_ci(spark, sf_dir):
    """CSI by method with circular blocks of issues: is the interval what the issues' spread gives."""
    s = scores(spark, sf_dir).withColumn("unit", F.datediff("issue", F.lit("1990-01-01").cast("date")) % UNITS)
    counts = V.contingency(s, ["unit", "method"], "fc", "obs").withColumn("T", F.col("H") + F.col("M") + F.col("F"))
    reps = B.bootstrap_sums(counts, "unit", ["method"], ["H", "T"], REPS, UNITS, BLOCK, 9).withColumn("csi", V.ratio(F.col("H"), F.col("T")))
    whole = counts.groupBy("method").agg(V.ratio(F.sum("H"), F.sum("T")).alias("estimate"), F.sum("T").alias("_t"))
    parts = counts.join(whole, "method").withColumn("_v", (F.col("H") - F.col("estimate") * F.col("T")) / F.col("_t"))
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda k: F.pmod(F.col("unit") - k, F.lit(UNITS))))
    blocks = parts.select("method", "estimate", "_v", starts.alias("_s")).groupBy("method", "estimate", "_s").agg(F.sum("_v").alias("_v"))
    theory = blocks.groupBy("method", "estimate").agg(F.sqrt(F.lit(UNITS // BLOCK) * F.sum(F.col("_v") * F.col("_v")) / UNITS).alias("sd"))
    return _law(reps, ["method"], "csi", theory)


@query(f"""WITH {SC}, u AS (SELECT CAST(datediff('day', DATE '1990-01-01', issue) % {UNITS} AS INT) AS unit, sum((p - o) * (p - o)) FILTER (WHERE method = 'A') AS a, count(*) FILTER (WHERE method = 'A') AS na,
  sum((p - o) * (p - o)) FILTER (WHERE method = 'N') AS b, count(*) FILTER (WHERE method = 'N') AS nb FROM sc GROUP BY ALL),
e AS (SELECT sum(a) / sum(na) AS ea, sum(b) / sum(nb) AS eb, sum(na) AS ta, sum(nb) AS tb FROM u),
theory AS (SELECT any_value(ea - eb) AS d, sqrt(sum(((coalesce(a, 0) - ea * na) / ta - (coalesce(b, 0) - eb * nb) / tb) ** 2)) AS sd FROM u, e),
draws AS (SELECT i // {UNITS} AS rep, CAST(hash(i, 'events') % {UNITS} AS INT) AS unit FROM range({REPS * UNITS}) t(i)),
r AS (SELECT rep, sum(a) / sum(na) - sum(b) / sum(nb) AS v FROM draws JOIN u USING (unit) GROUP BY rep)
SELECT round(any_value(d), 8) AS estimate, round(any_value(sd), 8) AS sd, {LAW.format(v='v', e='d', reps=REPS)}, (avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) > 0.5) = (any_value(d) > 0) AS sign_fits FROM r, theory""")
def paired_event_bootstrap(spark, sf_dir):
    """Difference of two methods' Brier scores with the event days both have drawn together."""
    square = (F.col("p") - F.col("o")) * (F.col("p") - F.col("o"))
    s = scores(spark, sf_dir).withColumn("unit", F.datediff("issue", F.lit("1990-01-01").cast("date")) % UNITS)
    of = lambda m, value: F.coalesce(F.sum(F.when(F.col("method") == m, value)), F.lit(0))
    units = s.groupBy("unit").agg(of("A", square).alias("a"), of("A", F.lit(1)).alias("na"), of("N", square).alias("b"), of("N", F.lit(1)).alias("nb"))
    reps = B.bootstrap_sums(units, "unit", [], ["a", "na", "b", "nb"], REPS, UNITS, 1, 3).withColumn("d", F.col("a") / F.col("na") - F.col("b") / F.col("nb"))
    whole = units.agg(*[F.sum(c).alias(f"_{c}") for c in ("a", "na", "b", "nb")])
    share = lambda c, n: (F.col(c) - F.col(f"_{c}") / F.col(f"_{n}") * F.col(n)) / F.col(f"_{n}")
    influence = units.crossJoin(F.broadcast(whole)).withColumns({"_v": share("a", "na") - share("b", "nb"), "_d": F.col("_a") / F.col("_na") - F.col("_b") / F.col("_nb")})
    theory = influence.agg(F.max("_d").alias("estimate"), F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("sd"))
    signs = reps.agg((F.avg((F.col("d") > 0).cast("double")) > 0.5).alias("_more"))
    return _law(reps, [], "d", theory).crossJoin(F.broadcast(signs)).withColumn("sign_fits", F.col("_more") == (F.col("estimate") > 0)).drop("_more")


@query(f"""WITH {POS}, pr AS (SELECT cell, min_bt - 250 AS dev, lead(min_bt - 250) OVER (PARTITION BY cell ORDER BY frame) AS nxt FROM pos),
u AS (SELECT row_number() OVER (ORDER BY cell) - 1 AS unit, sum(dev * nxt) AS xy, sum(dev * dev) AS xx FROM pr WHERE nxt IS NOT NULL GROUP BY cell),
n AS (SELECT count(*) AS n FROM u),
draws AS (SELECT i // n AS rep, CAST('0x' || left(md5('4:' || i), 12) AS BIGINT) % n AS unit FROM n, range({REPS} * (SELECT count(*) FROM u)) t(i)),
r AS (SELECT rep, sum(xy) / sum(xx) AS phi FROM draws JOIN u USING (unit) GROUP BY rep)
SELECT round(quantile_cont(phi, 0.025), 8) AS low, round(quantile_cont(phi, 0.5), 8) AS mid, round(quantile_cont(phi, 0.975), 8) AS high FROM r""")
def cell_bootstrap_ar1(spark, sf_dir):
    """Interval of the first-order autocorrelation: in every replicate as many cells are drawn, with replacement, as there are."""
    from nimboscale.operators.tracks import by_cell
    from nimboscale.plans.standins import positions

    p = positions(spark, sf_dir).withColumn("dev", F.col("min_bt") - 250)
    pairs = p.withColumn("nxt", F.lead("dev").over(by_cell())).where("nxt IS NOT NULL")
    cells = stored(pairs.groupBy("cell").agg(F.sum(F.col("dev") * F.col("nxt")).alias("xy"), F.sum(F.col("dev") * F.col("dev")).alias("xx")), "cell-sums")
    units = stored(B.numbered(cells, "cell", "unit").select("unit", "xy", "xx"), "cell-units")
    reps = B.drawn_sums(units, ["xy", "xx"], REPS, 4).withColumn("phi", F.try_divide("xy", "xx"))
    return B.interval(reps, [], "phi").select(*[F.round(c, 8).alias(c) for c in ("low", "mid", "high")])


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), e AS (SELECT day FROM d WHERE extract('day' FROM day) = 15 AND extract('month' FROM day) = 6),
t AS (SELECT day FROM d WHERE extract('year' FROM day) <= 1995), v AS (SELECT day FROM d WHERE extract('year' FROM day) >= 1995),
near AS (SELECT DISTINCT a.day FROM (SELECT * FROM t UNION SELECT * FROM v) a JOIN e ON abs(datediff('day', e.day, a.day)) <= 1)
SELECT day, 'both splits' AS reason FROM (SELECT * FROM t INTERSECT SELECT * FROM v) UNION ALL SELECT day, 'near an event' FROM near""")
def split_leak_check(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    e = d.where((F.dayofmonth("day") == 15) & (F.month("day") == 6))
    return ml.leaks(d.where(F.year("day") <= 1995), d.where(F.year("day") >= 1995), e, "day", 1)


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, avg(CASE WHEN o_totalprice > 250000 THEN 1.0::DOUBLE ELSE 0.0 END) AS deep FROM orders GROUP BY 1)
SELECT extract('year' FROM day)::INT AS year, count(*) AS days, count(*) FILTER (WHERE n >= 4 AND deep >= 0.25) AS usable,
  CASE WHEN count(*) FILTER (WHERE n >= 4 AND deep >= 0.25) >= 100 THEN 'PROCEED' ELSE 'STOP' END AS gate FROM d GROUP BY 1""")
def sufficiency_gate(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("o_totalprice") > 250000).cast("double")).alias("deep"))
    fit = F.count_if((F.col("n") >= 4) & (F.col("deep") >= 0.25))
    return d.groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("days"), fit.alias("usable"), F.when(fit >= 100, "PROCEED").otherwise("STOP").alias("gate"))


FEATURES = ["n_chars", "lines", "commas"]


def _learn(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    x = docs.select("doc_id", F.when(F.col("doc_id") % 13 != 0, F.log1p(F.col("n_chars").cast("double"))).alias("n_chars"), F.size(F.split("text", "\n")).cast("double").alias("lines"),
                    (F.regexp_count("text", F.lit(",")) / F.col("n_chars")).cast("double").alias("commas"))
    rows = x.join(labels, "doc_id").withColumns({"y": F.col("quality").cast("double"), "weight": 1.0 + (F.col("doc_id") % 3), "lead_bin": (F.col("doc_id") % 4).cast("int")})
    fifth = F.pmod("doc_id", F.lit(5))
    train, valid, test = rows.where(fifth > 1), rows.where(fifth == 1), rows.where(fifth == 0)
    stage, model, _ = ml.fit_boosted(train, valid, FEATURES, "y", "weight", rounds=8)
    return valid, test, stage, model


@query()
def gbt_isotonic_eval(spark, sf_dir):
    """Weighted log-loss by lead bin before and after calibration, on rows that chose neither trees, rounds nor calibration."""
    valid, test, stage, model = _learn(spark, sf_dir)
    known, fresh = (ml.scored(rows, stage, model, FEATURES) for rows in (valid, test))
    c = ml.calibrated(known, fresh, "p", "y", "weight", "lead_bin", [0, 1, 2, 3])
    return c.groupBy("lead_bin").agg(F.count(F.lit(1)).alias("n"), ml.log_loss(F.col("p"), F.col("y"), F.col("weight")).alias("raw"), ml.log_loss(F.col("calibrated"), F.col("y"), F.col("weight"), 1e-6).alias("calibrated"))


@query()
def permutation_importance(spark, sf_dir):
    valid, _, stage, model = _learn(spark, sf_dir)
    return ml.permutation_importance(valid, stage, model, FEATURES, "y", "weight", "doc_id").orderBy(F.col("increase").desc())


# ---- products -------------------------------------------------------------------


@query(f"""WITH {PLACES}, a AS (SELECT *, (place_id % 90 + 10) / 100.0::DOUBLE AS p, place_id % 2 * 30 + 30 AS lead FROM places)
SELECT place_id, '<?xml version="1.0" encoding="UTF-8"?><alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>demo-E&amp;1-x-' || place_id || '-' || lead || '</identifier><sender>demo@example.invalid</sender><sent>2026-05-01T09:30:00+00:00</sent><status>Exercise</status><msgType>Alert</msgType><scope>Private</scope>'
|| '<note>{products.NOTICE} Prediction m&lt;1&gt;/' || place_id || ', model v0.</note><info><category>Met</category><event>Deep convection</event><urgency>Expected</urgency><severity>Moderate</severity><certainty>Possible</certainty>'
|| '<expires>' || strftime(TIMESTAMP '2026-05-01 09:30:00' + to_minutes(CAST(lead + 60 AS INT)), '%Y-%m-%dT%H:%M:%S') || '+00:00</expires><headline>EXERCISE: probability ' || printf('%.2f', p) || ' of cold cloud near ' || place || ' within ' || lead || ' min</headline>'
|| '<description>Probability ' || printf('%.2f', p) || ' that the cloud top is colder than 235 K within 10 km of ' || place || ' at +' || lead || ' min.</description><parameter><valueName>prediction_id</valueName><value>m&lt;1&gt;/' || place_id || '</value></parameter>'
|| '<area><areaDesc>' || place || ' (10 km)</areaDesc><circle>' || printf('%.4f', lat) || ',' || printf('%.4f', lon) || ' 10</circle></area></info></alert>' AS cap FROM a""")
def cap_xml(spark, sf_dir):
    p = places(spark, sf_dir).withColumns({"p_max": (F.col("place_id") % 90 + 10) / 100.0, "lead_min": F.col("place_id") % 2 * 30 + 30})
    alert = {c: F.col(c) for c in ("place", "lat", "lon", "p_max", "lead_min")}
    alert |= {"alert_id": F.concat(F.lit("x#"), "place_id", F.lit("/"), "lead_min"), "prediction_id": F.concat(F.lit("m<1>/"), "place_id")}
    cap = products.cap_alert(alert, F.lit("2026-05-01 09:30:00").cast("timestamp"), F.lit("E&1"), F.lit("v0"))
    return p.select("place_id", cap.alias("cap"))


@query(f"""WITH {PLACES}, f AS (SELECT place_id, place_id // 25 AS block, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || CAST(round(lon, 4) AS VARCHAR) || ',' || CAST(round(lat, 4) AS VARCHAR) || ']}},"properties":{{"place":"' || place || '"}}}}' AS t FROM places)
SELECT block, '{{"type":"FeatureCollection","features":[' || string_agg(t, ',' ORDER BY place_id) || ']}}' AS geojson FROM f GROUP BY block""")
def geojson_features(spark, sf_dir):
    rows = places(spark, sf_dir).withColumn("block", F.expr("place_id div 25")).withColumns({c: F.round(c, 4) for c in ("lat", "lon")})
    return products.geojson_points(rows, ["block"], "lon", "lat", ["place"], "place_id")


@query("""SELECT CAST(doc_id % 7 AS BIGINT) AS part, CASE WHEN doc_id % 11 = 0 THEN 'DIFFERS' WHEN doc_id % 13 = 0 THEN 'UNRECORDED' ELSE 'OK' END AS status, count(*) AS n, min(sha256(text)) AS first_digest FROM documents GROUP BY ALL""")
def manifest_sha_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    recorded = docs.where("doc_id % 13 <> 0 OR doc_id % 11 = 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.lit("0")).otherwise(F.sha2("content", 256)).alias("sha256"))
    return products.digest_check(docs, recorded, "doc_id", "content").groupBy((F.col("doc_id") % 7).alias("part"), "status").agg(F.count(F.lit(1)).alias("n"), F.min("sha256").alias("first_digest"))


@query(f"""WITH {PLACES}, o AS (SELECT *, radians(lat) AS la, radians(lon) AS lo FROM places), r AS (SELECT place, asin(sin(la) * cos(100 / 6371.0::DOUBLE) + cos(la) * sin(100 / 6371.0::DOUBLE) * cos(radians(90))) AS lb, la, lo FROM o)
SELECT place, round(degrees(lb), 8) AS to_lat, round(degrees(lo) + degrees(atan2(sin(radians(90)) * sin(100 / 6371.0::DOUBLE) * cos(la), cos(100 / 6371.0::DOUBLE) - sin(la) * sin(lb))), 8) AS to_lon,
round(ln(tan(pi() / 4 + la / 2)), 9) AS merc FROM r""")
def destination_points(spark, sf_dir):
    p = places(spark, sf_dir)
    lat, lon = S.destination(F.col("lat"), F.col("lon"), F.lit(90.0), F.lit(100.0))
    return p.select("place", F.round(lat, 8).alias("to_lat"), F.round(lon, 8).alias("to_lon"), F.round(S.mercator(F.col("lat")), 9).alias("merc"))


# Authalic latitude and its centre, with the ellipsoid's axis and squared eccentricity written out.
_QS = lambda s: f"((1 - e2) * ({s} / (1 - e2 * {s} * {s}) - ln((1 - sqrt(e2) * {s}) / (1 + sqrt(e2) * {s})) / (2 * sqrt(e2))))"


@query(f"""WITH {PLACES}, c AS (SELECT *, 6378137.0::DOUBLE AS a, (2 - 1 / 298.257223563::DOUBLE) / 298.257223563::DOUBLE AS e2, radians(30.0) AS p0 FROM places),
q AS (SELECT *, {_QS('sin(radians(lat))')} AS q, {_QS('sin(p0)')} AS q0, {_QS('1.0::DOUBLE')} AS qp FROM c),
b AS (SELECT *, asin(q / qp) AS beta, asin(q0 / qp) AS b0, a * sqrt(qp / 2) AS rq, radians(lon - 78.0) AS dl FROM q),
d AS (SELECT *, a * cos(p0) / sqrt(1 - e2 * sin(p0) * sin(p0)) / (rq * cos(b0)) AS d, rq * sqrt(2 / (1 + sin(b0) * sin(beta) + cos(b0) * cos(beta) * cos(dl))) AS k FROM b)
SELECT place, round(k * d * cos(beta) * sin(dl), 4) + 0.0 AS x_m, round(k / d * (cos(b0) * sin(beta) - sin(b0) * cos(beta) * cos(dl)), 4) + 0.0 AS y_m, round(lat, 7) AS lat_back, round(lon, 7) AS lon_back FROM d""")
def projected_places(spark, sf_dir):
    """Equal-area coordinates and the way back, which must give the places' own."""
    p = places(spark, sf_dir)
    x, y = S.laea(F.col("lat"), F.col("lon"), 30.0, 78.0)
    q = p.withColumns({"x_m": x, "y_m": y})
    lat, lon = S.laea_inverse(F.col("x_m"), F.col("y_m"), 30.0, 78.0)
    return q.select("place", (F.round("x_m", 4) + 0.0).alias("x_m"), (F.round("y_m", 4) + 0.0).alias("y_m"), F.round(lat, 7).alias("lat_back"), F.round(lon, 7).alias("lon_back"))


@query("""SELECT event_id, 'merg_' || strftime(ts, '%Y%m%d%H') || '_4km-pixel' AS name, strftime(ts, '%Y%m%dT%H%MZ') AS stamp, date_trunc('hour', ts) + INTERVAL 30 MINUTE AS second_field,
round(sin((extract('hour' FROM ts) + extract('minute' FROM ts) / 60.0::DOUBLE) * 2 * pi() / 24), 9) AS hour_sin, strftime(ts + INTERVAL 330 MINUTE, '%H:%M') AS local FROM events""")
def time_codecs(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    name = S.hourly_name(ts)
    return table(spark, sf_dir, "events").select(
        "event_id", name.alias("name"), S.stamp(ts).alias("stamp"), S.field_times(name)[1].cast("timestamp_ntz").alias("second_field"), F.round(S.hour_angle(ts)[0], 9).alias("hour_sin"), S.local_time(ts).alias("local")
    )


@query("""SELECT l_orderkey, l_linenumber, CAST(round_even((l_quantity - 25) / 0.01 * 0.37, 0) AS SMALLINT) AS stored, CASE WHEN l_discount >= 0.09 THEN 4 WHEN l_discount >= 0.07 THEN 3 WHEN l_discount >= 0.05 THEN 2 WHEN l_discount >= 0.03 THEN 1 WHEN l_discount >= 0.01 THEN 0 ELSE -1 END AS bin FROM lineitem""")
def quantised_values(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", F.rint((F.col("l_quantity") - 25) / 0.01 * 0.37).cast("smallint").alias("stored"), S.probability_bin(F.col("l_discount"), (0.01, 0.03, 0.05, 0.07, 0.09)).alias("bin"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) SELECT start, event_type, n, total FROM w""")
def frame_windows(spark, sf_dir):
    from nimboscale.streaming.frames import windowed

    return windowed(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""WITH {PX}, g AS (SELECT DISTINCT frame FROM px) SELECT count(*) AS frames, min(frame) AS first, max(frame) AS last FROM g""")
def event_index(spark, sf_dir):
    return pixels(spark, sf_dir).select("frame").distinct().agg(F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first"), F.max("frame").alias("last"))

