"""Probability of cold cloud by pixel and lead: weighted sample, boosted trees, calibration by lead bin, like-for-like scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nimboscale.operators import kernels, ml, resample, verify

#: Most rows of a stratum, and first and last lead of each bin in minutes.
CAPS = {"event": 150, "near": 150, "far": 60}
LEAD_BINS = [(30, 30), (60, 60), (90, 120), (150, 360)]
METHODS = ("persistence", "advection", "neighbourhood", "ml", "climatology")


def labelled_pixels(px: DataFrame, event: float, height: int, width: int, leads: list[int], reference: float) -> DataFrame:
    """Predictors of every (issue, lead, pixel) with a valid observation at issue + lead, and ``y``; px has frame, y, x, v."""
    moved = kernels.extrapolate(px, height, width, leads, reference)
    rows = kernels.issue_features(px, moved, event)
    seen = px.where("v IS NOT NULL").select((F.col("frame")).alias("_valid"), "y", "x", (F.col("v") < event).cast("int").alias("label"))
    met = rows.withColumn("_valid", F.col("issue") + F.col("lead")).join(seen, ["_valid", "y", "x"]).drop("_valid")
    near = (F.col("adv_frac31") > 0) | (F.col("pers_frac31") > 0)
    stratum = F.when(F.col("label") == 1, "event").when(near, "near").otherwise("far")
    binned = verify.lead_bin(F.col("lead_min"), LEAD_BINS)
    return met.withColumns({"pixel": F.col("y") * width + F.col("x"), "stratum": stratum, "lead_bin": binned})


def dataset(rows: DataFrame, caps: dict[str, int] | None = None, seed: int = 20) -> DataFrame:
    """The stratified sample with inverse-probability weights; weights of a stratum add up to its pixels."""
    return resample.stratified_sample(rows, ["issue", "lead", "stratum"], "pixel", caps or CAPS, "stratum", seed)


def climatology(sample: DataFrame) -> DataFrame:
    return sample.groupBy("lead").agg((F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).alias("climatology"))


def train(sample: DataFrame, validation: DataFrame, rounds: int = 20):
    """(feature model, trees, losses, calibrate): calibrate(rows) adds ``p`` and ``ml``, the calibrated chance."""
    stage, model, losses = ml.fit_boosted(sample, validation, kernels.FEATURES, "label", "weight", rounds=rounds)
    known = ml.scored(validation, stage, model, kernels.FEATURES)

    def calibrate(rows: DataFrame) -> DataFrame:
        return ml.calibrated(known, ml.scored(rows, stage, model, kernels.FEATURES), "p", "label", "weight", "lead_bin", list(range(len(LEAD_BINS))), "ml")

    return stage, model, losses, calibrate


def evaluate(rows: DataFrame, clim: DataFrame, event: float) -> dict[str, DataFrame]:
    """Scores of all METHODS on identical pixels; mask V needs persistence, advection and observation, mask D the observation only.

    On D a missing forecast counts as no event. ``rows`` come from ``calibrate``.
    """
    chance = lambda c: F.coalesce((F.col(c) < event).cast("double"), F.lit(0.0))
    made = rows.join(F.broadcast(clim), "lead").withColumns({  # a row a lead
        "persistence": chance("pers_bt"), "advection": chance("adv_bt"), "neighbourhood": F.coalesce("adv_frac11", F.lit(0.0)), "ml": F.coalesce("ml", F.lit(0.0)),
        "in_v": F.col("pers_bt").isNotNull() & F.col("adv_bt").isNotNull(), "o": F.col("label").cast("double"),
    })
    masks = F.explode(F.when(F.col("in_v"), F.array(F.lit("V"), F.lit("D"))).otherwise(F.array(F.lit("D"))))
    methods = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("p")) for m in METHODS]))
    long = made.withColumn("mask", masks).withColumn("c", F.col("climatology")).withColumn("m", methods)
    long = long.select("m.*", "mask", "issue", "lead", "lead_min", "lead_bin", "o", "c").withColumns({"fc": F.col("p") >= 0.5, "obs": F.col("o") == 1})
    by_issue = verify.contingency(long, ["method", "mask", "issue", "lead"], "fc", "obs")
    sums = verify.brier(long, ["method", "mask", "issue", "lead"], "p", "o", "c").drop("bs", "bss")
    table = by_issue.join(sums, ["method", "mask", "issue", "lead"], "left")
    pooled = table.groupBy("method", "mask", "lead").agg(*[F.sum(c).alias(c) for c in (*verify.COUNTS, "n", "brier_sum", "brier_clim_sum")])
    pooled = verify.cat_scores(pooled).withColumns({"bs": verify.ratio(F.col("brier_sum"), F.col("n")), "bss": 1 - verify.ratio(F.col("brier_sum"), F.col("brier_clim_sum"))})
    bins = verify.reliability(long.where("mask = 'V'"), ["method", "lead_bin"], "p", "o")
    return {"by_issue": table, "scores": pooled, "reliability": bins, "ece": verify.expected_calibration_error(bins, ["method", "lead_bin"])}
