"""Track audits and lifecycle reliability: flags, shares, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from nimboscale.operators.quantile import with_quantiles
from nimboscale.operators.resample import scramble
from nimboscale.operators.tracks import by_cell
from nimboscale.operators.verify import ratio


def long_enough(tracks: DataFrame, least: int) -> DataFrame:
    """Rows of cells with at least ``least`` rows."""
    return tracks.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("cell"))).where(F.col("_n") >= least).drop("_n")


def genealogy_flag(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Add ``gen``: the cell takes part in a merge or split at that frame."""
    flagged = events.select("frame", F.explode(F.array("from_cell", "into_cell")).alias("cell")).distinct().withColumn("_g", F.lit(True))
    return rows.join(flagged, ["cell", "frame"], "left").withColumn("gen", F.coalesce("_g", F.lit(False))).drop("_g")


def log_steps(rows: DataFrame, value: str, out: str, plus_one: bool = False) -> DataFrame:
    """Add the change of the log of ``value`` (or of one plus it) from the cell's previous row; null from or to zero."""
    log = F.log1p(F.col(value).cast("double")) if plus_one else F.when(F.col(value) > 0, F.ln(F.col(value).cast("double")))
    return rows.withColumn("_log", log).withColumn(out, F.col("_log") - F.lag("_log").over(by_cell())).drop("_log")


def clean_pairs(rows: DataFrame, value: str) -> DataFrame:
    """Rows with a change and a next change, neither at a merge or split: adds ``nxt``."""
    w = by_cell()
    out = rows.withColumns({"nxt": F.lead(value).over(w), "_next_gen": F.lead("gen").over(w)})
    return out.where(~F.col("gen") & (F.col("_next_gen") == F.lit(False))).dropna(subset=[value, "nxt"]).drop("_next_gen")


def decision(low: DataFrame, estimate: str, lower: str) -> DataFrame:
    """BUILD where the estimate and its lower bound are above zero, else STOP."""
    return low.withColumn("decision", F.when((F.col(estimate) > 0) & (F.col(lower) > 0), "BUILD").otherwise("STOP"))


def audit_summary(steps: DataFrame, tracks: DataFrame, least: int = 4) -> DataFrame:
    """One row: cells, rows, steps, median and 90th percentile step, share of one-frame gaps, and cells of ``least`` frames or more."""
    spans = tracks.groupBy("cell").agg((F.max("frame") - F.min("frame") + 1).alias("span"), F.count(F.lit(1)).alias("n"))
    a = spans.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows"), F.count_if(F.col("span") >= least).alias("long_cells"))
    b = steps.agg(F.count(F.lit(1)).alias("steps"), F.avg((F.col("dframe") == 1).cast("double")).alias("unbroken"))
    b = with_quantiles(b, steps, [], {"median_step": ("dist", 0.5), "p90_step": ("dist", 0.9)})
    return a.crossJoin(F.broadcast(b))  # one row each


def link_summary(links: DataFrame) -> DataFrame:
    """One row of ``tracks.link_audit`` rows: links, and shares without overlap (moved or not), with a better candidate, with a jump in area.

    An area jumps if it more than doubles or falls under a half. A link whose
    parent has no shift is not counted as one without overlap.
    """
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    apart = (F.col("linked_frac") == 0) & ((F.col("moved_frac") == 0) if "moved_frac" in links.columns else F.lit(True))
    return links.agg(
        F.count(F.lit(1)).alias("seg_links"), share(apart).alias("zero_overlap"), share(F.col("better_other")).alias("better_other"), share((F.col("area_ratio") > 2) | (F.col("area_ratio") < 0.5)).alias("area_jump")
    )


def change_share(rows: DataFrame, value: str, measure: str) -> DataFrame:
    """Share of rows whose ``value`` differs from the cell's previous one, and the median ``measure`` with and without a change."""
    changed = rows.withColumn("_c", F.abs(F.col(value) - F.lag(value).over(by_cell())) > 0).where("_c IS NOT NULL")
    changed = changed.withColumns({"_yes": F.when(F.col("_c"), F.col(measure)), "_no": F.when(~F.col("_c"), F.col(measure))})
    sums = changed.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_c").cast("double")).alias("changed"))
    return with_quantiles(sums, changed, [], {"median_changed": ("_yes", 0.5), "median_same": ("_no", 0.5)})


def coverage(px: DataFrame, segment: DataFrame, usable: DataFrame) -> DataFrame:
    """By frame: event pixels in any segment and in usable (frame, feature) segments, as shares of all event pixels."""
    met = px.join(segment, ["frame", "y", "x"], "left").join(usable.select("frame", "feature").distinct().withColumn("_u", F.lit(1)), ["frame", "feature"], "left")
    return met.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), ratio(F.count("feature"), F.count(F.lit(1))).alias("segmented"), ratio(F.count("_u"), F.count(F.lit(1))).alias("usable"))


def interval_class(df: DataFrame, low: str, high: str) -> DataFrame:
    return df.withColumn("class", F.when(F.col(low) > 0, "above").when(F.col(high) < 0, "below").otherwise("neither"))


def random_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a scrambled key: the sort keeps n rows a task."""
    return df.orderBy(scramble(F.col(key), seed), key).limit(n)
