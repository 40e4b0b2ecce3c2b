"""Verification: additive counts first, ratios last, so that any roll-up is a sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

COUNTS = ("H", "M", "F", "CN")


def contingency(df: DataFrame, by: list[str], fc: str, obs: str, valid: Column | None = None) -> DataFrame:
    """Hits, misses, false alarms and correct negatives by ``by``; a null flag counts as no."""
    f, o = F.coalesce(F.col(fc), F.lit(False)), F.coalesce(F.col(obs), F.lit(False))
    df = df if valid is None else df.where(valid)
    return df.groupBy(*by).agg(
        F.count_if(f & o).alias("H"), F.count_if(~f & o).alias("M"), F.count_if(f & ~o).alias("F"), F.count_if(~f & ~o).alias("CN")
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; undefined is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def cat_scores(df: DataFrame, digits: int = 9) -> DataFrame:
    """Add POD, FAR, CSI, bias and base rate to counts."""
    h, m, f, cn = (F.col(c) for c in COUNTS)
    made = {"pod": ratio(h, h + m), "far": ratio(f, h + f), "csi": ratio(h, h + m + f), "bias": ratio(h + f, h + m), "base_rate": ratio(h + m, h + m + f + cn)}
    return df.withColumns({k: F.round(v, digits) for k, v in made.items()})


def roll_up(df: DataFrame, sets: list[list[str]], sums: list[str]) -> DataFrame:
    """Sums over several groupings in one pass; ``level`` numbers the grouping, columns outside it are null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in sums])
    return out


def fss(df: DataFrame, by: list[str], pf: str, po: str) -> DataFrame:
    """Fractions skill score pooled over pixels and pairs: 1 - sum (pf-po)^2 / (sum pf^2 + sum po^2)."""
    d = F.col(pf) - F.col(po)
    return df.groupBy(*by).agg((F.lit(1.0) - F.try_divide(F.sum(d * d), F.sum(F.col(pf) * F.col(pf)) + F.sum(F.col(po) * F.col(po)))).alias("fss"))


def useful(obs_events: Column, n: Column) -> Column:
    """FSS from which a forecast is useful: halfway between random skill and perfect."""
    return F.lit(0.5) + ratio(obs_events, n) / 2


def brier(df: DataFrame, by: list[str], p: str, o: str, climatology: str) -> DataFrame:
    """Brier sums of forecast and climatology, the score, and the skill score against climatology."""
    e, c = F.col(p) - F.col(o), F.col(climatology) - F.col(o)
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("brier_sum"), F.sum(c * c).alias("brier_clim_sum"))
    return sums.withColumns({"bs": ratio(F.col("brier_sum"), F.col("n")), "bss": F.lit(1.0) - ratio(F.col("brier_sum"), F.col("brier_clim_sum"))})


def reliability_bin(p: Column, bins: int = 10) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def reliability(df: DataFrame, by: list[str], p: str, o: str, bins: int = 10) -> DataFrame:
    """n, sum of p and of o by bin; empty bins are kept with zeros."""
    filled = df.groupBy(*by, reliability_bin(F.col(p), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("sum_p"), F.sum(o).alias("sum_o"))
    frame = filled.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(filled, [*by, "bin"], "left").fillna({"n": 0, "sum_p": 0.0, "sum_o": 0.0})


def expected_calibration_error(bins: DataFrame, by: list[str]) -> DataFrame:
    """Sum over bins of abs(sum p - sum o), over n; ``bins`` may hold finer keys than ``by``."""
    merged = bins.groupBy(*by, "bin").agg(*[F.sum(c).alias(c) for c in ("n", "sum_p", "sum_o")])
    return merged.groupBy(*by).agg(ratio(F.sum(F.abs(F.col("sum_p") - F.col("sum_o"))), F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def lead_bin(lead: Column, bins: list[tuple[int, int]]) -> Column:
    """Index of the (low, high) bin that holds the lead; null outside all."""
    out = F.lit(None).cast("int")
    for i, (low, high) in reversed(list(enumerate(bins))):
        out = F.when(lead.between(low, high), i).otherwise(out)
    return out


def edge_only(df: DataFrame, by: list[str], mask: str, sums: list[str], wide: str = "D", narrow: str = "V") -> DataFrame:
    """Sums of the wide mask less those of the narrow one."""
    part = lambda m, c: F.sum(F.when(F.col(mask) == m, F.col(c)).otherwise(0))
    return df.groupBy(*by).agg(*[(part(wide, c) - part(narrow, c)).alias(c) for c in sums])


def area_matched(df: DataFrame, by: list[str], value: str, observed: str, order: list[str]) -> DataFrame:
    """Flag the n lowest values of a group, n its observed events; ties by ``order``. Adds ``oracle``."""
    n = F.count_if(F.col(observed)).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last(), *order))
    return df.withColumn("oracle", rank <= n)


def bias_factors(df: DataFrame, by: list[str]) -> DataFrame:
    """Edge x area x intensity from summed areas a0 (issue), af (forecast on D), afv (on V), aod, aov (observed).

    Their product is the bias on V: edge = (afv / af) / (aov / aod), area = af / a0 (what moving changes), intensity = a0 / aod (what staying unchanged misses).
    """
    s = df.groupBy(*by).agg(*[F.sum(c).cast("double").alias(c) for c in ("a0", "af", "afv", "aod", "aov")])
    edge = ratio(ratio(F.col("afv"), F.col("aov")), ratio(F.col("af"), F.col("aod")))
    made = s.withColumns({"edge": edge, "area": ratio(F.col("af"), F.col("a0")), "intensity": ratio(F.col("a0"), F.col("aod")), "bias_v": ratio(F.col("afv"), F.col("aov"))})
    logs = {f"log_{c}": F.when(F.col(c) > 0, F.ln(c)) for c in ("edge", "area", "intensity", "bias_v")}
    return made.withColumns(logs | {"obs_in_edge": 1 - ratio(F.col("aov"), F.col("aod")), "fc_outside": 1 - ratio(F.col("afv"), F.col("af"))})


def skill_decay(df: DataFrame, by: list[str], lead: str, csi: str, ok: str, fit_to: int = 180) -> DataFrame:
    """Last uninterrupted useful lead (0 if none), first lead at half the first score, and the e-folding time.

    The time is from a log fit over leads up to ``fit_to``; null unless the score falls.
    """
    running = Window.partitionBy(*by).orderBy(lead).rowsBetween(Window.unboundedPreceding, 0)
    first = F.first_value(csi).over(Window.partitionBy(*by).orderBy(lead))
    held = F.min(F.col(ok).cast("int")).over(running)
    rows = df.withColumns({"_held": held, "_first": first})
    slope = F.regr_slope(F.when((F.col(csi) > 0) & (F.col(lead) <= fit_to), F.ln(F.col(csi))), F.col(lead).cast("double"))
    return rows.groupBy(*by).agg(
        F.coalesce(F.max(F.when(F.col("_held") == 1, F.col(lead))), F.lit(0)).alias("useful_to"),
        F.sum("_held").alias("useful_leads"),
        F.min(F.when(F.col(csi) <= 0.5 * F.col("_first"), F.col(lead))).alias("half_lead"),
        F.when(slope < 0, -1.0 / slope).alias("e_folding"),
    )


def across_events(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Pooled view of per-event values: events, mean, least, largest, and how many are above zero."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("events"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("largest"), F.count_if(v > 0).alias("positive"))


def largest_issue(areas: DataFrame, ahead: int) -> DataFrame:
    """(issue, area): of (frame, area) the largest frame that the last one follows by ``ahead`` frames or more, the earliest of equals; null if none does."""
    last = areas.agg(F.max("frame").alias("_last"))  # one row
    fit = areas.crossJoin(F.broadcast(last)).where(F.col("frame") + ahead <= F.col("_last"))
    return fit.agg(F.max_by("frame", F.struct("area", -F.col("frame"))).alias("issue"), F.max("area").alias("area"))
