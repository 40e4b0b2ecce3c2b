"""Exact quantiles of large groups without a group's values in one buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from nimboscale.session import stored

#: Ranges of values for each factor of two.
FINE = 256


def exact_quantiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(by..., names...): for each name of ``wanted`` the quantile q, interpolated between neighbours, of its column, nulls left out.

    Values are counted by range with map-side combine; the counts tell which
    range holds a rank, and only the values of those ranges are counted one by
    one and ordered. A group without values of a column has null there; groups
    without any value are left out. Infinities are values like any other; NaN counts as
    larger than all of them. Between two neighbours of which one is infinite or NaN, the
    result is that one wherever the quantile is not exactly the other.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    listed = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    long = rows.select(F.struct(F.lit(0).alias("_"), *by).alias("_k"), F.explode(listed).alias("_x")).where("_x.v IS NOT NULL")
    v = F.col("_x.v")
    # Grows with the value: ranges of equal width in its logarithm, on either side of zero.
    endless = F.abs(v) == F.lit(float("inf"))
    size = F.when(F.isnan(v), 1 << 30).when(endless, 1 << 29).otherwise(F.floor((F.log2(F.when(~endless & ~F.isnan(v), F.abs(v))) + 1100) * FINE) + 1)
    long = stored(long.select("_k", F.col("_x.c").alias("_c"), v.alias("_v"), F.when(v > 0, size).when(v < 0, -size).otherwise(0).cast("int").alias("_b")), "values")
    counts = long.groupBy("_k", "_c", "_b").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_k", "_c")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"_before": before, "_all": F.sum("_n").over(group)})
    needs = []
    for name, (column, q) in wanted.items():
        at = F.lit(q) * (F.col("_all") - 1)
        for end, rank in enumerate((F.floor(at), F.ceil(at))):
            needs.append(F.struct(F.lit(name).alias("name"), F.lit(columns.index(column)).alias("c"), F.lit(end).alias("end"), rank.alias("rank"), (at - F.floor(at)).alias("part")))
    picks = counts.withColumn("_w", F.explode(F.array(*needs))).where("_w.c = _c AND _w.rank >= _before AND _w.rank < _before + _n")
    picks = stored(picks.select("_k", "_c", "_b", "_before", "_w.name", "_w.end", "_w.rank", "_w.part"), "ranks")
    near = long.join(picks.select("_k", "_c", "_b").distinct(), ["_k", "_c", "_b"], "left_semi").groupBy("_k", "_c", "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("_k", "_c", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_first", F.coalesce(F.sum("_n").over(along), F.lit(0)))
    hit = near.join(picks, ["_k", "_c", "_b"]).withColumn("_at", F.col("rank") - F.col("_before")).where("_at >= _first AND _at < _first + _n")
    end = lambda name, k: F.max(F.when((F.col("name") == name) & (F.col("end") == k), F.struct("_v", "part")))

    def between(name):
        low, high, part = end(name, 0)["_v"], end(name, 1)["_v"], end(name, 0)["part"]
        return F.when((part == 0) | (low == high), low).otherwise(low * (1 - part) + high * part).alias(name)

    found = [between(n) for n in wanted]
    return hit.groupBy("_k").agg(*found).select(*[F.col("_k")[c].alias(c) for c in by], *wanted)


def with_quantiles(summary: DataFrame, rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``summary``, a row a group, with the quantiles of ``rows``; without ``by`` both are one row."""
    found = exact_quantiles(rows, by, wanted)
    if not by:
        # One row, or none where nothing has a value.
        return summary.join(F.broadcast(found), F.lit(True), "left")
    keys = [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in by]
    return summary.join(found.withColumnsRenamed({c: f"_q_{c}" for c in by}), keys, "left").drop(*[f"_q_{c}" for c in by])
