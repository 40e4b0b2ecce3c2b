"""Sampling and resampling: stratified weights, circular block and group bootstraps.

Every draw is a hash of a counter (seed, replicate, draw), so it depends on no
partition or retry, and draws are independent of each other. Replicates are sums of
additive measures: rows are first added up by resampling unit. Few units meet a
table of draws; many units carry Poisson weights, made beside each unit and added up
before any exchange, so that no table has a row for every replicate and unit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from nimboscale.session import gathered


def scramble(key: Column, seed: int) -> Column:
    """Order key by a hash of the seed and ``key``; the same in any SQL engine. Equal keys need a further key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def counter_hash(seed: int, *counters: Column) -> Column:
    """A long from 0 on, all values alike, for each combination of counters."""
    return F.xxhash64(F.lit(seed), *counters).bitwiseAND(F.lit((1 << 63) - 1))


def poisson_one(seed: int, *counters: Column) -> Column:
    """Weights 0, 1, 2, ... with the Poisson law of mean 1, by inversion of a hashed uniform."""
    u = F.shiftright(counter_hash(seed, *counters), 10).cast("double") / F.lit(float(1 << 53))
    # Beyond 18 lies less than a 53-bit uniform can say.
    sums = [math.fsum(math.exp(-1) / math.factorial(i) for i in range(k)) for k in range(1, 19)]
    return sum(((u >= F.lit(t)).cast("int") for t in sums), F.lit(0))


def stratified_sample(df: DataFrame, strata: list[str], key: str, caps: dict[str, int], stratum: str, seed: int, ties: list[str] = ()) -> DataFrame:
    """At most ``caps[stratum]`` rows of each group of ``strata``, with the weight n / kept; weights of a group add up to its rows.

    Rows are drawn in the order of the scrambled ``key``, then the key, then
    ``ties``: name there what rows of one key may differ in, or which of them is
    drawn is left open. Every task keeps its lowest rows of a group only, so no
    stratum is sorted whole; groups are counted with map-side combine.
    """
    cap = F.lit(0)
    for name, most in caps.items():
        cap = F.when(F.col(stratum) == name, most).otherwise(cap)
    sizes = df.groupBy(*[F.col(c).alias(f"_{c}") for c in strata]).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(scramble(F.col(key), seed), key, *ties))
    # The constant bound lets every task cut its groups before the exchange.
    drawn = df.withColumn("_rank", rank).where(F.col("_rank") <= max(caps.values(), default=0)).withColumn("_cap", cap).where("_rank <= _cap")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in strata]
    out = drawn.join(sizes, on).withColumn("weight", F.col("_n") / F.least("_n", "_cap").cast("double"))
    return out.select(*df.columns, "weight")


def numbered(df: DataFrame, key: str, out: str, rows: int = 100_000) -> DataFrame:
    """``df`` with ``out``, the rank of the whole-number, unique ``key`` from 0.

    Counts of key ranges give each range its first number, so no task ranks all.
    Ranges are cut at approximate quantiles, one for each ``rows``.
    """
    n = df.count()
    parts = min(1000, -(-n // rows))
    cuts = sorted(set(df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100_000)).first()[0])) if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    dealt = df.withColumn("_part", part)
    first = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # A row a range.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return dealt.withColumn("_in", inside).join(first, "_part").select(*df.columns, (F.col("_first") + F.col("_in") - 1).cast("long").alias(out))


def replicate_units(spark, reps: int, units: int, block: int, seed: int) -> DataFrame:
    """(rep, unit): circular blocks of ``block`` consecutive units until ``units`` are drawn.

    reps x units rows: for units whose number an argument sets, as issues or event
    days; for units that grow with the data see ``poisson_sums``.
    """
    blocks = -(-units // block)
    draws = spark.range(reps * blocks).select(F.expr(f"cast(id div {blocks} AS int)").alias("rep"), (F.col("id") % blocks).cast("int").alias("b"))
    draws = draws.withColumn("start", F.pmod(counter_hash(seed, F.col("rep"), F.col("b")), F.lit(units)))
    placed = draws.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).where(F.col("b") * block + F.col("k") < units)
    return placed.select("rep", F.pmod(F.col("start") + F.col("k"), F.lit(units)).alias("unit"))


def bootstrap_sums(rows: DataFrame, unit: str, by: list[str], sums: list[str], reps: int, units: int, block: int, seed: int) -> DataFrame:
    """(rep, by..., sums...) of every replicate; ``unit`` is numbered 0 .. units - 1. Replicates share their draws across ``by``."""
    totals = rows.groupBy(F.col(unit).alias("unit"), *by).agg(*[F.sum(c).alias(c) for c in sums])
    times = replicate_units(rows.sparkSession, reps, units, block, seed).groupBy("rep", "unit").agg(F.count(F.lit(1)).alias("_times"))
    return totals.join(times, "unit").groupBy("rep", *by).agg(*[F.sum(F.col(c) * F.col("_times")).alias(c) for c in sums])


def poisson_sums(rows: DataFrame, unit: str, by: list[str], sums: list[str], reps: int, seed: int) -> DataFrame:
    """(rep, by..., sums...) of every replicate, each unit weighted by a Poisson draw of its own: for units without number.

    The draw is a hash of replicate and unit, so replicates share it across ``by``
    and nothing is numbered. Weights are spent where the unit's sums are: a task sends a
    row a replicate and group. Units may be of any type; a null unit is one unit.
    """
    totals = rows.groupBy(F.col(unit).alias("_unit"), *by).agg(*[F.sum(c).alias(c) for c in sums])
    drawn = totals.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_times", poisson_one(seed, F.col("rep"), F.col("_unit")))
    return drawn.where("_times > 0").groupBy("rep", *by).agg(*[F.sum(F.col(c) * F.col("_times")).alias(c) for c in sums])


def drawn_sums(units: DataFrame, sums: list[str], reps: int, seed: int) -> DataFrame:
    """(rep, sums...) of every replicate, as many of the ``units`` drawn with replacement as there are; ``unit`` numbers them from 0.

    A draw is the first 48 bits of an MD5 of its counter, the same in any SQL engine. Draws are made
    where they are added up: units of three columns meet them by broadcast up to five million.
    """
    n = units.count()
    hashed = F.conv(F.substring(scramble(F.col("id"), seed), 1, 12), 16, 10).cast("bigint")
    draws = units.sparkSession.range(reps * n).select(F.expr(f"id div {max(1, n)}").alias("rep"), F.pmod(hashed, F.lit(max(1, n))).alias("unit"))
    return draws.join(gathered(units, 5_000_000), "unit").groupBy("rep").agg(*[F.sum(c).alias(c) for c in sums])


def interval(reps: DataFrame, by: list[str], value: str, low: float = 0.025, high: float = 0.975, finite: float = 0.9) -> DataFrame:
    """Exact percentiles over replicates; null if fewer than ``finite`` of them have a value."""
    enough = F.count(value) >= finite * F.count(F.lit(1))
    return reps.groupBy(*by).agg(*[F.when(enough, F.percentile(value, q)).alias(n) for n, q in (("low", low), ("mid", 0.5), ("high", high))])


def permuted(df: DataFrame, column: str, key: str, seed: int, rows: int = 100_000) -> DataFrame:
    """``df`` with ``column`` shuffled over all rows.

    Rows are ranked twice, by their key and by a hash of it, and values move
    between equal ranks. Ranks come from bucket counts and ranks inside buckets of
    about ``rows`` rows, so no task sorts the table. Keys must be unique.
    """
    buckets = max(1, -(-df.count() // rows))

    def ranked(order: Column, keep: list[str], name: str) -> DataFrame:
        part = F.pmod(F.xxhash64(order), F.lit(buckets)).cast("int")
        dealt = df.select(*keep, part.alias("_part"), order.alias("_order"))
        first = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        # A row a bucket.
        first = first.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
        inside = F.row_number().over(Window.partitionBy("_part").orderBy("_order"))
        return dealt.withColumn("_in", inside).join(F.broadcast(first), "_part").select(*keep, (F.col("_first") + F.col("_in")).alias(name))

    own = ranked(F.col(key), [key], "_rank")
    other = ranked(F.struct(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)), [column], "_rank")
    return df.drop(column).join(own.join(other, "_rank").drop("_rank"), key)
