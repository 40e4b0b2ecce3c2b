"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key ``-ln(u) / w`` with ``u`` a hash of (seed, id) in
(0, 1] and ``w`` its quality weight; the smallest keys come first. A source's
target is met by complete epochs, then by the documents of smallest key until
their sizes, summed along the key, reach what is left of the target.

No source is sorted in one task: keys fall into slices of equal width in the
logarithm of the key, sizes are summed by (source, slice) with map-side combine,
and the prefix sum over slices gives what lies before each. Only rows of one
slice are then sorted together. The logarithm of an exponential key has a
density of at most 1/e, and a weight only shifts it: whatever the weights are, a
slice of width 1/r holds about 1/(e r) of its source at most. r grows with the
table, so that this is SLICE_ROWS. The text is read once, for its size; the rows
that move are (id, source, size, key).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from nimboscale.llm.text import SPACE_CLASS, trim_space, without
from nimboscale.session import stored

#: Rows of one source that are sorted together, about, and the fewest slices for each factor e of the key.
SLICE_ROWS, LEAST_SLICES = 50_000, 100
WEIGHTS = (3, 1, 2)


def text_size(text: Column) -> Column:
    """Number of words; null and blank texts have none."""
    clean = trim_space(F.coalesce(text, F.lit("")))
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, SPACE_CLASS))).cast("long")


def text_weight(text: Column, size: Column) -> Column:
    """Quality weight in (0, 1]: highest where words are about as long as in prose."""
    mean = F.char_length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1)).cast("double")
    return F.lit(1.0) / (1.0 + F.abs(F.ln(F.greatest(mean, F.lit(0.1)) / 6.0)))


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets for a table (source, source_size), one row a source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes. A target stops at ``most`` times its source's size;
    the excess goes to the others by weight until none is above. That fixed
    point is target = min(cap, level * weight): with sources in the order of
    cap / weight, the level is what the capped ones leave, over the weight of
    the rest, at the first source where it does not exceed the next ratio.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy()
    ranked = (
        sources.withColumn("_n", F.row_number().over(order))
        .withColumn("_w", F.get(turn, F.pmod(F.col("_n") - 1, F.lit(len(weights)))))
        .withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("_total", F.lit(float(share)) * F.sum("source_size").over(everything))
    )
    by_ratio = Window.orderBy("_ratio", "_n").rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.orderBy("_ratio", "_n").rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0.0))) / F.sum("_w").over(from_here)
    leveled = ranked.withColumn("_ratio", F.col("_cap") / F.col("_w")).withColumn("_level", level)
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_n", "_level"))).over(everything)
    return leveled.withColumn("_fit", first["_level"]).select(
        "source",
        "source_size",
        F.when(F.col("_fit").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_fit") * F.col("_w"))).alias("target"),
    )


def slices_for(rows: int) -> int:
    """Slices for each factor e of the key."""
    return max(LEAST_SLICES, math.ceil(rows / math.e / SLICE_ROWS))


def take_by_key(rows: DataFrame, targets: DataFrame, slices: int = LEAST_SLICES, split_last: bool = True) -> DataFrame:
    """Words each row gives to the mix; ``rows`` has _id, source, size, _key.

    ``split_last``: the document on the budget's edge gives only the words up to
    it, so that a source meets its target to the word; else it is taken whole
    where that brings the source nearer to its target.
    """
    rows = rows.withColumn("_slice", F.floor(F.ln(F.greatest("_key", F.lit(1e-300))) * slices))
    sums = rows.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    budgets = targets.select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("_epochs"),
    ).withColumn("_left", F.floor(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long"))
    plan = sums.join(budgets, F.col("source").eqNullSafe(F.col("_source"))).select(
        "_source", F.col("_slice").alias("_in"), "source_size", "target", "_epochs", "_left", "_start", "_sum"
    )
    met = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_in")))
    here = Window.partitionBy("_source", "_in").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("_start") + F.coalesce(F.sum("size").over(here), F.lit(0))
    room = F.greatest(F.col("_left") - F.col("_done"), F.lit(0))
    if split_last:
        extra = F.least(F.col("size"), room)
    else:
        extra = F.when(room * 2 >= F.col("size"), F.when(room > 0, F.col("size")).otherwise(0)).otherwise(0)
    return met.withColumn("_done", done).withColumn("taken", F.col("_epochs") * F.col("size") + extra).drop(
        "_source", "_in", "_slice", "_epochs", "_left", "_start", "_sum", "_done"
    )


def keyed(rows: DataFrame, id_col: str, weight: Column, seed: int) -> DataFrame:
    """Add _id and the sampling key _key."""
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11)
    uniform = (hashed.cast("double") + 1.0) / F.lit(float(1 << 53))
    w = F.when(weight > 0, weight).otherwise(F.lit(1e-6))
    return rows.withColumn("_id", F.col(id_col)).withColumn("_key", -F.ln(uniform) / F.coalesce(w, F.lit(1e-6)))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    weights=WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    slices: int | None = None,
    split_last: bool = True,
) -> DataFrame:
    """One row a document: its id, source, size, source_size, target and taken.

    Edge cases: null and blank texts have size 0 and give nothing. A null
    source is a source of its own, last in order. Null, zero or negative quality
    weights count as 1e-6. A null id hashes like any value; rows that repeat an
    id share its key and are told apart by size. A source of size 0 has target
    0. An empty table gives an empty table. Only the named columns are read.
    """
    quality = F.col(weight_col).cast("double") if weight_col else F.lit(None).cast("double")
    rows = docs.select(
        F.col(id_col).alias("_doc"),
        F.col(source_col).alias("source"),
        text_size(F.col(text_col)).alias("size"),
        quality.alias("_q"),
        F.col(text_col).alias("_t"),
    )
    weight = F.col("_q") if weight_col else text_weight(F.col("_t"), F.col("size"))
    rows = stored(keyed(rows, "_doc", weight, seed).select("_doc", "_id", "source", "size", "_key"), "mix")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    out = take_by_key(rows, source_targets(sources, weights, share, most), slices or slices_for(rows.count()), split_last)
    return out.select(F.col("_doc").alias(id_col), "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every document as often as the mix takes it, whole.

    A document whose id the table repeats is taken as often as its id is; all
    without an id count as one id. Texts without words are taken once. The
    columns are those of ``docs``.
    """
    plan = mix_sources(docs, id_col=id_col, split_last=False, **options)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    plan = plan.groupBy(id_col).agg(F.max(times).alias("_nb_times")).withColumnRenamed(id_col, "_nb_planned").where(F.col("_nb_times") > 0)
    met = docs.join(plan, docs[id_col] == F.col("_nb_planned"))
    # Of rows without an id the plan has one row at most.
    met = met.unionByName(docs.where(docs[id_col].isNull()).crossJoin(F.broadcast(plan.where("_nb_planned IS NULL"))))
    return met.withColumn("_nb_copy", F.explode(F.sequence(F.lit(1), F.col("_nb_times")))).select(*docs.columns)


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    from nimboscale.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
