"""Document fingerprints: bottom-k sketches of shingle hashes, built-in functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a
text's five-word shingles. Sketches of parts merge into the sketch of the whole
(the k smallest of their union), so they can be aggregated like sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from nimboscale.llm.text import bind, words, without
from nimboscale.session import gathered, stored

K = 128
WIDTH = 5
_SPAN = float(1 << 64)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The k smallest distinct shingle hashes, ascending. Words are lower-cased.

    Texts of fewer than ``width`` words have one shingle, the whole sequence;
    texts without words (null, empty, blank) have an empty sketch.
    """
    hashed = F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))
    return bind(hashed, lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(_lowest(_shingles(h, width), k)))


def _lowest(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def _shingles(hashed: Column, width: int) -> Column:
    # Past the end F.get is null, which the hash skips: a short text is one shingle.
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(hashed) - width, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(width)]),
    )


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1; two empty sketches are alike, one is not."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both.cast("double") / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    reach = (F.element_at(a, -1).cast("double") + _SPAN / 2) / _SPAN
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1.0) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too, 0 to 1; of nothing, all is contained."""
    j = resemblance(a, b, k)
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1.0 + j) * na)))


def merge_sketches(df: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """Aggregate sketches of parts by ``keys``.

    The hashes of a key are ranked after a map-side distinct, so a key with a
    third of all rows costs each task at most what it has read.
    """
    spread = df.select(*keys, F.explode(sketch_col).alias("_h")).distinct()
    rank = Window.partitionBy(*keys).orderBy("_h")
    low = spread.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= k)
    return low.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))


def as_text(a: Column) -> Column:
    """Sketch as a string, 16 lower-case hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def from_text(s: Column) -> Column:
    """The sketch that ``as_text`` wrote."""
    parts = F.filter(F.split(s, "(?<=\\G.{16})"), lambda x: x != "")
    return F.transform(parts, lambda x: F.conv(x, 16, -10).cast("bigint"))


#: Rows of a bucket of ids as aimed at, until there are MOST_BUCKETS; CROWDED times as many are cut further.
AIM_ROWS, MOST_BUCKETS, CROWDED = 500, 400_000, 4
#: Bits by which crowded intervals of ids are cut further.
FINER = 6


def _buckets(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_bucket``, which cuts the ids in their order, and (_bucket, _first) of each bucket.

    Intervals are 2**shift wide, as many as the rows ask for; crowded ones are
    cut into 2**FINER finer ones, and so on, down to single ids. A bucket is
    (level, number); null ids come first, on level -1. Only ids are read to find
    the crowded intervals, of which there are MOST_BUCKETS / CROWDED at most.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("_at"))
    low, high, n = ids.agg(F.min("_at"), F.max("_at"), F.count("_at")).first()
    aim = max(AIM_ROWS, n // MOST_BUCKETS)
    shift = 0 if low is None else max(0, ((high - low) * aim // n).bit_length())
    level, ident = 0, F.col(id_col).cast("long")
    bucket = lambda k, at: F.struct(F.lit(k).alias("level"), at.alias("number"))
    out = docs.withColumn("_bucket", F.when(ident.isNull(), bucket(-1, F.lit(0).cast("long"))).otherwise(bucket(0, F.shiftright(ident, shift))))
    left = ids.where("_at IS NOT NULL")
    while shift:
        crowded = left.groupBy(F.shiftright("_at", shift).alias("_crowd")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWDED * aim)
        crowded = gathered(stored(crowded.select("_crowd"), "crowded-ids"))
        if crowded.isEmpty():
            break
        left = left.join(crowded, F.shiftright("_at", shift) == F.col("_crowd"), "left_semi")
        crowd, shift = crowded.select(bucket(level, F.col("_crowd")).alias("_crowd")), max(0, shift - FINER)
        level += 1
        finer = F.when(F.col("_crowd").isNull(), F.col("_bucket")).otherwise(bucket(level, F.shiftright(ident, shift)))
        out = out.join(crowd, F.col("_bucket") == F.col("_crowd"), "left").withColumn("_bucket", finer).drop("_crowd")
    return out, out.groupBy("_bucket").agg(F.min(id_col).alias("_first"))


def with_next(docs: DataFrame, id_col: str, derive: dict[str, Column], cols: list[str]) -> DataFrame:
    """Add the columns ``derive``, and ``_next_<c>`` for each of ``cols``: its value in the row of the next larger id.

    Ids are whole numbers. The last row's next is the first. A window sorts each
    bucket of ids on its own; the first row of every bucket is also sent to the
    bucket before it, as a guest at its end, so that no row needs another
    bucket's task. The guests' table has a row a bucket; its size is checked
    before it is broadcast.
    """
    held, found = _buckets(docs, id_col)
    found = stored(found, "buckets")
    order = Window.orderBy(F.col("_first").asc_nulls_first())
    last = F.max(F.struct("_first", "_bucket")).over(Window.partitionBy())["_bucket"]
    guests = gathered(found.select(F.col("_first").alias("_guest_id"), F.coalesce(F.lag("_bucket").over(order), last).alias("_before")))
    place = F.array(
        F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("guest")), F.struct(F.col("_before").alias("bucket"), F.lit(1).alias("guest"))
    )
    dealt = (
        held.join(guests, F.col(id_col).eqNullSafe(F.col("_guest_id")), "left")
        .withColumn("_place", F.explode(F.filter(place, lambda p: p["bucket"].isNotNull())))
        .select(*docs.columns, F.col("_place.bucket").alias("_bucket"), F.col("_place.guest").alias("_guest"))
        .repartition("_bucket")
        .withColumns(derive)
    )
    along = Window.partitionBy("_bucket").orderBy("_guest", F.col(id_col).asc_nulls_first(), *[c for c in docs.columns if c != id_col])
    return dealt.withColumns({f"_next_{c}": F.lead(c).over(along) for c in cols}).where(F.col("_guest") == 0).drop("_bucket", "_guest")


def fingerprint_documents(docs: DataFrame, text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Add ``sketch`` and ``distinct_shingles`` (estimated); other columns pass through.

    Edge cases: null, empty and blank texts have an empty sketch and 0 shingles.
    An input column of either name is replaced.
    """
    out = without(docs, "sketch", "distinct_shingles").withColumn("sketch", sketch(F.col(text_col), k, width))
    return out.withColumn("distinct_shingles", distinct_shingles(F.col("sketch"), k))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprint every text and its edit, whose last quarter comes from the next document's start.

    Edge cases: null texts are empty. Null ids come before all others, repeated
    ids in the order of their texts. In a table of one row the next document is
    the row itself. An empty table gives an empty table.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    linked = with_next(narrow, "_id", {"_sketch": sketch(F.col("_text"), k, width)}, ["_text", "_sketch"])
    n = F.char_length("_text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("left(_text, char_length(_text) - cast(floor(char_length(_text) / 4) AS int))"), F.left(F.col("_next__text"), cut))
    out = linked.withColumn("_n", n.cast("long")).withColumn("_edited", edited).withColumn("_edit_sketch", sketch(F.col("_edited"), k, width))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_text(F.col("_sketch")).alias("fingerprint"),
        as_text(F.col("_edit_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_edit_sketch"), k).alias("near_edited"),
        resemblance(F.col("_sketch"), F.col("_next__sketch"), k).alias("near_next"),
        distinct_shingles(F.col("_sketch"), k).alias("distinct_shingles"),
    )


def op6_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    from nimboscale.session import table

    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
