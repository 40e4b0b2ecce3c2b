"""Line dedup: drop lines whose key occurs in several documents.

Plan: explode lines to (document, position, 16-byte key hash), aggregate each
hash to its smallest and largest document (both combine map-side, so a line that
a third of all documents hold costs one row a task), join the repeated hashes
back, and gather the dropped positions by document. The text itself moves once,
in the final join by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nimboscale.llm.text import ascii_lower, bind, trim_space, without
from nimboscale.session import stored

OUT = ("n_lines", "n_dropped", "kept_text")


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """Add ``n_lines``, ``n_dropped`` and ``kept_text``; other columns pass through.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased. Keys of at least ``min_chars`` code points that at least
    ``min_docs`` documents hold lose all lines but those of the smallest id.

    Edge cases: a null or empty text is one empty line and stays. Rows with a
    null id keep all lines and count for no key. Rows that repeat an id are
    parts of one document: they lose nothing to each other. Input columns named
    like an output are replaced. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_nb_id"), F.xxhash64(text).alias("_nb_row"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
        .select("_nb_id", "_nb_row", "_pos", ascii_lower(trim_space(F.col("_line"))).alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_nb_id", "_nb_row", "_pos", F.unhex(F.md5("_key")).alias("_hash"))
    )
    # Both the counts and the join read the hashes: split and hash the texts once.
    lines = stored(lines, "lines")
    if min_docs <= 2:
        # Two documents hold a key exactly if its smallest and largest id differ.
        repeated = lines.groupBy("_hash").agg(F.min("_nb_id").alias("_keep"), F.max("_nb_id").alias("_last"))
        repeated = repeated.where(F.col("_keep") < F.col("_last")) if min_docs == 2 else repeated
    else:
        once = lines.groupBy("_hash", "_nb_id").agg(F.lit(1).alias("_one"))
        repeated = once.groupBy("_hash").agg(F.min("_nb_id").alias("_keep"), F.count("_one").alias("_docs"))
        repeated = repeated.where(F.col("_docs") >= min_docs)
    # As a table, so that the join below has plain shuffles on both sides, which adaptive execution splits where a line is very common.
    repeated = stored(repeated.select("_hash", "_keep"), "repeated-lines")
    dropped = (
        lines.join(repeated, "_hash")
        .where(F.col("_nb_id") > F.col("_keep"))
        .groupBy("_nb_id", "_nb_row")
        .agg(F.collect_set("_pos").alias("_nb_gone"))
    )
    kept = without(docs, *OUT).withColumn("_nb_row", F.xxhash64(text))
    kept = kept.join(dropped, (kept[id_col] == dropped["_nb_id"]) & (kept["_nb_row"] == dropped["_nb_row"]), "left").drop(dropped["_nb_row"])
    every = F.split(text, "\n", -1)

    def without_gone(lines):
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_nb_gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    gone = F.when(F.col("_nb_gone").isNull(), 0).otherwise(F.size("_nb_gone"))
    return (
        kept.withColumn("n_lines", F.size(every).cast("long"))
        .withColumn("n_dropped", gone.cast("long"))
        .withColumn(
            "kept_text",
            F.when(F.col("_nb_gone").isNull(), text).otherwise(bind(every, without_gone)),
        )
        .drop("_nb_id", "_nb_row", "_nb_gone")
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    from nimboscale.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
),
repeated AS (
  SELECT k, min(doc_id) AS keep FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
),
marked AS (
  SELECT a.doc_id, a.pos, a.line, (r.k IS NOT NULL AND a.doc_id <> r.keep) AS gone
  FROM keyed a LEFT JOIN repeated r ON a.k = r.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
