"""Stand-in relations on the test tables, in Spark and as SQL.

They give every operator deterministic rows to work on; nothing in them is an
observation, and no result is a statement about weather.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nimboscale.session import table

EVENT = -0.15
HEIGHT, WIDTH = 50, 64


def pixels(spark: SparkSession, sf_dir: str, masked: bool = False) -> DataFrame:
    """(frame, y, x, v): ``embeddings`` as a raster series, 50 vectors a frame; ``masked`` blanks a seventeenth."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    v = F.col("v").cast("double")
    if masked:
        v = F.when((F.col("vec_id") + F.col("x")) % 17 != 0, v)
    return rows.select(
        F.expr("cast(vec_id div 50 AS int)").alias("frame"), (F.col("vec_id") % 50).cast("int").alias("y"), F.col("x").cast("int").alias("x"), v.alias("v")
    )


PX = """px0 AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS x, unnest(embedding) AS v FROM embeddings
), px AS (
  SELECT CAST(vec_id // 50 AS INT) AS frame, CAST(vec_id % 50 AS INT) AS y, CAST(x AS INT) AS x, CAST(v AS DOUBLE) AS v FROM px0
), pm AS (
  SELECT CAST(vec_id // 50 AS INT) AS frame, CAST(vec_id % 50 AS INT) AS y, CAST(x AS INT) AS x,
         CASE WHEN (vec_id + x) % 17 <> 0 THEN CAST(v AS DOUBLE) END AS v FROM px0
)"""


def segments(px: DataFrame) -> DataFrame:
    """(frame, y, x, feature): event pixels, labelled by coarse tile; background is left out."""
    tile = F.lit(1) + F.col("frame") * 100 + F.expr("y div 10") * 10 + F.expr("x div 8")
    return px.where(F.col("v") < EVENT).select("frame", "y", "x", tile.cast("int").alias("feature"))


SEG = f"""seg AS (
  SELECT frame, y, x, CAST(1 + frame * 100 + (y // 10) * 10 + (x // 8) AS INT) AS feature FROM px WHERE v < {EVENT}
)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, frame, x, y, min_bt, area, core): users of ``events`` as cells, half days as frames; metres and kelvin in name only."""
    hours = F.expr("unix_micros(cast(ts AS timestamp)) - unix_micros(timestamp'2024-01-01 00:00:00')")
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("cell"),
            F.floor(hours / F.lit(12 * 3600 * 1_000_000)).cast("int").alias("frame"),
            "value",
            F.get_json_object("props", "$.k").cast("double").alias("k"),
        )
        .groupBy("cell", "frame")
        .agg(
            F.round(1000 * F.avg("value"), 3).alias("x"),
            F.round(1000 * F.avg("k"), 3).alias("y"),
            F.round(F.lit(300.0) - F.max("value") / 5, 6).alias("min_bt"),
            F.count(F.lit(1)).alias("area"),
            F.count_if(F.col("value") > 60).alias("core"),
        )
    )


POS = """pos AS (
  SELECT user_id AS cell,
         CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / (12 * 3600 * 1000000.0)) AS INT) AS frame,
         round(1000 * avg(value), 3) AS x, round(1000 * avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 3) AS y,
         round(300.0 - max(value) / 5, 6) AS min_bt, count(*) AS area, count(*) FILTER (WHERE value > 60) AS core
  FROM events GROUP BY ALL
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification rows (method, event, lead, issue, fc, obs, p, o) from ``lineitem``."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("method"),
        F.col("l_linestatus").alias("event"),
        (F.col("l_linenumber") * 30).cast("int").alias("lead"),
        F.to_date("l_shipdate").alias("issue"),
        (F.col("l_quantity") > 25).alias("fc"),
        ((F.col("l_discount") > 0.045) | (F.col("l_tax") > 0.065)).alias("obs"),
        F.least(F.round(F.col("l_discount") * 10, 4), F.lit(1.0)).alias("p"),
        F.when(F.col("l_tax") > 0.045, 1.0).otherwise(0.0).alias("o"),
    )


SC = """sc AS (
  SELECT l_returnflag AS method, l_linestatus AS event, CAST(l_linenumber * 30 AS INT) AS lead, CAST(l_shipdate AS DATE) AS issue,
         l_quantity > 25 AS fc, (l_discount > 0.045 OR l_tax > 0.065) AS obs,
         least(round(l_discount * 10, 4), 1.0) AS p, CASE WHEN l_tax > 0.045 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o
  FROM lineitem
)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place, lat, lon): suppliers, with coordinates from their keys."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("place"),
        F.col("s_suppkey").alias("place_id"),
        (26 + (F.col("s_suppkey") * 37 % 800) / 100.0).alias("lat"),
        (74 + (F.col("s_suppkey") * 53 % 900) / 100.0).alias("lon"),
    )


PLACES = """places AS (
  SELECT s_name AS place, s_suppkey AS place_id, 26 + (s_suppkey * 37 % 800) / 100.0::DOUBLE AS lat,
         74 + (s_suppkey * 53 % 900) / 100.0::DOUBLE AS lon FROM supplier
)"""
