"""Readers and writers: rasters, tables, nested products, provenance.

Everything goes through Spark's own sources, so any store that Spark reaches
will do; NaN becomes NULL on the way in.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType

from nimboscale.functions.scalars import field_times, from_code, quantised, to_code
from nimboscale.operators.preprocess import decode_frames

PIXEL = "event string, frame int, y int, x int, bt float, gapfilled boolean"
FEATURE = "frame int, feature int, hdim_1 double, hdim_2 double, threshold_value int, time timestamp_ntz, cell int"
SCORE = (
    "event string, method string, mask string, issue_time_utc timestamp_ntz, issue_hour_utc int, lead_min int, H bigint, M bigint, F bigint, CN bigint, n bigint, "
    "brier_sum double, brier_clim_sum double"
)
PLACE = "name string, printed_as string, state_hint string, query string, osm_display_name string, status string, lat double, lon double"


def null_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every float column."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in kinds.items() if isinstance(t, (FloatType, DoubleType))})


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return null_nan(reader.parquet(path))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return null_nan(spark.read.schema(schema).option("header", True).csv(path))


def read_json(spark: SparkSession, path: str, schema: str, whole: bool = True) -> DataFrame:
    """JSON documents (``whole``: one a file, else one a line)."""
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def read_config(path: str) -> dict:
    """A YAML file of settings, on the driver."""
    import yaml

    return yaml.safe_load(Path(path).read_text())


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def read_hourly(spark: SparkSession, path: str, rows: int, cols: int, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Pixels (time, y, x, v) of hourly binary files, two fields each, their times from the file name; cropped while decoding."""
    px = decode_frames(read_binary(spark, path), rows, cols, y, x)
    return px.select(F.get(field_times(F.col("path")), F.col("field")).alias("time"), "y", "x", "v")


def window_files(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(time, name) of the hourly files that cover [start, end]."""
    from nimboscale.functions.scalars import hourly_name

    hours = F.expr(f"explode(sequence(date_trunc('hour', timestamp'{start}'), timestamp'{end}', interval 1 hour))")
    return spark.range(1).select(hours.alias("time")).withColumn("name", hourly_name(F.col("time")))


def tiles(codes: DataFrame, scale: float, offset: float, code: str = "code") -> DataFrame:
    """Values of 8-bit tile codes; 255 is missing."""
    return codes.withColumn("value", from_code(F.col(code), scale, offset))


def geocoded(stations: DataFrame, found: DataFrame) -> DataFrame:
    """Stations with the coordinates of a lookup table by query text, and OK or NOT_FOUND."""
    met = stations.join(found.select("query", "lat", "lon", "osm_display_name").dropDuplicates(["query"]), "query", "left")
    return met.withColumn("status", F.when(F.col("lat").isNull(), "NOT_FOUND").otherwise("OK"))


def sample_raster(points: DataFrame, px: DataFrame, bounds: tuple[float, float, float, float], height: int, width: int, value: str = "v") -> DataFrame:
    """Value of every frame at (lat, lon) points on a Web-Mercator grid (south, north, west, east), row 0 in the north."""
    from nimboscale.functions.scalars import mercator

    south, north, west, east = (F.lit(float(b)) for b in bounds)
    row = F.floor((mercator(north) - mercator(F.col("lat"))) / (mercator(north) - mercator(south)) * height)
    col = F.floor((F.col("lon") - west) / (east - west) * width)
    at = points.withColumns({"y": row.cast("int"), "x": col.cast("int")})
    return at.join(px.select("frame", "y", "x", value), ["y", "x"]).drop("y", "x")


# ---- writers ------------------------------------------------------------------


def write_cube(px: DataFrame, path: str, by: list[str]) -> None:
    px.repartition(*by).sortWithinPartitions(*by).write.partitionBy(*by).option("compression", "zstd").mode("overwrite").parquet(path)


def pack_forecast(fc: DataFrame, value: str = "bt") -> DataFrame:
    """Hundredths of a kelvin around 250, half-even, in 16 bits."""
    return fc.withColumn(value, quantised(F.col(value), 0.01, 250.0))


def unpack_forecast(fc: DataFrame, value: str = "bt") -> DataFrame:
    return fc.withColumn(value, F.col(value) * 0.01 + 250.0)


def pack_probability(df: DataFrame, value: str = "p") -> DataFrame:
    return df.withColumn(value, quantised(F.col(value), 1e-4, 0.0, "int"))


def unpack_probability(df: DataFrame, value: str = "p") -> DataFrame:
    return df.withColumn(value, F.col(value) * 1e-4)


def tile_codes(px: DataFrame, scale: float, offset: float, value: str = "v") -> DataFrame:
    return px.withColumn("code", to_code(F.col(value), scale, offset))


def tile_rows(px: DataFrame, width: int) -> DataFrame:
    """(frame, y, codes): a binary column of one byte a pixel for each raster row; absent pixels are 255."""
    cells = F.map_from_entries(F.collect_list(F.struct("x", "code")))
    made = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(255)))
    return px.groupBy("frame", "y").agg(cells.alias("_m")).select("frame", "y", F.unhex(F.array_join(F.transform(made, lambda c: F.lpad(F.hex(c), 2, "0")), "")).alias("codes"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Compact JSON lines with nulls kept and NaN as null."""
    null_nan(df).write.option("ignoreNullFields", False).mode("overwrite").json(path)


def record_files(df: DataFrame, path: str) -> None:
    """Append (file, sha256, bytes, ...) rows to the manifest at ``path``, stamped with ``recorded_at``.

    One write is one commit: Spark publishes its files when the job ends, and
    rows are only ever added, so writers at the same time lose no entries.
    """
    df.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)


def recorded_files(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's latest row of each file; of rows with equal stamps, that with the greatest digest."""
    rows = spark.read.parquet(path)
    last = F.max_by(F.struct(*rows.columns), F.struct("recorded_at", "sha256"))
    return rows.groupBy("file").agg(last.alias("_r")).select("_r.*")


def unrecorded(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rows of ``files`` (file, sha256) that the manifest lacks or holds with another digest: those to fetch or check again."""
    return files.join(recorded.select("file", "sha256"), ["file", "sha256"], "left_anti")


def only_new(df: DataFrame, done: DataFrame, keys: list[str], config: Column) -> DataFrame:
    """Rows of partitions not yet built with this configuration: ``done`` holds keys and config_hash."""
    tagged = df.withColumn("config_hash", F.sha2(config.cast("string"), 256))
    return tagged.join(done.select(*keys, "config_hash").distinct(), [*keys, "config_hash"], "left_anti")


def provenance(outputs: DataFrame, settings: dict) -> DataFrame:
    """(path, bytes, sha256, settings) of output files, for a record beside them."""
    import json

    return outputs.select("path", "length", F.sha2("content", 256).alias("sha256")).withColumn("settings", F.lit(json.dumps(settings, sort_keys=True)))
