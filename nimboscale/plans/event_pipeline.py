"""One event from raw files to tracked cells, forecasts and scores, stage by stage as tables.

Each stage writes a table that the next one reads, so a stage can be rerun on
its own and a lost executor costs no more than its stage. Frames are the unit
of parallel work up to the segments; everything after is relational.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from nimboscale.functions.scalars import laea, laea_inverse
from nimboscale.operators import audit, kernels, preprocess, products, raster, tracks, verify
from nimboscale.session import stored
from nimboscale.sources import io


@dataclass(frozen=True)
class Source:
    """Regular source grid: file rows run north to south, decoded rows south to north."""

    rows: int
    cols: int
    lat0: float
    lon0: float
    step_lat: float
    step_lon: float


@dataclass(frozen=True)
class Event:
    name: str
    start: str
    box: tuple[float, float, float, float]  # south, north, west, east
    resolution_m: float = 2000.0
    centre: tuple[float, float] = (30.0, 78.0)
    event_k: float = 235.0
    segment_k: float = 245.0
    core_k: float = 221.0
    thresholds: list[float] = field(default_factory=lambda: [273.0, 253.0, 235.0, 221.0, 208.0])
    #: Of a feature, at each threshold.
    least_pixels: list[int] = field(default_factory=lambda: [25, 8, 4, 4, 4])
    least_overlap: float = 0.2
    least_frames: int = 2
    leads: list[int] = field(default_factory=lambda: [1, 2, 3, 4, 6, 8, 10, 12])
    scales: list[int] = field(default_factory=lambda: [10, 20])
    phase_rules: tuple[float, float, float, float, float] = (4.0, 221.0, 0.1, 273.0, -8.0)
    #: Lowest and highest value, largest missing and out-of-range shares of an accepted frame.
    quality: tuple[float, float, float, float] = (170.0, 330.0, 0.05, 0.0)
    minutes: int = 30

    @classmethod
    def read(cls, path: str) -> Event:
        """From a YAML file whose keys are the fields."""
        return cls(**{k: tuple(v) if k in ("box", "centre", "phase_rules", "quality") else v for k, v in io.read_config(path).items()})


def target_grid(spark: SparkSession, event: Event) -> tuple[DataFrame, int, int]:
    """(y, x, x_m, y_m, lat, lon, in_domain) of the equal-area rectangle around the box, and its height and width.

    The box's edges are walked in small steps, since they are curves on the map.
    """
    south, north, west, east = event.box
    part = F.col("id") / 200.0
    lat = F.array(F.lit(south), F.lit(north), south + part * (north - south), south + part * (north - south))
    lon = F.array(west + part * (east - west), west + part * (east - west), F.lit(west), F.lit(east))
    edge = spark.range(201).select(F.explode(F.arrays_zip(lat.alias("a"), lon.alias("b"))).alias("p")).select(F.col("p.a").alias("lat"), F.col("p.b").alias("lon"))
    x, y = laea(F.col("lat"), F.col("lon"), *event.centre)
    r = event.resolution_m
    low_x, high_x, low_y, high_y = edge.select(x.alias("x"), y.alias("y")).agg(F.floor(F.min("x") / r), F.ceil(F.max("x") / r), F.floor(F.min("y") / r), F.ceil(F.max("y") / r)).first()
    height, width = high_y - low_y + 1, high_x - low_x + 1
    cells = spark.range(height * width).select(F.expr(f"cast(id div {width} AS int)").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    cells = cells.withColumns({"x_m": (F.col("x") + low_x) * r, "y_m": (F.col("y") + low_y) * r})
    la, lo = laea_inverse(F.col("x_m"), F.col("y_m"), *event.centre)
    located = cells.withColumns({"lat": la, "lon": lo})
    return located.withColumn("in_domain", preprocess.in_box(F.col("lat"), F.col("lon"), event.box)), height, width


def cube(spark: SparkSession, raw: str, source: Source, event: Event, grid: DataFrame, until: int) -> tuple[DataFrame, DataFrame]:
    """(pixels (frame, y, x, v, gapfilled, in_domain), frame quality) of frames 0 .. until - 1."""
    south, north, west, east = event.box
    margin = 4
    y0, y1 = (int((lat - source.lat0) / source.step_lat) + m for lat, m in ((south, -margin), (north, margin)))
    x0, x1 = (int((lon - source.lon0) / source.step_lon) + m for lon, m in ((west, -margin), (east, margin)))
    y0, x0, y1, x1 = max(0, y0), max(0, x0), min(source.rows, y1 + 1), min(source.cols, x1 + 1)
    px = io.read_hourly(spark, raw, source.rows, source.cols, (y0, y1), (x0, x1))
    begin = F.lit(event.start).cast("timestamp")
    frame = ((F.unix_micros("time") - F.unix_micros(begin)) / (event.minutes * 60_000_000)).cast("int")
    px = px.select(frame.alias("frame"), (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), F.col("v").cast("double").alias("v")).where(F.col("frame").between(0, until - 1))
    filled = preprocess.gap_fill(px, y1 - y0, x1 - x0)
    targets = grid.select(
        F.col("y").alias("ty"), F.col("x").alias("tx"), "in_domain",
        ((F.col("lat") - source.lat0) / source.step_lat - y0).alias("fy"), ((F.col("lon") - source.lon0) / source.step_lon - x0).alias("fx"),
    )
    made = raster.bilinear(filled.select("frame", "y", "x", "v"), targets)
    out = made.select("frame", F.col("ty").alias("y"), F.col("tx").alias("x"), "v", "in_domain")
    flagged = filled.groupBy("frame").agg(F.avg(F.col("gapfilled").cast("double")).alias("gapfilled_frac"))
    return out, preprocess.frame_quality(out.where("in_domain"), "v", *event.quality).join(flagged, "frame")


def track(px: DataFrame, grid: DataFrame, event: Event, height: int, width: int) -> dict[str, DataFrame]:
    """Features, segments, links, cells and lifecycles of a cube. Features warmer than the segments keep a row of no area in ``unsegmented``."""
    inside = px.withColumn("v", F.when(F.col("in_domain"), F.col("v"))).select("frame", "y", "x", "v")
    # Each of these is read many times.
    features = stored(kernels.detect(inside, height, width, event.thresholds, event.least_pixels), "features")
    segment = stored(kernels.watershed(inside, features, height, width, event.segment_k), "segments")
    edges = stored(tracks.link_events(tracks.overlaps(segment, least=event.least_overlap)), "links")
    named = stored(tracks.assign_tracks(segment, edges), "tracks")
    kept = audit.long_enough(named, event.least_frames)
    stats = tracks.segment_stats(segment, inside, core=event.core_k, pixel_area=(event.resolution_m / 1000) ** 2)
    centre = tracks.cold_centroid(segment, inside, event.segment_k)
    missing = raster.touches(segment, inside.where("v IS NULL"), ["frame", "feature"]).withColumnRenamed("touches", "touches_missing")
    rows = kept.join(stats.drop("cy", "cx"), ["frame", "feature"]).join(centre, ["frame", "feature"]).join(missing, ["frame", "feature"])
    corner = grid.where("y = 0 AND x = 0").select(F.col("x_m").alias("_x0"), F.col("y_m").alias("_y0"))  # one row
    rows = rows.crossJoin(F.broadcast(corner)).withColumns({"x": F.col("_x0") + F.col("cx") * event.resolution_m, "y": F.col("_y0") + F.col("cy") * event.resolution_m})
    la, lo = laea_inverse(F.col("x"), F.col("y"), *event.centre)
    rows = rows.withColumns({"lat": la, "lon": lo, "min_bt": F.col("coldest"), "core": F.col("core_area")}).drop("_x0", "_y0", "coldest", "core_area")
    moved = tracks.movement(rows, seconds=event.minutes * 60.0)
    phased = tracks.phases(tracks.rates(moved), *event.phase_rules)
    lifecycle = tracks.with_age(phased, event.minutes).join(tracks.families(named, edges), "cell")
    return {"features": features, "segments": segment, "lifecycle": lifecycle, "cells": tracks.cell_summary(lifecycle, event.minutes), "genealogy": tracks.genealogy(named, edges), "unsegmented": raster.unsegmented(features, segment, inside)}


def audited(px: DataFrame, made: dict[str, DataFrame], event: Event, height: int, width: int) -> dict[str, DataFrame]:
    """Audit of the tracks against the motion of the field: summary (one row), cells to look at, and object forecasts along the field."""
    motion = stored(kernels.motion_fields(px.select("frame", "y", "x", "v"), height, width, event.segment_k), "motion")
    metres = event.resolution_m
    life = made["lifecycle"].select("cell", "frame", "feature", "x", "y", "cx", "cy")
    before = life.select("cell", (F.col("frame") + 1).alias("_next"), "frame", "feature", F.col("cy").alias("y"), F.col("cx").alias("x"))
    flow = stored(tracks.parent_motion(before, made["segments"], motion, height, width), "flow")
    one = tracks.steps(life).where("dframe = 1")
    along = one.join(flow.select("cell", F.col("_next").alias("frame"), (F.col("u") * metres).alias("u"), (F.col("v") * metres).alias("v")), ["cell", "frame"]).where("u IS NOT NULL")
    shift = flow.select("frame", "feature", F.rint("v").cast("int").alias("dy"), F.rint("u").cast("int").alias("dx"))
    child = life.select("cell", (F.col("frame") - 1).alias("frame"), F.col("feature").alias("child"))
    links = life.select("cell", "frame", F.col("feature").alias("parent")).join(child, ["cell", "frame"])
    checked = stored(tracks.link_audit(made["segments"], links, shift).join(links, ["frame", "parent", "child"]), "audited")
    turn = tracks.turns(life, 2 * metres).agg(F.count(F.lit(1)).alias("turns"), F.avg((F.col("cos") < 0).cast("double")).alias("zigzag"))
    # One row each.
    summary = audit.audit_summary(tracks.steps(life), life).withColumnRenamed("median_step", "median_all_steps").crossJoin(F.broadcast(turn))
    summary = summary.crossJoin(F.broadcast(tracks.flow_consistency(along, "u", "v"))).crossJoin(F.broadcast(audit.link_summary(checked)))
    pos = life.select("cell", "frame", F.col("cy").alias("y"), F.col("cx").alias("x"))
    ahead = tracks.field_forecasts(pos, motion, event.leads, height, width).unionByName(tracks.object_forecasts(pos, event.leads))
    return {"motion": motion, "track_audit": summary, "suspicious": tracks.suspicious_links(one, checked, 2 * metres), "object_forecasts": ahead}


def forecast_scores(px: DataFrame, event: Event, height: int, width: int) -> dict[str, DataFrame]:
    """Contingency and fractions scores of persistence and extrapolation, by lead, on the same pixels."""
    inside = px.where("in_domain").select("frame", "y", "x", "v")
    moved = kernels.extrapolate(px.select("frame", "y", "x", "v"), height, width, event.leads, event.segment_k)
    still = raster.persistence(px.select("frame", "y", "x", "v"), event.leads)
    pair = moved.select("issue", "lead", "y", "x", F.col("forecast").alias("extrapolation")).join(still.withColumnRenamed("forecast", "persistence"), ["issue", "lead", "y", "x"])
    met = raster.against(pair, inside)
    valid = F.col("persistence").isNotNull() & F.col("extrapolation").isNotNull() & F.col("observed").isNotNull()
    long = met.withColumn("m", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("forecast")) for m in ("persistence", "extrapolation")])))
    rows = long.select("m.*", "issue", "lead", "y", "x", "observed", valid.alias("valid")).withColumns({"fc": F.col("forecast") < event.event_k, "obs": F.col("observed") < event.event_k})
    by_issue = verify.contingency(rows, ["method", "issue", "lead"], "fc", "obs", F.col("valid"))
    boxed = rows.withColumns({c: F.coalesce(F.col(c) & F.col("valid"), F.lit(False)) for c in ("fc", "obs")}).withColumn("frame", F.struct("method", "issue", "lead"))
    made = raster.box_fractions(boxed, {f"box_{c}{n}": (c, n) for n in event.scales for c in ("fc", "obs")})
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scale"), F.col(f"box_fc{n}").alias("pf"), F.col(f"box_obs{n}").alias("po")) for n in event.scales]))
    fss = verify.fss(made.where("valid").select("method", "lead", each.alias("s")).select("method", "lead", "s.*"), ["method", "lead", "scale"], "pf", "po")
    by_lead = verify.cat_scores(by_issue.groupBy("method", "lead").agg(*[F.sum(c).alias(c) for c in verify.COUNTS]))
    return {"scores_by_issue": by_issue, "scores": by_lead, "fss": fss}


def scores_with_fss(scores: DataFrame, fss: DataFrame, scales: list[int]) -> DataFrame:
    """A row a method and lead: ``scores`` with a column ``fss_<scale>`` for each scale, null where a scale was not scored."""
    wide = fss.groupBy("method", "lead").pivot("scale", scales).agg(F.first("fss"))
    return scores.join(wide.select("method", "lead", *[F.col(f"`{n}`").alias(f"fss_{n}") for n in scales]), ["method", "lead"], "left")


def run_event(spark: SparkSession, raw: str, out: str, source: Source, event: Event, until: int = 48) -> dict[str, DataFrame]:
    """Every stage, each written under ``out`` and read back; returns the tables by name."""

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{event.name}/{name}")
        return spark.read.parquet(f"{out}/{event.name}/{name}")

    grid, height, width = target_grid(spark, event)
    tables = {"grid": kept("grid", grid)}
    px, quality = cube(spark, raw, source, event, tables["grid"], until)
    tables |= {"pixels": kept("pixels", px), "frame_quality": kept("frame_quality", quality)}
    made = track(tables["pixels"], tables["grid"], event, height, width)
    for name in ("features", "segments"):
        tables[name] = kept(name, made[name])
    for name in ("lifecycle", "cells", "genealogy", "unsegmented"):
        tables[name] = kept(name, made[name])
    for name, df in audited(tables["pixels"], tables, event, height, width).items():
        tables[name] = kept(name, df)
    for name, df in forecast_scores(tables["pixels"], event, height, width).items():
        tables[name] = kept(name, df)
    tables["metrics"] = kept("metrics", scores_with_fss(tables["scores"], tables["fss"], event.scales))
    summary = products.run_summary(tables["pixels"], tables["frame_quality"], tables["features"], tables["lifecycle"], tables["cells"], event.name, event.minutes)
    tables["run_summary"] = kept("run_summary", summary)
    return tables
