"""Products and integrity: alerts, nested documents, markup, digests, indexes."""

from __future__ import annotations

import math
import struct
import zlib

from pyspark.sql import Column, DataFrame, functions as F

from nimboscale.functions.scalars import geodesic, haversine_km, slug, xml_escape
from nimboscale.operators.raster import window_max
from nimboscale.session import gathered, stored


def nearest_place(points: DataFrame, places: DataFrame, by: list[str], km: float, sphere: bool = False) -> DataFrame:
    """The nearest of ``places`` (place, place_id, lat, lon) within ``km`` of each point (by..., lat, lon); ties to the smaller id.

    Distances are on the ellipsoid, or on the sphere that displays use.

    Of places at one spot only that of the smallest id can be nearest. Both sides are dealt to
    cells of latitude and longitude as wide as the radius, and points look into the cells around
    their own. Where places are dense this is done first within a part of ``km``, and only points that found none
    there look farther, so that pairs grow with the points. A row's columns
    share the whole circle evenly, so that the first and the last are neighbours;
    rows within a degree of a pole have one.
    """
    spots = places.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("lat", "lon").agg(F.min(F.struct("place_id", "place")).alias("_p"))
    spots = stored(spots.select("_p.place", "_p.place_id", "lat", "lon"), "spots")
    rest = stored(points, "points")
    dealt, _ = _cells(spots, km)
    most = dealt.groupBy("_row", "_col").count().agg(F.max("count")).first()[0] or 1
    # A quarter of the radius has about a sixteenth of the places.
    reaches = [km / 4**k for k in range(math.ceil(math.log(max(1, most / 4), 16)), 0, -1)] + [km]
    found = []
    for reach in reaches:
        found.append(_nearest_within(rest, spots, by, reach, sphere))
        if reach < km:
            found[-1] = stored(found[-1], "near-places")
            keys = [rest[c].eqNullSafe(found[-1][c]) for c in by]
            rest = stored(rest.join(found[-1], keys, "left_anti"), "points")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _cells(df: DataFrame, km: float):
    """``df`` (lat, lon) with ``_row``, ``_of`` and ``_col`` of cells as wide as ``km``; and the functions that give a row, a row's columns and a column."""
    step = km / 110.5  # no degree of latitude is shorter
    row = lambda lat: F.floor(lat / step).cast("long")
    # Longitude cells are at least as wide as the radius at the row's edge nearest a pole.
    edge = (F.abs(F.col("_row")) + 1) * step
    columns = F.when(edge >= 89, 1).otherwise(F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / step))).cast("long")
    column = lambda lon: F.floor(F.pmod(lon + 180, F.lit(360.0)) / (360 / F.col("_of"))).cast("long")
    return df.withColumn("_row", row(F.col("lat"))).withColumn("_of", columns).withColumn("_col", column(F.col("lon"))), (row, columns, column)


def _nearest_within(points: DataFrame, spots: DataFrame, by: list[str], km: float, sphere: bool) -> DataFrame:
    """One search of ``nearest_place``: (by..., place, km) of the points that have one of ``spots`` within ``km``."""
    dealt, (row, columns, column) = _cells(spots, km)
    dealt = dealt.select("place", "place_id", F.col("lat").alias("_plat"), F.col("lon").alias("_plon"), "_row", "_col")
    look = points.withColumn("_row", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: row(F.col("lat")) + d)))
    look = look.withColumn("_of", columns).withColumn("_own", column(F.col("lon")))
    look = look.withColumn("_col", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("_own") + d, F.col("_of"))))))
    ends = [F.col(c) for c in ("lat", "lon", "_plat", "_plon")]
    far = haversine_km(*ends) if sphere else geodesic(*ends)["km"]
    met = look.join(gathered(dealt), ["_row", "_col"]).withColumn("km", far).where(F.col("km") <= km)
    return met.groupBy(*by).agg(F.min_by("place", F.struct("km", "place_id")).alias("place"), F.min("km").alias("km"))


def window_alerts(points: DataFrame, px: DataFrame, p: str, half: int, leads: list[int], least: float, prefix: str) -> DataFrame:
    """First lead at which the largest p near a place reaches ``least``: (issue, place, lead_min, p_max, alert_id).

    Only pixels that reach ``least`` are spread over the windows they lie in. Places of the same
    pixels share their alerts until the end, so that the work before the last join grows with
    the raster, not with places times frames. A place issues in the frames that have a pixel in its windows.
    """
    at = points.select("place", "y", "x").distinct()
    sites = stored(at.groupBy("place").agg(F.sort_array(F.collect_set(F.struct("y", "x"))).alias("site")), "sites")  # at most the raster's pixels a place
    spots = sites.select("site").distinct().select("site", F.inline("site"))
    near = window_max(px.where(F.col(p) >= least), p, half).join(F.broadcast(spots) if spots.limit(500_001).count() <= 500_000 else spots, ["y", "x"])
    near = near.groupBy("frame", "site").agg(F.max("max_value").alias("p_max"))
    lead = F.explode(F.array(*[F.lit(n) for n in leads]))
    ahead = near.select(F.col("frame").alias("_valid"), "site", "p_max", lead.alias("lead"))
    hit = ahead.withColumn("issue", F.col("_valid") - F.col("lead"))
    # A frame of all the raster's pixels has one in every window that another frame has one in; the others are looked at.
    sizes = px.groupBy(F.col("frame").alias("issue")).agg(F.count_distinct("y", "x").alias("_n")).withColumn("_whole", F.col("_n") == F.lit(px.select("y", "x").distinct().count())).drop("_n")
    part = px.join(sizes.where("NOT _whole").select(F.col("issue").alias("frame")), "frame").withColumn("_one", F.lit(1))
    seen = window_max(part, "_one", half).join(spots, ["y", "x"]).select(F.col("frame").alias("issue"), "site").distinct().withColumn("_seen", F.lit(True))
    first = hit.groupBy("issue", "site").agg(F.min("lead").alias("_lead"), *[F.max(F.when(F.col("lead") == n, F.col("p_max"))).alias(f"_p{n}") for n in leads])
    first = first.join(sizes, "issue").join(seen, ["issue", "site"], "left").where("_whole OR _seen")
    value = F.coalesce(*[F.when(F.col("_lead") == n, F.col(f"_p{n}")) for n in leads])
    alerts = first.select("issue", "site", (F.col("_lead") * 30).alias("lead_min"), value.alias("p_max")).join(sites.withColumn("_slug", slug(F.col("place"))), "site")
    return alerts.select("issue", "place", "lead_min", "p_max", F.concat(F.lit(prefix + "/"), "issue", F.lit("/L"), "lead_min", F.lit("#"), "_slug").alias("alert_id"))


NOTICE = "Exercise only: replay of past data, not an official warning."


def cap_alert(
    alert: dict[str, Column], issue: Column, event: Column, model: Column, sender: str = "demo@example.invalid", prefix: str = "demo", hazard: str = "Deep convection", below_k: float = 235, radius_km: float = 10
) -> Column:
    """A CAP 1.2 alert as XML text; status is always Exercise, values are escaped, and it expires an hour after the lead.

    ``alert`` has alert_id, prediction_id, place, lat, lon, p_max and lead_min.
    """
    tag = lambda name, *parts: F.concat(F.lit(f"<{name}>"), xml_escape(F.concat(*parts)), F.lit(f"</{name}>"))
    time = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    fixed = lambda v, d: F.format_string(f"%.{d}f", v)
    lead, place, p = alert["lead_min"].cast("string"), alert["place"], fixed(alert["p_max"], 2)
    expires = issue + F.make_dt_interval(mins=(alert["lead_min"] + 60).cast("int"))
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><alert xmlns="urn:oasis:names:tc:emergency:cap:1.2">'),
        tag("identifier", F.lit(f"{prefix}-"), event, F.lit("-"), slug(alert["alert_id"])), tag("sender", F.lit(sender)), tag("sent", time(issue)),
        F.lit("<status>Exercise</status><msgType>Alert</msgType><scope>Private</scope>"),
        tag("note", F.lit(NOTICE + " Prediction "), alert["prediction_id"], F.lit(", model "), model, F.lit(".")),
        F.lit("<info><category>Met</category>"), tag("event", F.lit(hazard)), F.lit("<urgency>Expected</urgency><severity>Moderate</severity><certainty>Possible</certainty>"),
        tag("expires", time(expires)),
        tag("headline", F.lit("EXERCISE: probability "), p, F.lit(" of cold cloud near "), place, F.lit(" within "), lead, F.lit(" min")),
        tag("description", F.lit("Probability "), p, F.lit(f" that the cloud top is colder than {below_k:g} K within {radius_km:g} km of "), place, F.lit(" at +"), lead, F.lit(" min.")),
        F.lit("<parameter><valueName>prediction_id</valueName>"), tag("value", alert["prediction_id"]), F.lit("</parameter><area>"),
        tag("areaDesc", place, F.lit(f" ({radius_km:g} km)")), tag("circle", fixed(alert["lat"], 4), F.lit(","), fixed(alert["lon"], 4), F.lit(f" {radius_km:g}")), F.lit("</area></info></alert>"),
    )


def geojson_points(df: DataFrame, by: list[str], lon: str, lat: str, properties: list[str], order: str) -> DataFrame:
    """A FeatureCollection of points for each group, as JSON text, features in the order of ``order``; nulls stay null."""
    feature = F.struct(
        F.col(order).alias("_order"), F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"),
    )
    listed = F.transform(F.array_sort(F.collect_list(feature)), lambda f: f.dropFields("_order"))
    return df.groupBy(*by).agg(listed.alias("_f")).select(*by, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("_f").alias("features")), {"ignoreNullFields": "false"}).alias("geojson"))


def nested_by(df: DataFrame, by: list[str], key: str, values: list[str]) -> DataFrame:
    """A map from ``key`` to the struct of ``values`` for each group, as JSON text with sorted keys."""
    entry = F.struct(F.col(key).cast("string").alias("key"), F.struct(*values).alias("value"))
    return df.groupBy(*by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))


def digest_check(files: DataFrame, recorded: DataFrame, key: str, content: str) -> DataFrame:
    """(key, sha256, status): OK, DIFFERS, UNRECORDED or MISSING against recorded (key, sha256)."""
    own = files.select(key, F.sha2(F.col(content), 256).alias("sha256"))
    met = own.join(recorded.select(key, F.col("sha256").alias("_recorded")), key, "full")
    status = F.when(F.col("sha256").isNull(), "MISSING").when(F.col("_recorded").isNull(), "UNRECORDED").when(F.col("sha256") == F.col("_recorded"), "OK").otherwise("DIFFERS")
    return met.select(key, F.coalesce("sha256", "_recorded").alias("sha256"), status.alias("status"))


def verified_only(files: DataFrame, recorded: DataFrame, key: str, content: str) -> DataFrame:
    """``files``, failing at the first row whose digest is not the recorded one."""
    met = files.join(recorded.select(key, F.col("sha256").alias("_recorded")), key, "left")
    bad = F.col("_recorded").isNull() | (F.sha2(F.col(content), 256) != F.col("_recorded"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("digest of "), F.col(key).cast("string"), F.lit(" differs")))).otherwise(F.col(content))
    return met.withColumn(content, checked).drop("_recorded")


def frozen(files: DataFrame, excluded: DataFrame, key: str, content: str) -> DataFrame:
    """Digest and size of every file that is not excluded."""
    return files.join(excluded, key, "left_anti").select(key, F.sha2(F.col(content), 256).alias("sha256"), F.octet_length(content).alias("bytes"))


def archived(files: DataFrame, path: str, name: str, content: str) -> DataFrame:
    """Copy files that the archive at ``path`` lacks, each under its digest, with name, size and time; returns what was added.

    The copy of a file is a row of the folder named by the first two digits of its SHA-256. Equal
    contents are kept once, under the smallest name. One write is one commit.
    """
    spark = files.sparkSession
    rows = files.groupBy(F.sha2(F.col(content), 256).alias("sha256")).agg(F.min(F.struct(F.col(name).alias("name"), F.col(content).alias("content"))).alias("_f"))
    rows = rows.select("sha256", "_f.name", F.octet_length("_f.content").cast("bigint").alias("bytes"), "_f.content", F.current_timestamp().alias("archived_at"), F.substring("sha256", 1, 2).alias("folder"))
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    if here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(here):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select("sha256"), "sha256", "left_anti")
    added = stored(rows, "archive")
    added.write.partitionBy("folder").mode("append").parquet(path)
    return added.drop("content")


def event_index(listed: DataFrame, bundled: DataFrame) -> DataFrame:
    """A card for each event: those of ``listed`` (code, date, place, hazard, status, reason) and the built ones of ``bundled`` (code, event, date, place, hazard, held_out)."""
    built = bundled.withColumns({"status": F.lit("BUNDLED"), "reason": F.when(F.col("held_out"), "held-out test event (never used in training)")})
    cards = listed.withColumns({"event": F.lit(None).cast("string"), "held_out": F.lit(None).cast("boolean")}).unionByName(built)
    return cards.select("code", "event", "date", "place", "hazard", "status", "held_out", "reason")


def document(rows: DataFrame, order: str, default: str | None = None, key: str = "events") -> DataFrame:
    """One row ``json``: the rows as a list in the order of ``order``, nulls left out, with the default's name; for tables of a card an event."""
    cards = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *rows.columns))), lambda c: c.dropFields("_order"))
    named = [F.lit(default).alias("default")] if default is not None else []
    return rows.agg(cards.alias(key)).select(F.to_json(F.struct(*named, key)).alias("json"))


def run_summary(px: DataFrame, quality: DataFrame, features: DataFrame, lifecycle: DataFrame, cells: DataFrame, event: str, frame_minutes: int = 30, long_minutes: int = 120, cold: float = 221.0) -> DataFrame:
    """One row ``json`` on a finished event: frames, failures, missing share, features, linked ones, cells, long and cold ones, families."""
    one = [
        quality.agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(F.col("status") != "OK").alias("qc_fail_frames"), F.array_sort(F.collect_list(F.when(F.col("status") != "OK", F.col("frame")))).alias("qc_fail_list"), F.max("missing_frac").alias("residual_missing_max")),
        px.agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")),
        features.agg(F.count(F.lit(1)).alias("n_features")), lifecycle.agg(F.count(F.lit(1)).alias("n_features_linked")),
        cells.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("lifetime_min") >= long_minutes).alias("n_cells_long"), F.count_if(F.col("min_bt") < cold).alias("n_cells_cold"), F.count_if(F.col("frames_touching_missing") > 0).alias("cells_touching_missing")),
        lifecycle.select("cell", "family").distinct().groupBy("family").agg(F.count(F.lit(1)).alias("_k")).agg(F.count_if(F.col("_k") > 1).alias("n_families_gt1")),
    ]
    out = one[0]
    for part in one[1:]:  # one row each
        out = out.crossJoin(F.broadcast(part))
    return out.select(F.to_json(F.struct(F.lit(event).alias("event"), F.lit(frame_minutes).alias("frame_minutes"), *out.columns)).alias("json"))


def simplified(ring: list, tolerance: float) -> list:
    """The closed ring with every corner that lies within ``tolerance`` of the lines kept left out.

    The ring is halved at the corner farthest from its first; each part keeps its
    farthest corner while that is beyond the tolerance.
    """
    if tolerance <= 0 or len(ring) < 4:
        return ring
    far = max(range(len(ring)), key=lambda k: math.dist(ring[0], ring[k]))
    keep, parts = {0, far, len(ring) - 1}, [(0, far), (far, len(ring) - 1)]
    while parts:
        a, b = parts.pop()
        (x0, y0), (x1, y1) = ring[a], ring[b]
        span = math.hypot(x1 - x0, y1 - y0)
        off = lambda p: abs((x1 - x0) * (p[1] - y0) - (y1 - y0) * (p[0] - x0)) / span if span else math.dist(p, (x0, y0))  # noqa: B023, E731
        most, at = max(((off(ring[k]), k) for k in range(a + 1, b)), default=(0.0, a))
        if most > tolerance:
            keep.add(at)
            parts += [(a, at), (at, b)]
    return [ring[k] for k in sorted(keep)]


def located_rings(df: DataFrame, x0: float, y0: float, step: float, to_latlon, column: str = "rings") -> DataFrame:
    """``rings`` in pixel corners as [longitude, latitude] with four decimals; (x0, y0) is the centre of pixel (0, 0), ``step`` its width in metres."""

    def place(p: Column) -> Column:
        lat, lon = to_latlon(x0 + (p[0] - 0.5) * step, y0 + (p[1] - 0.5) * step)
        return F.array(F.round(lon, 4), F.round(lat, 4))

    return df.withColumn(column, F.transform(column, lambda ring: F.transform(ring, place)))


def rings(mask_rows: DataFrame, by: list[str], tolerance: float = 0.0, least: int = 0) -> DataFrame:
    """Boundary rings of pixel sets (by..., y, x): JSON-ready arrays of [x, y] corners per group, outer rings and holes.

    Every pixel edge between inside and outside is one unit segment; a group's
    segments are chained to closed rings and straight runs are merged. Rings are
    simplified within ``tolerance`` pixels; those left with under ``least``
    points (the first is repeated at the end) go, so a group may have none.
    """
    import pandas as pd

    kinds = ", ".join(f"{mask_rows.schema[c].name} {mask_rows.schema[c].dataType.simpleString()}" for c in by)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        inside = set(zip(pdf["y"].tolist(), pdf["x"].tolist()))
        after: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for y, x in inside:
            for a, b, other in (((x, y), (x + 1, y), (y - 1, x)), ((x + 1, y), (x + 1, y + 1), (y, x + 1)), ((x + 1, y + 1), (x, y + 1), (y + 1, x)), ((x, y + 1), (x, y), (y, x - 1))):
                if other not in inside:
                    after.setdefault(a, []).append(b)
        out = []
        while after:
            start = min(after)
            ring, at = [start], start
            while True:
                to = after[at].pop()
                if not after[at]:
                    del after[at]
                at = to
                if at == start:
                    break
                ring.append(at)
            n = len(ring)
            turn = [p for k, p in enumerate(ring) if not (ring[k - 1][0] == p[0] == ring[(k + 1) % n][0] or ring[k - 1][1] == p[1] == ring[(k + 1) % n][1])]
            ring = simplified([[float(a), float(b)] for a, b in [*turn, turn[0]]], tolerance)
            if len(ring) >= least:
                out.append(ring)
        first = {c: [pdf[c].iloc[0]] for c in by}
        return pd.DataFrame({**first, "rings": [sorted(out)]})

    return mask_rows.select(*by, "y", "x").groupBy(*by).applyInPandas(chain, f"{kinds}, rings array<array<array<double>>>")


def png_tiles(rows: DataFrame, height: int, width: int) -> DataFrame:
    """(frame, png): grey 8-bit images of code rows (frame, y, codes), absent rows filled with 255; a frame is the unit of work."""
    import pandas as pd

    def image(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = dict(zip(pdf["y"], pdf["codes"]))
        raw = b"".join(b"\0" + bytes(lines.get(y, b"\xff" * width)) for y in range(height))
        part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
        png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")
        return pd.DataFrame({"frame": [pdf["frame"].iloc[0]], "png": [png]})

    return rows.select("frame", "y", "codes").groupBy("frame").applyInPandas(image, "frame int, png binary")


def mercator_rows(north: float, south: float, rows: int) -> list[float]:
    """Latitudes of display rows evenly spaced in Web Mercator, north first."""
    m = lambda d: math.log(math.tan(math.pi / 4 + math.radians(d) / 2))
    return [math.degrees(2 * math.atan(math.exp(m(north) + (m(south) - m(north)) * (k + 0.5) / rows)) - math.pi / 2) for k in range(rows)]
