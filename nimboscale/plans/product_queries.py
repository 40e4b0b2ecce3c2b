"""Queries of sources, sinks, products and gates on the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nimboscale.functions import scalars as S
from nimboscale.operators import audit as A, ml, preprocess as P, products, raster as R, regions, resample as B
from nimboscale.plans import probability
from nimboscale.plans.event_pipeline import scores_with_fss
from nimboscale.plans.kernel_queries import GAPS
from nimboscale.plans.region_queries import FEATURES, features
from nimboscale.plans.registry import query
from nimboscale.plans.score_queries import _QS, ROWS, SAMPLE, _sample
from nimboscale.plans.standins import EVENT, HEIGHT, PLACES, POS, PX, SC, SEG, WIDTH, pixels, places, positions, scores, segments
from nimboscale.plans.track_queries import EDGES, TRACKS, _tracks
from nimboscale.session import new_shared_path, stored, table
from nimboscale.sources import io

# ---- files out and back ---------------------------------------------------------

ORDERS = "SELECT o_orderpriority, count(*) AS n, count(price) AS priced, round(sum(price), 2) AS total, CAST(sum(o_orderkey % 97) AS BIGINT) AS checksum FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders) GROUP BY o_orderpriority"


def _orders(spark, sf_dir):
    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice").cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", price.alias("price"))


def _summed(df):
    return df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"), F.round(F.sum("price"), 2).alias("total"), F.sum(F.col("o_orderkey") % 97).alias("checksum"))


@query(ORDERS)
def csv_round_trip(spark, sf_dir):
    """Rows written as CSV and read with a schema; NaN comes back as null."""
    path = new_shared_path(spark, "csv")
    io.write_csv(_orders(spark, sf_dir), path)
    return _summed(io.read_csv(spark, path, "o_orderkey bigint, o_orderpriority string, price double"))


@query(ORDERS)
def json_round_trip(spark, sf_dir):
    """Rows written as JSON lines with nulls kept."""
    path = new_shared_path(spark, "json")
    io.write_json(_orders(spark, sf_dir), path)
    return _summed(io.read_json(spark, path, "o_orderkey bigint, o_orderpriority string, price double", whole=False))


@query(f"WITH {PX} SELECT frame, count(*) AS n, count(v) AS valid, round(sum(v), 5) AS total FROM pm WHERE y BETWEEN 5 AND 44 AND x BETWEEN 3 AND 60 GROUP BY frame")
def cube_round_trip(spark, sf_dir):
    """A raster cube, a folder a frame, cropped on reading."""
    path = new_shared_path(spark, "cube")
    io.write_cube(pixels(spark, sf_dir, True), path, ["frame"])
    out = io.read_parquet(spark, path).where(F.col("y").between(5, 44) & F.col("x").between(3, 60))
    return out.groupBy(F.col("frame").cast("int").alias("frame")).agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("valid"), F.round(F.sum("v"), 5).alias("total"))


@query("""SELECT l_orderkey, l_linenumber, CAST(round_even(((250 + (l_quantity - 25) * 0.37) - 250) / 0.01, 0) AS INT) AS bt, round(round_even(((250 + (l_quantity - 25) * 0.37) - 250) / 0.01, 0) * 0.01 + 250.0, 6) AS bt_back,
CAST(round_even(l_discount * 0.77 / 1e-4, 0) AS INT) AS p, round(round_even(l_discount * 0.77 / 1e-4, 0) * 1e-4, 8) AS p_back FROM lineitem""")
def packed_forecasts(spark, sf_dir):
    """Forecasts in hundredths of a kelvin and chances in ten-thousandths, and what reading gives back."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (250 + (F.col("l_quantity") - 25) * 0.37).alias("bt"), (F.col("l_discount") * 0.77).alias("p"))
    packed = io.pack_probability(io.pack_forecast(t))
    back = io.unpack_probability(io.unpack_forecast(packed.withColumns({"bt_back": F.col("bt"), "p_back": F.col("p")}), "bt_back"), "p_back")
    return back.select("l_orderkey", "l_linenumber", F.col("bt").cast("int").alias("bt"), F.round("bt_back", 6).alias("bt_back"), "p", F.round("p_back", 8).alias("p_back"))


@query(f"""WITH {PX}, c AS (SELECT frame, y, x, CASE WHEN v IS NULL THEN 255 ELSE CAST(least(greatest(round_even((v + 0.5) * 250, 0), 0), 254) AS INT) END AS code FROM pm WHERE (y + x) % 9 <> 0),
g AS (SELECT DISTINCT frame, y FROM c), xs AS (SELECT frame, y, unnest(range({WIDTH})) AS x FROM g)
SELECT frame, y, string_agg(printf('%02X', coalesce(code, 255)), '' ORDER BY x) AS codes FROM xs LEFT JOIN c USING (frame, y, x) GROUP BY frame, y""")
def tile_code_rows(spark, sf_dir):
    """A byte a pixel for each raster row, missing and absent ones 255."""
    px = io.tile_codes(pixels(spark, sf_dir, True).where("(y + x) % 9 <> 0"), 250.0, -0.5)
    return io.tile_rows(px, WIDTH).select("frame", "y", F.hex("codes").alias("codes"))


@query(f"""WITH {PX} SELECT frame, CAST({HEIGHT} AS INT) AS height, CAST({WIDTH} AS INT) AS width, count(v) AS shown FROM pm GROUP BY frame""")
def png_frames(spark, sf_dir):
    """Images of the frames; the size and the shown pixels are read back from the files."""
    import struct
    import zlib

    import pandas as pd

    px = io.tile_codes(pixels(spark, sf_dir, True), 250.0, -0.5)
    made = products.png_tiles(io.tile_rows(px, WIDTH), HEIGHT, WIDTH)

    def look(batches):
        for pdf in batches:
            rows = []
            for frame, png in zip(pdf["frame"], pdf["png"]):
                width, height = struct.unpack(">II", png[16:24])
                at = png.index(b"IDAT")
                lines = zlib.decompress(png[at + 4 : at + 4 + struct.unpack(">I", png[at - 4 : at])[0]])
                rows.append((frame, height, width, sum(b != 255 for k, b in enumerate(lines) if k % (width + 1))))
            yield pd.DataFrame(rows, columns=["frame", "height", "width", "shown"])

    return made.mapInPandas(look, "frame int, height int, width int, shown bigint")


# ---- manifests, digests, archives ------------------------------------------------


@query("""SELECT substr(sha256(text), 1, 1) AS first_digit, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, 0::BIGINT AS added_again FROM (SELECT DISTINCT text FROM documents) GROUP BY 1""")
def archived_files(spark, sf_dir):
    """Documents as files of an archive by digest; a second run finds nothing new."""
    files = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.format_string("%08d.txt", "doc_id").alias("name"), F.encode("text", "UTF-8").alias("content"))
    path = new_shared_path(spark, "file-archive")
    products.archived(files, path, "name", "content")
    again = products.archived(files, path, "name", "content").count()
    kept = spark.read.parquet(path)
    return kept.groupBy(F.substring("sha256", 1, 1).alias("first_digit")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.lit(again).cast("bigint").alias("added_again"))


@query("""SELECT CAST(doc_id % 5 AS BIGINT) AS part, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(sha256(text)) AS least FROM documents WHERE doc_id % 10 <> 3 GROUP BY 1""")
def frozen_files(spark, sf_dir):
    """Digest and size of all files that are not excluded, each checked against its record while it is read."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    recorded = files.select("doc_id", F.sha2("content", 256).alias("sha256"))
    frozen = products.frozen(products.verified_only(files, recorded, "doc_id", "content"), files.where("doc_id % 10 = 3").select("doc_id"), "doc_id", "content")
    return frozen.groupBy((F.col("doc_id") % 5).alias("part")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("bytes").cast("bigint")).alias("bytes"), F.min("sha256").alias("least"))


@query("""SELECT CASE WHEN item_id % 3 = 0 THEN 'second' ELSE 'first' END AS version, count(*) AS files, count(*) FILTER (WHERE item_id % 4 = 0) AS to_fetch, '{"hours": 24}' AS settings FROM benchmark GROUP BY 1""")
def manifest_versions(spark, sf_dir):
    """Two writes to a manifest: the latest row of a file counts; what differs from it is to be fetched again."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("file"), F.encode("text", "UTF-8").alias("content"))
    path = new_shared_path(spark, "manifest")
    row = lambda df, version: df.select("file", F.sha2(F.concat("content", F.lit(version).cast("binary")), 256).alias("sha256"), F.octet_length("content").alias("bytes"), F.lit(version).alias("version"))
    io.record_files(row(rows, "first"), path)
    io.record_files(row(rows.where("item_id % 3 = 0"), "second"), path)
    latest = io.recorded_files(spark, path)
    now = rows.select("item_id", F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("file")).join(latest.select("file", "sha256"), "file")
    now = now.withColumn("sha256", F.when(F.col("item_id") % 4 == 0, F.lit("other")).otherwise(F.col("sha256")))
    todo = io.unrecorded(now.select("file", "sha256"), latest).withColumn("_todo", F.lit(1))
    settings = io.provenance(rows.select(F.col("file").alias("path"), F.octet_length("content").alias("length"), "content"), {"hours": 24}).select(F.col("path").alias("file"), "settings")
    met = latest.join(todo.select("file", "_todo"), "file", "left").join(settings, "file")
    return met.groupBy("version").agg(F.count(F.lit(1)).alias("files"), F.count("_todo").alias("to_fetch"), F.max("settings").alias("settings"))


@query("""SELECT o_orderstatus AS part, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def incremental_build(spark, sf_dir):
    """Rows of parts not built yet with this configuration."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("part"))
    config = F.lit('{"leads": [1, 2]}')
    done = rows.select("part").distinct().withColumn("config_hash", F.when(F.col("part") == "F", F.sha2(config, 256)).otherwise(F.sha2(F.lit("older"), 256)))
    return io.only_new(rows, done, ["part"], config).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# ---- places and grids ------------------------------------------------------------------


@query("""SELECT s_suppkey, 'n' || s_nationkey AS query, CASE WHEN n_nationkey IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status, CASE WHEN n_nationkey IS NOT NULL THEN n_nationkey * 1.5::DOUBLE END AS lat
FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) n ON n_nationkey = s_nationkey""")
def geocoded_stations(spark, sf_dir):
    """Stations with the coordinates of a lookup by query text, and a status."""
    st = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("query"))
    found = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("query"), (F.col("n_nationkey") * 1.5).cast("double").alias("lat"), F.lit(70.0).alias("lon"), F.col("n_name").alias("osm_display_name"))
    return io.geocoded(st, found.unionByName(found)).select("s_suppkey", "query", "status", "lat")


_UP = lambda d: f"ln(tan(pi() / 4 + radians({d}) / 2))"


@query(f"""WITH {PX}, {PLACES}, a AS (SELECT place_id, CAST(floor(({_UP(40)} - {_UP('lat')}) / ({_UP(40)} - {_UP(20)}) * {HEIGHT}) AS INT) AS y, CAST(floor((lon - 70) / 20.0 * {WIDTH}) AS INT) AS x FROM places)
SELECT place_id, frame, v FROM a JOIN pm USING (y, x)""")
def sampled_places(spark, sf_dir):
    """The raster's value at each place, every frame."""
    return io.sample_raster(places(spark, sf_dir).select("place_id", "lat", "lon"), pixels(spark, sf_dir, True), (20.0, 40.0, 70.0, 90.0), HEIGHT, WIDTH).select("place_id", "frame", "v")


@query(f"""WITH {PLACES} SELECT CAST(place_id % 7 AS BIGINT) AS part, count(*) AS n, count(*) FILTER (WHERE lat BETWEEN 27 AND 31.5 AND lon BETWEEN 75 AND 80) AS inside,
count(*) FILTER (WHERE place_id % 5 <> 0 AND lat BETWEEN 27 AND 31.5 AND lon BETWEEN 75 AND 80) AS known_inside FROM places GROUP BY 1""")
def places_in_domain(spark, sf_dir):
    """Places in the box, and those of them with coordinates."""
    p = places(spark, sf_dir)
    box = (27.0, 31.5, 75.0, 80.0)
    some = F.when(F.col("place_id") % 5 != 0, F.col("lat"))
    return p.groupBy((F.col("place_id") % 7).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(P.in_box(F.col("lat"), F.col("lon"), box)).alias("inside"), F.count_if(P.in_box(some, F.col("lon"), box)).alias("known_inside")
    )


DISPLAY, COLS, X0, Y0, STEP = (24.0, 36.0, 70.0, 86.0), 48, -800_000.0, -620_000.0, 26_000.0
_H = R.display_height(DISPLAY, COLS)


@query(f"""WITH {PX}, cell AS (SELECT r AS row, c AS col, degrees(2 * atan(exp({_UP(36)} - (r + 0.5) / {float(_H)}::DOUBLE * ({_UP(36)} - {_UP(24)}))) - pi() / 2) AS lat, 70 + (c + 0.5) / {float(COLS)}::DOUBLE * 16 AS lon FROM range({_H}) a(r), range({COLS}) b(c)),
c AS (SELECT *, 6378137.0::DOUBLE AS a, (2 - 1 / 298.257223563::DOUBLE) / 298.257223563::DOUBLE AS e2, radians(30.0) AS p0 FROM cell),
q AS (SELECT *, {_QS('sin(radians(lat))')} AS q, {_QS('sin(p0)')} AS q0, {_QS('1.0::DOUBLE')} AS qp FROM c),
b AS (SELECT *, asin(q / qp) AS beta, asin(q0 / qp) AS b0, a * sqrt(qp / 2) AS rq, radians(lon - 78.0) AS dl FROM q),
d AS (SELECT *, a * cos(p0) / sqrt(1 - e2 * sin(p0) * sin(p0)) / (rq * cos(b0)) AS d, rq * sqrt(2 / (1 + sin(b0) * sin(beta) + cos(b0) * cos(beta) * cos(dl))) AS k FROM b),
m AS (SELECT row, col, CAST(round_even((k / d * (cos(b0) * sin(beta) - sin(b0) * cos(beta) * cos(dl)) - {Y0}) / {STEP}, 0) AS INT) AS y, CAST(round_even((k * d * cos(beta) * sin(dl) - {X0}) / {STEP}, 0) AS INT) AS x FROM d)
SELECT frame, CAST(row AS INT) AS row, count(*) AS shown, count(v) AS valid, round(sum(v), 5) AS total FROM m JOIN pm USING (y, x) GROUP BY frame, row""")
def mercator_display_rows(spark, sf_dir):
    """Frames on a Web-Mercator image whose height follows from its width, by the nearest pixel of the equal-area source."""
    cells = R.display_cells(spark, DISPLAY, COLS)
    out = R.display_regrid(pixels(spark, sf_dir, True), cells, lambda lat, lon: S.laea(lat, lon, 30.0, 78.0), X0, Y0, STEP)
    return out.groupBy("frame", "row").agg(F.count(F.lit(1)).alias("shown"), F.count("v").alias("valid"), F.round(F.sum("v"), 5).alias("total"))


# ---- quality, gates, documents -----------------------------------------------------------


@query(f"""WITH RECURSIVE {GAPS} SELECT frame, round(avg(CASE WHEN p.v IS NULL THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS raw_missing, round(avg(CASE WHEN f.v IS NULL THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS residual_missing,
round(avg(CASE WHEN p.v IS NULL AND f.v IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS gapfilled FROM pm p JOIN f4 f USING (frame, y, x) GROUP BY frame""")
def missing_before_and_after(spark, sf_dir):
    """Shares of each frame missing before and after gap filling."""
    raw = pixels(spark, sf_dir, True)
    out = P.missing_shares(raw, stored(regions.gap_fill(raw), "filled"))
    return out.select("frame", *[F.round(c, 9).alias(c) for c in ("raw_missing", "residual_missing", "gapfilled")])


@query(f"""WITH RECURSIVE {GAPS}, {EDGES.split(SEG)[0].replace(PX + ',', '').strip()} {SEG}, {EDGES.split(SEG + ',')[1].strip()}, {TRACKS},
dom AS (SELECT f.frame, p.v AS raw, f.v AS v FROM pm p JOIN f4 f USING (frame, y, x) WHERE (y + 2 * x) % 5 <> 0),
fr AS (SELECT frame, avg(CASE WHEN raw IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS r, avg(CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS m, avg(CASE WHEN raw IS NULL AND v IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS g,
  count(*) FILTER (WHERE v < {EVENT}) AS deep, count(*) AS n FROM dom GROUP BY frame), sp AS (SELECT cell, count(*) AS n FROM tracks GROUP BY cell)
SELECT count(*) AS n_frames, round(avg(CASE WHEN deep > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS deep_frames, round(avg(deep / n::DOUBLE), 9) AS deep_area_mean, round(max(deep / n::DOUBLE), 9) AS deep_area_max, round(max(r), 9) AS raw_missing_max,
  round(max(m), 9) AS residual_missing_max, round(avg(g), 9) AS gapfilled_mean, (SELECT count(*) FROM sp) AS n_cells, (SELECT count(*) FROM sp WHERE n >= 3) AS n_long_cells, count(*) = 10 AND avg(CASE WHEN deep > 0 THEN 1.0::DOUBLE ELSE 0.0 END) >= 0.5 AS suitable FROM fr""")
def event_quality_row(spark, sf_dir):
    """Everything that decides on an event: missing, filled, deep frames and areas, cells, suitability."""
    inside = lambda df: df.where((F.col("y") + 2 * F.col("x")) % 5 != 0)
    raw = pixels(spark, sf_dir, True)
    filled = stored(regions.gap_fill(raw), "filled")
    _, _, tracks = _tracks(spark, sf_dir)
    out = P.event_quality(inside(raw), inside(filled), tracks, EVENT, 10, 0.5, 3)
    return out.withColumns({c: F.round(c, 9) for c in ("deep_frames", "deep_area_mean", "deep_area_max", "raw_missing_max", "residual_missing_max", "gapfilled_mean")})


@query("""WITH b AS (SELECT event_type, count(*) AS n, min(CAST(ts AS DATE)) AS d FROM events GROUP BY 1)
SELECT 'R' || r_regionkey AS code, NULL::VARCHAR AS event, '' AS date, r_name AS place, 'Lightning' AS hazard, 'NOT AVAILABLE' AS status, NULL::BOOLEAN AS held_out, 'outside the archive' AS reason FROM region
UNION ALL SELECT upper(event_type), event_type, strftime(d, '%Y-%m-%d'), 'n = ' || n, 'Hail', 'BUNDLED', n % 2 = 0, CASE WHEN n % 2 = 0 THEN 'held-out test event (never used in training)' END FROM b""")
def event_cards(spark, sf_dir):
    """An index row an event, with status and reason."""
    return products.event_index(*_cards(spark, sf_dir))


def _cards(spark, sf_dir):
    text = lambda s: F.lit(s)
    listed = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("code"), text("").alias("date"), F.col("r_name").alias("place"), text("Lightning").alias("hazard"), text("NOT AVAILABLE").alias("status"), text("outside the archive").alias("reason"))
    found = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date("ts")).alias("d"))
    bundled = found.select(F.upper("event_type").alias("code"), F.col("event_type").alias("event"), F.date_format("d", "yyyy-MM-dd").alias("date"), F.concat(F.lit("n = "), F.col("n").cast("string")).alias("place"), text("Hail").alias("hazard"), (F.col("n") % 2 == 0).alias("held_out"))
    return listed, bundled


@query("""SELECT '{"default":"R0","events":[' || string_agg('{"code":"R' || r_regionkey || '","date":"","place":"' || r_name || '","hazard":"Lightning","status":"NOT AVAILABLE","reason":"outside the archive"}', ',' ORDER BY 'R' || r_regionkey) || ']}' AS json FROM region""")
def event_index_document(spark, sf_dir):
    """The index as one JSON document."""
    listed, bundled = _cards(spark, sf_dir)
    return products.document(products.event_index(listed, bundled.limit(0)), "code", "R0")


@query("""SELECT l_returnflag, '{' || string_agg('"' || k || '":{"n":' || n || ',"late":' || late || '}', ',' ORDER BY k) || '}' AS json
FROM (SELECT l_returnflag, CAST(l_linenumber AS VARCHAR) AS k, count(*) AS n, count(*) FILTER (WHERE l_tax > 0.045) AS late FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""")
def nested_predictions(spark, sf_dir):
    """Counts by lead nested under each method as a JSON map."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_tax") > 0.045).alias("late"))
    return products.nested_by(t, ["l_returnflag"], "l_linenumber", ["n", "late"])


@query(f"""WITH {SC}, s AS (SELECT method, lead, count(*) AS n, avg(CASE WHEN fc THEN 1.0::DOUBLE ELSE 0.0 END) AS f, avg(CASE WHEN obs THEN 1.0::DOUBLE ELSE 0.0 END) AS o FROM sc GROUP BY ALL)
SELECT method, lead, n, CASE WHEN lead <> 60 THEN round(f, 9) END AS fss_1, round(o, 9) AS fss_5 FROM s""")
def metrics_beside_fss(spark, sf_dir):
    """Scores with a column for each scale; a scale that was not scored is null."""
    s = scores(spark, sf_dir).groupBy("method", "lead").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("fc").cast("double")).alias("f"), F.avg(F.col("obs").cast("double")).alias("o"))
    long = s.select("method", "lead", F.lit(1).alias("scale"), F.round("f", 9).alias("fss")).where("lead <> 60").unionByName(s.select("method", "lead", F.lit(5).alias("scale"), F.round("o", 9).alias("fss")))
    return scores_with_fss(s.select("method", "lead", "n"), long, [1, 5])


@query(f"""WITH {POS}, pr AS (SELECT cell, area, min_bt - 250 AS dev, lead(min_bt - 250) OVER (PARTITION BY cell ORDER BY frame) AS nxt, lead(area) OVER (PARTITION BY cell ORDER BY frame) AS nxa FROM pos),
u AS (SELECT cell, 'min_bt' AS measure, sum(dev * nxt) AS xy, sum(dev * dev) AS xx FROM pr WHERE nxt IS NOT NULL GROUP BY cell UNION ALL SELECT cell, 'area', sum(-1.0::DOUBLE * area * nxa), sum(1.0::DOUBLE * area * area) FROM pr WHERE nxa IS NOT NULL GROUP BY cell),
e AS (SELECT measure, sum(xy) / sum(xx) AS phi, sum(xx) AS t FROM u GROUP BY measure)
SELECT measure, round(any_value(phi), 8) AS estimate, round(any_value(phi) - 1.96 * sqrt(sum(((xy - phi * xx) / t) ** 2)), 8) AS low, CASE WHEN any_value(phi) > 0 AND any_value(phi) - 1.96 * sqrt(sum(((xy - phi * xx) / t) ** 2)) > 0 THEN 'BUILD' ELSE 'STOP' END AS decision FROM u JOIN e USING (measure) GROUP BY measure""")
def lifecycle_gate(spark, sf_dir):
    """BUILD where the autocorrelation and the lower end of its interval over cells are above zero."""
    from nimboscale.operators.tracks import by_cell

    p = positions(spark, sf_dir).withColumn("dev", F.col("min_bt") - 250)
    p = p.withColumns({"nxt": F.lead("dev").over(by_cell()), "nxa": F.lead("area").over(by_cell())}).where("nxt IS NOT NULL")
    one = lambda m, x, y: F.struct(F.lit(m).alias("measure"), (x * y).cast("double").alias("xy"), (F.abs(x) * F.abs(x)).cast("double").alias("xx"))
    long = p.select("cell", F.inline(F.array(one("min_bt", F.col("dev"), F.col("nxt")), one("area", -F.col("area"), F.col("nxa")))))
    u = stored(long.groupBy("cell", "measure").agg(F.sum("xy").alias("xy"), F.sum("xx").alias("xx")), "gate-sums")
    e = u.groupBy("measure").agg((F.sum("xy") / F.sum("xx")).alias("phi"), F.sum("xx").alias("t"))
    v = (F.col("xy") - F.col("phi") * F.col("xx")) / F.col("t")
    out = u.join(e, "measure").groupBy("measure").agg(F.max("phi").alias("_e"), F.sqrt(F.sum(v * v)).alias("_sd"))
    return A.decision(out.select("measure", F.round("_e", 8).alias("estimate"), F.round(F.col("_e") - 1.96 * F.col("_sd"), 8).alias("low")), "estimate", "low")


# ---- features, tracers, learning ---------------------------------------------------------


@query(f"""WITH RECURSIVE {FEATURES}, b AS (SELECT frame, feature, CAST(round_even(cy, 0) AS INT) AS y, CAST(round_even(cx, 0) AS INT) AS x FROM ft WHERE feature % 3 <> 0)
SELECT b.frame, b.feature, min(p.v) AS min_bt FROM b LEFT JOIN pm p ON p.frame = b.frame AND p.y BETWEEN b.y - 1 AND b.y + 1 AND p.x BETWEEN b.x - 1 AND b.x + 1 GROUP BY b.frame, b.feature""")
def unsegmented_features(spark, sf_dir):
    """The coldest of the nine pixels around each feature that has no segment."""
    found = stored(features(spark, sf_dir), "features")
    return R.unsegmented(found, found.where("feature % 3 = 0").select("frame", "feature"), pixels(spark, sf_dir, True)).select("frame", "feature", "min_bt")


@query(f"WITH {PX} SELECT frame, count(v) AS n, round(sum(greatest(0.0, {EVENT} - v)), 6) AS depth FROM pm GROUP BY frame")
def coldness_tracer(spark, sf_dir):
    """Depth below the event threshold, missing pixels left out."""
    return pixels(spark, sf_dir, True).withColumn("c", R.cold_tracer(F.col("v"), EVENT)).groupBy("frame").agg(F.count("c").alias("n"), F.round(F.sum("c"), 6).alias("depth"))


@query(f"WITH {ROWS}, {SAMPLE} SELECT lead, round(sum(y * weight) / sum(weight), 8) AS climatology FROM smp GROUP BY lead")
def sampled_climatology(spark, sf_dir):
    """Base rate by lead of the stratified sample, by its weights."""
    return probability.climatology(_sample(spark, sf_dir).withColumnRenamed("y", "label")).withColumn("climatology", F.round("climatology", 8))


@query(f"""WITH {SC}, k AS (SELECT lead, p, sum(o * (lead / 30)) AS wy, CAST(sum(lead / 30) AS DOUBLE) AS w FROM sc WHERE event = 'F' GROUP BY ALL),
c AS (SELECT *, sum(wy) OVER o AS sy, sum(w) OVER o AS sw, row_number() OVER o AS i FROM k WINDOW o AS (PARTITION BY lead ORDER BY p)),
r AS (SELECT a.lead, a.i, b.i AS j, (b.sy - a.sy + a.wy) / (b.sw - a.sw + a.w) AS m FROM c a JOIN c b ON b.lead = a.lead AND b.i >= a.i),
f AS (SELECT q.lead, q.p, q.i, max(l.low) AS calibrated FROM c q JOIN (SELECT r.lead, r.i AS start, t.i AS at, min(r.m) FILTER (WHERE r.j >= t.i) AS low FROM r JOIN c t ON t.lead = r.lead AND t.i >= r.i GROUP BY ALL) l ON l.lead = q.lead AND l.at = q.i GROUP BY ALL)
SELECT lead, round(p, 4) AS p, round(calibrated, 7) AS calibrated FROM f""")
def isotonic_by_lead(spark, sf_dir):
    """Weighted isotonic calibration for each lead; the SQL takes the greatest least mean over intervals."""
    s = scores(spark, sf_dir).where("event = 'F'").withColumn("w", F.col("lead") / 30)
    known = s.select("lead", "p").distinct()
    return ml.calibrated(s, known, "p", "o", "w", "lead", [30, 60, 90, 120, 150, 180, 210]).select("lead", F.round("p", 4).alias("p"), F.round("calibrated", 7).alias("calibrated"))


@query("""SELECT count(*) AS days, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) WHERE extract('year' FROM day) < 1995 AND NOT (extract('day' FROM day) BETWEEN 14 AND 16 AND extract('month' FROM day) = 6)""")
def guarded_split(spark, sf_dir):
    """Training days that the guard lets pass: a day near an event would stop the read."""
    d = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    events = d.select("day").where((F.dayofmonth("day") == 15) & (F.month("day") == 6))
    near = ml.with_buffer(events, "day", 1)
    train = d.where(F.year("day") < 1995).join(near, "day", "left_anti")
    leak = ml.leaks(train.select("day"), d.where(F.year("day") >= 1995).select("day"), events, "day", 1)
    return ml.guarded(train, leak.select("day").unionByName(near), "day").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"))


@query("SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total, true AS moved, true AS unrelated FROM orders")
def permuted_column(spark, sf_dir):
    """A column shuffled over all rows: the same values, nearly none at its place, without correlation to what it was."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("was"))
    out = B.permuted(t, "o_custkey", "o_orderkey", 5, 4000)
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("total"), (F.avg((F.col("o_custkey") == F.col("was")).cast("double")) < 0.02).alias("moved"), (F.abs(F.corr("o_custkey", "was")) < 0.1).alias("unrelated"))


@query("""SELECT l_linenumber * 30 AS minutes, CASE WHEN l_linenumber * 30 < 60 THEN 'T+' || (l_linenumber * 30) || 'm' ELSE 'T+' || regexp_replace(CAST(l_linenumber / 2.0::DOUBLE AS VARCHAR), '\\.0$', '') || 'h' END AS label,
printf('%02d-%02d', CAST(l_linenumber * 3 // 6 * 6 AS INT), CAST(l_linenumber * 3 // 6 * 6 + 6 AS INT)) AS block, count(*) AS n FROM lineitem GROUP BY ALL""")
def display_labels(spark, sf_dir):
    """Lead labels and hour blocks as shown."""
    m = F.col("l_linenumber") * 30
    t = table(spark, sf_dir, "lineitem").select(m.alias("minutes"), S.lead_label(m).alias("label"), S.hour_block(F.col("l_linenumber") * 3).alias("block"))
    return t.groupBy("minutes", "label", "block").agg(F.count(F.lit(1)).alias("n"))
