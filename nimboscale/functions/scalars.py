"""Scalar expressions: time codecs, quantisation, geodesy, projections, display."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

A_WGS84, F_WGS84 = 6378137.0, 1 / 298.257223563
R_SPHERE_KM = 6371.0


# ---- quantisation -------------------------------------------------------------


def to_code(value: Column, scale: float, offset: float, nodata: int = 255, most: int = 254) -> Column:
    """Half-even 8-bit code of (value - offset) * scale, clipped; missing is ``nodata``."""
    code = F.least(F.greatest(F.rint((value - offset) * scale), F.lit(0.0)), F.lit(float(most)))
    return F.when(value.isNull() | F.isnan(value), nodata).otherwise(code).cast("int")


def from_code(code: Column, scale: float, offset: float, nodata: int = 255) -> Column:
    return F.when(code != nodata, code / F.lit(scale) + offset)


def quantised(value: Column, step: float, offset: float, kind: str = "smallint") -> Column:
    """Half-even fixed-point storage; null stays null."""
    return F.rint((value - offset) / step).cast(kind)


# ---- time ---------------------------------------------------------------------


def stamp(time: Column) -> Column:
    return F.date_format(time, "yyyyMMdd'T'HHmm'Z'")


def parse_stamp(text: Column) -> Column:
    return F.to_timestamp(text, "yyyyMMdd'T'HHmm'Z'")


def hourly_name(time: Column, prefix: str = "merg") -> Column:
    """Name of the public hourly merged-infrared file that holds ``time``. Fixed format."""
    return F.concat(F.lit(prefix + "_"), F.date_format(time, "yyyyMMddHH"), F.lit("_4km-pixel"))


def field_times(name: Column) -> Column:
    """The two half-hour stamps of an hourly file, from its name."""
    hour = F.to_timestamp(F.regexp_extract(name, r"_(\d{10})_", 1), "yyyyMMddHH")
    return F.array(hour, hour + F.expr("interval 30 minutes"))


def hour_angle(time: Column) -> tuple[Column, Column]:
    """Sine and cosine of the time of day."""
    turn = (F.hour(time) + F.minute(time) / 60.0) * (2 * math.pi / 24)
    return F.sin(turn), F.cos(turn)


def local_time(time: Column, minutes: int = 330) -> Column:
    return F.date_format(time + F.make_dt_interval(mins=F.lit(minutes)), "HH:mm")


def lead_label(minutes: Column) -> Column:
    hours = F.regexp_replace((minutes / 60).cast("double").cast("string"), r"\.0$", "")
    return F.when(minutes == 0, "T+0").when(minutes < 60, F.concat(F.lit("T+"), minutes.cast("string"), F.lit("m"))).otherwise(F.concat(F.lit("T+"), hours, F.lit("h")))


def hour_block(hour: Column, width: int = 6) -> Column:
    low = (F.floor(hour / width) * width).cast("int")
    return F.format_string("%02d-%02d", low, low + width)


def probability_bin(p: Column, steps=(0.1, 0.3, 0.5, 0.7, 0.9)) -> Column:
    """Index of the last step that p reaches; -1 below the first and for null."""
    out = F.lit(-1)
    for i, s in enumerate(steps):
        out = F.when(p >= s, i).otherwise(out)
    return out


# ---- geodesy -------------------------------------------------------------------


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on the sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * R_SPHERE_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dl = F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def destination(lat: Column, lon: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    """(lat, lon) reached on the sphere."""
    d, b, f = km / R_SPHERE_KM, F.radians(bearing), F.radians(lat)
    to = F.asin(F.sin(f) * F.cos(d) + F.cos(f) * F.sin(d) * F.cos(b))
    turn = F.atan2(F.sin(b) * F.sin(d) * F.cos(f), F.cos(d) - F.sin(f) * F.sin(to))
    return F.degrees(to), lon + F.degrees(turn)


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 8) -> Column:
    """Struct (km, azimuth) on the WGS84 ellipsoid by Vincenty's inverse formula with fixed rounds.

    Equal points give 0 km and a null azimuth. Nearly antipodal points, where
    the iteration does not settle, are beyond its use here.
    """
    b = A_WGS84 * (1 - F_WGS84)
    u1, u2 = F.atan(F.tan(F.radians(lat1)) * (1 - F_WGS84)), F.atan(F.tan(F.radians(lat2)) * (1 - F_WGS84))
    start = F.struct(
        F.radians(lon2 - lon1).alias("l"), F.sin(u1).alias("su1"), F.cos(u1).alias("cu1"), F.sin(u2).alias("su2"), F.cos(u2).alias("cu2"),
        F.radians(lon2 - lon1).alias("x"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), F.lit(1.0).alias("cs"), F.lit(0.0).alias("c2a"), F.lit(0.0).alias("c2m"),
    )

    def turn(p, _):
        sx, cx = F.sin(p["x"]), F.cos(p["x"])
        ss = F.sqrt(F.pow(p["cu2"] * sx, 2) + F.pow(p["cu1"] * p["su2"] - p["su1"] * p["cu2"] * cx, 2))
        cs = p["su1"] * p["su2"] + p["cu1"] * p["cu2"] * cx
        s = F.atan2(ss, cs)
        sa = F.coalesce(F.try_divide(p["cu1"] * p["cu2"] * sx, ss), F.lit(0.0))
        c2a = 1 - sa * sa
        c2m = F.coalesce(cs - F.try_divide(2 * p["su1"] * p["su2"], c2a), F.lit(0.0))
        c = F_WGS84 / 16 * c2a * (4 + F_WGS84 * (4 - 3 * c2a))
        x = p["l"] + (1 - c) * F_WGS84 * sa * (s + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))
        return F.struct(*[p[k].alias(k) for k in ("l", "su1", "cu1", "su2", "cu2")], x.alias("x"), s.alias("s"), ss.alias("ss"), cs.alias("cs"), c2a.alias("c2a"), c2m.alias("c2m"))

    def finish(p):
        u = p["c2a"] * ((A_WGS84**2 - b**2) / b**2)
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        ds = small * p["ss"] * (p["c2m"] + small / 4 * (p["cs"] * (2 * p["c2m"] * p["c2m"] - 1) - small / 6 * p["c2m"] * (4 * p["ss"] * p["ss"] - 3) * (4 * p["c2m"] * p["c2m"] - 3)))
        azimuth = F.atan2(p["cu2"] * F.sin(p["x"]), p["cu1"] * p["su2"] - p["su1"] * p["cu2"] * F.cos(p["x"]))
        return F.struct((b * big * (p["s"] - ds) / 1000).alias("km"), F.when(p["ss"] > 0, F.pmod(F.degrees(azimuth), F.lit(360.0))).alias("azimuth"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, finish)


# ---- projections -----------------------------------------------------------------


def mercator(lat: Column) -> Column:
    return F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def mercator_inverse(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y)) - F.lit(math.pi / 2))


_E2 = F_WGS84 * (2 - F_WGS84)
_E = math.sqrt(_E2)


def _q(sin_lat):
    """Authalic q of a sine of latitude; works on columns and floats."""
    log = F.ln if isinstance(sin_lat, Column) else math.log
    es = sin_lat * _E
    return (sin_lat / (1 - es * es) - log((1 - es) / (1 + es)) / (2 * _E)) * (1 - _E2)


_QP = _q(1.0)
_RQ = A_WGS84 * math.sqrt(_QP / 2)


def _centre(lat0: float):
    s = math.sin(math.radians(lat0))
    beta = math.asin(_q(s) / _QP)
    d = A_WGS84 * math.cos(math.radians(lat0)) / math.sqrt(1 - _E2 * s * s) / (_RQ * math.cos(beta))
    return beta, d


def laea(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """(x, y) in metres, Lambert azimuthal equal-area on WGS84 around (lat0, lon0)."""
    b0, d = _centre(lat0)
    beta, dl = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _q(F.sin(F.radians(lat))) / _QP))), F.radians(lon - lon0)
    k = F.sqrt(2 / (1 + math.sin(b0) * F.sin(beta) + math.cos(b0) * F.cos(beta) * F.cos(dl))) * _RQ
    return k * d * F.cos(beta) * F.sin(dl), k / d * (math.cos(b0) * F.sin(beta) - math.sin(b0) * F.cos(beta) * F.cos(dl))


def laea_inverse(x: Column, y: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """(lat, lon); the authalic latitude series is good to millimetres."""
    b0, d = _centre(lat0)
    rho = F.hypot(x / d, y * d)
    c = 2 * F.asin(F.least(F.lit(1.0), rho / (2 * _RQ)))
    beta = F.asin(F.cos(c) * math.sin(b0) + F.coalesce(F.try_divide(d * y * F.sin(c) * math.cos(b0), rho), F.lit(0.0)))
    dl = F.atan2(x * F.sin(c), d * rho * math.cos(b0) * F.cos(c) - d * d * y * math.sin(b0) * F.sin(c))
    e2, e4, e6 = _E2, _E2**2, _E2**3
    lat = (
        beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
    )
    return F.degrees(lat), F.degrees(dl) + lon0


# ---- markup -----------------------------------------------------------------------


def xml_escape(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "-")
