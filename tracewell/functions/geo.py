"""Geography as Column expressions, inside whole-stage code generation but for the decoding of polylines, which works on Arrow arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_M = 6371000.0
DBSCAN_EARTH_M = 6371008.8
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def valid_lat_lng(lat: Column, lng: Column) -> Column:
    """Both are numbers within -90..90 and -180..180; null and NaN are not."""
    ok = lat.between(-90, 90) & lng.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lng)
    return F.coalesce(ok, F.lit(False))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle metres; 0 where a point is invalid."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    d = 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))
    return F.when(valid_lat_lng(lat1, lng1) & valid_lat_lng(lat2, lng2), d).otherwise(0.0)


def heading_diff(before: Column, after: Column) -> Column:
    """Shortest angle between two headings, 0..180."""
    d = F.abs(after - before) % 360
    return F.when(d > 180, 360 - d).otherwise(d)


def speed_kmph(distance_m: Column, gap_s: Column) -> Column:
    """0 for a gap that is null or not positive."""
    return F.when(gap_s > 0, distance_m / gap_s * 3.6).otherwise(0.0)


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing in degrees, 0 up to 360."""
    y = F.sin(F.radians(lng2 - lng1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2 - lng1))
    return (F.degrees(F.atan2(y, x)) + 360) % 360


def move_point(lat: Column, lng: Column, bearing_deg: Column, distance_m: Column) -> Column:
    """struct(lat, lng) at a distance along a great circle."""
    d, b = distance_m / EARTH_M, F.radians(bearing_deg)
    to = F.asin(F.sin(F.radians(lat)) * F.cos(d) + F.cos(F.radians(lat)) * F.sin(d) * F.cos(b))
    east = F.radians(lng) + F.atan2(F.sin(b) * F.sin(d) * F.cos(F.radians(lat)), F.cos(d) - F.sin(F.radians(lat)) * F.sin(to))
    return F.struct(F.degrees(to).alias("lat"), F.degrees(east).alias("lng"))


def grid_key(lat: Column, lng: Column, digits: int = 4) -> Column:
    """Text key of a cell, as lat_lng rounded to `digits`; the same cells as whole numbers of 10**-digits degrees."""
    scale = float(10**digits)
    return F.concat_ws("_", *((F.round(c * scale) / scale).cast("string") for c in (lat, lng)))


def geohash(lat: Column, lng: Column, precision: int) -> Column:
    """Geohash of `precision` characters (12 at most), by interleaving the bits of both scaled coordinates."""
    bits = precision * 5
    lng_bits, lat_bits = (bits + 1) // 2, bits // 2
    scaled = lambda v, low, width, n: F.least(F.floor((v - low) / width * (1 << n)), F.lit((1 << n) - 1))
    east, north = scaled(lng, -180.0, 360.0, lng_bits), scaled(lat, -90.0, 180.0, lat_bits)
    out = []
    for c in range(precision):
        code = F.lit(0)
        for k in range(5 * c, 5 * c + 5):
            source, at = (east, lng_bits - 1 - k // 2) if k % 2 == 0 else (north, lat_bits - 1 - k // 2)
            code = code * 2 + F.shiftright(source.cast("long"), at).bitwiseAND(F.lit(1))
        out.append(F.substring(F.lit(BASE32), code.cast("int") + 1, F.lit(1)))
    return F.concat(*out)


def polyline_points(texts: pa.Array) -> pa.Array:
    """decode_polyline() of an Arrow array: all characters of all texts at once, each a fixed number of times."""
    texts = texts.cast(pa.large_binary())
    coded = pc.fill_null(texts, b"")
    at = np.frombuffer(coded.buffers()[1], np.int64)[coded.offset : coded.offset + len(coded) + 1]
    data = coded.buffers()[2]
    group = (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)).astype(np.int64) - 63
    at = at - at[0]
    last = np.zeros(len(group), bool)
    last[group < 32] = True
    cut = last.copy()
    cut[at[1:][np.diff(at) > 0] - 1] = True  # a number doesn't go over a text's end
    end = np.flatnonzero(cut)
    begin = np.concatenate([[0], end[:-1] + 1])[: len(end)]
    place = np.arange(len(group)) - np.repeat(begin, end - begin + 1)
    value = np.add.reduceat((group & 31) << (5 * np.minimum(place, 12)), begin) if len(begin) else np.zeros(0, np.int64)
    whole, owner = last[end], np.searchsorted(at, begin, "right") - 1
    value, owner = value[whole], owner[whole]
    delta = np.where(value & 1, ~(value >> 1), value >> 1)
    n = np.bincount(owner, minlength=len(texts))
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    paired = nth < np.repeat(n // 2 * 2, n)
    points = n // 2
    edge = np.concatenate([[0], np.cumsum(points)])
    parts = []
    for k in (0, 1):
        total = np.concatenate([[0], np.cumsum(delta[paired & (nth % 2 == k)])])
        parts.append(pa.array((total[1:] - np.repeat(total[edge[:-1]], points)) / 1e5))
    rows = pa.StructArray.from_arrays(parts, ["lat", "lng"])
    mask = pa.array(texts.is_null().to_numpy(zero_copy_only=False)) if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), rows, mask=mask)


def decode_polyline(text: Column) -> Column:
    """array<struct<lat,lng>> of an encoded polyline: 5-bit groups, zigzag deltas of 1e-5 degrees.

    In time linear in the text's length. An unfinished number at the end and a latitude
    without its longitude are left out; null gives null, an empty text no points.
    """
    return F.arrow_udf(polyline_points, "array<struct<lat:double,lng:double>>")(text)


def polyline_number(delta: Column) -> Column:
    """The characters of one delta of a polyline, a whole number of 1e-5 degrees."""
    value = F.when(delta < 0, -2 * delta - 1).otherwise(2 * delta).cast("long")
    group = lambda k: F.shiftright(value, 5 * k)
    char = lambda k: F.when(group(k + 1) > 0, F.char(group(k).bitwiseAND(F.lit(31)) + 95)).otherwise(F.char(group(k) + 63))
    return F.concat(char(0), *(F.when(group(k) > 0, char(k)).otherwise("") for k in range(1, 7)))


def encode_polylines(points: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by.., polyline string): the points (lat, lng) of each group in their order, as an encoded polyline.

    A group's text is put together in one row, so groups are lines of a bounded size, as a trip's.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    scaled = {f"_{c}": F.floor(F.col(c) * 1e5 + 0.5).cast("long") for c in ("lat", "lng")}
    step = lambda c: polyline_number(F.col(f"_{c}") - F.coalesce(F.lag(f"_{c}").over(w), F.lit(0)))
    coded = points.withColumns(scaled).withColumns({"_text": F.concat(step("lat"), step("lng")), "_place": F.row_number().over(w)})
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_place", "_text"))), lambda s: s["_text"]), "")
    return coded.groupBy(*by).agg(text.alias("polyline"))
