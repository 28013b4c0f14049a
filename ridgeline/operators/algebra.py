"""Route construction on arrays: sections, reversal, restart, stitching, privacy cut, polylines and share texts."""

from __future__ import annotations

import base64
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.operators.track import simplify

SHARE_LADDER = (5, 10, 20, 40, 80, 120, 250)
SHARE_CHARS = 7000


def reversed_line(geometry: Column) -> Column:
    return F.reverse(geometry)


def restarted(geometry: Column, at: Column) -> Column:
    """A loop rotated to start at point ``at`` (from 0); its closing point is not doubled."""
    n = F.size(geometry)
    return F.concat(F.slice(geometry, at + 1, n - at), F.slice(geometry, F.lit(2), at))


def stitched(*parts: Column) -> Column:
    """Lines one after the other, a point equal to the one before it left out."""
    joined = F.concat(*parts)
    before = F.concat(F.array(F.lit(None).cast("struct<lat:double,lon:double>")), F.slice(joined, F.lit(1), F.size(joined) - 1))
    return F.transform(F.filter(F.arrays_zip(joined.alias("p"), before.alias("q")), lambda z: ~z["p"].eqNullSafe(z["q"])), lambda z: z["p"])


def privacy_cut(geometry: Column, lat: float, lon: float, metres: float) -> Column:
    """Without the points at both ends within the distance of home; what passes near home in the middle stays. Null if nothing is left."""
    outside = F.transform(geometry, lambda p: geo.flat_metres(p["lat"], p["lon"], F.lit(lat), F.lit(lon)) > metres)
    first = F.array_position(outside, True)
    last = F.size(outside) - F.array_position(F.reverse(outside), True) + 1
    return F.when((first > 0) & (last - first >= 1), F.slice(geometry, first.cast("int"), (last - first + 1).cast("int")))


def section(lat: np.ndarray, lon: np.ndarray, begin: float, end: float) -> np.ndarray:
    """(n, 2) part between two planar distances, ends interpolated; reversed when begin > end."""
    if begin > end:
        return section(lat, lon, end, begin)[::-1]
    x, y = geo.laea_arrays(lat, lon)
    cum = np.r_[0.0, np.cumsum(np.hypot(np.diff(x), np.diff(y)))]
    inner = (cum > begin) & (cum < end)
    at = np.r_[begin, cum[inner], end]
    return np.column_stack([np.interp(at, cum, lat), np.interp(at, cum, lon)])


def shortest_order(ends: list[tuple[tuple[float, float], tuple[float, float]]], closed: bool = False) -> list[int]:
    """Order of up to eight parts with the least total gap; a closed ride keeps part 0 first; the first best wins."""
    if len(ends) > 8:
        raise ValueError("at most eight parts")
    gap = lambda a, b: float(np.hypot(ends[b][0][0] - ends[a][1][0], ends[b][0][1] - ends[a][1][1]))
    orders = itertools.permutations(range(len(ends))) if not closed else ((0, *p) for p in itertools.permutations(range(1, len(ends))))
    return list(min(orders, key=lambda o: sum(gap(a, b) for a, b in itertools.pairwise(o)) + (gap(o[-1], o[0]) if closed else 0)))


def encode_polyline(points: list[tuple[float, float, float | None]]) -> str:
    """Latitude, longitude (1e-5 degrees) and elevation (metres) as interleaved deltas in printable base-32 chunks."""
    out: list[str] = []
    last = [0, 0, 0]
    for lat, lon, ele in points:
        now = [int(np.floor(lat * 1e5 + 0.5)), int(np.floor(lon * 1e5 + 0.5)), last[2] if ele is None or ele != ele else int(np.floor(ele + 0.5))]
        for a, b in zip(now, last, strict=True):
            d = a - b
            v = ~(d << 1) if d < 0 else d << 1
            while v >= 32:
                out.append(chr((32 | v & 31) + 63))
                v >>= 5
            out.append(chr(v + 63))
        last = now
    return "".join(out)


def decode_polyline(text: str) -> list[tuple[float, float, int]]:
    values, shift, value = [], 0, 0
    for c in text:
        b = ord(c) - 63
        value |= (b & 31) << shift
        shift += 5
        if b < 32:
            values.append(~(value >> 1) if value & 1 else value >> 1)
            shift = value = 0
    if shift or len(values) % 3:
        raise ValueError("cut off polyline")
    sums = np.cumsum(np.array(values, dtype=np.int64).reshape(-1, 3), axis=0)
    return [(a / 1e5, o / 1e5, int(e)) for a, o, e in sums]


def pack_share(name: str, lat: np.ndarray, lon: np.ndarray) -> str | None:
    """URL-safe text of a route, simplified up a ladder of tolerances until it is short enough."""
    xy = np.column_stack(geo.laea_arrays(lat, lon))
    for tolerance in SHARE_LADDER:
        keep = simplify(xy, tolerance)
        body = json.dumps({"v": 1, "n": name, "p": encode_polyline([(a, o, None) for a, o in zip(lat[keep], lon[keep], strict=True)])}, ensure_ascii=False)
        squeeze = zlib.compressobj(9, zlib.DEFLATED, -15)
        text = base64.urlsafe_b64encode(squeeze.compress(body.encode()) + squeeze.flush()).decode().rstrip("=")
        if len(text) <= SHARE_CHARS:
            return text
    return None


def unpack_share(text: str) -> tuple[str, list[tuple[float, float, int]]]:
    doc = json.loads(zlib.decompress(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)), -15))
    if doc.get("v") != 1:
        raise ValueError("unknown version")
    return doc["n"], decode_polyline(doc["p"])


def share_texts(routes: DataFrame) -> DataFrame:
    """(id, share, chars): the share text of each route's line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [pack_share(n or "", np.asarray(a, float), np.asarray(o, float)) for n, a, o in zip(pdf["name"], pdf["lat"], pdf["lon"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "share": texts, "chars": [len(t or "") for t in texts]}).astype({"chars": "int32"})

    lines = routes.select("id", "name", F.col("geometry.lat").alias("lat"), F.col("geometry.lon").alias("lon"))
    return lines.mapInPandas(run, "id long, share string, chars int")
