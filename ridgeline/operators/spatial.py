"""Spatial joins keyed by grid cells: places along routes, nearest towns and stations, areas, duplicate places, route pairs.

A bounded distance join is an equi-join: one side lists the cell of each point, the other the cells within the bound, an exact
predicate follows. Catalyst has no spatial join; as an inequality join it would be a nested loop.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.operators.covering import covering_candidates
from ridgeline.operators.meeting import pairs_within
from ridgeline.operators.near_points import usable_position
from ridgeline.operators.track import metric_segments
from ridgeline.session import cut, shuffle_partitions


def metric_points(points: DataFrame, *keep: str) -> DataFrame:
    """Points with usable positions and their planar x, y (other columns as named)."""
    ok = points.where(usable_position(F.col("lat"), F.col("lon")))
    x, y = geo.laea(F.col("sb"), F.col("lon"))
    return ok.withColumn("sb", geo.sin_beta(F.col("lat"))).select(*keep, x.alias("px"), y.alias("py"))


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("int")


def covering(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(cell(low, size), cell(high, size)))


def segment_cells(segments: DataFrame, reach: float, size: float) -> DataFrame:
    """Segments once per cell that their box, widened by ``reach``, covers. Long segments are cut first, so that a box stays small."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("m") / (2 * size)).cast("int"))
    cut = segments.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a, b = F.col("part") / F.col("parts"), (F.col("part") + 1) / F.col("parts")
    at = lambda p, q, f: F.col(p) + f * (F.col(q) - F.col(p))
    ends = cut.select("*", at("x", "x2", a).alias("ax"), at("y", "y2", a).alias("ay"), at("x", "x2", b).alias("bx"), at("y", "y2", b).alias("by"))
    return (
        ends.withColumn("gx", covering(F.least("ax", "bx") - reach, F.greatest("ax", "bx") + reach, size))
        .withColumn("gy", covering(F.least("ay", "by") - reach, F.greatest("ay", "by") + reach, size))
        .drop("parts", "part", "ax", "ay", "bx", "by")
    )


#: Edge of the tiles in which lines and places meet, strips of a tile, places of a block of a tile, and at once: tests of a segment and a place, pairs of a line and a place.
ALONG_M, STRIP_M = 4000.0, 500.0
ALONG_PLACES, ALONG_TESTS, ALONG_PAIRS = 20_000, 100_000, 300_000
RUNS = "tile long, block int, line boolean, id long, distance_km double, total double, at array<int>, x array<double>, y array<double>, before array<double>"


def _tile_of(gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    return gx.astype(np.int64) * (1 << 20) + gy.astype(np.int64)


def _runs(metres: float, blocks: dict[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of each line within the distance of a tile, for each block of its places: points with their number and the metres before each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lat, lon = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("lat", "lon"))
        n = batch.column("lat").value_lengths().to_numpy(zero_copy_only=False)
        x, y = geo.laea_arrays(lat, lon)
        last = np.cumsum(n) - 1
        line = np.repeat(np.arange(len(n)), n)
        inner = np.ones(len(x), dtype=bool)
        inner[last] = False
        seg = np.flatnonzero(inner)
        dx, dy = x[seg + 1] - x[seg], y[seg + 1] - y[seg]
        m = np.zeros(len(x))
        m[seg + 1] = np.sqrt(dx * dx + dy * dy)
        before = np.concatenate([np.cumsum(m[low : high + 1]) for low, high in zip(last - n + 1, last, strict=True)])
        known = np.isfinite(dx) & np.isfinite(dy)
        seg, dx, dy = seg[known], dx[known], dy[known]
        if not len(seg):
            continue
        # long segments in parts, so that a box stays small
        parts = np.maximum(1, np.ceil(m[seg + 1] / ALONG_M)).astype(np.int64)
        owner = np.repeat(np.arange(len(seg)), parts)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        edges = []
        for v, d in ((x, dx), (y, dy)):
            one, two = v[seg][owner] + k / parts[owner] * d[owner], v[seg][owner] + (k + 1) / parts[owner] * d[owner]
            edges.append((np.floor((np.minimum(one, two) - metres - 1) / ALONG_M).astype(np.int64), np.floor((np.maximum(one, two) + metres + 1) / ALONG_M).astype(np.int64)))
        (x0, x1), (y0, y1) = edges
        wide, cells = x1 - x0 + 1, (x1 - x0 + 1) * (y1 - y0 + 1)
        again = np.repeat(np.arange(len(owner)), cells)
        k = np.arange(len(again)) - np.repeat(np.cumsum(cells) - cells, cells)
        tile, at = _tile_of(x0[again] + k % wide[again], y0[again] + k // wide[again]), seg[owner[again]]
        order = np.lexsort([at, tile, line[at]])
        tile, at = tile[order], at[order]
        own = line[at]
        same = (tile[1:] == tile[:-1]) & (own[1:] == own[:-1])
        once = np.r_[True, ~(same & (at[1:] == at[:-1]))]
        tile, at, own = tile[once], at[once], own[once]
        # both ends of each segment, once for each line and tile
        heads = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (own[1:] != own[:-1])])
        group = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(at)]))
        ends = np.unique(np.r_[group * len(x) + at, group * len(x) + at + 1])
        group, index = ends // len(x), ends % len(x)
        begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        tile, which = tile[heads], line[index[begin]]
        offsets = pa.array(np.r_[begin, len(index)].astype(np.int32))
        number = (index - (last - n + 1)[line[index]]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (number, x[index], y[index], before[index])]
        many = np.array([blocks.get(t, 1) for t in tile.tolist()], dtype=np.int64)
        row = np.repeat(np.arange(len(begin)), many)
        block = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)
        for low in range(0, len(row), 10_000):
            r = row[low : low + 10_000]
            take, of = pa.array(r), pa.array(which[r])
            yield pa.RecordBatch.from_arrays(
                [pa.array(tile[r]), pa.array(block[low : low + 10_000]), pa.array(np.ones(len(r), dtype=bool)), batch.column("id").take(of), batch.column("distance_km").take(of), pa.array(before[last][which[r]]), *(v.take(take) for v in lists)],
                names=[c.split()[0] for c in RUNS.split(", ")],
            )


class _Places:
    """The places of a block of a tile, by strip and y."""

    def __init__(self, tile: int, rows: pa.Table) -> None:
        x, y = (rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("px", "py"))
        tx = (tile + (1 << 19)) >> 20
        self.x0, self.y0 = tx * ALONG_M, (tile - tx * (1 << 20)) * ALONG_M
        key = self._key(self.strip(x), y)
        order = np.argsort(key, kind="stable")
        self.key, self.x, self.y, self.ids = key[order], x[order], y[order], rows.column("place_id").combine_chunks().take(pa.array(order))

    def strip(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - self.x0) / STRIP_M), 0, ALONG_M // STRIP_M - 1)

    def _key(self, strip: np.ndarray, y: np.ndarray) -> np.ndarray:
        return strip * (4 * ALONG_M) + np.clip(y - self.y0, -2.0, ALONG_M + 2)

    def near(self, x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray, metres: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, first, last): the places of each strip among which those within the distance of a segment are."""
        reach = metres + 1
        low, high = np.minimum(x, x + dx) - reach, np.maximum(x, x + dx) + reach
        s0 = self.strip(low).astype(np.int64)
        count = np.where((high < self.x0) | (low > self.x0 + ALONG_M), 0, self.strip(high).astype(np.int64) - s0 + 1)
        s = np.repeat(np.arange(len(x)), count)
        strip = np.arange(len(s)) + np.repeat(s0 - (np.cumsum(count) - count), count)
        edge, x, y, dx, dy = self.x0 + strip * STRIP_M, x[s], y[s], dx[s], dy[s]
        run = np.where(dx == 0, 1, dx)  # of a segment, the part whose x is within reach of the strip
        ends = [y + np.where(dx == 0, side, np.clip((edge + along - x) / run, 0, 1)) * dy for side, along in ((0, -reach), (1, STRIP_M + reach))]
        first = np.searchsorted(self.key, self._key(strip, np.minimum(*ends) - reach))
        last = np.searchsorted(self.key, self._key(strip, np.maximum(*ends) + reach), side="right")
        some = last > first
        return s[some], first[some], last[some]

    def along(self, metres: float, rows: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        """The nearest place of each line to each place, where it first is nearest."""
        column = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        number, x, y, before = (rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "x", "y", "before"))
        row = np.repeat(np.arange(rows.num_rows), rows.column("at").value_lengths().to_numpy(zero_copy_only=False))
        at = np.flatnonzero((row[1:] == row[:-1]) & (number[1:] == number[:-1] + 1))
        row, seq, before, x2, y2, x, y = row[at], number[at], before[at], x[at + 1], y[at + 1], x[at], y[at]
        dx, dy = x2 - x, y2 - y
        m = np.sqrt(dx * dx + dy * dy)
        square = np.where(m > 0, m * m, 1)
        s, first, last = self.near(x, y, dx, dy, metres)
        tests = np.cumsum(np.r_[0, last - first])
        ids, scaled, total, unknown = column("id"), column("distance_km").astype(float), column("total"), rows.column("distance_km").is_null().to_numpy(zero_copy_only=False)
        here, step = len(self.x), max(1, ALONG_PAIRS // len(self.x))
        for top in range(0, rows.num_rows, step):
            pairs = min(step, rows.num_rows - top) * here
            least, place_m, which = np.full(pairs, np.inf), np.empty(pairs), np.empty(pairs, dtype=np.int32)
            low, stop = np.searchsorted(row[s], [top, top + step])
            while low < stop:
                high = min(stop, max(low + 1, int(np.searchsorted(tests, tests[low] + ALONG_TESTS))))
                n = last[low:high] - first[low:high]
                f = np.repeat(s[low:high], n)
                p = np.arange(len(f)) + np.repeat(first[low:high] - (np.cumsum(n) - n), n)
                px, py, x1, y1, vx, vy = self.x[p], self.y[p], x[f], y[f], dx[f], dy[f]
                t = np.where(m[f] > 0, np.clip(((px - x1) * vx + (py - y1) * vy) / square[f], 0.0, 1.0), 0.0)
                d = np.sqrt((px - (x1 + t * vx)) ** 2 + (py - (y1 + t * vy)) ** 2)
                (hit,) = np.nonzero(d <= metres)
                f, d, t = f[hit], d[hit], t[hit]
                pair = (row[f] - top) * here + p[hit]
                old = least[pair]
                np.minimum.at(least, pair, d)
                better = np.flatnonzero((d == least[pair]) & (d < old))[::-1]  # of equals the first is written last
                place_m[pair[better]], which[pair[better]] = before[f[better]] + t[better] * m[f[better]], seq[f[better]]
                low = high
            (found,) = np.nonzero(least < np.inf)
            if not len(found):
                continue
            r, d = found // here + top, least[found]
            with np.errstate(divide="ignore", invalid="ignore"):
                km = np.floor(place_m[found] * scaled[r] / total[r] * 10 + 0.5) / 10
            columns = [pa.array(ids[r]), self.ids.take(pa.array(found % here)), pa.array(km, mask=unknown[r]), pa.array(np.floor(d + 0.5)), pa.array(d), pa.array(which[found])]
            yield dict(zip(("route_id", "place_id", "km", "off_m", "d", "seq"), columns, strict=True))


def _along(metres: float, several: bool, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile and block, places first; of these the ones with several positions or the others are held, lines pass by."""
    key, held, places = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "block", "line")]
        begins = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]).tolist()
        for low, high in zip(begins, [*begins[1:], batch.num_rows], strict=True):
            if (now := (int(keys[0][low]), int(keys[1][low]))) != key:
                key, held, places = now, [], None
            rows = batch.slice(low, high - low)
            if not keys[2][low]:
                rows = rows.select(["place_id", "px", "py", "several"])
                held.append(rows.filter(rows.column("several") if several else pa.array(~rows.column("several").to_numpy(zero_copy_only=False))))
                continue
            if held:
                of = pa.Table.from_batches(held)
                places, held = _Places(key[0], of) if of.num_rows else None, []
            if places:
                for found in places.along(metres, rows):
                    yield pa.RecordBatch.from_arrays([found[c] for c in names], names=names)


def places_along(routes: DataFrame, places: DataFrame, metres: float) -> DataFrame:
    """(route_id, place_id, km, off_m): places within the distance of a route, where it first is nearest; km scaled to the route's own distance.

    Lines are shuffled once, as their parts near each tile, and pass by the places of the tile; a place is in one tile, so what is found
    there is complete. Only places with several positions are brought together afterwards.
    """
    lines = routes.select("id", F.col("geometry.lat").alias("lat"), F.col("geometry.lon").alias("lon"), F.col("distance_km").cast("double").alias("distance_km"))
    points = metric_points(places.select(F.col("id").alias("place_id"), "lat", "lon").distinct(), "place_id")
    tile = (F.floor(F.col("px") / ALONG_M) * (1 << 20) + F.floor(F.col("py") / ALONG_M)).alias("tile")
    several = (F.col("place_id").isNull() | (F.count(F.lit(1)).over(W.partitionBy("place_id")) > 1)).alias("several")
    points = cut(points.select(tile, F.lit(False).alias("line"), "place_id", "px", "py", several))
    blocks = {r["tile"]: -(-r["n"] // ALONG_PLACES) for r in points.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ALONG_PLACES).collect()}  # only tiles of over ALONG_PLACES
    many = F.coalesce(F.create_map(*(F.lit(v) for pair in blocks.items() for v in pair))[F.col("tile")], F.lit(1)) if blocks else F.lit(1)
    points = points.withColumn("block", F.pmod(F.xxhash64("px", "py"), many).cast("int"))
    runs = lines.mapInArrow(lambda it: _runs(metres, blocks, it), RUNS)
    # a fixed number of partitions, of a few tiles each
    apart = runs.unionByName(points, allowMissingColumns=True).repartition(8 * shuffle_partitions(routes.sparkSession), "tile", "block").sortWithinPartitions("tile", "block", "line")
    kind = points.schema["place_id"].dataType.simpleString()
    kinds = {"route_id": "long", "place_id": kind, "km": "double", "off_m": "double", "d": "double", "seq": "int"}

    def near(some: bool, *names: str) -> DataFrame:
        return apart.mapInArrow(lambda it: _along(metres, some, list(names), it), ", ".join(f"{n} {kinds[n]}" for n in names))

    found = near(False, "route_id", "place_id", "km", "off_m")
    if points.where("several").isEmpty():
        return found
    best = F.min(F.struct("d", "seq", "km", "off_m")).alias("best")
    return found.unionByName(near(True, *kinds).groupBy("route_id", "place_id").agg(best).select("route_id", "place_id", "best.km", "best.off_m"))


def nearest(points: DataFrame, targets: DataFrame, metres: float) -> DataFrame:
    """(id, target_id, metres): the nearest target of each point within the bound; ties go to the least id."""
    size = metres
    a = metric_points(points.select("id", "lat", "lon"), "id").withColumn("gx", covering(F.col("px") - metres, F.col("px") + metres, size)).withColumn("gy", covering(F.col("py") - metres, F.col("py") + metres, size))
    b = metric_points(targets.select(F.col("id").alias("target_id"), "lat", "lon"), "target_id").select("target_id", F.col("px").alias("tx"), F.col("py").alias("ty"))
    b = b.withColumns({"gx": cell(F.col("tx"), size), "gy": cell(F.col("ty"), size)})
    d = F.hypot(F.col("tx") - F.col("px"), F.col("ty") - F.col("py"))
    best = a.join(b, ["gx", "gy"]).withColumn("d", d).where(F.col("d") <= metres).groupBy("id").agg(F.min(F.struct("d", "target_id")).alias("best"))
    return best.select("id", F.col("best.target_id").alias("target_id"), geo.js_round(F.col("best.d")).alias("metres"))


def duplicate_places(places: DataFrame, metres: float = 25.0) -> DataFrame:
    """(a_id, b_id): places of one trimmed lower-case name within the distance of each other.

    Joined on name and cell: places of one hot name only meet in their own surroundings.
    """
    key = F.lower(F.trim("name"))
    p = metric_points(places.where(F.col("name").isNotNull()).select("id", key.alias("key"), "lat", "lon").distinct(), "id", "key")
    size = 4 * metres
    a = p.withColumns({"gx": cell(F.col("px"), size), "gy": cell(F.col("py"), size)})
    b = p.select(F.col("id").alias("b_id"), "key", F.col("px").alias("qx"), F.col("py").alias("qy"))
    b = b.withColumn("gx", covering(F.col("qx") - metres, F.col("qx") + metres, size)).withColumn("gy", covering(F.col("qy") - metres, F.col("qy") + metres, size))
    near = F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py")) <= metres
    return a.join(b, ["key", "gx", "gy"]).where((F.col("id") < F.col("b_id")) & near).select(F.col("id").alias("a_id"), "b_id").distinct()


def not_mine(found: DataFrame, mine: DataFrame) -> DataFrame:
    """Found places that are not kept yet: other id, no kept one of the same name within 25 m or of the same category within 10 m."""

    def near(left: DataFrame, key: str, metres: float) -> DataFrame:
        size = 4 * metres
        a = metric_points(left.where(F.col(key).isNotNull()).select("osm_id", F.lower(F.trim(key)).alias("key"), "lat", "lon"), "osm_id", "key")
        a = a.withColumns({"gx": cell(F.col("px"), size), "gy": cell(F.col("py"), size)})
        b = metric_points(mine.where(F.col(key).isNotNull()).select(F.lower(F.trim(key)).alias("key"), "lat", "lon"), "key").select("key", F.col("px").alias("qx"), F.col("py").alias("qy"))
        b = b.withColumn("gx", covering(F.col("qx") - metres, F.col("qx") + metres, size)).withColumn("gy", covering(F.col("qy") - metres, F.col("qy") + metres, size))
        return a.join(b, ["key", "gx", "gy"]).where(F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py")) <= metres).select("osm_id").distinct()

    out = found.join(mine.where(F.col("osm_id").isNotNull()).select("osm_id").distinct(), "osm_id", "left_anti")
    return out.join(near(out, "name", 25.0).unionByName(near(out, "category", 10.0)).distinct(), "osm_id", "left_anti")


def starts_in_areas(routes: DataFrame, areas: DataFrame) -> DataFrame:
    """(id, area_id): routes whose start lies in an area; one-degree cells of the area's box key the join."""
    box = areas.select("area_id", "polygon", F.array_min("polygon.lat").alias("s"), F.array_max("polygon.lat").alias("n"), F.array_min("polygon.lon").alias("w"), F.array_max("polygon.lon").alias("e"))
    cells = box.withColumn("gx", covering(F.col("w"), F.col("e"), 1.0)).withColumn("gy", covering(F.col("s"), F.col("n"), 1.0))
    starts = routes.where(usable_position(F.col("start_lat"), F.col("start_lon"))).select("id", "start_lat", "start_lon", cell(F.col("start_lon"), 1.0).alias("gx"), cell(F.col("start_lat"), 1.0).alias("gy"))
    inside = geo.point_in_polygon(F.col("start_lat"), F.col("start_lon"), F.col("polygon"))
    return starts.join(cells, ["gx", "gy"]).where(inside).select("id", "area_id")


def places_near_leg(places: DataFrame, a: tuple[float, float], b: tuple[float, float], detour_m: float | None = None) -> DataFrame:
    """(id, detour_km) of places that a leg between two positions can pass with a small detour; a stated leg, so a filter."""
    (ax, bx), (ay, by) = geo.laea_arrays(np.array([a[0], b[0]]), np.array([a[1], b[1]]))
    direct = float(np.hypot(bx - ax, by - ay))
    most = detour_m if detour_m is not None else max(2000.0, direct / 2)
    d = F.hypot(F.col("px") - float(ax), F.col("py") - float(ay)) + F.hypot(F.col("px") - float(bx), F.col("py") - float(by)) - direct
    return metric_points(places, "id").withColumn("d", d).where(F.col("d") <= most).select("id", geo.js_round(F.col("d") / 100) .alias("detour_km")).withColumn("detour_km", F.col("detour_km") / 10)


# ---------------------------------------------------------------- pairs of routes


def _within(a: np.ndarray, b: np.ndarray, tol: float) -> float:
    """Length of a within ``tol`` of b: the union, per segment of a, of its stretches inside the discs and strips around b."""
    step = max(1, 200_000 // len(b))
    return sum(_within_part(a[low : low + step + 1], b, tol) for low in range(0, len(a) - 1, step))


def _within_part(a: np.ndarray, b: np.ndarray, tol: float) -> float:
    p, v = a[:-1, None, :], np.diff(a, axis=0)[:, None, :]
    m2 = np.maximum((v**2).sum(axis=2), 1e-18)
    # discs around the points of b: roots of |p + t v - c| = tol
    w = p - b[None]
    half, c = (w * v).sum(axis=2) / m2, ((w**2).sum(axis=2) - tol * tol) / m2
    root = np.sqrt(np.maximum(half * half - c, 0))
    some = half * half >= c
    low, high = np.where(some, -half - root, 0), np.where(some, -half + root, 0)
    # strips along the segments of b: two slabs
    q, d = b[:-1], np.diff(b, axis=0)
    length = np.hypot(d[:, 0], d[:, 1])
    u = d / np.where(length > 0, length, 1)[:, None]
    o = p - q[None]
    t0, t1 = np.full(o.shape[:2], -np.inf), np.full(o.shape[:2], np.inf)
    along = (o[..., 0] * u[:, 0] + o[..., 1] * u[:, 1], v[..., 0] * u[:, 0] + v[..., 1] * u[:, 1], 0.0, length)
    across = (o[..., 1] * u[:, 0] - o[..., 0] * u[:, 1], v[..., 1] * u[:, 0] - v[..., 0] * u[:, 1], -tol, tol)
    for start, speed, lo, hi in (along, across):
        still = np.abs(speed) < 1e-12
        with np.errstate(divide="ignore", invalid="ignore"):
            x, y = (lo - start) / speed, (hi - start) / speed
        inside = (start >= lo) & (start <= hi)
        t0 = np.maximum(t0, np.where(still, np.where(inside, -np.inf, np.inf), np.minimum(x, y)))
        t1 = np.minimum(t1, np.where(still, np.where(inside, np.inf, -np.inf), np.maximum(x, y)))
    real = (t0 < t1) & (length > 0)
    begin = np.clip(np.concatenate([low, np.where(real, t0, 0)], axis=1), 0, 1)
    end = np.clip(np.concatenate([high, np.where(real, t1, 0)], axis=1), 0, 1)
    order = np.argsort(begin, axis=1)
    begin, end = np.take_along_axis(begin, order, 1), np.maximum.accumulate(np.take_along_axis(end, order, 1), axis=1)
    gaps = np.maximum(0, begin[:, 1:] - end[:, :-1]).sum(axis=1)
    return float(((end[:, -1] - begin[:, 0] - gaps) * np.sqrt((v[:, 0] ** 2).sum(axis=1))).sum())


def _closest(a: np.ndarray, b: np.ndarray) -> float:
    """Least distance of two lines; 0 where they cross."""
    best = np.inf
    for one, other in ((a, b), (b, a)):
        q, d = other[:-1], np.diff(other, axis=0)
        w = one[:, None, :] - q
        square = (d**2).sum(axis=1)
        t = np.clip((w * d).sum(axis=2) / np.where(square > 0, square, 1), 0, 1)
        best = min(best, float(np.sqrt(((w - t[:, :, None] * d) ** 2).sum(axis=2)).min()))
    side = lambda o, d, p: d[..., 0] * (p[..., 1] - o[..., 1]) - d[..., 1] * (p[..., 0] - o[..., 0])
    p, q = a[:-1][:, None], b[:-1][None]
    dp, dq = np.diff(a, axis=0)[:, None], np.diff(b, axis=0)[None]
    cross = (side(p, dp, q) * side(p, dp, q + dq) < 0) & (side(q, dq, p) * side(q, dq, p + dp) < 0)
    return 0.0 if cross.any() else best


def reversed_direction(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether b runs the opposite way along a: 19 places of a on b mostly come later backwards; jumps of half of b are left out."""
    cum = np.r_[0.0, np.cumsum(np.hypot(*np.diff(a, axis=0).T))]
    along = np.r_[0.0, np.cumsum(np.hypot(*np.diff(b, axis=0).T))]
    t = (0.05 + 0.9 * np.arange(19) / 18) * cum[-1]
    p = np.column_stack([np.interp(t, cum, a[:, 0]), np.interp(t, cum, a[:, 1])])
    q, d = b[:-1], np.diff(b, axis=0)
    square = (d**2).sum(axis=1)
    w = p[:, None, :] - q
    f = np.clip((w * d).sum(axis=2) / np.where(square > 0, square, 1), 0, 1)
    k = ((w - f[:, :, None] * d) ** 2).sum(axis=2).argmin(axis=1)
    at = along[k] + f[np.arange(19), k] * np.sqrt(square[k])
    step = np.diff(at)
    step = step[np.abs(step) < 0.5 * along[-1]]
    return bool((step < 0).sum() > (step > 0).sum())


def _metric(lat, lon) -> np.ndarray:
    return np.column_stack(geo.laea_arrays(np.asarray(lat, float), np.asarray(lon, float)))


PAIR = "a_id long, b_id long, min_distance_m double, a_shared_km double, b_shared_km double, a_shared_pct double, b_shared_pct double, reversed boolean"


def _judge_pairs(metres: float, batches: Iterator[pd.DataFrame], share: float | None = None) -> Iterator[pd.DataFrame]:
    """Pairs within the distance; with a share, only those of which one line may be covered for it."""
    half_up = lambda v, d: np.floor(v * 10**d + 0.5) / 10**d
    tol = max(metres, 0.5)
    for pdf in batches:
        rows = []
        for i, j, ala, alo, bla, blo in zip(*(pdf[c] for c in ("a_id", "b_id", "a_lat", "a_lon", "b_lat", "b_lon")), strict=True):
            a, b = _metric(ala, alo), _metric(bla, blo)
            if share and not (_may_cover(a, b, tol, share) or _may_cover(b, a, tol, share)):
                continue
            d = _closest(a, b)
            if d > metres:
                continue
            la, lb = (float(np.hypot(*np.diff(x, axis=0).T).sum()) for x in (a, b))
            sa, sb = _within(a, b, tol), _within(b, a, tol)
            rows.append((i, j, half_up(d, 1), half_up(sa / 1000, 2), half_up(sb / 1000, 2), half_up(100 * sa / la, 1) if la else 0.0, half_up(100 * sb / lb, 1) if lb else 0.0, reversed_direction(a, b)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAIR.split(", ")]).astype({"a_id": "int64", "b_id": "int64", "reversed": "bool"})


def proximity_pairs(routes: DataFrame, metres: float) -> DataFrame:
    """Pairs of routes that come within the distance of each other, with shared lengths both ways.

    Lines go to the tiles that they pass; a pair is judged where it is closest, and no pair is shuffled.
    """
    return pairs_within(_lat_lon(routes), metres, PAIR)


def similar_to(probe: tuple[list[float], list[float]], routes: DataFrame, metres: float = 50.0, overlap: float = 0.85) -> DataFrame:
    """(other_id, a_in_b, b_in_a, very_similar): routes of which, or by which, the probe line is covered for the share."""
    line = _metric(*probe)
    low, high = np.min(probe, axis=1), np.max(probe, axis=1)
    pad = metres / 111_000
    near = (F.col("max_lat") >= float(low[0] - pad)) & (F.col("min_lat") <= float(high[0] + pad)) & (F.col("max_lon") >= float(low[1] - 2 * pad)) & (F.col("min_lon") <= float(high[1] + 2 * pad))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length = float(np.hypot(*np.diff(line, axis=0).T).sum())
        for pdf in batches:
            rows = []
            for i, la, lo in zip(pdf["id"], pdf["lat"], pdf["lon"], strict=True):
                other = _metric(la, lo)
                n = float(np.hypot(*np.diff(other, axis=0).T).sum())
                if not n:
                    continue
                x, y = round(_within(line, other, metres) / length, 3), round(_within(other, line, metres) / n, 3)
                if max(x, y) >= overlap:
                    rows.append((i, x, y, min(x, y) >= overlap))
            yield pd.DataFrame(rows, columns=["other_id", "a_in_b", "b_in_a", "very_similar"]).astype({"other_id": "int64", "a_in_b": "float64", "b_in_a": "float64", "very_similar": "bool"})

    lines = routes.where(near & (F.size("geometry") >= 2)).select("id", F.col("geometry.lat").alias("lat"), F.col("geometry.lon").alias("lon"))
    return lines.mapInPandas(judge, "other_id long, a_in_b double, b_in_a double, very_similar boolean")


PROBED = "probe_id long, other_id long, a_in_b double, b_in_a double, very_similar boolean"
PIECE_M = 100.0
SIMILAR_CELL_M = 1000.0
#: Cells across a tile: the cells of a line in a tile are one 64-bit mask.
TILE_CELLS = 8
SIMILAR_WORDS = 8
SIMILAR_BITS = 64 * SIMILAR_WORDS
#: Counts of cells by their hash; they only order the cells of a line.
CELL_COUNTS = 1 << 16
#: Least metres that a flagged bit holds, of which the one that rules out most is taken.
HELD_M = (2000.0, 1000.0, 700.0, 500.0, 300.0, 100.0)
#: Pieces of a line that are looked at before its shared length is worked out.
LOOKED_AT = 160
_SIGNED = tuple(f"w{w}" for w in range(SIMILAR_WORDS))
COVERING = "tile long, id long, mask long, " + ", ".join(f"{w} long" for w in _SIGNED)
COVERED = "tile long, id long, mask long, off int, " + ", ".join(f"{w} long" for w in _SIGNED)


def _around(xy: np.ndarray, reach: float) -> np.ndarray:
    """Cells of the corners of the boxes around places, (places, 4); no more cells meet a box smaller than a cell."""
    corners = xy[:, None, :] + reach * np.array([(-1, -1), (-1, 1), (1, -1), (1, 1)])
    at = np.floor(corners / SIMILAR_CELL_M).astype(np.int64)
    return (at[..., 0] + (1 << 19)) * (1 << 20) + at[..., 1] + (1 << 19)


def _hashed(cells: np.ndarray, values: int) -> np.ndarray:
    return ((cells.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - values.bit_length() + 1)).astype(np.int64)


def _tile_masks(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tiles, masks): distinct cells by tile."""
    x, y = cells >> 20, cells & ((1 << 20) - 1)
    tile = (x // TILE_CELLS) * (1 << 20) + y // TILE_CELLS
    tiles, number = np.unique(tile, return_inverse=True)
    masks = np.zeros(len(tiles), dtype=np.uint64)
    np.bitwise_or.at(masks, number, np.uint64(1) << (x % TILE_CELLS * TILE_CELLS + y % TILE_CELLS).astype(np.uint64))
    return tiles, masks.view(np.int64)


def _pieces(lat, lon) -> tuple[np.ndarray, float]:
    """Middles of equal pieces of at most PIECE_M, and the length of a piece."""
    line = _metric(lat, lon)
    s = np.r_[0.0, np.cumsum(np.hypot(*np.diff(line, axis=0).T))]
    n = max(1, math.ceil(s[-1] / PIECE_M))
    t = (np.arange(n) + 0.5) * s[-1] / n
    return np.column_stack([np.interp(t, s, line[:, 0]), np.interp(t, s, line[:, 1])]), float(s[-1] / n)


def _cell_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(CELL_COUNTS, dtype=np.int64)
    for pdf in batches:
        for la, lo in zip(pdf["lat"], pdf["lon"], strict=True):
            total += np.bincount(_hashed(np.unique(_around(_pieces(la, lo)[0], PIECE_M / 2)), CELL_COUNTS), minlength=CELL_COUNTS)
    (some,) = np.nonzero(total)
    yield pd.DataFrame({"bucket": some.astype(np.int32), "n": total[some]})


def _tile_rows(parts: list[tuple]) -> dict[str, np.ndarray]:
    """Columns of (id, tiles, masks, flags) by line: one row a tile, each with all flags of the line."""
    words = np.array([np.packbits(flags, bitorder="little").view(np.int64) for _, _, _, flags in parts])
    n = [len(tiles) for _, tiles, _, _ in parts]
    columns = {"tile": np.concatenate([t for _, t, _, _ in parts]), "id": np.repeat([i for i, _, _, _ in parts], n), "mask": np.concatenate([m for _, _, m, _ in parts])}
    return columns | {w: np.repeat(words[:, k], n) for k, w in enumerate(_SIGNED)}


def _covering(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every cell that a line touches, by tile, with a bitmap of them all."""
    for pdf in batches:
        parts = []
        for i, la, lo in zip(pdf["id"], pdf["lat"], pdf["lon"], strict=True):
            own = np.unique(_around(_pieces(la, lo)[0], PIECE_M / 2))
            flags = np.zeros(SIMILAR_BITS, dtype=bool)
            flags[_hashed(own, SIMILAR_BITS)] = True
            parts.append((i, *_tile_masks(own), flags))
        if parts:
            yield pd.DataFrame(_tile_rows(parts))


def _covered(often: np.ndarray, metres: float, share: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cells about the pieces in the least used places that make up more of a line than may be off, by tile, and a bitmap of where it is long.

    A line that is covered for the share has a piece of these within the distance of the other, which then touches one of the cells.
    """
    for pdf in batches:
        parts, offs = [], []
        for i, la, lo in zip(pdf["id"], pdf["lat"], pdf["lon"], strict=True):
            xy, piece = _pieces(la, lo)
            near = _around(xy, PIECE_M / 2 + metres)
            used = often[_hashed(near, CELL_COUNTS)].max(axis=1)
            may = math.floor((1 - share) * len(xy) + 1e-9)
            rare = np.unique(near[np.argsort(used, kind="stable")[: may + 1]])
            # a piece counts for a bit where its box lies in one cell only
            inner = near[(near == near[:, :1]).all(axis=1), 0]
            held = np.bincount(_hashed(inner, SIMILAR_BITS), minlength=SIMILAR_BITS) * piece
            off = (1 - share) * piece * len(xy) + 1e-6
            least = max(HELD_M, key=lambda m: m * (held >= m).sum() - m * (off // m))
            parts.append((i, *_tile_masks(rare), held >= least))
            offs += [int(off // least)] * len(parts[-1][1])
        if parts:
            rows = _tile_rows(parts)
            yield pd.DataFrame({"tile": rows.pop("tile"), "id": rows.pop("id"), "mask": rows.pop("mask"), "off": np.array(offs, dtype=np.int32)} | rows)


def _cover_pairs(covered: pd.DataFrame, covering: pd.DataFrame) -> pd.DataFrame:
    """Pairs that share a cell of a tile and whose bitmaps leave the share possible."""
    covered, covering = (df.sort_values("tile", kind="stable", ignore_index=True) for df in (covered, covering))
    ids, by = covered["id"].to_numpy(), covering["id"].to_numpy()
    mask, touched = covered["mask"].to_numpy(), covering["mask"].to_numpy()
    held, reach = ([df[w].to_numpy().view(np.uint64) for w in _SIGNED] for df in (covered, covering))
    off = covered["off"].to_numpy()
    tiles, first, count = np.unique(covered["tile"].to_numpy(), return_index=True, return_counts=True)
    begin, end = (np.searchsorted(covering["tile"].to_numpy(), tiles, side=side) for side in ("left", "right"))
    found = [np.empty((0, 2), dtype=np.int64)]
    for n in np.flatnonzero(end > begin):
        stop, step = first[n] + count[n], max(1, 1_000_000 // (end[n] - begin[n]))
        for low in range(first[n], stop, step):
            i, j = np.nonzero(mask[low : min(low + step, stop), None] & touched[begin[n] : end[n]])
            i, j = i + low, j + begin[n]
            apart = np.zeros(len(i), dtype=np.int16)
            for h, s in zip(held, reach, strict=True):
                apart += np.bitwise_count(h[i] & ~s[j])
                near = apart <= off[i]
                i, j, apart = i[near], j[near], apart[near]
            found.append(np.column_stack([ids[i], by[j]])[ids[i] != by[j]])
    pairs = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame({"covered": pairs[:, 0], "covering": pairs[:, 1]})


def _may_cover(a: np.ndarray, b: np.ndarray, metres: float, share: float) -> bool:
    """False only where pieces of a that b cannot reach make up more than may be off."""
    s = np.r_[0.0, np.cumsum(np.hypot(*np.diff(a, axis=0).T))]
    n = min(LOOKED_AT, 400_000 // len(b))
    if n < 8 or not s[-1]:
        return True
    t = (np.arange(n) + 0.5) * s[-1] / n
    p = np.column_stack([np.interp(t, s, a[:, 0]), np.interp(t, s, a[:, 1])])
    q, d = b[:-1], np.diff(b, axis=0)
    square = d[:, 0] ** 2 + d[:, 1] ** 2
    x, y = p[:, :1] - q[:, 0], p[:, 1:] - q[:, 1]
    f = np.clip((x * d[:, 0] + y * d[:, 1]) / np.where(square > 0, square, 1), 0, 1)
    far = (((x - f * d[:, 0]) ** 2 + (y - f * d[:, 1]) ** 2) > (metres + s[-1] / n / 2 + 1e-3) ** 2).all(axis=1)
    return int(far.sum()) <= (1 - share) * n + 1e-6


def _judge_probes(metres: float, overlap: float, share: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, j, ala, alo, bla, blo in zip(*(pdf[c] for c in ("a_id", "b_id", "a_lat", "a_lon", "b_lat", "b_lon")), strict=True):
            a, b = _metric(ala, alo), _metric(bla, blo)
            if not (_may_cover(a, b, metres, share) or _may_cover(b, a, metres, share)):
                continue
            x, y = (round(_within(p, q, metres) / n, 3) if (n := float(np.hypot(*np.diff(p, axis=0).T).sum())) else 0.0 for p, q in ((a, b), (b, a)))
            if max(x, y) >= overlap:
                rows.append((i, j, x, y, min(x, y) >= overlap))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PROBED.split(", ")]).astype({"probe_id": "int64", "other_id": "int64", "a_in_b": "float64", "b_in_a": "float64", "very_similar": "bool"})


def _lat_lon(lines: DataFrame) -> DataFrame:
    return lines.select("id", F.col("geometry.lat").alias("lat"), F.col("geometry.lon").alias("lon"))


def _moving(lines: DataFrame) -> DataFrame:
    return lines.where(F.exists("lat", lambda v: v != F.col("lat")[0]) | F.exists("lon", lambda v: v != F.col("lon")[0]))


def _counts_of(lines: DataFrame):
    """Broadcast counts of the cells that all lines touch."""
    often = np.zeros(CELL_COUNTS, dtype=np.int64)
    for r in lines.mapInPandas(_cell_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most CELL_COUNTS rows
        often[r["bucket"]] = r["n"]
    return lines.sparkSession.sparkContext.broadcast(often)


def cover_candidates(lines: DataFrame, by: DataFrame, often, metres: float, share: float) -> DataFrame:
    """(covered, covering), not distinct: no pair of a moving line and one of ``by`` that covers it for the share is left out.

    The rare part of the line to be covered meets all cells of the other in the tiles of both; a bitmap bounds the covered length.
    """
    rare, cells = lines.mapInPandas(lambda it: _covered(often.value, metres, share, it), COVERED), by.mapInPandas(_covering, COVERING)
    part = F.pmod(F.xxhash64("tile"), F.lit(8 * shuffle_partitions(lines.sparkSession))).alias("part")  # a group of its own for each tile is dear where tiles are near empty
    return rare.groupBy(part).cogroup(cells.groupBy(part)).applyInPandas(_cover_pairs, "covered long, covering long")


def _with_lines(candidates: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidates (a_id, b_id) with both lines; few and dear, so in a fixed number of partitions, which AQE does not coalesce by their bytes."""
    a, b = (df.select(F.col("id").alias(f"{k}_id"), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon")) for df, k in ((left, "a"), (right, "b")))
    joined = candidates.join(a, "a_id").join(b, "b_id").select("a_id", "b_id", "a_lat", "a_lon", "b_lat", "b_lon")
    return joined.repartition(4 * shuffle_partitions(candidates.sparkSession), "a_id", "b_id")


def similar_to_each(probes: DataFrame, routes: DataFrame, metres: float = 50.0, overlap: float = 0.85) -> DataFrame:
    """(probe_id, other_id, a_in_b, b_in_a, very_similar): ``similar_to`` for every row of ``probes`` against all other ``routes``.

    Both are (id, geometry) of usable lines. Candidates of each direction come from ``cover_candidates``; the exact geometry decides.
    """
    share = overlap - 0.0006  # shares are rounded to three digits before they are held against the overlap
    some, all_lines = (cut(_moving(_lat_lon(df))) for df in (probes, routes))
    often = _counts_of(all_lines)
    one = cover_candidates(some, all_lines, often, metres, share).select(F.col("covered").alias("a_id"), F.col("covering").alias("b_id"))
    two = cover_candidates(all_lines, some, often, metres, share).select(F.col("covering").alias("a_id"), F.col("covered").alias("b_id"))
    return _with_lines(one.unionByName(two).distinct(), some, all_lines).mapInPandas(lambda it: _judge_probes(metres, overlap, share, it), PROBED)


def duplicate_pairs(routes: DataFrame, metres: float, pct: float) -> DataFrame:
    """``proximity_pairs`` of which one route is shared for the percentage, without the pairs that merely meet."""
    share = pct / 100 - 0.0006  # percentages are rounded to one digit before they are held against the bound
    lines = cut(_lat_lon(routes))
    found = covering_candidates(lines, max(metres, 0.5), share)
    pairs = found.select(F.least("covered", "covering").alias("a_id"), F.greatest("covered", "covering").alias("b_id")).distinct()
    return _with_lines(pairs, lines, lines).mapInPandas(lambda it: _judge_pairs(metres, it, share), PAIR).where(F.greatest("a_shared_pct", "b_shared_pct") >= pct)
