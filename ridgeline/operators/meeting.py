"""Pairs of lines that come within a distance of each other, found and judged where both lines are.

Every line goes whole to the tiles that it passes. A pair is judged in one tile only, that of the place where it is closest, so neither
candidates nor pairs are shuffled. A tile of many points is parted into pairs of blocks. The geometry is that of ``spatial._closest``,
``spatial._within`` and ``spatial.reversed_direction``, for the segments of many pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.session import cut, shuffle_partitions

#: Cells across a tile, and room for rounding at the borders of cells.
TILE_CELLS = 64
ROOM_M = 0.5
#: Points of a block of the lines of a tile.
BLOCK_POINTS = 500_000
#: Marks of candidates, tests of boxes, pairs of segments and distances of places that are held at once.
MARKS, TESTS, SEGMENTS, PLACES = 32_000_000, 200_000, 50_000, 50_000
SENT = "tile long, i int, j int, other boolean, id long, x array<double>, y array<double>"
_PAIR = ("a_id", "b_id", "min_distance_m", "a_shared_km", "b_shared_km", "a_shared_pct", "b_shared_pct", "reversed")


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, index): the indices first, first + 1, ... of each range, one range after the other."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) + np.repeat(first - (np.cumsum(count) - count), count)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


def _box_cells(begin: list[np.ndarray], end: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, x, y): the cells of each box of cells, both ends included."""
    wide, high = (np.maximum(0, e - b + 1) for b, e in zip(begin, end, strict=True))
    which, k = _ranges(np.zeros(len(wide), dtype=np.int64), wide * high)
    return which, begin[0][which] + k % wide[which], begin[1][which] + k // wide[which]


def _floor(v: np.ndarray, size: float) -> np.ndarray:
    return np.floor(v / size).astype(np.int64)


def _tile_at(x: np.ndarray, y: np.ndarray, edge: float) -> np.ndarray:
    return _floor(x, edge) * (1 << 20) + _floor(y, edge)


class Lines:
    """Points and segments of lines, in order of their ids."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        _, at = _ranges((np.cumsum(points) - points)[order], points[order])
        self.ids, points, self.x, self.y = ids[order], points[order], x[at], y[at]
        self.point, self.count = np.cumsum(points) - points, points - 1
        self.first = np.cumsum(self.count) - self.count
        self.line = np.repeat(np.arange(len(points)), self.count)
        at = np.arange(len(self.line)) + self.line
        self.x0, self.y0, self.x1, self.y1 = self.x[at], self.y[at], self.x[at + 1], self.y[at + 1]
        self.dx, self.dy = self.x1 - self.x0, self.y1 - self.y0
        self.square, self.m = self.dx**2 + self.dy**2, np.hypot(self.dx, self.dy)
        self.box = np.minimum(self.x0, self.x1), np.maximum(self.x0, self.x1), np.minimum(self.y0, self.y1), np.maximum(self.y0, self.y1)
        self.around = [f.reduceat(v, self.first) for f, v in zip((np.fmin, np.fmax) * 2, self.box, strict=True)]
        #: metres before a segment, and the length of a line
        self.before, self.length = np.zeros(len(self.m)), np.zeros(len(points))
        for i, (low, n) in enumerate(zip(self.first.tolist(), self.count.tolist(), strict=True)):
            along = np.cumsum(self.m[low : low + n])
            self.before[low + 1 : low + n], self.length[i] = along[:-1], along[-1]

    def cells(self, tile: int, reach: float, size: float) -> tuple[np.ndarray, np.ndarray]:
        """(cell, line) by cell and line: the cells of a tile within reach of a line."""
        tx = (tile + (1 << 19)) >> 20
        corner = np.array([tx, tile - tx * (1 << 20)]) * TILE_CELLS
        low, high = np.zeros(len(self.m)), np.ones(len(self.m))
        axes = (self.x0, self.dx, corner[0]), (self.y0, self.dy, corner[1])
        for start, d, c in axes:  # the stretch of a segment near the tile
            one, two = c * size - 2 * reach - start, (c + TILE_CELLS) * size + 2 * reach - start
            with np.errstate(divide="ignore", invalid="ignore"):
                enter, leave = np.minimum(one / d, two / d), np.maximum(one / d, two / d)
            still = d == 0
            low = np.maximum(low, np.where(still, np.where((one <= 0) & (two >= 0), 0, 2), enter))
            high = np.minimum(high, np.where(still, 1, leave))
        (s,) = np.nonzero((low <= high) & np.isfinite(self.m))
        low, wide = low[s], (high - low)[s]
        parts = np.maximum(1, np.ceil(wide * self.m[s] / size)).astype(np.int64)
        which, k = _ranges(np.zeros(len(s), dtype=np.int64), parts)
        begin, end = [], []
        for start, d, c in axes:
            one, two = (start[s][which] + (low[which] + (k + e) / parts[which] * wide[which]) * d[s][which] for e in (0, 1))
            begin.append(np.maximum(c, _floor(np.minimum(one, two) - reach, size)) - c)
            end.append(np.minimum(c + TILE_CELLS - 1, _floor(np.maximum(one, two) + reach, size)) - c)
        again, x, y = _box_cells(begin, end)
        key = np.unique((x * TILE_CELLS + y) * len(self.ids) + self.line[s[which[again]]])
        return key // len(self.ids), key % len(self.ids)


def _candidates(first: Lines, second: Lines, tile: int, reach: float, size: float) -> Iterator[tuple[int, np.ndarray]]:
    """(line of first, lines of second of a greater id) that share a cell of the tile."""
    ca, la = first.cells(tile, reach, size)
    cb, lb = (ca, la) if second is first else second.cells(tile, reach, size)
    both, often = np.unique(ca, return_counts=True)
    both = both[often > 1] if second is first else np.intersect1d(both, cb)
    a0, a1, b0, b1 = (np.searchsorted(c, both, side=side).tolist() for c in (ca, cb) for side in ("left", "right"))
    later = np.searchsorted(second.ids, first.ids, side="right")
    step = max(1, MARKS // len(second.ids))
    for low in range(0, len(first.ids), step):
        marks = np.zeros((min(step, len(first.ids) - low), len(second.ids)), dtype=bool)
        for p, q, r, s in zip(a0, a1, b0, b1, strict=True):
            rows = la[p:q] - low
            marks[rows[(rows >= 0) & (rows < len(marks))][:, None], lb[r:s]] = True
        for row in np.flatnonzero(marks.any(axis=1)).tolist():
            a = low + row
            found = np.flatnonzero(marks[row, later[a] :]) + later[a]
            if len(found):
                yield a, found


def _near_segments(first: Lines, second: Lines, a: int, others: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Segments (of a line, of others) whose boxes are within reach; by other line, its segment and that of the line."""
    x0, x1, y0, y1 = (v[a] + side for v, side in zip(first.around, (-reach, reach) * 2, strict=True))
    low_x, high_x, low_y, high_y = second.around
    others = others[(low_x[others] <= x1) & (high_x[others] >= x0) & (low_y[others] <= y1) & (high_y[others] >= y0)]
    _, j = _ranges(second.first[others], second.count[others])
    low_x, high_x, low_y, high_y = (v[j] for v in second.box)
    (some,) = np.nonzero((low_x <= x1) & (high_x >= x0) & (low_y <= y1) & (high_y >= y0))
    own = slice(first.first[a], first.first[a] + first.count[a])
    x0, x1, y0, y1 = (v[own] + side for v, side in zip(first.box, (-reach, reach) * 2, strict=True))
    step = max(1, TESTS // len(x0))
    for k in range(0, len(some), step):
        at = some[k : k + step]
        n, f = np.nonzero((low_x[at, None] <= x1) & (high_x[at, None] >= x0) & (low_y[at, None] <= y1) & (high_y[at, None] >= y0))
        yield first.first[a] + f, j[at[n]]


def _foot(px, py, qx, qy, dx, dy, square) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(square of the distance, x, y of the way there) from places to segments."""
    wx, wy = px - qx, py - qy
    t = np.clip((wx * dx + wy * dy) / np.where(square > 0, square, 1), 0, 1)
    wx, wy = wx - t * dx, wy - t * dy
    return wx**2 + wy**2, wx, wy


def _spans(one: Lines, f: np.ndarray, other: Lines, s: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of each segment f, as shares of it, within tol of segment s: of two discs and a strip, which together are convex."""
    px, py, vx, vy = one.x0[f], one.y0[f], one.dx[f], one.dy[f]
    m2 = np.maximum(one.square[f], 1e-18)
    begin, end = np.full(len(f), np.inf), np.full(len(f), -np.inf)
    for cx, cy in ((other.x0[s], other.y0[s]), (other.x1[s], other.y1[s])):
        wx, wy = px - cx, py - cy
        half, c = (wx * vx + wy * vy) / m2, (wx**2 + wy**2 - tol * tol) / m2
        root = np.sqrt(np.maximum(half * half - c, 0))
        some = half * half >= c
        begin, end = np.where(some, np.minimum(begin, -half - root), begin), np.where(some, np.maximum(end, -half + root), end)
    length = other.m[s]
    safe = np.where(length > 0, length, 1)
    ux, uy = other.dx[s] / safe, other.dy[s] / safe
    ox, oy = px - other.x0[s], py - other.y0[s]
    t0, t1 = np.full(len(f), -np.inf), np.full(len(f), np.inf)
    for start, speed, lo, hi in ((ox * ux + oy * uy, vx * ux + vy * uy, 0.0, length), (oy * ux - ox * uy, vy * ux - vx * uy, -tol, tol)):
        still = np.abs(speed) < 1e-12
        with np.errstate(divide="ignore", invalid="ignore"):
            x, y = (lo - start) / speed, (hi - start) / speed
        inside = (start >= lo) & (start <= hi)
        t0 = np.maximum(t0, np.where(still, np.where(inside, -np.inf, np.inf), np.minimum(x, y)))
        t1 = np.minimum(t1, np.where(still, np.where(inside, np.inf, -np.inf), np.maximum(x, y)))
    real = (t0 < t1) & (length > 0)
    begin, end = np.where(real, np.minimum(begin, t0), begin), np.where(real, np.maximum(end, t1), end)
    return np.clip(begin, 0, 1), np.clip(end, 0, 1)


def _shared(pair: np.ndarray, segment: np.ndarray, begin: np.ndarray, end: np.ndarray, m: np.ndarray, pairs: int) -> np.ndarray:
    """Metres of each pair: the union of the stretches of each segment."""
    (some,) = np.nonzero(end > begin)
    some = some[np.lexsort((begin[some], pair[some] * len(m) + segment[some]))]
    pair, segment, begin, end = pair[some], segment[some], begin[some], end[some]
    first = _changes(pair, segment)
    size = np.diff(np.r_[first, len(pair)])
    upto = end[first]
    total = upto - begin[first]
    (more,) = np.nonzero(size > 1)
    k = 1
    while len(more):
        at = first[more] + k
        total[more] += np.maximum(0, end[at] - np.maximum(begin[at], upto[more]))
        upto[more] = np.maximum(upto[more], end[at])
        k += 1
        more = more[size[more] > k]
    return np.bincount(pair[first], weights=total * m[segment[first]], minlength=pairs)


def _reversed(first: Lines, second: Lines, a: int, others: np.ndarray) -> np.ndarray:
    """Whether others run the opposite way along a line: ``reversed_direction`` of each."""
    points = slice(first.point[a], first.point[a] + first.count[a] + 1)
    cum = np.r_[first.before[first.first[a] : first.first[a] + first.count[a]], first.length[a]]
    t = (0.05 + 0.9 * np.arange(19) / 18) * cum[-1]
    px, py = (np.interp(t, cum, v[points])[:, None] for v in (first.x, first.y))
    which, j = _ranges(second.first[others], second.count[others])
    qx, qy, dx, dy, square = (v[j] for v in (second.x0, second.y0, second.dx, second.dy, second.square))
    safe = np.where(square > 0, square, 1)
    starts = np.cumsum(second.count[others]) - second.count[others]
    wx, wy = px - qx, py - qy
    f = wx * dx
    f += wy * dy
    f /= safe
    np.clip(f, 0, 1, out=f)
    wx -= f * dx
    wy -= f * dy
    wx *= wx
    wy *= wy
    wx += wy
    hit = np.flatnonzero(wx == np.repeat(np.minimum.reduceat(wx, starts, axis=1), second.count[others], axis=1))
    row, col = hit // len(j), hit % len(j)
    code = row * len(others) + which[col]
    best = _changes(code)
    at = np.zeros(19 * len(others))
    at[code[best]] = second.before[j[col[best]]] + f.ravel()[hit[best]] * np.sqrt(square[col[best]])
    step = np.diff(at.reshape(19, -1), axis=0)
    step[np.abs(step) >= 0.5 * second.length[others]] = 0
    return (step < 0).sum(axis=0) > (step > 0).sum(axis=0)


def _judged(first: Lines, second: Lines, f: np.ndarray, s: np.ndarray, metres: float, tile: int, edge: float) -> pa.RecordBatch | None:
    """The pairs of lines of these pairs of segments that are within the distance and closest in the tile."""
    half_up = lambda v, d: np.floor(v * 10**d + 0.5) / 10**d
    tol = max(metres, 0.5)
    starts = _changes(first.line[f], second.line[s])
    pair = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(f)]))
    px, py, ex, ey, vx, vy, pp = (v[f] for v in (first.x0, first.y0, first.x1, first.y1, first.dx, first.dy, first.square))
    qx, qy, gx, gy, dx, dy, qq = (v[s] for v in (second.x0, second.y0, second.x1, second.y1, second.dx, second.dy, second.square))
    ways = [((px, py), _foot(px, py, qx, qy, dx, dy, qq)), ((ex, ey), _foot(ex, ey, qx, qy, dx, dy, qq)), ((qx, qy), _foot(qx, qy, px, py, vx, vy, pp)), ((gx, gy), _foot(gx, gy, px, py, vx, vy, pp))]
    off = np.minimum.reduce([w[0] for _, w in ways])
    side = lambda ox, oy, ux, uy, x, y: ux * (y - oy) - uy * (x - ox)
    cross = (side(px, py, vx, vy, qx, qy) * side(px, py, vx, vy, qx + dx, qy + dy) < 0) & (side(qx, qy, dx, dy, px, py) * side(qx, qy, dx, dy, px + vx, py + vy) < 0)
    off[cross] = 0
    least = np.minimum.reduceat(off, starts)
    hit = np.flatnonzero(off == least[pair])
    hit = hit[_changes(pair[hit])]
    # where they are closest: on the crossing, or halfway from a place to its foot
    (x, y), (_, wx, wy) = ways[0]
    x, y = (x - wx / 2)[hit], (y - wy / 2)[hit]
    for (tx, ty), (d, wx, wy) in reversed(ways):
        here = d[hit] == least[pair[hit]]
        x, y = np.where(here, tx[hit] - wx[hit] / 2, x), np.where(here, ty[hit] - wy[hit] / 2, y)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((qx - px) * dy - (qy - py) * dx)[hit] / (vx * dy - vy * dx)[hit]
    x, y = np.where(cross[hit], px[hit] + t * vx[hit], x), np.where(cross[hit], py[hit] + t * vy[hit], y)
    # a place without a tile (no finite numbers) is in none
    here = np.zeros(len(starts), dtype=bool)
    fit = (np.sqrt(least[pair[hit]]) <= metres) & np.isfinite(x) & np.isfinite(y)
    here[pair[hit[fit]]] = _tile_at(x[fit], y[fit], edge) == tile
    if not here.any():
        return None
    number = np.cumsum(here) - 1
    keep = here[pair]
    f, s, pair = f[keep], s[keep], number[pair[keep]]
    starts = _changes(pair)
    a, b = first.line[f[starts]], second.line[s[starts]]
    sa = _shared(pair, f, *_spans(first, f, second, s, tol), first.m, len(a))
    sb = _shared(pair, s, *_spans(second, s, first, f, tol), second.m, len(a))
    turned = np.zeros(len(a), dtype=bool)
    for low, high in zip(begins := _changes(a).tolist(), [*begins[1:], len(a)], strict=True):
        at = low
        for upto in [*(low + np.flatnonzero(np.diff(np.cumsum(second.count[b[low:high]]) * 19 // PLACES)) + 1).tolist(), high]:
            turned[at:upto] = _reversed(first, second, a[at], b[at:upto])
            at = upto
    la, lb = first.length[a], second.length[b]
    pct = lambda part, whole: half_up(np.where(whole > 0, 100 * part / np.where(whole > 0, whole, 1), 0.0), 1)
    columns = first.ids[a], second.ids[b], half_up(np.sqrt(least[here]), 1), half_up(sa / 1000, 2), half_up(sb / 1000, 2), pct(sa, la), pct(sb, lb), turned
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(_PAIR))


def _pairs_of(first: Lines, second: Lines, metres: float, tile: int, size: float) -> Iterator[pa.RecordBatch]:
    """The pairs of a line of first and one of second of a greater id that are closest in the tile."""
    held, n = [], 0
    judge = lambda: _judged(first, second, *(np.concatenate(v) for v in zip(*held, strict=True)), metres, tile, TILE_CELLS * size)
    for a, others in _candidates(first, second, tile, metres / 2 + ROOM_M, size):
        for f, s in _near_segments(first, second, a, others, max(metres, 0.5) + 1e-3):
            if len(f):
                held.append((f, s))
                n += len(f)
        if n >= SEGMENTS:  # all segments of a pair are judged together
            if found := judge():
                yield found
            held, n = [], 0
    if n and (found := judge()):
        yield found


def _meet(metres: float, size: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile and blocks: the pairs of each."""

    def lines(rows: pa.Table) -> Lines:
        flat = lambda c: np.concatenate([np.empty(0), *(v.flatten().to_numpy(zero_copy_only=False) for v in rows.column(c).chunks)])
        points = np.concatenate([np.empty(0, dtype=np.int64), *(v.value_lengths().to_numpy(zero_copy_only=False) for v in rows.column("x").chunks)])
        return Lines(rows.column("id").to_numpy(), points, flat("x"), flat("y"))

    def group(key: tuple, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        if key[1] == key[2]:
            one = lines(rows)
            yield from _pairs_of(one, one, metres, key[0], size)
        else:
            other = rows.column("other").to_numpy()
            one, two = lines(rows.filter(pa.array(~other))), lines(rows.filter(pa.array(other)))
            if len(one.ids) and len(two.ids):
                yield from _pairs_of(one, two, metres, key[0], size)
                yield from _pairs_of(two, one, metres, key[0], size)

    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "i", "j")]
        for low, high in zip(begins := _changes(*keys).tolist(), [*begins[1:], batch.num_rows], strict=True):
            if (now := tuple(int(k[low]) for k in keys)) != key and held:
                yield from group(key, held)
                held = []
            key = now
            held.append(batch.slice(low, high - low))
    if held:
        yield from group(key, held)


def _passed(batch: pa.RecordBatch, reach: float, edge: float) -> tuple[np.ndarray, ...]:
    """(x, y, points of each line, line, tile): the tiles within reach of each line, once each."""
    lat, lon = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("lat", "lon"))
    points = batch.column("lat").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = geo.laea_arrays(lat, lon)
    seg = np.setdiff1d(np.arange(len(x)), np.cumsum(points) - 1)
    dx, dy = x[seg + 1] - x[seg], y[seg + 1] - y[seg]
    known = np.isfinite(dx) & np.isfinite(dy)
    seg, dx, dy = seg[known], dx[known], dy[known]
    parts = np.maximum(1, np.ceil(np.hypot(dx, dy) / edge)).astype(np.int64)  # long segments in parts, so that a box stays small
    which, k = _ranges(np.zeros(len(seg), dtype=np.int64), parts)
    begin, end = [], []
    for v, d in ((x, dx), (y, dy)):
        one, two = (v[seg][which] + (k + e) / parts[which] * d[which] for e in (0, 1))
        begin.append(_floor(np.minimum(one, two) - reach, edge))
        end.append(_floor(np.maximum(one, two) + reach, edge))
    again, tx, ty = _box_cells(begin, end)
    line, tile = np.repeat(np.arange(len(points)), points)[seg[which[again]]], tx * (1 << 20) + ty
    order = np.lexsort((tile, line))
    once = order[_changes(line[order], tile[order])]
    return x, y, points, line[once], tile[once]


def _tile_points(reach: float, edge: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        _, _, points, line, tile = _passed(batch, reach, edge)
        tiles, number = np.unique(tile, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(tiles), pa.array(np.bincount(number, weights=points[line], minlength=len(tiles)).astype(np.int64))], names=["tile", "n"])


def _sent(reach: float, edge: float, blocks: dict[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line to its tiles; where a tile has several blocks, to the pairs of its block and each other."""
    tiles = np.array(sorted(blocks), dtype=np.int64)
    many = np.array([blocks[t] for t in tiles.tolist()], dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y, points, line, tile = _passed(batch, reach, edge)
        n = np.ones(len(tile), dtype=np.int64)
        if len(tiles):
            at = np.minimum(np.searchsorted(tiles, tile), len(tiles) - 1)
            n = np.where(tiles[at] == tile, many[at], 1)
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        own = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)[line] % n
        which, k = _ranges(np.zeros(len(n), dtype=np.int64), n)
        own, line, tile = own[which], line[which], tile[which]
        offsets = np.r_[0, np.cumsum(points)].astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (x, y)]
        step = 20_000
        for low in range(0, len(line), step):
            part = slice(low, low + step)
            take = pa.array(line[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(tile[part]), pa.array(np.minimum(own, k)[part].astype(np.int32)), pa.array(np.maximum(own, k)[part].astype(np.int32)), pa.array((k < own)[part]), pa.array(ids[line[part]]), *(v.take(take) for v in lists)],
                names=[c.split()[0] for c in SENT.split(", ")],
            )


def pairs_within(lines: DataFrame, metres: float, schema: str) -> DataFrame:
    """All pairs of lines (id, lat, lon) within the distance, as ``schema`` names their columns."""
    size = max(2 * metres, 250.0)
    reach, edge = metres / 2 + ROOM_M, TILE_CELLS * size
    usable = cut(lines.where(F.col("id").isNotNull() & (F.size("lat") > 1)))
    points = usable.mapInArrow(lambda it: _tile_points(reach, edge, it), "tile long, n long").groupBy("tile").agg(F.sum("n").alias("n"))
    blocks = {r["tile"]: -(-r["n"] // BLOCK_POINTS) for r in points.where(F.col("n") > BLOCK_POINTS).collect()}  # only tiles of over BLOCK_POINTS
    sent = usable.mapInArrow(lambda it: _sent(reach, edge, blocks, it), SENT)
    apart = sent.repartition(8 * shuffle_partitions(lines.sparkSession), "tile", "i", "j").sortWithinPartitions("tile", "i", "j")
    return apart.mapInArrow(lambda it: _meet(metres, size, it), schema)
