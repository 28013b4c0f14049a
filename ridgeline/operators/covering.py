"""Candidates for lines that lie along each other, found where both are and without shuffling a pair that merely meets.

A line of which a share lies within a distance of another has few pieces that the other comes nowhere near. Pieces are counted by cell in
the tiles that hold enough of the line: lines that only cross it touch the cells of a few pieces and are ruled out there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.operators.meeting import _changes, _floor, _passed, _ranges
from ridgeline.session import shuffle_partitions

#: Longest pieces of a line to be covered, and room for rounding at the borders of cells.
PIECE_M, ROOM_M = 100.0, 0.5
CELL_M = 250.0
#: Cells across a tile, and with a ring of one cell around it, for pieces at its border.
TILE_CELLS = 128
LOCAL = TILE_CELLS + 2
#: Tiles of a line are counted until they hold so many times the pieces that may be off.
COUNTED = 2
#: Pieces that are counted first, those of the least used cells: so many times those that may be off, and some more.
TRIED, MORE = 3.5, 6
#: Lines of a block of the covering lines of a tile, those for which the lines to be covered are parted, in at most PARTS; pieces that are held at once.
BLOCK_LINES, PART_LINES, PARTS, HELD = 100_000, 20_000, 3, 200_000
SENT = "tile long, i int, covered boolean, id long, need int, cells array<short>, n array<int>"


def _middles(x: np.ndarray, y: np.ndarray, points: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, x, y, pieces of each line, length of each): middles of equal pieces of at most ``longest``."""
    last = np.cumsum(points) - 1
    first = last - points + 1
    m = np.r_[0.0, np.hypot(np.diff(x), np.diff(y))]
    m[first] = 0
    s = np.cumsum(m)
    length = s[last] - s[first]
    n = np.maximum(1, np.ceil(length / longest)).astype(np.int64)
    line, k = _ranges(np.zeros(len(n), dtype=np.int64), n)
    at = s[first][line] + (k + 0.5) * (length / n)[line]
    j = np.clip(np.searchsorted(s, at, side="right") - 1, first[line], last[line] - 1)
    t = np.clip((at - s[j]) / np.where(m[j + 1] > 0, m[j + 1], 1), 0, 1)
    return line, x[j] + t * (x[j + 1] - x[j]), y[j] + t * (y[j + 1] - y[j]), n, length


def _box(v: np.ndarray, reach: float, size: float) -> tuple[np.ndarray, np.ndarray]:
    return _floor(v - reach, size), _floor(v + reach, size)


def _touched(x: np.ndarray, y: np.ndarray, points: np.ndarray, size: float) -> tuple[np.ndarray, ...]:
    """(line, tile, cell) by line and tile: the cells that each line touches, in all tiles in or around which they lie."""
    at = np.setdiff1d(np.arange(len(x)), np.cumsum(points) - 1)
    line, x, y, dx, dy = np.repeat(np.arange(len(points)), points - 1), x[at], y[at], np.diff(x)[at], np.diff(y)[at]
    low, high = (_floor(f(x, x + dx) + side, size) for f, side in ((np.minimum, -ROOM_M), (np.maximum, ROOM_M)))
    s, cx = _ranges(low, high - low + 1)  # a segment in each column of cells
    line, x, y, dx, dy = line[s], x[s], y[s], dx[s], dy[s]
    run = np.where(dx == 0, 1, dx)
    ends = [y + np.where(dx == 0, side, np.clip((cx * size + along - x) / run, 0, 1)) * dy for side, along in ((0, -ROOM_M), (1, size + ROOM_M))]
    low, high = _floor(np.minimum(*ends) - ROOM_M, size), _floor(np.maximum(*ends) + ROOM_M, size)
    s, cy = _ranges(low, high - low + 1)
    line, cx = line[s], cx[s]
    tx, ty = ([_floor(c + side, TILE_CELLS) for side in (-1, 1)] for c in (cx, cy))
    border = np.flatnonzero((tx[0] != tx[1]) | (ty[0] != ty[1]))
    pick = [np.arange(len(line)), *[border] * 3]
    line, cx, cy = (np.concatenate([v[p] for p in pick]) for v in (line, cx, cy))
    tx, ty = (np.concatenate([t[e][p] for e, p in zip(ends, pick, strict=True)]) for t, ends in ((tx, (0, 1, 0, 1)), (ty, (0, 0, 1, 1))))
    tiles, number = np.unique(tx * (1 << 20) + ty, return_inverse=True)
    local = (cx - tx * TILE_CELLS + 1) * LOCAL + cy - ty * TILE_CELLS + 1
    key = np.unique((line * len(tiles) + number) * LOCAL**2 + local)
    group, local = key // LOCAL**2, key % LOCAL**2
    return group // len(tiles), tiles[group % len(tiles)], local


def _counted(x: np.ndarray, y: np.ndarray, points: np.ndarray, metres: float, share: float, size: float) -> tuple[np.ndarray, ...]:
    """(line, tile, need, cell, n) by line and tile: the counted pieces of moving lines by the cells about them, and how many of a tile another line must come near.

    ``cell`` is the lower left cell about the pieces, n four times their number, 2 more where they reach the cells to the right and 1 more where those above.

    At most ``may`` pieces of a line that is covered for the share are off the other. Of a number counted in several tiles, in one at least
    the other comes near as large a part as it must of them all.
    """
    line, px, py, n, length = _middles(x, y, points, PIECE_M)
    may = np.floor((1 - share) * n + 1e-9).astype(np.int64)
    tx, ty = _floor(px, TILE_CELLS * size), _floor(py, TILE_CELLS * size)
    tiles, number = np.unique(tx * (1 << 20) + ty, return_inverse=True)
    key = line * len(tiles) + number
    keys, of, held = np.unique(key, return_inverse=True, return_counts=True)
    # tiles of a line that hold most, until they hold enough
    order = np.lexsort((-held, keys // len(tiles)))
    own = keys[order] // len(tiles)
    upto = np.cumsum(held[order])
    begin = _changes(own)
    before = upto - held[order] - np.repeat((upto - held[order])[begin], np.diff(np.r_[begin, len(own)]))
    count = np.empty(len(keys), dtype=np.int64)
    count[order] = np.where(before <= (COUNTED * may)[own], held[order], 0)
    total = np.bincount(keys // len(tiles), weights=count, minlength=len(n)).astype(np.int64)
    which = keys // len(tiles)
    need = np.ceil(count * (total - may)[which] / total[which] - 1e-9).astype(np.int64)
    (some,) = np.nonzero((count[of] > 0) & (length > 0)[line])
    reach = metres + PIECE_M / 2 + ROOM_M
    (x0, x1), (y0, y1) = _box(px[some], reach, size), _box(py[some], reach, size)
    local = (x0 - tx[some] * TILE_CELLS + 1) * LOCAL + y0 - ty[some] * TILE_CELLS + 1
    code, times = np.unique(of[some] * (4 * LOCAL**2) + local * 4 + (x1 - x0) * 2 + (y1 - y0), return_counts=True)
    group, code = code // (4 * LOCAL**2), code % (4 * LOCAL**2)
    return which[group], tiles[keys % len(tiles)][group], need[group], code >> 2, times * 4 + (code & 3)


def _lists(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[begin, len(values)].astype(np.int32)), pa.array(values, kind))


def _sent(metres: float, share: float, size: float, blocks: dict[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covering lines to one block of each tile that they touch, lines to be covered to all blocks, in a part of theirs, of the tiles where they are counted."""

    def sides(tile: np.ndarray, id: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(number, own) of the blocks of a tile, and of the parts."""
        here = np.array([blocks.get(t, 1) for t in tile.tolist()], dtype=np.int64)
        hashed = ((id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
        numbers = -(-here // BLOCK_LINES), np.minimum(PARTS, -(-here // PART_LINES))
        return [(n, hashed % n) for n in numbers]

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in SENT.split(", ")])

    for ids, x, y, points in _parts(batches):
        line, tile, cell = _touched(x, y, points, size)
        begin = _changes(line, tile)
        (_, block), (parts, _) = sides(tile[begin], ids[line[begin]])
        which, part = _ranges(np.zeros(len(begin), dtype=np.int64), parts)
        at, w, cells = begin[which], pa.array(which), _lists(cell, begin, pa.int16())
        none = np.zeros(len(at), dtype=np.int32)
        yield rows(tile[at], (block[which] * PARTS + part).astype(np.int32), none > 0, ids[line[at]], none, cells.take(w), pa.nulls(len(at), pa.list_(pa.int32())))
        line, tile, need, cell, n = _counted(x, y, points, metres, share, size)
        if not len(line):
            continue
        begin = _changes(line, tile)
        cells, n = _lists(cell, begin, pa.int16()), _lists(n, begin, pa.int32())
        (number, _), (_, part) = sides(tile[begin], ids[line[begin]])
        which, block = _ranges(np.zeros(len(begin), dtype=np.int64), number)
        at, w = begin[which], pa.array(which)
        yield rows(tile[at], (block * PARTS + part[which]).astype(np.int32), np.ones(len(at), dtype=bool), ids[line[at]], need[at].astype(np.int32), cells.take(w), n.take(w))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, x, y, points) of lines whose coordinates are finite, so many that about HELD pieces come of them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lat, lon = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("lat", "lon"))
        points = batch.column("lat").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        x, y = geo.laea_arrays(lat, lon)
        first = np.cumsum(points) - points
        good = np.logical_and.reduceat(np.isfinite(x) & np.isfinite(y), first)
        keep = np.repeat(good, points)
        ids, x, y, points = ids[good], x[keep], y[keep], points[good]
        if not len(ids):
            continue
        first = np.cumsum(points) - points
        m = np.r_[0.0, np.hypot(np.diff(x), np.diff(y))]
        m[first] = 0
        part = np.cumsum(np.add.reduceat(m, first) / PIECE_M + 1) // HELD
        begin = _changes(part)
        for low, high in zip(begin.tolist(), [*begin[1:].tolist(), len(ids)], strict=True):
            of = slice(first[low], first[high - 1] + points[high - 1])
            yield ids[low:high], x[of], y[of], points[low:high]


class _Covering:
    """The covering lines of a block by cell."""

    def __init__(self, rows: list[pa.RecordBatch]) -> None:
        self.ids = np.concatenate([r.column("id").to_numpy(zero_copy_only=False) for r in rows])
        self.cells = np.concatenate([r.column("cells").flatten().to_numpy(zero_copy_only=False) for r in rows])
        n = np.concatenate([r.column("cells").value_lengths().to_numpy(zero_copy_only=False) for r in rows])
        self.at = np.r_[0, np.cumsum(n)]
        order = np.argsort(self.cells, kind="stable")
        self.lines = np.repeat(np.arange(len(n), dtype=np.int32), n)[order]
        self.first = np.searchsorted(self.cells[order], np.arange(LOCAL**2 + 1))

    def found(self, rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """(id, ids of those which come near as many of its pieces as they must) of each row."""
        ids, need = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "need"))
        base, n = (rows.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cells", "n"))
        held = rows.column("cells").value_lengths().to_numpy(zero_copy_only=False)
        row, begin = np.repeat(np.arange(len(held)), held), np.r_[0, np.cumsum(held)]
        times, right, up = n >> 2, (n & 2) > 0, (n & 1) > 0
        none = LOCAL**2  # a cell of no line
        near = np.stack([base, np.where(right, base + LOCAL, none), np.where(up, base + 1, none), np.where(right & up, base + LOCAL + 1, none)])
        # pieces of the least used cells are tried first: of these too, no more may be off than of all
        lines_at = np.r_[np.diff(self.first), 0]
        order = np.lexsort((lines_at[near].sum(axis=0) / times, row))
        before = np.cumsum(times[order]) - times[order]
        before -= np.repeat(before[begin[:-1]], held)
        may = np.add.reduceat(times, begin[:-1]) - need
        tried = np.zeros(len(base), dtype=bool)
        tried[order] = before < (TRIED * may + MORE)[row]
        least = np.bincount(row, weights=times * tried, minlength=len(held)) - may
        # a line in several cells about a piece is counted too often here, and counted again
        some, at = np.nonzero((near < none) & tried)
        key, of = np.unique(row[at] * none + near[some, at], return_inverse=True)
        weight = np.bincount(of, weights=times[at])
        cell = key % none
        bounds = np.searchsorted(key // none, np.arange(len(held) + 1)).tolist()
        starts, ends, size = self.first[cell].tolist(), self.first[cell + 1].tolist(), lines_at[cell]
        flags = np.zeros(none + 1, dtype=bool)
        for r, i in enumerate(ids.tolist()):
            low, high = bounds[r], bounds[r + 1]
            lines = np.concatenate([self.lines[starts[k] : ends[k]] for k in range(low, high)])
            if not len(lines):
                continue
            maybe = np.flatnonzero(np.bincount(lines, weights=np.repeat(weight[low:high], size[low:high])) >= least[r])
            own, good = slice(begin[r], begin[r + 1]), []
            about, pieces = near[:, own], times[own]
            for line in maybe[self.ids[maybe] != i].tolist():
                touched = self.cells[self.at[line] : self.at[line + 1]]
                flags[touched] = True
                if pieces[flags[about].any(axis=0)].sum() >= need[r]:
                    good.append(line)
                flags[touched] = False
            if good:
                yield i, self.ids[good]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile and block, covering lines first: (covered, covering) of each."""
    key, held, covering, out = None, [], None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "i", "covered")]
        for low, high in zip(begins := _changes(*keys).tolist(), [*begins[1:], batch.num_rows], strict=True):
            if (now := (int(keys[0][low]), int(keys[1][low]))) != key:
                key, held, covering = now, [], None
            rows = batch.slice(low, high - low)
            if not keys[2][low]:
                held.append(rows)
                continue
            if held:
                covering, held = _Covering(held), []
            if covering:
                out += [(np.full(len(by), i), by) for i, by in covering.found(rows)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out, strict=True)], names=["covered", "covering"])
            out = []


def _tile_lines(edge: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            tiles, n = np.unique(_passed(batch, 0.0, edge)[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tiles), pa.array(n)], names=["tile", "n"])


def covering_candidates(lines: DataFrame, metres: float, share: float) -> DataFrame:
    """(covered, covering), not distinct: no pair of a moving line and another that covers it for the share within the distance is left out.

    Lines (id, lat, lon) of at least two points.
    """
    size = max(CELL_M, math.ceil(2 * (metres + PIECE_M / 2 + ROOM_M)))
    counts = lines.mapInArrow(lambda it: _tile_lines(TILE_CELLS * size, it), "tile long, n long").groupBy("tile").agg(F.sum("n").alias("n"))
    blocks = {r["tile"]: r["n"] for r in counts.where(F.col("n") > min(PART_LINES, BLOCK_LINES)).collect()}  # only tiles of many lines
    sent = lines.mapInArrow(lambda it: _sent(metres, share, size, blocks, it), SENT)
    apart = sent.repartition(8 * shuffle_partitions(lines.sparkSession), "tile", "i").sortWithinPartitions("tile", "i", "covered")
    return apart.mapInArrow(_pairs, "covered long, covering long")
