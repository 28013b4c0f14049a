"""Near-duplicate records with small edits: routes that are the same ride.

The geometry decides: each line must lie for 85 % of its length, measured on 160 samples of it, within 50 m of the other. A join on
1 km cells proposes pairs and leaves none out that the geometry accepts, whatever the direction, heading, starting point, length and
sampling. Let the reach of a line be all cells within 50 m of it. A sample within 50 m of the other line lies in a cell of both
reaches. Take the rarest cell in both: all samples of a line in rarer cells are off the other line, which 24 samples may be. So this
cell is among those of the reach that are no rarer-ranked than the line's 25th sample, and only these are posted, for either line.

Postings carry two bitmaps: the reach, and the cells that hold at least h samples of the line. A cell of the second that is not in the
other's reach has h samples off it, so more than 24 / h of them rule the pair out. Both are bounds of the rule, not estimates.

``_postings`` and ``_candidates`` are the join of sets by Jaccard similarity, of which the kernels are used here.

Skew: exact copies are one representative; postings of hot tokens (known from a fixed-size count sketch) are cut into blocks
that meet pairwise, so no task takes an unbounded list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.session import cut

CELL_M = 1000.0
HEADINGS = 4
SIMILARITY = 0.6
WITHIN_M = 50.0
SHARE = 0.85
SAMPLES = 160
METRES_PER_DEGREE = 111_195.0
#: Samples of a line that may be off the other.
MOST_OFF = SAMPLES - math.ceil(SHARE * SAMPLES - 1e-9)
#: Places for the reach are this far apart; its bound has half of it and a tenth of WITHIN_M to spare.
STEP_M = 100.0
REACH = (1.1 * WITHIN_M + STEP_M / 2) / CELL_M
SKETCH = 1 << 16
HOT = 20_000
GROUP = 200_000
SHORT_LIST = 64
MIDDLE_LIST = 4096
SIGNATURE = ("s0", "s1", "s2", "s3")
POSTING = ("token", "one", "other", "id", "size", "pos", *SIGNATURE)
COVER = 3
COVERED = tuple(f"s{w}" for w in range(COVER)) + tuple(f"h{w}" for w in range(COVER))
WEIGHTS = (25, 12, 8, 6, 5, 4, 3, 2, 1)
LEADER_RADIUS = 24
#: SHA-256 of no bytes: the placeholder of tracks without points.
EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def clean_line(lat, lon) -> np.ndarray | None:
    """(n, 2) array of the usable points, longitudes unwrapped; null with fewer than two points or no length."""
    if lat is None or lon is None or len(lat) != len(lon):
        return None
    p = np.column_stack([np.asarray(lat, dtype=float), np.asarray(lon, dtype=float)])
    p = p[(np.abs(p[:, 0]) <= 90) & (np.abs(p[:, 1]) <= 180)]  # NaN fails as well
    if len(p) < 2 or (p == p[0]).all():
        return None
    p[:, 1] = np.unwrap(p[:, 1], period=360.0)
    return p


def batch_tokens(lats, lons) -> tuple[np.ndarray, np.ndarray]:
    """(line number, token) of many lines, sorted and distinct: the cells a line runs through with its undirected heading, as 32 bits."""
    usable = [(n, len(a)) for n, (a, o) in enumerate(zip(lats, lons, strict=True)) if a is not None and o is not None and len(a) == len(o) and len(a)]
    if not usable:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint32)
    line = np.repeat([n for n, _ in usable], [k for _, k in usable])
    lat = np.concatenate([np.asarray(lats[n], dtype=float) for n, _ in usable])
    lon = np.concatenate([np.asarray(lons[n], dtype=float) for n, _ in usable])
    ok = (np.abs(lat) <= 90) & (np.abs(lon) <= 180)  # NaN fails as well
    line, lat, lon = line[ok], lat[ok], lon[ok]
    inside = np.flatnonzero(line[1:] == line[:-1])
    a, o, owner = lat[inside], lon[inside], line[inside]
    da, do = lat[inside + 1] - a, lon[inside + 1] - o
    do -= 360.0 * np.round(do / 360.0)
    dy, dx = da * METRES_PER_DEGREE, do * METRES_PER_DEGREE * np.cos(np.radians(np.floor(a) + 0.5))
    d = np.hypot(dx, dy)
    owner, a, o, da, do, dx, dy, d = (v[d > 0] for v in (owner, a, o, da, do, dx, dy, d))
    if not len(d):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint32)
    ends = np.cumsum(d)
    lines, first = np.unique(owner, return_index=True)
    base = np.r_[0.0, ends[first[1:] - 1]]
    length = np.r_[base[1:], ends[-1]] - base
    n = np.maximum(1, np.ceil(length / (CELL_M / 5))).astype(np.int64)
    which = np.repeat(np.arange(len(lines)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    t = base[which] + (k + 0.5) * (length / n)[which]
    last = np.r_[first[1:], len(d)] - 1
    seg = np.clip(np.searchsorted(ends, t, side="right"), first[which], last[which])
    f = np.clip((t - (ends[seg] - d[seg])) / d[seg], 0, 1)
    la, lo = a[seg] + f * da[seg], (o[seg] + f * do[seg] + 180.0) % 360.0
    row = np.floor(la * METRES_PER_DEGREE / CELL_M).astype(np.int64)
    column = np.floor(lo * METRES_PER_DEGREE * np.cos(np.radians(np.floor(la) + 0.5)) / CELL_M).astype(np.int64)
    heading = np.floor((np.arctan2(dy, dx)[seg] % math.pi) / math.pi * HEADINGS).astype(np.int64) % HEADINGS
    token = _mix(((row + 20_000) * 65_536 + column) * HEADINGS + heading) >> np.uint64(32)
    both = np.unique((lines[which].astype(np.uint64) << np.uint64(32)) | token)
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def line_tokens(lat, lon) -> np.ndarray:
    """Sorted distinct tokens of one line."""
    return batch_tokens([lat], [lon])[1]


class _Lines:
    """The moving segments of many lines, to take places along them at equal distances."""

    def __init__(self, lats, lons):
        usable = [(n, len(a)) for n, (a, o) in enumerate(zip(lats, lons, strict=True)) if a is not None and o is not None and len(a) == len(o) and len(a)]
        line = np.repeat(np.array([n for n, _ in usable], dtype=np.int64), [k for _, k in usable])
        lat, lon = (np.concatenate([np.empty(0), *(np.asarray(v[n], dtype=float) for n, _ in usable)]) for v in (lats, lons))
        ok = (np.abs(lat) <= 90) & (np.abs(lon) <= 180)  # NaN fails as well
        line, lat, lon = line[ok], lat[ok], lon[ok]
        inside = np.flatnonzero(line[1:] == line[:-1])
        a, o, owner = lat[inside], lon[inside], line[inside]
        da, do = lat[inside + 1] - a, lon[inside + 1] - o
        do -= 360.0 * np.round(do / 360.0)
        d = segment_lengths(a, da, do)
        self.a, self.o, self.da, self.do, self.d, owner = (v[d > 0] for v in (a, o, da, do, d, owner))
        self.ends = np.cumsum(self.d)
        self.lines, self.first = np.unique(owner, return_index=True)
        self.last = np.r_[self.first[1:], len(self.d)].astype(np.int64) - 1
        self.base = self.ends[self.first] - self.d[self.first]
        self.length = self.ends[self.last] - self.base if len(self.lines) else np.empty(0)

    def places(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number in ``lines``, latitude, longitude from 0 to 360) of the middles of n equal parts of each line."""
        which = np.repeat(np.arange(len(self.lines)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        t = self.base[which] + (k + 0.5) * (self.length / n)[which]
        seg = np.clip(np.searchsorted(self.ends, t, side="right"), self.first[which], self.last[which])
        f = np.clip((t - (self.ends[seg] - self.d[seg])) / self.d[seg], 0, 1)
        return which, self.a[seg] + f * self.da[seg], (self.o[seg] + f * self.do[seg] + 180.0) % 360.0

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, token, samples) of runs of the SAMPLES places in one cell; a cell may have several runs."""
        which, la, lo = self.places(np.full(len(self.lines), SAMPLES))
        key = _cell_key(la, lo)
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (which[1:] != which[:-1])]) if len(key) else np.empty(0, dtype=np.int64)
        return which[start], _token(key[start]), np.diff(np.r_[start, len(key)])

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """(number, token), distinct: all cells within 50 m of each line."""
        which, la, lo = self.places(np.maximum(1, np.ceil(self.length / STEP_M)).astype(np.int64))
        y = la * METRES_PER_DEGREE / CELL_M
        row = np.floor(y).astype(np.int64)
        scale = _across(row)
        x = lo * scale
        fy, fx = y - row, x - np.floor(x)
        key = _cell_key(la, lo)
        new = np.r_[True, (key[1:] != key[:-1]) | (which[1:] != which[:-1])] if len(key) else np.empty(0, dtype=bool)
        edge = (np.minimum(fy, 1 - fy) <= REACH) | (np.minimum(fx, 1 - fx) <= 1.05 * REACH)
        lines, keys = [which[new]], [key[new]]
        which, la, lo, scale = which[edge], la[edge], lo[edge], scale[edge]
        for north in (-REACH, REACH):
            for east in (-1.05 * REACH, 1.05 * REACH):
                k = _cell_key(la + north * CELL_M / METRES_PER_DEGREE, (lo + east / scale) % 360.0)
                new = np.r_[True, (k[1:] != k[:-1]) | (which[1:] != which[:-1])] if len(k) else np.empty(0, dtype=bool)
                lines.append(which[new])
                keys.append(k[new])
        both = np.unique((np.concatenate(lines).astype(np.uint64) << np.uint64(32)) | _token(np.concatenate(keys)))
        return (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)


def segment_lengths(lat: np.ndarray, dlat: np.ndarray, dlon: np.ndarray) -> np.ndarray:
    """Metres of segments from their start and differences in degrees."""
    return METRES_PER_DEGREE * np.hypot(dlat, dlon * np.cos(np.radians(lat + dlat / 2)))


def _across(row: np.ndarray) -> np.ndarray:
    """Cells in a degree of longitude."""
    return METRES_PER_DEGREE / CELL_M * np.maximum(1e-6, np.cos(np.radians((row + 0.5) * CELL_M / METRES_PER_DEGREE)))


def _cell_key(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    row = np.floor(lat * METRES_PER_DEGREE / CELL_M).astype(np.int64)
    return (row + 20_000) * 65_536 + np.floor(lon * _across(row)).astype(np.int64)


def _token(key: np.ndarray) -> np.ndarray:
    return _mix(key) >> np.uint64(32)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the cells of all lines by their hash."""
    total = np.zeros(SKETCH, dtype=np.int64)
    for pdf in batches:
        line, token, _ = _Lines(list(pdf["lat"]), list(pdf["lon"])).samples()
        once = np.unique((line.astype(np.uint64) << np.uint64(32)) | token) & np.uint64(0xFFFFFFFF)
        total += np.bincount((once % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    (some,) = np.nonzero(total)
    yield pd.DataFrame({"bucket": some.astype(np.int32), "n": total[some]})


def _cover_postings(counts, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    often = counts.value
    rank = lambda token: (often[(token % np.uint64(SKETCH)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | token
    bits = 64 * COVER

    for pdf in batches:
        lines = _Lines(list(pdf["lat"]), list(pdf["lon"]))
        count = len(lines.lines)
        if not count:
            continue
        # the rank of each line's first sample that must not be off as well
        line, token, n = lines.samples()
        order = np.lexsort([rank(token), line])
        line, token, n = line[order], token[order], n[order]
        so_far = np.cumsum(n) - SAMPLES * line
        beyond = np.flatnonzero(so_far > MOST_OFF)
        turn = beyond[np.r_[True, line[beyond][1:] != line[beyond][:-1]]]
        limit = rank(token[turn])
        # samples by bit, and the weight whose bits hold most samples
        bit = lambda token: (_mix(token) % np.uint64(bits)).astype(np.int64)
        held = np.bincount(line * bits + bit(token), weights=n, minlength=count * bits).reshape(count, bits)
        worth = np.stack([w * (held >= w).sum(axis=1) - MOST_OFF // w * w for w in WEIGHTS])
        weight = np.array(WEIGHTS)[worth.argmax(axis=0)]
        line, token = lines.reach()
        inside = np.zeros((count, bits), dtype=bool)
        inside[line, bit(token)] = True
        words = np.concatenate([np.packbits(m, axis=1, bitorder="little").view(np.int64) for m in (inside, held >= weight[:, None])], axis=1)
        kept = np.flatnonzero(rank(token) <= limit[line])
        line, token = line[kept], token[kept]
        key = pdf["id"].to_numpy()[lines.lines[line]]
        # postings of hot tokens go to blocks; a block meets every block of its list once
        blocks = np.maximum(1, -(-often[(token % np.uint64(SKETCH)).astype(np.int64)] // HOT))
        mine = (_mix(key) % blocks.astype(np.uint64)).astype(np.int64)
        again = np.repeat(np.arange(len(kept)), blocks)
        other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        out = {
            "token": token[again].astype(np.int64), "one": np.minimum(mine[again], other).astype(np.int32), "other": np.maximum(mine[again], other).astype(np.int32),
            "id": key[again], "off": (MOST_OFF // weight)[line[again]].astype(np.int32),
        }
        yield pd.DataFrame(out | {name: words[line[again], w] for w, name in enumerate(COVERED)})


def prefix_length(size: np.ndarray, similarity: float) -> np.ndarray:
    return size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1


def _postings(counts, similarity: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    often = counts.value
    for pdf in batches:
        line, token = batch_tokens(list(pdf["lat"]), list(pdf["lon"]))
        if not len(line):
            continue
        seen = often[token % SKETCH]
        order = np.lexsort([token, seen, line])
        line, token, seen = line[order], token[order], seen[order]
        _, first, size = np.unique(line, return_index=True, return_counts=True)
        bit = _mix(token) % np.uint64(64 * len(SIGNATURE))
        flag = np.uint64(1) << (bit & np.uint64(63))
        signature = [np.bitwise_or.reduceat(np.where(bit >> np.uint64(6) == w, flag, np.uint64(0)), first) for w in range(len(SIGNATURE))]
        number = np.repeat(np.arange(len(first)), size)
        pos = np.arange(len(line)) - first[number]
        kept = np.flatnonzero(pos < prefix_length(size, similarity)[number])
        key = pdf["id"].to_numpy()[line[kept]]
        # postings of hot tokens go to blocks; a block meets every block of its list once
        blocks = np.maximum(1, -(-seen[kept] // HOT))
        mine = (_mix(key) % blocks.astype(np.uint64)).astype(np.int64)
        again = np.repeat(np.arange(len(kept)), blocks)
        other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at, number = kept[again], number[kept[again]]
        out = {
            "token": token[at].astype(np.int64), "one": np.minimum(mine[again], other).astype(np.int32), "other": np.maximum(mine[again], other).astype(np.int32),
            "id": key[again], "size": size[number].astype(np.int32), "pos": pos[at].astype(np.int32),
        }
        yield pd.DataFrame(out | {name: w[number].view(np.int64) for name, w in zip(SIGNATURE, signature, strict=True)})


class _Lists:
    """Posting lists of one group, sorted by list, size and position."""

    def __init__(self, pdf: pd.DataFrame, similarity: float):
        self.t = similarity
        order = np.lexsort([pdf["pos"], pdf["size"], pdf["other"], pdf["one"], pdf["token"]])
        self.id, self.size, self.pos = (pdf[c].to_numpy()[order] for c in ("id", "size", "pos"))
        self.words = [pdf[c].to_numpy()[order].view(np.uint64) for c in SIGNATURE]
        keys = pdf[["token", "one", "other"]].to_numpy()[order]
        new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
        self.starts = np.flatnonzero(new)
        self.ends = np.r_[self.starts[1:], len(order)]
        self.list_end = np.repeat(self.ends, self.ends - self.starts)
        self.length = np.repeat(self.ends - self.starts, self.ends - self.starts)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lower bound of the symmetric difference, from the signatures."""
        return sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int16) for w in self.words)

    def passing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs can be similar, by the positions and the signatures word by word."""
        total = self.size[i] + self.size[j]
        left = np.minimum(self.size[i] - self.pos[i], self.size[j] - self.pos[j])
        ok = np.flatnonzero(left >= self.t / (1 + self.t) * total - 1e-9)
        most = (1 - self.t) / (1 + self.t) * total[ok] + 1e-9
        apart = np.zeros(len(ok), dtype=np.int16)
        for w in self.words:
            apart += np.bitwise_count(w[i[ok]] ^ w[j[ok]])
            near = apart <= most
            ok, most, apart = ok[near], most[near], apart[near]
        return ok[self.id[i[ok]] != self.id[j[ok]]]

    def short(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Lists of up to SHORT_LIST sets, all at once, by distance within the list."""
        active = np.flatnonzero(self.length <= SHORT_LIST)
        step = 1
        while len(active):
            active = active[active + step < self.list_end[active]]
            # sizes ascend: the first set too large ends the list for this probe
            active = active[self.size[active] >= self.t * self.size[active + step] - 1e-9]
            ok = self.passing(active, active + step)
            yield active[ok], active[ok] + step
            step += 1

    def middle(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Lists of up to MIDDLE_LIST sets, by blocks of probes against the sizes they can be similar to."""
        lengths = self.ends - self.starts
        for n in np.flatnonzero((lengths > SHORT_LIST) & (lengths <= MIDDLE_LIST)):
            begin, end = int(self.starts[n]), int(self.ends[n])
            for low in range(begin, end, 64):
                rows = np.arange(low, min(low + 64, end))
                stop = begin + int(np.searchsorted(self.size[begin:end], self.size[rows[-1]] / self.t + 1e-9, side="right"))
                yield self.block(rows, np.arange(low, stop), None)

    def block(self, rows: np.ndarray, columns: np.ndarray, also: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of two sets of postings, each once: later columns, and earlier ones where ``also`` says so."""
        i, j = np.repeat(rows, len(columns)), np.tile(columns, len(rows))
        once = j > i if also is None else (j > i) | ((j < i) & np.tile(also, len(rows)))
        i, j = i[once], j[once]
        near = np.minimum(self.size[i], self.size[j]) >= self.t * np.maximum(self.size[i], self.size[j]) - 1e-9
        i, j = i[near], j[near]
        ok = self.passing(i, j)
        return i[ok], j[ok]

    def long(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Longer lists, by leaders and their computed answers."""
        for begin, end in zip(self.starts, self.ends, strict=True):
            if end - begin <= MIDDLE_LIST:
                continue
            free = np.ones(end - begin, dtype=bool)
            while free.any():
                first = int(begin + free.argmax())
                rest = begin + np.flatnonzero(free)
                own = rest[self.apart(np.full(len(rest), first), rest) <= LEADER_RADIUS]
                free[own - begin] = False
                most = self.size[own].max()
                stop = begin + int(np.searchsorted(self.size[begin:end], most / self.t + 1e-9, side="right"))
                reach = np.arange(first, stop)
                bound = (1 - self.t) / (1 + self.t) * (most + self.size[reach]) + LEADER_RADIUS + 1e-9
                answers = reach[self.apart(np.full(len(reach), first), reach) <= bound]
                step = max(1, 1_000_000 // max(1, len(answers)))
                for low in range(0, len(own), step):
                    yield self.block(own[low : low + step], answers, free[answers - begin])


def _candidates(similarity: float, pdf: pd.DataFrame) -> pd.DataFrame:
    lists = _Lists(pdf, similarity)
    found = [np.column_stack([lists.id[i], lists.id[j]]) for part in (lists.short(), lists.middle(), lists.long()) for i, j in part if len(i)]
    pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.empty((0, 2), dtype=np.int64)
    return pd.DataFrame({"a_id": pairs[:, 0], "b_id": pairs[:, 1]})


class _Covers(_Lists):
    """Posting lists of lines; a pair passes if neither line can have more than MOST_OFF samples off the other."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values(["token", "one", "other"], kind="stable", ignore_index=True)
        super().__init__(pdf.assign(size=1, pos=0, **{w: 0 for w in SIGNATURE if w not in pdf}), 1.0)
        self.off = pdf["off"].to_numpy()
        self.reach, self.held = ([pdf[c].to_numpy().view(np.uint64) for c in COVERED[k : k + COVER]] for k in (0, COVER))

    def passing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.flatnonzero(self.id[i] != self.id[j])
        for p, q in ((i, j), (j, i)):
            apart = np.zeros(len(ok), dtype=np.int16)
            for reach, held in zip(self.reach, self.held, strict=True):
                apart += np.bitwise_count(held[p[ok]] & ~reach[q[ok]])
                near = apart <= self.off[p[ok]]
                ok, apart = ok[near], apart[near]
        return ok

    def middle(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for n in np.flatnonzero(self.ends - self.starts > SHORT_LIST):
            for low in range(int(self.starts[n]), int(self.ends[n]), 64):
                yield self.block(np.arange(low, min(low + 64, self.ends[n])), np.arange(low, self.ends[n]), None)


def _cover_candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    lists = _Covers(pdf)
    found = [np.column_stack([lists.id[i], lists.id[j]]) for part in (lists.short(), lists.middle()) for i, j in part if len(i)]
    pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.empty((0, 2), dtype=np.int64)
    return pd.DataFrame({"a_id": pairs[:, 0], "b_id": pairs[:, 1]})


def sample_points(line: np.ndarray) -> np.ndarray:
    """(SAMPLES, 2) places of a cleaned line, the middles of equal parts of its length."""
    step = np.diff(line, axis=0)
    s = np.r_[0.0, np.cumsum(segment_lengths(line[:-1, 0], step[:, 0], step[:, 1]))]
    t = (np.arange(SAMPLES) + 0.5) * s[-1] / SAMPLES
    return np.column_stack([np.interp(t, s, line[:, 0]), np.interp(t, s, line[:, 1])])


def _covered(p: np.ndarray, line: np.ndarray, metres: float, most_off: int) -> bool:
    """All but ``most_off`` of the places p lie within the distance of the line, each in its own local plane."""
    q, d = line[:-1] * METRES_PER_DEGREE, np.diff(line, axis=0) * METRES_PER_DEGREE
    off = 0
    for part in (p[0::4], p[2::4], p[1::4], p[3::4]):  # what has too many off in some needs no closer look
        c = np.cos(np.radians(part[:, :1]))
        near = np.zeros(len(part), dtype=bool)
        for begin in range(0, len(d), 512):
            at = slice(begin, min(begin + 512, len(d)))
            v, u = part[:, :1] * METRES_PER_DEGREE - q[at, 0], (part[:, 1:] * METRES_PER_DEGREE - q[at, 1]) * c
            dy, dx = d[at, 0], d[at, 1] * c
            square = dx * dx + dy * dy
            f = np.clip((u * dx + v * dy) / np.where(square > 0, square, 1), 0, 1)
            near |= ((u - f * dx) ** 2 + (v - f * dy) ** 2 <= metres**2).any(axis=1)
        off += int((~near).sum())
        if off > most_off:
            return False
    return True


def same_ride(a: np.ndarray, b: np.ndarray, metres: float = WITHIN_M, share: float = SHARE) -> bool:
    """Both cleaned lines lie for the share of their length within the distance of the other."""
    b = b.copy()
    b[:, 1] += 360.0 * np.round((a[:, 1].mean() - b[:, 1].mean()) / 360.0)
    most_off = SAMPLES - math.ceil(share * SAMPLES - 1e-9)
    return _covered(sample_points(a), b, metres, most_off) and _covered(sample_points(b), a, metres, most_off)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = []
        for a_lat, a_lon, b_lat, b_lon in zip(pdf["a_lat"], pdf["a_lon"], pdf["b_lat"], pdf["b_lon"], strict=True):
            a, b = clean_line(a_lat, a_lon), clean_line(b_lat, b_lon)
            keep.append(a is not None and b is not None and same_ride(a, b))
        yield pdf.loc[keep, ["a_id", "b_id"]]


def similar_lines(lines: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id), a_id < b_id, of ``lines`` (id, lat array, lon array; one row an id) that are the same ride."""
    spark = lines.sparkSession
    rows = lines.select("id", "lat", "lon").mapInPandas(_sketch, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most SKETCH rows
    often = np.zeros(SKETCH, dtype=np.int64)
    for r in rows:
        often[r["bucket"]] = r["n"]
    counts = spark.sparkContext.broadcast(often)
    # groups of about so many postings however many there are, each a partition of its own
    groups = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(often.sum()) // GROUP))
    postings = lines.select("id", "lat", "lon").mapInPandas(
        lambda it: _cover_postings(counts, it),
        "token long, one int, other int, id long, off int, " + ", ".join(f"{w} long" for w in COVERED),
    )
    candidates = (
        postings.withColumn("part", F.pmod(F.xxhash64("token", "one", "other"), F.lit(groups))).repartition(groups, "part").groupBy("part")
        .applyInPandas(_cover_candidates, "a_id long, b_id long")
        .distinct()
    )
    a = lines.select(F.col("id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = lines.select(F.col("id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    return candidates.join(a, "a_id").join(b, "b_id").select("a_id", "b_id", "a_lat", "a_lon", "b_lat", "b_lon").mapInPandas(_verify, "a_id long, b_id long")


def class_pairs(members: DataFrame) -> DataFrame:
    """All pairs (a_id, b_id) inside classes of ``members`` (cls, id): n (n - 1) / 2 of a class of n."""
    one = members.select("cls", "id").distinct()
    a, b = one.select("cls", F.col("id").alias("a_id")), one.select("cls", F.col("id").alias("b_id"))
    return a.join(b, "cls").where("a_id < b_id").select("a_id", "b_id")


def track_key(text: Column) -> Column:
    bare = F.lower(F.trim(text))
    return F.when((bare != "") & (bare != EMPTY_HASH), bare)


def same_rides(routes: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id) of routes with the same track hash or the same line up to small changes.

    Null, blank and placeholder hashes, and geometries with fewer than two usable points (null, NaN and out-of-range points are
    left out) or without length, identify nothing. Several versions of a route are one case. Exact copies of a geometry are
    compared once by their least id and then expanded to all their pairs.
    Empty tables give an empty result; other columns are ignored.
    """
    known = routes.where(F.col("id").isNotNull())
    lat, lon = F.col("geometry.lat"), F.col("geometry.lon")
    moves = F.exists("geometry", lambda p: (p["lat"] != F.col("geometry")[0]["lat"]) | (p["lon"] != F.col("geometry")[0]["lon"]))
    lines = known.where((F.size("geometry") >= 2) & moves).select("id", lat.alias("lat"), lon.alias("lon"))
    keyed = lines.select("id", F.xxhash64("lat", "lon").alias("h"), F.xxhash64("lon", "lat").alias("k"), "lat", "lon")
    representatives = cut(
        keyed.groupBy("h", "k").agg(F.min("id").alias("id"), F.first("lat").alias("lat"), F.first("lon").alias("lon")).select("id", "lat", "lon")
    )
    ids = keyed.select("h", "k", "id").distinct()
    sizes = ids.groupBy("h", "k").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(ids.join(sizes, ["h", "k"]).select("cls", "id"))  # exact copies only
    between = cut(similar_lines(representatives))
    spread = members.where(F.col("id") != F.col("cls")).select("cls", "id").distinct()
    ends = between.select("a_id").unionByName(between.select(F.col("b_id").alias("a_id"))).distinct().withColumnRenamed("a_id", "cls")
    holders = ends.select("cls", F.col("cls").alias("id")).unionByName(ends.join(spread, "cls").select("cls", "id"))
    a = holders.select(F.col("cls").alias("a_id"), F.col("id").alias("a"))
    b = holders.select(F.col("cls").alias("b_id"), F.col("id").alias("b"))
    expanded = between.join(a, "a_id").join(b, "b_id").where("a <> b").select(F.least("a", "b").alias("a_id"), F.greatest("a", "b").alias("b_id"))
    copies = class_pairs(members)
    hashes = class_pairs(known.select(track_key(F.col("track_hash")).alias("cls"), "id").where(F.col("cls").isNotNull()))
    return expanded.unionByName(copies).unionByName(hashes).distinct()
