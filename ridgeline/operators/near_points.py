"""Points near other points: a complete radius join on the sphere, and points in regions.

Voronoi partition around pivots. Every left point goes to the cell of its nearest pivot; a right point goes to each
cell whose pivot is no more than twice the radius farther than its own nearest pivot (triangle inequality: no left point
within the radius can lie in any other cell). Within a cell a vantage-point tree over the right points answers the radius
query by the exact great-circle metric. Cells that hold many points of either side are parted again around pivots of their own; what
stays heavy (points of one position) is cut into blocks, left blocks meeting each right block once, so no task takes an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.session import cut

EARTH_RADIUS_M = 6_371_008.8
NUMBER_OF_METRES = 1500.0
#: Bounds: pivots are picked from at most SAMPLE positions and are at most PIVOTS, and so again in each heavy cell; they are the only data shipped.
SAMPLE = 4096
PIVOTS = 256
BLOCK = 20_000
LEAF = 24
_SLACK = 1e-12


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle angle of unit vectors, exact for small ones (by the chord)."""
    return 2 * np.arcsin(np.minimum(1.0, 0.5 * np.sqrt(((a - b) ** 2).sum(axis=-1))))


def pick_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first pivots, without repeats."""
    chosen, far = [0], angle(points, points[0])
    while len(chosen) < min(count, len(points)):
        nxt = int(far.argmax())
        if far[nxt] <= 0:
            break
        chosen.append(nxt)
        far = np.minimum(far, angle(points, points[nxt]))
    return points[chosen]


def pivot_angles(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    chord2 = np.maximum(0.0, 2 - 2 * (points @ pivots.T))
    return 2 * np.arcsin(np.minimum(1.0, 0.5 * np.sqrt(chord2)))


class VantageTree:
    """Vantage-point tree; queries are answered for many points at once."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self._build(np.arange(len(points)))

    def _build(self, members: np.ndarray):
        if len(members) <= LEAF:
            return members
        vantage, rest = members[0], members[1:]
        d = angle(self.points[rest], self.points[vantage])
        mid = float(np.median(d))
        inner = d <= mid
        if inner.all():  # ties: equal positions make no deeper tree
            if d.max() <= 0:
                return members
            inner = d < mid
            if not inner.any():
                return members
        return vantage, float(d[inner].max()), float(d[~inner].min()), self._build(rest[inner]), self._build(rest[~inner])

    def within(self, queries: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(query index, member index) of all pairs within the angle."""
        qs: list[np.ndarray] = []
        ms: list[np.ndarray] = []
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, asked = stack.pop()
            if not len(asked):
                continue
            if isinstance(node, np.ndarray):
                for begin in range(0, len(asked), 8192):
                    some = asked[begin : begin + 8192]
                    for low in range(0, len(node), 256):
                        part = node[low : low + 256]
                        i, j = np.nonzero(angle(queries[some][:, None, :], self.points[part][None, :, :]) <= radius)
                        qs.append(some[i])
                        ms.append(part[j])
                continue
            vantage, inner_far, outer_near, inner, outer = node
            d = angle(queries[asked], self.points[vantage])
            hit = asked[d <= radius]
            qs.append(hit)
            ms.append(np.full(len(hit), vantage))
            stack.append((inner, asked[d <= inner_far + radius + _SLACK]))
            stack.append((outer, asked[d >= outer_near - radius - _SLACK]))
        return (np.concatenate(qs), np.concatenate(ms)) if qs else (np.empty(0, int), np.empty(0, int))


def usable_position(lat: Column, lon: Column) -> Column:
    """Neither null nor NaN nor out of range (NaN sorts above every number)."""
    return lat.between(-90, 90) & lon.between(-180, 180)


def _assign(pivots: dict[int, np.ndarray], reach: float | None, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each point in the cell of its nearest pivot among those of its ``cell`` so far, or with ``reach`` in every cell that a point within
    the radius may belong to. Cells without pivots stay as they are."""
    for pdf in batches:
        for begin in range(0, len(pdf), 16384):
            part = pdf.iloc[begin : begin + 16384].reset_index(drop=True)
            before = part["cell"].to_numpy()
            at = unit_vectors(part["lat"].to_numpy(float), part["lon"].to_numpy(float))
            rows, cells = [], []
            for c in np.unique(before).tolist():
                (mine,) = np.nonzero(before == c)
                if c not in pivots:
                    rows.append(mine)
                    cells.append(np.full(len(mine), c * PIVOTS))
                    continue
                d = pivot_angles(at[mine], pivots[c])
                if reach is None:
                    rows.append(mine)
                    cells.append(c * PIVOTS + d.argmin(axis=1))
                else:
                    row, cell = np.nonzero(d <= d.min(axis=1, keepdims=True) + reach)
                    rows.append(mine[row])
                    cells.append(c * PIVOTS + cell)
            if rows:
                yield part.iloc[np.concatenate(rows)].reset_index(drop=True).assign(cell=np.concatenate(cells).astype("int32"))


def _join_cell(radius: float, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if not len(left) or not len(right):
        return pd.DataFrame({"left_id": [], "right_id": [], "metres": []}).astype({"left_id": "int64", "right_id": "int64"})
    a = unit_vectors(left["lat"].to_numpy(float), left["lon"].to_numpy(float))
    b = unit_vectors(right["lat"].to_numpy(float), right["lon"].to_numpy(float))
    q, m = VantageTree(b).within(a, radius)
    return pd.DataFrame(
        {"left_id": left["id"].to_numpy()[q], "right_id": right["id"].to_numpy()[m], "metres": angle(a[q], b[m]) * EARTH_RADIUS_M}
    )


def cell_counts(side: DataFrame) -> dict[int, int]:
    """Points by cell; at most PIVOTS squared rows come to the driver."""
    return {r["cell"]: r["n"] for r in side.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}


def voronoi_cells(a: DataFrame, b: DataFrame, radius: float, pivots: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides (id, lat, lon) with their ``cell``, the right one replicated: first around the pivots of a sample, then heavy cells around pivots of
    their own, so that the number of cells grows with the number of points."""
    # a bounded sample of positions of both sides, the same on every run, only to place the pivots
    picked = [x.select("lat", "lon").orderBy(F.xxhash64("lat", "lon"), "lat", "lon").limit(SAMPLE // 2).toPandas() for x in (a, b)]
    some = pd.concat(picked, ignore_index=True)
    schema, reach = "id long, lat double, lon double, cell int", 2 * radius + 1e-7  # rounding of the pivot angles by dot products
    if not len(some):
        return a.withColumn("cell", F.lit(0)), b.withColumn("cell", F.lit(0))
    count = min(PIVOTS, pivots or max(8, len(some) // 16))
    first = {0: pick_pivots(unit_vectors(some["lat"].to_numpy(float), some["lon"].to_numpy(float)), count)}
    a = cut(a.withColumn("cell", F.lit(0)).mapInPandas(lambda it: _assign(first, None, it), schema))
    b = cut(b.withColumn("cell", F.lit(0)).mapInPandas(lambda it: _assign(first, reach, it), schema))
    heavy: dict[int, int] = {}
    for counts in (cell_counts(a), cell_counts(b)):
        for cell, n in counts.items():
            if n > block:
                heavy[cell] = max(n, heavy.get(cell, 0))
    if not heavy:
        return a, b
    # of each heavy cell about SAMPLE positions, by a threshold of their hash
    spread = 1 << 30
    rate = F.element_at(F.create_map(*[x for c, n in heavy.items() for x in (F.lit(c), F.lit(int(spread * min(1.0, SAMPLE / n))))]), F.col("cell"))
    both = a.select("cell", "lat", "lon").unionByName(b.select("cell", "lat", "lon")).where(F.col("cell").isin(list(heavy)))
    sampled = both.where(F.pmod(F.xxhash64("lat", "lon"), F.lit(spread)) < rate).distinct().groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("lat", "lon"))).alias("at"))
    second = {}
    for r in sampled.select("cell", "at.lat", "at.lon").collect():
        count = min(PIVOTS, max(2, 4 * heavy[r["cell"]] // block))
        step = max(1, len(r["lat"]) // SAMPLE)
        second[r["cell"]] = pick_pivots(unit_vectors(np.array(r["lat"][::step]), np.array(r["lon"][::step])), count)
    a = cut(a.mapInPandas(lambda it: _assign(second, None, it), schema))
    return a, cut(b.mapInPandas(lambda it: _assign(second, reach, it), schema))


def radius_join(left: DataFrame, right: DataFrame, metres: float, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """All pairs (left_id, right_id, metres) of ``left`` (id, lat, lon) and ``right`` (id, lat, lon) within ``metres``.

    Positions that are null, NaN or out of range have no neighbours; a repeated (id, position) gives one case; ties and equal
    positions are all returned; an empty side gives an empty result. Ids are integers. Other columns are ignored.
    """
    ok = usable_position(F.col("lat"), F.col("lon")) & F.col("id").isNotNull()
    radius = metres / EARTH_RADIUS_M
    sides = [
        x.where(ok).select(F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).distinct()
        for x in (left, right)
    ]
    a, b = voronoi_cells(*sides, radius, pivots, block)
    spark = left.sparkSession
    # blocks are left for what no pivots part: many points of one position, or of one radius
    blocks = {side: {c: -(-n // block) for c, n in cell_counts(df).items() if n > block} for side, df in (("a", a), ("b", b))}
    parted = sorted(blocks["a"].keys() | blocks["b"].keys())
    schema = "left_id long, right_id long, metres double"
    if parted:
        number = F.broadcast(spark.createDataFrame([(c, blocks["a"].get(c, 1), blocks["b"].get(c, 1)) for c in parted], "cell int, many_a int, many_b int"))
        a, b = (df.join(number, "cell", "left").fillna(1, ["many_a", "many_b"]) for df in (a, b))
    else:
        a, b = (df.withColumns({"many_a": F.lit(1), "many_b": F.lit(1)}) for df in (a, b))

    def blocked(df: DataFrame, mine: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64("id"), F.col(f"many_{mine}")).cast("int")
        return df.withColumn(mine, own).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"many_{other}") - 1)))

    return (
        blocked(a, "a", "b").groupBy("cell", "a", "b")
        .cogroup(blocked(b, "b", "a").groupBy("cell", "a", "b"))
        .applyInPandas(lambda x, y: _join_cell(radius, x, y), schema)
    )


def belfries_near_starts(routes: DataFrame, belfries: DataFrame, metres: float = NUMBER_OF_METRES) -> DataFrame:
    """(route_id, belfry_id, metres): for the start of each route the belfries within the distance; several versions of a route are one case."""
    starts = routes.select("id", F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"))
    places = belfries.select(F.col("belfry_id").alias("id"), "lat", "lon")
    return (
        radius_join(starts, places, metres).groupBy("left_id", "right_id").agg(F.min("metres").alias("metres"))
        .select(F.col("left_id").alias("route_id"), F.col("right_id").alias("belfry_id"), "metres")
    )
