"""Explorer tiles: coverage of lines, gain against tile sets, comparison, largest square and cluster."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.session import cut


def point_tiles(points: DataFrame, zoom: int = geo.TILE_ZOOM) -> DataFrame:
    """(id, x, y) distinct tiles of the points."""
    return points.select("id", geo.tile_x(F.col("lon"), zoom).alias("x"), geo.tile_y(F.col("lat"), zoom).alias("y")).distinct()


def line_tiles(lat: np.ndarray, lon: np.ndarray, zoom: int) -> np.ndarray:
    """(n, 2) distinct tiles a line passes, in order: where it crosses grid lines, tile by tile, so that cut corners count."""
    n = 2**zoom
    phi = np.radians(np.clip(lat, -85.0511, 85.0511))
    fx, fy = (lon + 180) / 360 * n, (1 - np.log(np.tan(phi) + 1 / np.cos(phi)) / math.pi) / 2 * n
    out = [(fx[:1], fy[:1])]
    for ax, ay, bx, by in zip(fx[:-1], fy[:-1], fx[1:], fy[1:], strict=True):
        cuts = [np.array([0.0, 1.0])]
        for a, b in ((ax, bx), (ay, by)):
            low, high = math.floor(min(a, b)) + 1, math.ceil(max(a, b))
            if high > low:
                cuts.append((np.arange(low, high) - a) / (b - a))
        t = np.unique(np.concatenate(cuts))
        mid = (t[1:] + t[:-1]) / 2
        out.append((np.r_[ax + mid * (bx - ax), bx], np.r_[ay + mid * (by - ay), by]))
    x = np.clip(np.floor(np.concatenate([o[0] for o in out])), 0, n - 1).astype(np.int64)
    y = np.clip(np.floor(np.concatenate([o[1] for o in out])), 0, n - 1).astype(np.int64)
    _, first = np.unique(x * n + y, return_index=True)
    order = np.sort(first)
    return np.column_stack([x[order], y[order]])


def _walk(zoom: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts = [line_tiles(np.asarray(a, float), np.asarray(o, float), zoom) for a, o in zip(pdf["lat"], pdf["lon"], strict=True)]
        if not parts:
            continue
        sizes = [len(p) for p in parts]
        both = np.concatenate(parts)
        seq = np.concatenate([np.arange(s) for s in sizes])
        yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), sizes), "seq": seq.astype(np.int32), "x": both[:, 0].astype(np.int32), "y": both[:, 1].astype(np.int32)})


def walked_tiles(routes: DataFrame, zoom: int = geo.TILE_ZOOM) -> DataFrame:
    """(id, seq, x, y): every tile a line passes through, in the order it reaches them."""
    lines = routes.select("id", F.col("geometry.lat").alias("lat"), F.col("geometry.lon").alias("lon"))
    return lines.mapInPandas(lambda it: _walk(zoom, it), "id long, seq int, x int, y int")


def gain(route_tiles: DataFrame, explored: DataFrame, missing_mode: bool = False) -> DataFrame:
    """(id, tiles, fresh): tiles of a route, and those not yet explored (or, for a set of missing tiles, in it)."""
    known = explored.select("x", "y").distinct().withColumn("there", F.lit(True))
    there = F.coalesce("there", F.lit(False))
    fresh = there if missing_mode else ~there
    return route_tiles.select("id", "x", "y").distinct().join(known, ["x", "y"], "left").groupBy("id").agg(F.count(F.lit(1)).alias("tiles"), F.count_if(fresh).alias("fresh"))


def boxes(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def tile_state(in_set: Column, inside_box: Column, missing_mode: bool) -> Column:
    """explored, missing or unknown: a set of missing tiles only knows its own box."""
    if not missing_mode:
        return F.when(in_set, "explored").otherwise("missing")
    return F.when(in_set, "missing").when(inside_box, "explored").otherwise("unknown")


def compare(tiles: DataFrame, a: DataFrame, b: DataFrame, a_missing: bool = False, b_missing: bool = False) -> DataFrame:
    """(x, y, state) of tiles as two riders see them: both, a, b, shared, or null when nothing is known."""

    def side(df: DataFrame, rows: DataFrame, missing: bool, name: str) -> DataFrame:
        keys = rows.select("x", "y").distinct().withColumn("hit", F.lit(True))
        box = F.broadcast(rows.agg(F.min("x").alias("bx0"), F.max("x").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1")))  # one row
        inside = F.coalesce(F.col("x").between(F.col("bx0"), F.col("bx1")) & F.col("y").between(F.col("by0"), F.col("by1")), F.lit(False))
        state = tile_state(F.coalesce("hit", F.lit(False)), inside, missing)
        return df.join(keys, ["x", "y"], "left").crossJoin(box).withColumn(name, state).drop("hit", "bx0", "bx1", "by0", "by1")

    both = side(side(tiles.select("x", "y").distinct(), a, a_missing, "sa"), b, b_missing, "sb")
    ea, eb = F.col("sa") == "explored", F.col("sb") == "explored"
    state = F.when(ea & eb, "both").when(ea, "a").when(eb, "b").when((F.col("sa") == "missing") & (F.col("sb") == "missing"), "shared")
    return both.select("x", "y", state.alias("state"))


def inner_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles with all four neighbours in the set: four semi-joins, here one aggregation over shifted copies."""
    t = tiles.select("x", "y").distinct()
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    near = t.select("x", "y", around.alias("s")).select((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), ((F.col("s.dx") == 0) & (F.col("s.dy") == 0)).alias("own"))
    return near.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).where("n = 5 AND own").select("x", "y")


BLOCK = 512
_SHIFT = 1 << 20


def _block_components(pdf: pd.DataFrame) -> pd.DataFrame:
    """4-connected components of the tiles of one block (at most BLOCK**2): label each tile by its component's least key."""
    keys = np.sort((pdf["x"].to_numpy(np.int64) * _SHIFT + pdf["y"].to_numpy(np.int64)))
    label = np.arange(len(keys))
    links = []
    for step in (1, _SHIFT):
        at = np.minimum(np.searchsorted(keys, keys + step), len(keys) - 1)
        (hit,) = np.nonzero(keys[at] == keys + step)
        links.append((hit, at[hit]))
    a, b = (np.concatenate(v) for v in zip(*links, strict=True))
    while True:  # least labels over links, then labels of labels
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    return pd.DataFrame({"x": (keys // _SHIFT).astype(np.int32), "y": (keys % _SHIFT).astype(np.int32), "label": keys[label]})


def clusters(tiles: DataFrame) -> DataFrame:
    """(cluster_x, cluster_y, size) of 4-connected groups of inner tiles, named by their least tile.

    Components are found inside blocks of the grid, a bounded group each; only components that touch across block borders are then
    merged, by least labels over that small graph, its lineage cut by a reliable checkpoint each round.
    """
    blocked = inner_tiles(tiles).groupBy(F.floor(F.col("x") / BLOCK).alias("bx"), F.floor(F.col("y") / BLOCK).alias("by"))
    local = cut(blocked.applyInPandas(_block_components, "x int, y int, label long"))
    sizes = local.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    pairs = []
    for x, y in ((1, 0), (0, 1)):
        edge = local.where((F.col("x") + 1) % BLOCK == 0) if x else local.where((F.col("y") + 1) % BLOCK == 0)
        other = local.select((F.col("x") - x).alias("x"), (F.col("y") - y).alias("y"), F.col("label").alias("to"))
        pairs.append(edge.join(other, ["x", "y"]).select("label", "to").where("label <> to"))
    links = pairs[0].unionByName(pairs[1]).distinct()
    links = cut(links.unionByName(links.select(F.col("to").alias("label"), F.col("label").alias("to"))).distinct())
    state = cut(links.select("label").distinct().withColumn("least", F.col("label")))
    while True:
        sent = links.join(state.select(F.col("label").alias("to"), F.col("least").alias("theirs")), "to").groupBy("label").agg(F.min("theirs").alias("theirs"))
        nxt = cut(state.join(sent, "label").select("label", F.least("least", "theirs").alias("least"), (F.col("theirs") < F.col("least")).alias("moved")))
        state = nxt.select("label", "least")
        if not nxt.where("moved").limit(1).count():
            break
    merged = sizes.join(state, "label", "left").groupBy(F.coalesce("least", "label").alias("cluster")).agg(F.sum("n").alias("size"))
    return merged.select(F.floor(F.col("cluster") / _SHIFT).cast("int").alias("cluster_x"), (F.col("cluster") % _SHIFT).cast("int").alias("cluster_y"), "size")


def _square(pdf: pd.DataFrame) -> pd.DataFrame:
    """The dynamic programme over rows of one set, with only the row above in memory."""
    above: dict[int, int] = {}
    best = (0, 0, 0)
    last_y = None
    for y, row in pdf.sort_values(["y", "x"]).groupby("y", sort=True):
        if last_y is None or y != last_y + 1:
            above = {}
        now: dict[int, int] = {}
        for x in row["x"].tolist():
            s = 1 + min(now.get(x - 1, 0), above.get(x, 0), above.get(x - 1, 0))
            now[x] = s
            if s > best[0]:
                best = (s, x - s + 1, y - s + 1)
        above, last_y = now, y
    return pd.DataFrame({"id": [pdf["id"].iloc[0]], "size": [best[0]], "x": [best[1]], "y": [best[2]]}).astype({"size": "int32", "x": "int32", "y": "int32"})


def largest_squares(tiles: DataFrame) -> DataFrame:
    """(id, size, x, y) of each set's largest full square, its top-left tile; a set of tiles is bounded by the map's grid."""
    return tiles.select("id", "x", "y").distinct().groupBy("id").applyInPandas(_square, "id long, size int, x int, y int")
