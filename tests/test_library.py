"""Analytic and golden values of tracks, tiles, library rules and spatial joins."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.functions import text as X
from ridgeline.operators import library as L
from ridgeline.operators import spatial as S
from ridgeline.operators import tiles as G
from ridgeline.operators import track as K


def east(start=(51.0, 4.4), metres=5000, step=100, north=0.0, begin=0.0):
    d = np.arange(begin, begin + metres + step / 2, step)
    return (np.full(len(d), start[0] + north / 111320)).tolist(), (start[1] + d / (111320 * math.cos(math.radians(start[0])))).tolist()


def test_geodesic_distance():
    assert geo.vincenty(0, 0, 1, 0) / 1000 == pytest.approx(110.574, abs=0.01)
    assert geo.vincenty(51, 4, 51, 4) == 0


def folded(spark, *lines):
    """(gain, loss) of each line of heights."""
    rows = spark.createDataFrame([(n, [float(v) for v in line]) for n, line in enumerate(lines)], "n int, v array<double>")
    return [tuple(r["f"]) for r in rows.select("n", K.gain_loss_column(F.col("v")).alias("f")).orderBy("n").collect()]


def test_gain_loss_folds(spark):
    assert folded(spark, [0, 0.5, 0, 0.5, 0], [0, 10, 0], [0, 5, 5.5], [3], []) == [(0, 0), (10, 10), (5.5, 0), (0, 0), (0, 0)]


def test_hill_and_noise(spark):
    d = np.arange(0, 10_001, 10.0)
    hill = K.elevation_grid(d, np.interp(d, [0, 5000, 10_000], [0, 100, 0]))
    noise = K.elevation_grid(np.arange(0, 20_001, 10.0), np.random.default_rng(1).uniform(-1.5, 1.5, 2001))
    (gain, loss), (noise_gain, _) = folded(spark, hill[1], noise[1])
    assert abs(gain - 100) < 3 and abs(loss - 100) < 3 and noise_gain < 60
    grid, _ = K.elevation_grid(np.array([0, 12.0, 25.0]), np.array([1.0, np.nan, 2.0]))
    assert grid.tolist() == [0, 10, 20, 25] and K.elevation_grid(np.array([0.0, 5.0]), np.array([1.0, np.nan])) is None


def test_climbing_stretches_are_joined_by_class():
    grid = np.arange(0, 1001, 10.0)
    begin, end, cls = K.climbing_stretches(grid, np.interp(grid, [0, 400, 600, 1000], [0, 16, 16, 56]))
    assert begin.tolist() == [0, 600] and end.tolist() == [400, 1000] and cls.tolist() == [0, 2]
    assert not len(K.climbing_stretches(grid, np.zeros(len(grid)))[0])


def test_statistics_and_profile_with_heights(spark):
    la, lo = east()
    n = len(la)
    ele = [float(v) for v in np.interp(np.arange(n), [0, n // 2, n - 1], [10, 60, 10])]
    lines = spark.createDataFrame([(1, [float(v) for v in la], [float(v) for v in lo], ele), (2, [float(v) for v in la], [float(v) for v in lo], None)], "id long, lat array<double>, lon array<double>, ele array<double>")
    one, two = K.route_statistics(lines).orderBy("id").collect()
    assert abs(one["elevation_gain_m"] - 50) <= 2 and abs(one["elevation_loss_m"] - 50) <= 2 and one["min_elevation_m"] >= 10 and two["elevation_gain_m"] is None
    columns = K.profile_columns(K.profiles(lines), 20)
    assert columns.count() == 20 and columns.where("ele IS NULL").count() == 0 and columns.agg(F.max("ele")).first()[0] == pytest.approx(60, abs=2)


def test_simplify_keeps_ends_and_corners():
    xy = np.array([[0, 0], [50, 1], [100, 0], [100, 100.0]])
    assert K.simplify(xy, 5).tolist() == [True, False, True, True]


def test_parallel_and_crossing_pairs(spark):
    la, lo = east()
    lb, mb = east(north=50)
    far, fo = east(north=5000)
    part, po = east(metres=1000, begin=4000, north=10)
    rows = [(i, [{"lat": a, "lon": o} for a, o in zip(*line, strict=True)]) for i, line in enumerate([(la, lo), (lb[::-1], mb[::-1]), (far, fo), (part, po)], 1)]
    df = spark.createDataFrame(rows, "id long, geometry array<struct<lat double, lon double>>")
    got = {(r["a_id"], r["b_id"]): r for r in S.proximity_pairs(df, 100.0).collect()}
    assert set(got) == {(1, 2), (1, 4), (2, 4)}
    one = got[1, 2]
    assert one["min_distance_m"] == pytest.approx(50, abs=1) and one["a_shared_pct"] == pytest.approx(100, abs=2) and one["reversed"]
    assert got[1, 4]["b_shared_pct"] == pytest.approx(100, abs=2) and got[1, 4]["a_shared_pct"] == pytest.approx(22, abs=3) and not got[1, 4]["reversed"]


def test_perpendicular_crossing():
    a, b = np.array([[-1000.0, 0], [1000, 0]]), np.array([[0, -1000.0], [0, 1000]])
    assert S._closest(a, b) == 0
    assert S._within(a, b, 50) == pytest.approx(100, abs=0.5)


def test_antwerp_tile(spark):
    row = spark.range(1).select(geo.tile_x(F.lit(4.4025)).alias("x"), geo.tile_y(F.lit(51.2194)).alias("y")).first()
    assert (row["x"], row["y"]) == (8392, 5469)


def test_line_tiles_count_cut_corners():
    n = 2**14
    at = lambda x, y: (math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / n)))), x / n * 360 - 180)
    (a, b), (c, d) = at(8000.5, 5000.9), at(8001.4, 5001.2)
    got = G.line_tiles(np.array([a, c]), np.array([b, d]), 14).tolist()
    assert got == [[8000, 5000], [8000, 5001], [8001, 5001]]


def test_square_cluster_and_gain(spark):
    block = [(1, x, y) for x in range(10, 14) for y in range(20, 23)] + [(1, 900, 900)]
    df = spark.createDataFrame(block, "id long, x int, y int")
    assert tuple(G.largest_squares(df).first()) == (1, 3, 10, 20)
    assert [tuple(r) for r in G.clusters(df).collect()] == [(11, 21, 2)]
    wide = spark.createDataFrame([(1, x, y) for x in range(500, 530) for y in (7, 8, 9)], "id long, x int, y int")  # over a block border
    assert [tuple(r) for r in G.clusters(wide).collect()] == [(501, 8, 28)]
    assert tuple(G.gain(df, df.where("x < 12")).first()) == (1, 13, 7)


def test_point_in_polygon(spark):
    square = F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in ((0, 0), (0, 2), (2, 2), (2, 0))])
    got = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (None, 1.0)], "lat double, lon double").select(geo.point_in_polygon(F.col("lat"), F.col("lon"), square).alias("i")).collect()
    assert [r["i"] for r in got] == [True, False, False]


def test_filter_text_round_trip():
    f = L.RouteFilter.parse("activity=road&min_distance=40&loop=true&tags=a&tags=b&max_gain=x&sort=distance_km")
    assert (f.activity, f.min_distance, f.loop, f.tags, f.max_gain) == ("road", 40.0, True, ["a", "b"], None)
    assert f.canonical() == "min_distance=40&tags=a&tags=b&loop=true&activity=road"
    with pytest.raises(ValueError):
        L.RouteFilter.parse("sort=name").canonical()


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(X.slugify(F.lit("Café – Über Ｋapel!"))) == "cafe-uber-kapel"
    assert one(X.slugify(F.lit("---"))) == "route" and one(X.slugify(F.lit(None).cast("string"))) == "route"
    assert one(X.normalise_tags(F.array(F.lit(" A  b "), F.lit("a b"), F.lit(""), F.lit(None)))) == ["a b"]
    assert one(X.strip_html(F.lit("a<br>b <b>c</b>"))) == "a\nb c"
    assert one(X.route_name(F.lit("x/Start (4).gpx"), F.lit("Lus"), F.lit(1), F.lit(0))) == "Lus"
    assert one(X.route_name(F.lit("Mooie rit.gpx"), F.lit("Lus"), F.lit(1), F.lit(0))) == "Mooie rit"
    assert one(X.activity_from(F.array(F.lit("x"), F.lit("mtb_easy")))) == "gravel"
