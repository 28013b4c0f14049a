"""Profiles and statistics are made where the lines are: no profile is shuffled or handed on."""

import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from ridgeline.operators import track as K  # noqa: E402


def _lines(spark, heights=True):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        n = int(rng.integers(2, 30))
        lat, lon = 51 + np.cumsum(rng.normal(0, 0.003, n)), 4 + np.cumsum(rng.normal(0, 0.003, n))
        ele = [None if rng.random() < 0.2 else float(v) for v in rng.normal(100, 8, n)]
        rows.append((i, lat.tolist(), lon.tolist(), None if i % 11 == 0 else ele))
    return spark.createDataFrame(rows, "id long, lat array<double>, lon array<double>, ele array<double>")


def _table(spark, tmp_path):
    rows = [(i, None, [{"lat": 51 + 0.001 * i, "lon": 4.0}, {"lat": 51.2, "lon": 4.1 + 0.001 * i}]) for i in range(40)]
    spark.createDataFrame(rows, "id long, updated_at timestamp, geometry array<struct<lat double, lon double>>").write.parquet(f"{tmp_path}/library_routes.parquet")
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_columns_are_those_of_the_profiles(spark):
    lines = _lines(spark)
    for width in (7, 40):
        want = {tuple(r) for r in K.profile_columns(K.profiles(lines), width).select("id", "col", "ele").collect()}
        got = [tuple(r) for r in K.line_columns(lines, width).collect()]
        assert set(got) == want and len(got) == len(want) > 50 * width


def test_profile_columns_shuffle_no_profile(spark, tmp_path):
    # only the current versions of the routes are shuffled
    assert _plan(entry.queries()["profile_columns"](spark, _table(spark, tmp_path))).count("Exchange") == 1


def test_climb_and_kept_points_side_by_side_are_those_of_one_line(spark):
    rng = np.random.default_rng(6)
    profiles = [np.cumsum(rng.normal(0, 0.6, int(n))) for n in rng.integers(2, 300, 400)] + [np.zeros(5000), np.array([1.0, 2.0])]
    folded = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(profiles)], "k long, v array<double>").select("k", K.gain_loss_column(F.col("v")).alias("f"))
    want = np.array([tuple(r["f"]) for r in folded.orderBy("k").collect()])
    assert np.array_equal(K.gain_loss(profiles), want) and np.array_equal(K.gain_loss(profiles[:5]), want[:5])  # side by side, and one by one
    lines = [np.cumsum(rng.normal(0, 6, (int(n), 2)), axis=0) for n in rng.integers(2, 60, 100)]
    last = np.cumsum([len(v) for v in lines]) - 1
    kept = K.simplified_points(np.concatenate(lines), last - [len(v) - 1 for v in lines], last, 5.0)
    assert kept.tolist() == [int(K.simplify(v, 5.0).sum()) for v in lines]


def test_route_statistics_hand_on_no_profile(spark, tmp_path):
    assert "heights" not in _plan(entry.queries()["route_statistics"](spark, _table(spark, tmp_path)))
    assert "heights" not in K.STATS
    flat = {r["id"]: r for r in K.route_statistics(_lines(spark)).collect()}
    assert len(flat) == 150 and flat[0]["elevation_gain_m"] is None and flat[0]["min_elevation_m"] is None and flat[1]["elevation_gain_m"] is not None
