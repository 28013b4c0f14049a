"""The join of routes proposes every pair that the geometry accepts."""

import math

import numpy as np
from ridgeline.llm import neardup

LINE = "id long, track_hash string, geometry array<struct<lat double, lon double>>"


def _line(x, y, lat, lon, noise, rng):
    """Degrees of planar metres, resampled every 40 m, with noise."""
    s = np.r_[0, np.cumsum(np.hypot(np.diff(x), np.diff(y)))]
    t = np.linspace(0, s[-1], max(2, int(s[-1] / 40)))
    x, y = np.interp(t, s, x) + rng.normal(0, noise, len(t)), np.interp(t, s, y) + rng.normal(0, noise, len(t))
    la = lat + y / neardup.METRES_PER_DEGREE
    return [(a, (o + 180) % 360 - 180) for a, o in zip(la, lon + x / neardup.METRES_PER_DEGREE / math.cos(math.radians(lat)), strict=True)]


def _grid(rng, metres):
    """A walk on east and north streets."""
    x, y, heading = [0.0], [0.0], rng.integers(0, 2)
    while metres > 0:
        leg = float(rng.integers(2, 9) * 100)
        x.append(x[-1] + leg * (heading == 0) * rng.choice([1, 1, -1]))
        y.append(y[-1] + leg * (heading == 1) * rng.choice([1, 1, -1]))
        metres, heading = metres - leg, 1 - heading
    return np.array(x), np.array(y)


def test_axis_parallel_street_grid_and_short_lines_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    rides = [_line([0, 20_000.0], [north, north], 51.0, 4.0, 0, rng) for north in (-10.0, 10.0)]
    rides += [_line([0, 20_000.0 * math.cos(k)], [0, 20_000.0 * math.sin(k)], lat, 3.0 + k, 8, rng)[:: 1 - 2 * b] for k in (0, math.pi / 4, math.pi / 2, 3 * math.pi / 4) for lat in (50.9999, 51.3) for b in (0, 1)]
    shapes = [(_grid(rng, m), 50.8 + 0.02 * k, 4.3 + 0.01 * k) for k, m in enumerate([10_000] * 6 + [37_000] * 6 + [3_000] * 8 + [300] * 6)]
    rides += [_line(*shape, lat, lon, 8, rng)[:: 1 - 2 * b] for shape, lat, lon in shapes for b in (0, 1)]
    rides += [_line(x[: max(2, int(0.93 * len(x)))], y[: max(2, int(0.93 * len(y)))], lat, lon, 5, rng) for (x, y), lat, lon in shapes]
    rides += [_line([-6_000, 6_000.0], [0, 0], -17.0, 180.0, 5, rng) for _ in range(2)]  # over the date line
    lines = [neardup.clean_line(*zip(*r, strict=True)) for r in rides]
    want = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if neardup.same_ride(lines[i], lines[j])}
    assert (0, 1) in want and len(want) > 45
    df = spark.createDataFrame([(i, None, [{"lat": float(a), "lon": float(o)} for a, o in r]) for i, r in enumerate(rides)], LINE)
    assert {tuple(r) for r in neardup.same_rides(df).collect()} == want


def test_samples_and_reach_agree_with_single_lines():
    rng = np.random.default_rng(2)
    ride = _line(*_grid(rng, 8_000), 51.0, 4.0, 8, rng)
    lines = neardup._Lines(*([list(v)] for v in zip(*ride, strict=True)))
    _, la, lo = lines.places(np.array([neardup.SAMPLES]))
    p = neardup.sample_points(neardup.clean_line(*zip(*ride, strict=True)))
    assert np.allclose(la, p[:, 0], atol=1e-9) and np.allclose(lo - 180, p[:, 1], atol=1e-9)
    # every place within 50 m of the line is in the reach
    turn, far = rng.uniform(0, 2 * np.pi, 5_000), rng.uniform(0, 50, 5_000)
    at = rng.integers(0, len(p), 5_000)
    la, lo = p[at, 0] + far * np.sin(turn) / neardup.METRES_PER_DEGREE, p[at, 1] + far * np.cos(turn) / neardup.METRES_PER_DEGREE / np.cos(np.radians(p[at, 0]))
    assert set(neardup._token(neardup._cell_key(la, (lo + 180) % 360)).tolist()) <= set(lines.reach()[1].tolist())


def test_large_classes_give_all_pairs(spark):
    rng = np.random.default_rng(5)
    ride = _line([0, 3_000.0, 5_000], [0, 2_000.0, 0], 51.0, 4.0, 0, rng)
    near = _line([0, 3_000.0, 5_000], [0, 2_000.0, 0], 51.0, 4.0, 5, rng)
    far = [_line([0, 2_000.0], [0, 500.0 * (k + 1)], 52.0 + 0.1 * k, 5.0, 0, rng) for k in range(65)]
    rides = [(k, "abc", far[k]) for k in range(65)] + [(100 + k, None, ride) for k in range(70)] + [(200 + k, None, near) for k in range(66)]
    df = spark.createDataFrame([(i, h, [{"lat": float(a), "lon": float(o)} for a, o in r]) for i, h, r in rides], LINE)
    copies = [*range(100, 170), *range(200, 266)]
    want = {(a, b) for ids in (range(65), copies) for a in ids for b in ids if a < b}
    assert {tuple(r) for r in neardup.same_rides(df).collect()} == want and len(want) == 2_080 + 136 * 135 // 2
