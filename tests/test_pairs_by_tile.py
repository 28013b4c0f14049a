"""Places along lines and covered lines by tile: nothing is shuffled by pair, and none is left out."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ridgeline.operators import spatial as S  # noqa: E402

METRE = 1 / 111_195.0
LINE = "id long, distance_km double, geometry array<struct<lat double, lon double>>"


def _walks(seed, count):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(1, count + 1):
        n = int(rng.integers(2, 40))
        turn = np.cumsum(rng.normal(0, 0.6, n))
        la, lo = 51 + 0.05 * rng.random() + np.cumsum(900 * np.sin(turn)) * METRE, 4 + 0.05 * rng.random() + np.cumsum(900 * np.cos(turn)) * METRE / 0.63
        rows.append((i, None if i % 9 == 0 else float(n), [{"lat": float(a), "lon": float(o)} for a, o in zip(la, lo, strict=True)]))
    rows.append((count + 1, 300.0, [{"lat": 51.0, "lon": 3.9}, {"lat": 51.05, "lon": 8.0}]))
    rows.append((count + 2, 1.0, [{"lat": 51.02, "lon": 4.02}] * 3))
    return rows


def test_places_along_finds_every_place_at_its_first_nearest_point(spark):
    lines = _walks(7, 40)
    rng = np.random.default_rng(8)
    places = [(int(i // 2) if i < 40 else int(i), 51 + float(rng.uniform(-0.1, 0.15)), 4 + float(rng.uniform(-0.1, 0.2))) for i in range(1500)]
    places += [(None, 51.02, 4.02), (None, 51.03, 4.02), (5000, 51.02, 4.02)]
    df = S.places_along(spark.createDataFrame(lines, LINE), spark.createDataFrame(places, "id long, lat double, lon double"), 200.0)
    want = {}
    for i, km, geometry in lines:
        xy = S._metric([p["lat"] for p in geometry], [p["lon"] for p in geometry])
        d, m = np.diff(xy, axis=0), np.hypot(*np.diff(xy, axis=0).T)
        before = np.r_[0.0, np.cumsum(m)]
        for (place, *_), p in zip(places, S._metric([p[1] for p in places], [p[2] for p in places]), strict=True):
            t = np.clip(((p - xy[:-1]) * d).sum(axis=1) / np.where(m > 0, m * m, 1), 0, 1)
            off = np.hypot(*(p - (xy[:-1] + t[:, None] * d)).T)
            k = int(off.argmin())
            if off[k] <= 200 and off[k] < want.get((i, place), (np.inf,))[0]:
                at = before[k] + t[k] * m[k]
                want[i, place] = (off[k], None if km is None else at * km / before[-1] if before[-1] else np.nan)
    rows = df.collect()
    got = {(r["route_id"], r["place_id"]): (r["km"], r["off_m"]) for r in rows}
    assert len(got) == len(rows) > 200 and set(got) == set(want)
    for key, (off, at) in want.items():
        assert abs(got[key][1] - off) <= 0.5 + 1e-6
        assert got[key][0] is None if at is None else np.isnan(got[key][0]) if np.isnan(at) else abs(got[key][0] - at) <= 0.05 + 1e-6
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan  # before: segments joined with places by cells


def test_duplicate_pairs_are_the_shared_ones_of_all_pairs(spark):
    rng = np.random.default_rng(9)
    lines = []
    for i, km, geometry in _walks(10, 25):
        la, lo = (np.array([p[c] for p in geometry]) for c in ("lat", "lon"))
        near = rng.normal(0, 8, (2, len(la))) * METRE
        for k, (a, o) in enumerate(((la, lo), (la[::-1] + near[0], lo[::-1] + near[1]), (la[: len(la) // 2 + 1], lo[: len(la) // 2 + 1]))):
            if len(a) > 1:
                lines.append((3 * i + k, km, [{"lat": float(p), "lon": float(q)} for p, q in zip(a, o, strict=True)]))
    lines += [(900, 0.1, [{"lat": 51.02, "lon": 4.02}, {"lat": 51.0201, "lon": 4.0201}])]  # covered by a line without length
    df = spark.createDataFrame(lines, LINE)
    want = {tuple(r) for r in S.proximity_pairs(df, 50.0).where("greatest(a_shared_pct, b_shared_pct) >= 85").collect()}
    got = [tuple(r) for r in S.duplicate_pairs(df, 50.0, 85.0).collect()]
    assert set(got) == want and len(got) == len(want) > 40


def test_counts_of_cells_are_those_of_all_lines(spark):
    df = spark.createDataFrame(_walks(11, 30), LINE)
    often = S._counts_of(S._lat_lon(df)).value
    own = [np.unique(S._around(S._pieces(*([p[c] for p in r[2]] for c in ("lat", "lon")))[0], S.PIECE_M / 2)) for r in _walks(11, 30)]
    assert often.sum() == sum(map(len, own))  # before: of every eighth line


def test_candidates_for_coverage_leave_out_lines_that_merely_cross(spark):
    from ridgeline.operators.covering import covering_candidates

    rng = np.random.default_rng(12)
    lines = []
    for i in range(1, 401):  # many lines in little room: nearly all meet
        turn = np.cumsum(rng.normal(0, 0.5, 24))
        la, lo = 51 + 0.08 * rng.random() + np.cumsum(900 * np.sin(turn)) * METRE, 4 + 0.12 * rng.random() + np.cumsum(900 * np.cos(turn)) * METRE / 0.63
        lines.append((i, 1.0, la, lo))
    for i in range(1, 41):  # a part of a line, and a way back beside it
        la, lo = lines[i - 1][2:]
        lines += [(1000 + i, 1.0, la[:9], lo[:9]), (2000 + i, 1.0, la[::-1] + 20 * METRE, lo[::-1])]
    df = spark.createDataFrame([(i, km, [{"lat": float(p), "lon": float(q)} for p, q in zip(la, lo, strict=True)]) for i, km, la, lo in lines], LINE)
    met = S.proximity_pairs(df, 50.0)
    want = {(r[0], r[1]) for r in met.where("greatest(a_shared_pct, b_shared_pct) >= 85").collect()}
    flat = S.cut(S._lat_lon(df))
    pairs = {tuple(sorted(r)) for r in covering_candidates(flat, 50.0, 0.8494).collect()}
    before = {tuple(sorted(r)) for r in S.cover_candidates(S._moving(flat), flat, S._counts_of(flat), 50.0, 0.8494).collect()}
    assert len(want) >= 80 and want <= pairs
    assert len(pairs) < 1.5 * len(want) < len(before)
    assert {(r[0], r[1]) for r in S.duplicate_pairs(df, 50.0, 85.0).collect()} == want


def test_blocks_of_a_tile_of_many_lines_leave_no_pair_out(spark, monkeypatch):
    from ridgeline.operators import covering

    lines = S.cut(S._lat_lon(spark.createDataFrame(_walks(13, 60) + [(i + 500, *r) for i, *r in _walks(13, 60)], LINE)))
    whole = {tuple(r) for r in covering.covering_candidates(lines, 50.0, 0.85).collect()}
    monkeypatch.setattr(covering, "BLOCK_LINES", 7)
    monkeypatch.setattr(covering, "PART_LINES", 5)
    assert {tuple(r) for r in covering.covering_candidates(lines, 50.0, 0.85).collect()} == whole and len(whole) >= 120


def test_places_along_holds_no_more_than_a_block_of_places_and_what_is_found_in_a_step(spark, monkeypatch):
    lines = spark.createDataFrame(_walks(14, 60), LINE)
    rng = np.random.default_rng(15)
    places = spark.createDataFrame([(i, 51 + float(rng.uniform(0, 0.05)), 4 + float(rng.uniform(0, 0.05))) for i in range(3000)] + [(7, 51.02, 4.02), (None, 51.03, 4.03)], "id long, lat double, lon double")
    whole = sorted(map(str, S.places_along(lines, places, 200.0).collect()))
    for name, value in (("ALONG_PLACES", 100), ("ALONG_PAIRS", 300), ("ALONG_TESTS", 64)):
        monkeypatch.setattr(S, name, value)
    df = S.places_along(lines, places, 200.0)
    assert sorted(map(str, df.collect())) == whole and len(whole) > 2000
    assert "CoGroup" not in df._jdf.queryExecution().executedPlan().toString()  # before: all that a few tiles hold, and all that was found there, at once
