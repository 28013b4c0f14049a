"""Pairs of lines that meet: all of them with the figures of the exact geometry, judged in one tile each, no pair shuffled."""

import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ridgeline.operators import meeting as M  # noqa: E402
from ridgeline.operators import spatial as S  # noqa: E402

METRE = 1 / 111_195.0
LINE = "id long, geometry array<struct<lat double, lon double>>"


def _lines():
    rng = np.random.default_rng(21)
    lines = []
    for i in range(1, 41):
        n = int(rng.integers(2, 60))
        turn = np.cumsum(rng.normal(0, 0.5, n))
        step = float(rng.choice([60, 700, 2500]))
        la, lo = 51 + 0.1 * rng.random() + np.cumsum(step * np.sin(turn)) * METRE, 4 + 0.1 * rng.random() + np.cumsum(step * np.cos(turn)) * METRE / 0.63
        lines.append((3 * i, la, lo))
        if i % 4 == 0:  # the same way back, and side by side
            lines += [(3 * i + 1, la[::-1], lo[::-1]), (200 - i, la + 60 * METRE, lo)]
    lines += [(500, np.array([51.0, 51.05]), np.array([3.0, 8.0])), (501, np.array([-33.0, 62.0]), np.array([151.0, 4.1]))]  # over many tiles
    lines += [(502, np.full(3, 51.05), np.full(3, 4.05)), (503, np.array([51.05, 51.05, 51.06]), np.array([4.05, 4.05, 4.05]))]  # points that do not move
    return lines


def _want(lines, metres):
    lines = sorted((i, la.tolist(), lo.tolist()) for i, la, lo in lines)
    pairs = [(*a, *b) for k, a in enumerate(lines) for b in lines[k + 1 :]]
    pdf = pd.DataFrame(pairs, columns=["a_id", "a_lat", "a_lon", "b_id", "b_lat", "b_lon"])
    return {tuple(r) for r in next(S._judge_pairs(metres, iter([pdf]))).itertuples(index=False)}


@pytest.mark.parametrize(("metres", "block"), [(100.0, 500_000), (100.0, 300), (0.0, 500_000), (3000.0, 200)])
def test_every_pair_once_with_the_exact_figures(spark, monkeypatch, metres, block):
    monkeypatch.setattr(M, "BLOCK_POINTS", block)
    lines = _lines()
    rows = [(i, [{"lat": float(a), "lon": float(o)} for a, o in zip(la, lo, strict=True)]) for i, la, lo in lines]
    df = S.proximity_pairs(spark.createDataFrame(rows, LINE), metres)
    got, want = [tuple(r) for r in df.collect()], _want(lines, metres)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan  # before: cells joined with cells, the pairs made distinct and joined with both lines


def test_small_batches_change_nothing(spark, monkeypatch):
    lines = S._lat_lon(spark.createDataFrame([(i, [{"lat": float(a), "lon": float(o)} for a, o in zip(la, lo, strict=True)]) for i, la, lo in _lines()], LINE))
    rows = [(r["id"], np.column_stack(M.geo.laea_arrays(np.array(r["lat"]), np.array(r["lon"])))) for r in lines.collect()]
    one = M.Lines(np.array([i for i, _ in rows]), np.array([len(xy) for _, xy in rows]), *(np.concatenate([xy[:, k] for _, xy in rows]) for k in (0, 1)))
    tile = int(M._tile_at(one.x[:1], one.y[:1], 64 * 250.0)[0])
    found = lambda: {tuple(r.values()) for b in M._pairs_of(one, one, 100.0, tile, 250.0) for r in b.to_pylist()}
    whole = found()
    for name, n in (("MARKS", 90), ("TESTS", 7), ("SEGMENTS", 1), ("PLACES", 40)):
        monkeypatch.setattr(M, name, n)
    assert found() == whole and len(whole) > 20
