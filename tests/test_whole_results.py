"""Queries return the whole job: no row cap, no probe or pair left out."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from ridgeline.operators import spatial as S  # noqa: E402

SORTED = {
    "sort_nulls_last": ("quality_rating", False), "sort_desc_nulls_last": ("elevation_gain_m", True), "sort_source_name": ("source_name", True), "sort_unknown_key": ("name", False),
}


@pytest.mark.parametrize("name", SORTED)
def test_sorts_give_every_route_its_position(spark, tmp_path, name):
    key, down = SORTED[name]
    rows = [(i, None, None if i % 7 == 0 else f"R{i % 50}", None if i % 3 == 0 else i % 5, None if i % 4 == 0 else i % 90, None if i % 6 == 0 else f"s{i % 8}") for i in range(1, 351)]
    df = spark.createDataFrame(rows, "id long, updated_at timestamp, name string, quality_rating int, elevation_gain_m int, source_name string")
    df.repartition(5).write.parquet(f"{tmp_path}/library_routes.parquet")
    at = {"id": 0, "name": 2, "quality_rating": 3, "elevation_gain_m": 4, "source_name": 5}[key]
    want = sorted(rows, key=lambda r: (r[2] is None, (r[2] or "").lower(), r[0]))
    full = sorted([r for r in want if r[at] is not None], key=lambda r: r[at].lower() if isinstance(r[at], str) else r[at], reverse=down)
    if down:  # a reversed stable sort keeps ties in order
        assert [r[at] for r in full] == sorted((r[at] for r in full), reverse=True)
    want = full + [r for r in want if r[at] is None]
    got = sorted((r["position"], r["id"]) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    assert got == [(n, r[0]) for n, r in enumerate(want, 1)]


def test_similar_to_set_answers_every_probe(spark, tmp_path):
    rng = np.random.default_rng(3)
    metre = 1 / 111_195.0
    rides = []
    for k in range(24):
        n = int(rng.integers(3, 120))
        turn = np.cumsum(rng.normal(0, 0.5, n))
        y, x = np.cumsum(200 * np.sin(turn)), np.cumsum(200 * np.cos(turn))
        la, lo = 51 + 0.01 * k + y * metre, 4 + x * metre / 0.63
        near = rng.normal(0, 10, (2, n)) * metre
        rides += [(la, lo), (la[::-1] + near[0], lo[::-1] + near[1]), (la[: n // 2 + 2], lo[: n // 2 + 2]), (la[: int(0.9 * n)], lo[: int(0.9 * n)])]
    rides += [(np.full(2, 51.0 + north * metre), np.array([4.0, 4.3])) for north in (0, 20)]
    rows = [(i, None, [{"lat": float(a), "lon": float(o)} for a, o in zip(*r, strict=True)]) for i, r in enumerate(rides, 1)]
    df = spark.createDataFrame(rows, "id long, updated_at timestamp, geometry array<struct<lat double, lon double>>")
    df.write.parquet(f"{tmp_path}/library_routes.parquet")
    lines = {i: S._metric(*r) for i, r in enumerate(rides, 1)}
    length = {i: float(np.hypot(*np.diff(v, axis=0).T).sum()) for i, v in lines.items()}
    share = {(a, b): round(S._within(lines[a], lines[b], 50.0) / length[a], 3) for a in lines for b in lines if a != b}
    every = {(a, b, x, share[b, a]) for (a, b), x in share.items() if max(x, share[b, a]) >= 0.85}
    all_probes = S.similar_to_each(df, df)
    assert {tuple(r)[:4] for r in all_probes.collect()} == every and len(every) > 100
    got = {tuple(r)[:4] for r in entry.queries()["similar_to_set"](spark, str(tmp_path)).collect()}
    assert got == {r for r in every if r[0] % 20 == 0} and len({r[0] for r in got}) > 1
