"""Problems 1 to 3 against plain brute force, with nulls, repeats, ties, empty tables and clashing column names."""

import datetime as dt
import random

import numpy as np
import pytest

from ridgeline.operators import near_points as N
from ridgeline.operators import references as R
from ridgeline.operators import rejects as J

T = lambda m, d=1: dt.datetime(2024, m, d, tzinfo=dt.UTC)


def test_bitmap_and_not_matches_sets():
    rng = np.random.default_rng(3)
    for span, many, few in ((200_000, 90_000, 500), (70_000, 60_000, 60_000), (10, 0, 4)):
        a, b = rng.integers(0, span, many), rng.integers(0, span, few)
        left = R.CompressedBitmap.of(a).and_not(R.CompressedBitmap.of(b)).decode()
        assert left.tolist() == sorted(set(a.tolist()) - set(b.tolist()))
        assert R.CompressedBitmap.of(b).and_not(R.CompressedBitmap.of(a)).decode().tolist() == sorted(set(b.tolist()) - set(a.tolist()))


REF = "owner_id long, field string, ref_key string, ref_time timestamp, salt int, key_range int"
REC, DEL = "field string, ref_key string, own_time timestamp, extra string", "field string, ref_key string, deleted_at timestamp"


def test_orphans_have_their_reasons(spark):
    refs = [(1, "f", "gone", T(5)), (1, "f", "gone", T(5)), (2, "f", "here", T(5)), (3, "f", "late", T(5)), (4, "f", "late", T(6, 3)), (5, "f", "dead", T(5)), (6, "f", "again", T(5)), (7, "f", None, T(5)), (8, "f", "removed", None), (9, "g", "here", T(5)), (10, "f", "timeless", T(1))]
    records = [("f", "here", None), ("f", "late", T(6, 2)), ("f", "dead", T(1)), ("f", "again", T(4)), ("f", "timeless", None), ("f", None, T(1))]
    deletions = [("f", "dead", T(1)), ("f", "again", T(3)), ("f", "again", T(2)), ("f", "removed", T(2)), ("f", "timeless", T(2))]
    df = R.orphan_references(spark.createDataFrame([(*r, 1, 2) for r in refs], REF), spark.createDataFrame([(*r, "x") for r in records], REC), spark.createDataFrame(deletions, DEL))
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted(
        [(1, "f", "gone", "missing", "2024-05"), (3, "f", "late", "late", "2024-05"), (5, "f", "dead", "deleted", "2024-05"), (8, "f", "removed", "deleted", None), (9, "g", "here", "missing", "2024-05"), (10, "f", "timeless", "deleted", "2024-01")],
        key=str,
    )


def test_orphans_of_empty_tables_and_hot_key(spark):
    none, no_rec, no_del = spark.createDataFrame([], REF), spark.createDataFrame([], REC), spark.createDataFrame([], DEL)
    assert R.orphan_references(none, no_rec, no_del).count() == 0
    hot = spark.range(3000).selectExpr("id AS owner_id", "'f' AS field", "if(id % 3 = 0, 'hot', concat('k', id)) AS ref_key", "timestamp'2024-05-01 00:00:00' AS ref_time")
    assert R.orphan_references(hot, no_rec, no_del).where("reason = 'missing'").count() == 3000


@pytest.mark.parametrize(
    ("record", "reason"),
    [
        ('"POINT (3.69 50.93)","a, b",x\r\n', None), ("point z( 3 50 1e2 ) ,a,b\r", None), ('POINT (3 50),"x"y,z', "quoting"), ('POINT (3 50),x"y,z', "quoting"), ('"POINT (3 50)" ,x,z', "quoting"),
        ('POINT (3 50),"open,z', "quoting"), ("POINT (3 50),x", "columns"), ("", "columns"), (None, "columns"), ("POINT (3 50),x,y,", "columns"), ("POINT (3 95),x,y", "value"), ("POINT (3,50),x,y", "columns"),
        ("LINESTRING (3 50),x,y", "value"), ("POINT (3 50 1 2),x,y", "value"), ("POINT (3 1e999),x,y", "value"), ("POINT (3 5_0),x,y", "value"), ("POINT Z (3 50),x,y", "value"), ("POINT (3 50 7),x,y", "value"), ("POINT (3 ５０),x,y", "value"), ('POINT (3 50),"a\nb",""', None), ("POINT (3 50),a\nb,c", None),
    ],
)
def test_each_record_has_its_first_reason(spark, record, reason):
    lines = spark.createDataFrame([(1, 1, "2-kroegtijgers.csv", 1, record)], "line_id long, upload_id long, file_name string, line_no int, raw_record string")
    assert [r["reason"] for r in J.parse_records(lines).collect()] == [reason]


def test_reader_agrees_with_the_grammar_on_noise(spark):
    rng = random.Random(5)
    alphabet = ['"', '""', ",", "a", " ", "\n", "\r", "1", "50.5", "-3e0", "\t", "é", "\\", "'"]
    rows = [(i, i % 3, rng.choice([x.file_name for x in J.LAYOUTS]), 1, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9)))) for i in range(1500)]
    rows += [(5000 + i, 1, "3-mybrevet-belfries.csv", 1, rng.choice(['"n",50.5,-3e0', 'n, 50.5 ,"1"', 'x"y",50,3', '"a""b",1,2\n'])) for i in range(300)]
    rows += [(9000, 1, "3-mybrevet-belfries.csv", 1, "x" * 1_200_000 + ",50,3"), (9000, 1, "3-mybrevet-belfries.csv", 1, "x" * 1_200_000 + ",50,3"), (9001, 1, "3-mybrevet-belfries.csv", 0, "name,lat,lon"), (9002, 1, "other.csv", 1, "x")]
    df = J.parse_records(spark.createDataFrame(rows, "line_id long, upload_id long, file_name string, line_no int, raw_record string"))
    got = {r["line_id"]: r["reason"] for r in df.collect()}
    by_name = {x.file_name: x for x in J.LAYOUTS}
    assert got == {i: J.judge(by_name[f], J.without_line_break(r))[0] for i, _, f, n, r in rows if n > 0 and f in by_name}
    assert got[9000] is None


def test_empty_line_table(spark):
    empty = spark.createDataFrame([], "line_id long, upload_id long, file_name string, line_no int, raw_record string")
    assert J.parse_records(empty).count() == 0


POINT = "id long, lat double, lon double, cell int"


def test_radius_join_is_complete(spark):
    rng = random.Random(2)
    some = lambda n, off: [(off + i, *rng.choice([(rng.uniform(50, 51), rng.uniform(3, 4)), (rng.uniform(-90, 90), rng.uniform(-180, 180)), (51.0, 4.0), (0.0, 179.999), (0.0, -179.999), (89.99, rng.uniform(-180, 180))]), 7) for i in range(n)]
    left, right = some(700, 0), some(500, 10_000)
    bad = [(1, None, 4.0, 1), (2, float("nan"), 4.0, 1), (3, 514.0, 4.0, 1), (None, 51.0, 4.0, 1), (left[5][0], *left[5][1:])]
    radius = 3000.0
    df = N.radius_join(spark.createDataFrame(left + bad, POINT), spark.createDataFrame(right, POINT), radius, pivots=16, block=60)
    got = sorted((r["left_id"], r["right_id"]) for r in df.collect())
    a, b = (N.unit_vectors(np.array([x[1] for x in s]), np.array([x[2] for x in s])) for s in (left, right))
    d = N.angle(a[:, None], b[None]) * N.EARTH_RADIUS_M
    assert got == sorted((left[i][0], right[j][0]) for i, j in zip(*np.nonzero(d <= radius), strict=True))


def test_heavy_cells_are_parted_again(spark):
    rng = np.random.default_rng(8)
    where = [np.column_stack([51 + rng.normal(0, 0.1, 6000), 4 + rng.normal(0, 0.1, 6000)]) for _ in range(2)]
    frames = [spark.createDataFrame([(i, float(a), float(o), 1) for i, (a, o) in enumerate(w)], POINT) for w in where]
    metres = 150.0
    a, b = N.voronoi_cells(frames[0].drop("cell"), frames[1].drop("cell"), metres / N.EARTH_RADIUS_M, pivots=8, block=150)
    most = max(max(N.cell_counts(a).values()), max(N.cell_counts(b).values()))
    assert a.count() == 6000 and b.count() <= 3 * 6000 and most <= 6 * 150  # 700 a cell at first, copied less than three times
    got = {(r["left_id"], r["right_id"]) for r in N.radius_join(*frames, metres, pivots=8, block=150).collect()}
    u, v = (N.unit_vectors(w[:, 0], w[:, 1]) for w in where)
    want = {(i, int(j)) for i in range(6000) for j in np.flatnonzero(N.angle(u[i][None], v) * N.EARTH_RADIUS_M <= metres)}
    assert got == want and len(want) > 1000


def test_radius_join_of_empty_sides(spark):
    empty, one = spark.createDataFrame([], POINT), spark.createDataFrame([(1, 50.0, 3.0, 0)], POINT)
    assert N.radius_join(empty, one, 100).count() == N.radius_join(one, empty, 100).count() == 0


def test_vantage_tree_with_ties():
    points = N.unit_vectors(np.full(400, 50.0), np.r_[np.full(300, 3.0), np.linspace(3, 4, 100)])
    q, m = N.VantageTree(points).within(points[:2], 1e-9)
    assert len(q) == 602
