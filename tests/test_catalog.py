"""Catalogue operators against brute force and small analytic fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import catalog as G
from ridgeline.operators import trees as C


def test_connected_groups_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 300)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    loose = [(rng.randrange(2000, 2060), rng.randrange(2000, 2060)) for _ in range(40)]
    rows = chain + star + loose + [(5, 5), (None, 7), (9, 8), (8, 9)]
    got = {r["id"]: r["grp"] for r in G.connected_groups(spark.createDataFrame(rows, "a_id long, b_id long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in rows:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {x: find(x) for x in parent}
    assert G.connected_groups(spark.createDataFrame([], "a_id long, b_id long")).count() == 0


def test_variants_ignored_pairs_and_order(spark):
    pairs = spark.createDataFrame([(1, 2, 0.95, 0.4, 3.0), (3, 1, 0.9, 0.92, 1.0), (2, 3, 0.5, 0.5, 2.0)], "a_id long, b_id long, a_in_b double, b_in_a double, min_distance_m double")
    assert [tuple(r) for r in G.variants(pairs, 0.85, 0.8).collect()] == [(1, 2, 95)]
    ignored = spark.createDataFrame([(1, 3)], "a_id long, b_id long")
    assert {(r["a_id"], r["b_id"]) for r in G.without_ignored(pairs, ignored).collect()} == {(1, 2), (2, 3)}
    assert [(r["a_id"], r["position"]) for r in G.pairs_in_order(pairs).orderBy("position").collect()] == [(1, 1), (3, 2), (2, 3)]
    rides = spark.createDataFrame([(1, 7, 0.9), (1, 8, 0.95), (2, 7, 0.5), (3, 9, 0.8), (3, 4, 0.8)], "ride_id long, route_id long, b_in_a double")
    assert {tuple(r) for r in G.best_ride_match(rides).collect()} == {(1, 8), (3, 4)}


def test_deep_trees_and_cycles(spark):
    deep = [(i, i - 1 if i else None, f"n{i}") for i in range(100)] + [(200, 201, "x"), (201, 200, "y"), (300, 300, "self"), (400, 999, "lost")]
    t = spark.createDataFrame(deep, "id long, parent_id long, name string")
    inside = {tuple(r) for r in C.closure(t).select("ancestor", "id").collect()}
    assert {(a, b) for a in range(100) for b in range(a, 100)} | {(200, 201), (201, 200)} <= inside and (300, 300) in inside and (999, 400) not in inside
    path = {r["id"]: r["path"] for r in C.paths(t).collect()}
    assert path[99] == " › ".join(f"n{i}" for i in range(100)) and path[400] == "lost" and path[300] == "self" and len(path) == 104
    left = {r["id"]: r["parent_id"] for r in G.delete_collection(t.where("id < 100"), F.col("id").between(40, 60)).collect()}
    assert left[61] == 39 and 50 not in left and left[62] == 61


def test_answers_of_services(spark):
    daily = '{"daily": {"time": ["2025-05-01", "2025-05-02"], "temperature_2m_min": [3.5], "temperature_2m_max": [12, null], "precipitation_sum": null}}'
    rows = G.daily_rows(spark.createDataFrame([(1, daily), (2, None), (3, "{broken")], "id long, answer string")).collect()
    assert [tuple(r) for r in rows] == [(1, "2025-05-01", 3.5, 12.0, None), (1, "2025-05-02", None, None, None)]
    answer = '{"elements": [{"type": "node", "id": 5, "lat": 51.0, "lon": 4.0, "tags": {"amenity": "cafe", "name": "De Vos"}}, {"type": "way", "id": 6, "center": {"lat": 50.5, "lon": 3.5}, "tags": {"historic": "castle"}}, {"type": "node", "id": 7, "lat": 1.0, "lon": 2.0, "tags": {"amenity": "bank"}}, {"type": "way", "id": 8, "tags": {"tourism": "viewpoint"}}]}'
    found = G.found_places(spark.createDataFrame([(1, answer)], "id long, answer string")).collect()
    assert [(r["osm_id"], r["name"], r["category"]) for r in found] == [("node/5", "De Vos", "cafe"), ("way/6", "", "castle")]


def test_suggested_category_and_names(spark):
    row = spark.createDataFrame([("Bike shops", None, None), (None, "icons/drinking-water.png", "x"), (None, None, "My castles"), (None, None, None)], "c string, i string, l string")
    cats = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.array(F.lit(w)).alias("words")) for i, label, w in (("bike", "Bike shops", "bike"), ("water", "Water", "water"), ("castle", "Castle", "castle"))])
    assert [r[0] for r in row.select(G.suggested_category(F.col("c"), F.col("i"), F.col("l"), cats)).collect()] == ["bike", "water", "castle", None]
    names = spark.createDataFrame([(1, "Tour", 30.2), (2, "tour", 30.4), (3, "TOUR", 30.0), (4, "Other", 1.0)], "id long, name string, distance_km double")
    assert {tuple(r) for r in G.told_apart(names).collect()} == {(1, "Tour"), (2, "tour (30 km)"), (3, "TOUR (30 km, 2)"), (4, "Other")}


def test_times_and_axes(spark):
    one = spark.range(1)
    days = [dt.date(2025, 5, d) for d in (2, 3, 4)]
    got = spark.createDataFrame([(d,) for d in days], "d date").select(G.next_saturday(F.col("d"))).collect()
    assert [r[0].day for r in got] == [3, 3, 10]
    assert one.select(G.added_minutes(F.lit("23:50"), F.lit(25))).first()[0] == "00:15"
    assert one.select(G.nice_step(F.lit(730.0), 5)).first()[0] == pytest.approx(200) and one.select(G.ticks(F.lit(95.0), F.lit(310.0), F.lit(100.0))).first()[0] == [100.0, 200.0, 300.0]
    assert len(one.select(G.sample_distances(F.lit(500_000.0))).first()[0]) == 21 and one.select(G.sample_distances(F.lit(100.0))).first()[0] == [0.0, 100.0]


def test_train_patterns(spark):
    routes = spark.createDataFrame([(1, False, 50.0), (2, True, 30.0), (3, False, 20.0)], "id long, is_loop boolean, distance_km double")
    start = spark.createDataFrame([(1, 10, 1000), (2, 20, 500), (3, 30, 11_000)], "id long, target_id long, metres long")
    end = spark.createDataFrame([(1, 99, 2000), (2, 20, 700), (3, 99, 100)], "id long, target_id long, metres long")
    got = {tuple(r) for r in C.train_candidates(routes, start, end, home_id=99).collect()}
    assert got == {(1, "out", 10, 99, False, 53.9, 3900), (1, "back", 99, 10, True, 53.9, 3900), (2, "loop", 20, 20, False, 31.6, 1560)}
