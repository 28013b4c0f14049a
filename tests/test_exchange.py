"""Files and answers of other programs, and merging libraries."""

import io
import zipfile
import zlib

import pytest

from ridgeline.operators import merge as B
from ridgeline.sources import exchange as Z


def test_place_tables_with_headings_in_several_languages(spark):
    rows = [
        ("a.csv", 1, ["Naam", "Breedte", "Lengte", "Soort"], ["De Vos", "51,5", "4,25", "cafe"], ";"), ("b.csv", 1, ["title", "WKT"], ["X", "POINT Z (3.5 50.5 12)"], ","),
        ("c.csv", 1, ["name", "lat,lon"], ["Y", "50.1, 3.2"], ","), ("d.csv", 1, ["name", "lat", "lon"], ["Bar", "left", "51", "4"], ","), ("e.csv", 1, ["name", "lat", "lon"], ["Off", "95", "4"], ","), ("f.csv", 1, ["name"], ["None"], ","),
    ]
    got = {r["file"]: (r["name"], r["lat"], r["lon"], r["category"], r["error"]) for r in Z.placed_rows(spark.createDataFrame(rows, "file string, line_no int, header array<string>, fields array<string>, sep string")).collect()}
    assert got == {
        "a.csv": ("De Vos", 51.5, 4.25, "cafe", None), "b.csv": ("X", 50.5, 3.5, None, None), "c.csv": ("Y", 50.1, 3.2, None, None), "d.csv": ("Bar, left", 51.0, 4.0, None, None),
        "e.csv": ("Off", None, None, None, "no position"), "f.csv": ("None", None, None, None, "no position"),
    }
    one = spark.createDataFrame([("x/My map - Cafés.csv",), ("Plain.csv",)], "f string")
    assert [tuple(r[0]) for r in one.select(Z.map_and_layer(one["f"])).collect()] == [("My map", "Cafés"), ("Plain", "Plain")]


def test_waypoints_rings_and_tiles(spark):
    gpx = '<gpx><wpt lat="51" lon="4"><name>A</name><cmt>c</cmt><sym>Flag</sym><link href="http://x/y"/></wpt><wpt lat="x" lon="4"/></gpx>'
    assert [tuple(r) for r in Z.waypoints(spark.createDataFrame([("f", gpx), ("g", None), ("h", "<gpx>")], "path string, text string")).collect()] == [("f", 0, "A", 51.0, 4.0, "c", "Flag", None, "http://x/y")]
    x, y, n = 8392, 5469, 2**14
    import math

    lon, lat = (lambda t: t / n * 360 - 180), (lambda t: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * t / n)))))
    square = lambda w: " ".join(f"{lon(a)},{lat(b)},0" for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)))
    ring = lambda c: f"<Polygon><outerBoundaryIs><LinearRing><coordinates>{c}</coordinates></LinearRing></outerBoundaryIs></Polygon>"
    kml = spark.createDataFrame([("k", ring(square(1)) + ring(square(2)) + ring("1,2 3,4"))], "path string, text string")
    assert Z.rings(kml).count() == 2
    assert [tuple(r) for r in Z.explored_tiles(kml).collect()] == [("k", x, y)]


def test_archives_checksums_and_service_routes(spark):
    files = spark.createDataFrame([("z", "b/é.txt", b"x" * 500), ("z", "a.bin", bytes(range(9))), ("y", "n", None)], "archive string, path string, content binary")
    (row,) = Z.zipped(files).collect()
    with zipfile.ZipFile(io.BytesIO(bytes(row["content"]))) as z:
        assert z.namelist() == ["a.bin", "b/é.txt"] and z.read("b/é.txt") == b"x" * 500 and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    (sums,) = Z.checksums(spark.createDataFrame([("p", b"123456789"), ("q", None)], "path string, content binary")).collect()
    assert sums["crc32"] == zlib.crc32(b"123456789") and sums["crc16"] == 0xBB3D
    doc = '{"name": " ", "distance": 12345, "unpaved_pct": 20, "track_points": [{"x": 4, "y": 51, "e": 2}, {"x": 4.1, "y": 51}, {"x": 400, "y": 51}]}'
    got = Z.service_routes(spark.createDataFrame([(7, doc), (8, "{}"), (9, None)], "id long, answer string")).collect()
    assert [(r["id"], r["name"], len(r["points"]), r["paved_pct"], r["distance_km"]) for r in got] == [(7, "Route 7", 2, 80.0, 12.35)] or got[0]["distance_km"] == pytest.approx(12.35, abs=0.01)


def test_surface_of_a_matched_track(spark):
    pieces = [(1, 0, 0.0, 400.0, {"surface": "asphalt"}), (1, 1, 400.0, 700.0, {"highway": "residential"}), (1, 2, 700.0, 900.0, None), (1, 3, 900.0, 1000.0, {"surface": "gravel"}), (2, 0, 0.0, 100.0, None)]
    m = spark.createDataFrame(pieces, "id long, seq int, from_m double, to_m double, tags map<string,string>")
    one, two = B.surface_summary(m).orderBy("id").collect()
    assert (one["paved_km"], one["unpaved_km"], one["unknown_km"], one["inferred_km"], one["match_ratio"], one["paved_pct"]) == (0.7, 0.1, 0.2, 0.3, 0.8, 88) and two["paved_pct"] is None
    assert [(r["category"], r["from_m"], r["to_m"]) for r in B.surface_stretches(m).where("id = 1").orderBy("stretch").collect()] == [("paved", 0, 700), ("unknown", 700, 900), ("unpaved", 900, 1000)]
    routes = spark.createDataFrame([(1, 10.0, "manual"), (2, None, None)], "id long, paved_pct double, paved_source string")
    guess = spark.createDataFrame([(1, 88), (2, 40)], "id long, paved_pct int")
    assert {tuple(r) for r in B.applied_estimate(routes, guess).collect()} == {(1, 10.0, "manual"), (2, 40.0, "estimated")}
    assert {tuple(r) for r in B.applied_estimate(routes, guess, overwrite=True).collect()} == {(1, 88.0, "estimated"), (2, 40.0, "estimated")}


def test_names_and_merged_ids(spark):
    v = [(1, "Gent", 0.0, 9.0, "start"), (1, "Aalst", 0.3, 5.0, None), (1, "Ninove", 0.2, 4.0, None), (1, "Mons", 0.5, 6.0, None), (1, "Gent", 0.9, 9.0, None), (1, "Brugge", 1.0, 3.0, "end"), (2, None, 0.5, 1.0, None)]
    got = {r["id"]: r["name"] for r in B.generated_names(spark.createDataFrame(v, "id long, place string, pos double, score double, role string")).collect()}
    assert got == {1: "Gent – Aalst – Mons – Brugge", 2: "Unnamed route"}
    cols = "id long, file_hash string, track_index int, track_hash string"
    ids = B.id_map(spark.createDataFrame([(1, "f", 0, "t"), (2, None, 0, "u")], cols), spark.createDataFrame([(10, "f", 0, "x"), (11, None, 0, "u"), (12, "f", 1, "y"), (13, None, None, None)], cols))
    assert {tuple(r) for r in ids.collect()} == {(10, 1, False), (11, 2, False), (12, 3, True), (13, 4, True)}
    back = spark.createDataFrame([(12, [10, 99, 11, 10]), (13, None)], "id long, derived_from array<long>")
    assert [(r["id"], r["derived_from"]) for r in B.remapped_references(back, ids).collect()] == [(3, [1, 2])]
