"""Track files, place lists, share texts, the GPX round trip and the incremental import."""

import gzip
import io
import struct
import zipfile

import numpy as np
import pytest

from ridgeline.operators import algebra as A
from ridgeline.sources import trackfiles as S
from ridgeline.streaming import ingest

GPX = '﻿<?xml version="1.0"?><x:gpx><metadata><name>A &amp; B</name></metadata><trk><trkseg><trkpt lat="51" lon="4"><ele>10.5</ele></trkpt><trkpt lat="x" lon="4"/></trkseg><trkseg><trkpt lat="51.1" lon="4.1"/></trkseg></trk></x:gpx>'
TCX = "<TrainingCenterDatabase><Activities><Activity><Id>i</Id><Lap><Track><Trackpoint><Position><LatitudeDegrees>51</LatitudeDegrees><LongitudeDegrees>4</LongitudeDegrees></Position></Trackpoint><Trackpoint/></Track></Lap><Lap><Track><Trackpoint><Position><LatitudeDegrees>51.2</LatitudeDegrees><LongitudeDegrees>4.2</LongitudeDegrees></Position><AltitudeMeters>7</AltitudeMeters></Trackpoint></Track></Lap></Activity></Activities></TrainingCenterDatabase>"


def fit(order="<", cut=0):
    fields = [(0, 4, 0x85), (1, 4, 0x85), (2, 2, 0x84)]
    body = bytes([0x40, 0, 1 if order == ">" else 0]) + struct.pack(order + "H", 20) + bytes([len(fields)]) + b"".join(map(bytes, fields))
    for lat, lon, h in ((51.0, 4.0, 2550), (51.1, 4.1, 0xFFFF), (51.2, 4.2, 2600)):
        body += b"\x00" + struct.pack(order + "iiH", int(lat * 2**31 / 180), int(lon * 2**31 / 180), h)
    return bytes([14, 16]) + struct.pack("<HI", 100, len(body)) + b".FIT" + b"\0\0" + body[: len(body) - cut] + b"\0\0" * (not cut)


def test_formats():
    assert [(n, len(p)) for n, p in S.parse_gpx(GPX)] == [("A & B", 2)] and S.parse_gpx(GPX)[0][1][0] == (51.0, 4.0, 10.5)
    assert S.parse_tcx(TCX)[0][1] == [(51.0, 4.0, None), (51.2, 4.2, 7.0)]
    for order in "<>":
        points = S.parse_fit(fit(order))[0][1]
        assert [round(p[0], 5) for p in points] == [51.0, 51.1, 51.2] and [p[2] for p in points] == [10.0, None, 20.0]
    assert len(S.parse_fit(fit(cut=3))[0][1]) == 2


def test_files_through_archives_and_errors(spark):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.gpx", GPX)
        z.writestr("note.txt", "x")
        z.writestr("b.fit", fit())
    rows = [("z.zip", packed.getvalue()), ("g.gpx.gz", gzip.compress(GPX.encode())), ("bad.gpx", b"nothing"), ("empty.gpx", b"")]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = S.track_points(files).collect()
    assert sorted({(r["path"], r["entry"], r["format"]) for r in got if r["error"] is None}) == [("g.gpx.gz", "", "gpx"), ("z.zip", "a.gpx", "gpx"), ("z.zip", "b.fit", "fit")]
    assert {r["path"] for r in got if r["error"]} == {"bad.gpx", "empty.gpx"}
    assert [r[0] for r in files.select(S.format_column(files["content"])).collect()] == ["zip", "gzip", None, None]


def test_kml_layers():
    kml = "<kml><Document><name>Map</name><Folder><name>Bars</name><Placemark><name>De Vos</name><Point><coordinates>4.1,51.2,0</coordinates></Point></Placemark></Folder><Placemark><LineString><coordinates>1,2</coordinates></LineString></Placemark></Document></kml>"
    assert S.parse_kml(kml) == [("Map / Bars", "De Vos", 51.2, 4.1, None)]


def test_polyline_and_share():
    points = [(51.0, 4.0, 10), (51.00012, 3.99991, 8), (50.5, 4.5, 8)]
    assert A.decode_polyline(A.encode_polyline(points)) == points
    with pytest.raises(ValueError):
        A.decode_polyline(A.encode_polyline(points)[:-1])
    t = np.linspace(0, 20, 5000)
    name, line = A.unpack_share(A.pack_share("Lus – é", 51 + 0.2 * np.sin(t), 4 + 0.3 * np.cos(1.7 * t)))
    assert name == "Lus – é" and len(line) > 50


def test_orders_and_sections():
    assert A.shortest_order([((0, 0), (1, 0)), ((9, 0), (9, 1)), ((2, 0), (8, 0))]) == [0, 2, 1]
    part = A.section(np.array([51.0, 51.0, 51.0]), np.array([4.0, 4.01, 4.02]), 900.0, 300.0)
    assert len(part) == 3 and part[0][1] > part[1][1] > part[2][1]


def test_incremental_import_takes_each_content_once(spark, tmp_path):
    inbox, library, state = (tmp_path / n for n in ("in", "library", "state"))
    inbox.mkdir()
    (inbox / "a.gpx").write_text(GPX)
    ingest.watch(spark, str(inbox), str(library), str(state)).awaitTermination(60)
    (inbox / "b.gpx").write_text(GPX)
    (inbox / "c.tcx").write_text(TCX)
    ingest.watch(spark, str(inbox), str(library), str(state)).awaitTermination(60)
    got = spark.read.parquet(str(library))
    assert got.count() == 4 and got.select("file_hash").distinct().count() == 2
