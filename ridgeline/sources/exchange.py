"""Files and answers exchanged with other programs: place tables, waypoints, areas, explored tiles, service routes, archives and checksums."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.sources.trackfiles import _float, _usable, tolerant_xml

# Headings of the columns of a place table, in the languages of the library.
HEADINGS = {
    "name": ("name", "naam", "nom", "title", "titel", "place", "plaats"),
    "lat": ("lat", "latitude", "breedte", "breedtegraad", "y"),
    "lon": ("lon", "lng", "long", "longitude", "lengte", "lengtegraad", "x"),
    "latlon": ("latlon", "lat,lon", "lat lon", "coordinates", "coördinaten", "coordinaten", "location", "locatie", "gps"),
    "wkt": ("wkt", "geometry", "geometrie"),
    "category": ("category", "categorie", "type", "soort", "kind", "catégorie"),
    "notes": ("notes", "note", "description", "beschrijving", "omschrijving", "notities", "opmerking", "desc"),
    "url": ("url", "link", "website", "web", "photos", "foto's", "album"),
}
ZOOM = 14
CRC16_POLYNOMIAL = 0xA001  # CRC-16/ARC, reflected


def placed_rows(rows: DataFrame) -> DataFrame:
    """(file, line_no, name, lat, lon, category, notes, url, error): the places of tables ``rows`` (file, header array, fields array, sep).

    Columns are found by their headings; the position is a WKT point, one column "lat, lon" or two; with ``;`` between fields a decimal comma is
    read; surplus fields belong to the name. What has no position in range comes out with an error. Any number of files and rows.
    """
    head = F.transform("header", lambda h: F.lower(F.trim(h)))

    def column(kind: str) -> Column:
        at = [F.array_position(head, word) for word in HEADINGS[kind]]
        return F.least(*[F.when(a > 0, a) for a in at]).cast("int")

    at = {kind: F.col(f"at_{kind}") for kind in HEADINGS}
    surplus = F.size("fields") - F.size("header")
    # commas of an unquoted name
    joined = F.when(
        (surplus > 0) & at["name"].isNotNull(),
        F.concat(
            F.slice("fields", F.lit(1), at["name"] - 1), F.array(F.array_join(F.slice("fields", at["name"], surplus + 1), ", ")),
            F.slice("fields", at["name"] + surplus + 1, F.greatest(F.size("header") - at["name"], F.lit(0))),
        ),
    ).otherwise(F.col("fields"))
    said = lambda kind: F.nullif(F.trim(F.get(F.col("cells"), at[kind] - 1)), F.lit(""))
    number = lambda text: F.when(F.col("sep") == ";", F.replace(text, F.lit(","), F.lit("."))).otherwise(text).try_cast("double")
    wkt = F.regexp_extract(F.coalesce(said("wkt"), F.lit("")), r"(?i)^\s*point\s*z?\s*\(\s*(\S+)\s+([^\s)]+)", 0)
    part = lambda n: F.regexp_extract(wkt, r"(?i)\(\s*(\S+)\s+([^\s)]+)", n).try_cast("double")
    both = F.split(F.coalesce(said("latlon"), F.lit("")), r"\s*[,;\s]\s*")
    lat = F.coalesce(F.when(wkt != "", part(2)), F.get(both, F.lit(0)).try_cast("double"), number(said("lat")))
    lon = F.coalesce(F.when(wkt != "", part(1)), F.get(both, F.lit(1)).try_cast("double"), number(said("lon")))
    out = rows.withColumns({f"at_{kind}": column(kind) for kind in HEADINGS}).withColumn("cells", joined).withColumns({"y": lat, "x": lon})
    ok = F.col("y").between(-90, 90) & F.col("x").between(-180, 180)
    return out.select(
        "file", "line_no", F.coalesce(said("name"), F.lit("")).alias("name"), F.when(ok, F.col("y")).alias("lat"), F.when(ok, F.col("x")).alias("lon"),
        *(said(k).alias(k) for k in ("category", "notes", "url")), F.when(F.coalesce(ok, F.lit(False)), None).otherwise("no position").alias("error"),
    )


def map_and_layer(file: Column) -> Column:
    """struct(map, layer) of "Map - Layer.csv"; a plain name is both."""
    stem = F.regexp_replace(F.substring_index(file, "/", -1), r"\.[^.]*$", "")
    cut = F.instr(stem, " - ")
    return F.struct(F.when(cut > 0, F.substring(stem, F.lit(1), cut - 1)).otherwise(stem).alias("map"), F.when(cut > 0, F.substring(stem, cut + 3, F.length(stem))).otherwise(stem).alias("layer"))


WAYPOINTS = "path string, seq int, name string, lat double, lon double, notes string, symbol string, kind string, url string"


def _waypoints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in WAYPOINTS.split(", ")]
    for pdf in batches:
        rows = []
        for path, text in zip(pdf["path"], pdf["text"], strict=True):
            found = (n for n in tolerant_xml(text or "").deep("wpt"))
            for node in found:
                lat, lon = _float(node.attributes.get("lat")), _float(node.attributes.get("lon"))
                if _usable(lat, lon):
                    link = node.first("link")
                    rows.append((path, len(rows), node.said("name"), lat, lon, node.said("desc") or node.said("cmt"), node.said("sym"), node.said("type"), link.attributes.get("href") if link else None))
        yield pd.DataFrame(rows, columns=names).astype({"seq": "int32", "lat": "float64", "lon": "float64"})


def waypoints(texts: DataFrame) -> DataFrame:
    """The waypoints of GPX documents (path, text); a document without tracks may have some, those without a usable position are left out."""
    return texts.select("path", "text").mapInPandas(_waypoints, WAYPOINTS)


def rings(kml: DataFrame) -> DataFrame:
    """(path, seq, ring): outer rings of KML documents (path, text), as (lat, lon) in order; rings of fewer than three points are none."""
    text = F.regexp_extract_all("text", F.lit(r"(?s)<outerBoundaryIs>.*?<coordinates>([^<]*)</coordinates>"), F.lit(1))
    point = lambda t: F.struct(F.get(F.split(t, ","), F.lit(1)).try_cast("double").alias("lat"), F.get(F.split(t, ","), F.lit(0)).try_cast("double").alias("lon"))
    ring = F.filter(F.transform(F.filter(F.split(F.trim("c"), r"\s+"), lambda t: t != ""), point), lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    return kml.select("path", F.posexplode(text).alias("seq", "c")).select("path", "seq", ring.alias("ring")).where(F.size("ring") >= 3)


def explored_tiles(kml: DataFrame, slack: float = 0.05) -> DataFrame:
    """(path, x, y): the map squares of KML documents that outline one tile each; outlines of another size are left out."""
    p = rings(kml.withColumn("text", F.regexp_replace("text", "<(/?)coordinates>", "<$1coordinates>")))
    corner = p.select("path", F.transform("ring", lambda q: geo.tile_x_exact(q["lon"])).alias("xs"), F.transform("ring", lambda q: geo.tile_y_exact(q["lat"])).alias("ys"))
    box = corner.select("path", *(f(c).alias(n) for n, f, c in (("x0", F.array_min, "xs"), ("x1", F.array_max, "xs"), ("y0", F.array_min, "ys"), ("y1", F.array_max, "ys"))))
    one = (F.abs(F.col("x1") - F.col("x0") - 1) <= slack) & (F.abs(F.col("y1") - F.col("y0") - 1) <= slack)
    return box.where(one).select("path", F.floor((F.col("x0") + F.col("x1")) / 2).alias("x"), F.floor((F.col("y0") + F.col("y1")) / 2).alias("y")).distinct()


def service_routes(answers: DataFrame) -> DataFrame:
    """(id, name, points, paved_pct, distance_km) of route documents in JSON (id, answer); unusable points are left out."""
    schema = "struct<name: string, distance: double, unpaved_pct: double, track_points: array<struct<x: double, y: double, e: double>>>"
    r = answers.select("id", F.from_json("answer", schema).alias("r"))
    usable = F.filter("r.track_points", lambda p: p["y"].between(-90, 90) & p["x"].between(-180, 180))
    points = F.transform(usable, lambda p: F.struct(p["y"].alias("lat"), p["x"].alias("lon"), p["e"].alias("ele")))
    out = r.select(
        "id", F.coalesce(F.nullif(F.trim("r.name"), F.lit("")), F.concat(F.lit("Route "), F.col("id").cast("string"))).alias("name"), points.alias("points"),
        (100 - F.col("r.unpaved_pct")).alias("paved_pct"), F.round(F.col("r.distance") / 1000, 2).alias("distance_km"),
    )
    return out.where(F.size("points") >= 2)


def crc16(data: bytes) -> int:
    """CRC-16/ARC, as device files end with."""
    crc = 0
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ CRC16_POLYNOMIAL if crc & 1 else crc >> 1
    return crc


def checksums(files: DataFrame) -> DataFrame:
    """(path, crc32, crc16, sha256) of files (path, content)."""

    def sixteen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "crc32": pdf["crc32"], "crc16": [crc16(bytes(c)) for c in pdf["content"]], "sha256": pdf["sha256"]}).astype({"crc16": "int32"})

    known = files.where("content IS NOT NULL").select("path", F.crc32("content").alias("crc32"), "content", F.sha2("content", 256).alias("sha256"))
    return known.mapInPandas(sixteen, "path string, crc32 long, crc16 int, sha256 string")


def zipped(files: DataFrame) -> DataFrame:
    """(archive, content): one archive for each ``archive`` of files (archive, path, content), entries by name; what does not shrink is stored.

    One archive is one file and so one task; its size is what the user asks to have in one file.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for path, content in sorted(zip(pdf["path"], pdf["content"], strict=True)):
                entry = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
                trial = io.BytesIO()
                with zipfile.ZipFile(trial, "w", zipfile.ZIP_DEFLATED) as t:
                    t.writestr("x", bytes(content))
                entry.compress_type = zipfile.ZIP_DEFLATED if t.infolist()[0].compress_size < len(content) else zipfile.ZIP_STORED
                archive.writestr(entry, bytes(content))
        return pd.DataFrame({"archive": [pdf["archive"].iloc[0]], "content": [out.getvalue()]})

    return files.where("path IS NOT NULL AND content IS NOT NULL").groupBy("archive").applyInPandas(pack, "archive string, content binary")


def map_query(rules: list[str], boxes: Column) -> Column:
    """The text of a map query: each rule once for every box (south, west, north, east)."""
    box = lambda b: F.format_string("(%.5f,%.5f,%.5f,%.5f)", b["south"], b["west"], b["north"], b["east"])
    lines = F.flatten(F.transform(F.array(*map(F.lit, rules)), lambda r: F.transform(boxes, lambda b: F.concat(F.lit("nwr["), r, F.lit("]"), box(b), F.lit(";")))))
    return F.concat(F.lit("[out:json];("), F.array_join(lines, ""), F.lit(");out center;"))
