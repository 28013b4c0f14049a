"""Track files (GPX, TCX, FIT, gzip and zip around them) and place lists (KML, KMZ, CSV) as DataFrames, and the GPX writer.

Files come as ``binaryFile`` rows and are parsed where they lie, one file a row, by ``mapInPandas``; a file that cannot be read gives a row with
its error, never a failed job. The XML reader is tolerant: prefixes are dropped, stray close tags ignored.
"""

from __future__ import annotations

import gzip
import html
import io
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACK_NAMES = r"(?i)\.(gpx|tcx|fit)(\.gz)?$"
POINTS = "path string, entry string, format string, track_index int, track_name string, seq int, lat double, lon double, ele double, error string"
PLACES = "path string, layer string, name string, lat double, lon double, description string, error string"


@dataclass
class Node:
    tag: str
    attributes: dict[str, str]
    children: list[Node] = field(default_factory=list)
    text: str = ""

    def all(self, tag: str) -> list[Node]:
        return [c for c in self.children if c.tag == tag]

    def first(self, *tags: str) -> Node | None:
        node: Node | None = self
        for tag in tags:
            node = next((c for c in node.children if c.tag == tag), None) if node else None
        return node

    def said(self, *tags: str) -> str | None:
        node = self.first(*tags)
        return node.text.strip() or None if node else None

    def deep(self, tag: str) -> Iterator[Node]:
        for c in self.children:
            if c.tag == tag:
                yield c
            yield from c.deep(tag)


_PIECE = re.compile(r"<!\[CDATA\[(.*?)\]\]>|<!--.*?-->|<\?.*?\?>|<![^>]*>|<(/?)([^\s/>]+)([^>]*?)(/?)>|([^<]+)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def tolerant_xml(text: str) -> Node:
    root = Node("", {})
    stack = [root]
    for m in _PIECE.finditer(text.lstrip("﻿")):
        cdata, close, name, attributes, empty, plain = m.groups()
        if cdata is not None:
            stack[-1].text += cdata
        elif plain is not None:
            stack[-1].text += html.unescape(plain)
        elif name:
            tag = name.split(":")[-1].lower()
            if close:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), None)
                if depth:
                    del stack[depth:]
            else:
                node = Node(tag, {k.split(":")[-1].lower(): html.unescape(a or b) for k, a, b in _ATTRIBUTE.findall(attributes)})
                stack[-1].children.append(node)
                if not empty:
                    stack.append(node)
    return root


def _float(text: str | None) -> float | None:
    try:
        value = float(text) if text is not None else None
    except ValueError:
        return None
    return value if value is not None and abs(value) != float("inf") and value == value else None


def _usable(lat: float | None, lon: float | None) -> bool:
    return lat is not None and lon is not None and abs(lat) <= 90 and abs(lon) <= 180


Track = tuple[str | None, list[tuple[float, float, float | None]]]


def parse_gpx(text: str) -> list[Track]:
    gpx = tolerant_xml(text).first("gpx")
    if gpx is None:
        raise ValueError("no GPX document")
    read = lambda nodes: [(a, o, _float(p.said("ele"))) for p in nodes if _usable(a := _float(p.attributes.get("lat")), o := _float(p.attributes.get("lon")))]
    name = gpx.said("metadata", "name") or gpx.said("name")
    tracks = [(t.said("name") or name, read(t.deep("trkpt"))) for t in gpx.all("trk")]
    found = [t for t in tracks if len(t[1]) >= 2] or [(r.said("name") or name, p) for r in gpx.all("rte") if len(p := read(r.all("rtept"))) >= 2]
    if not found:
        raise ValueError("no track with two points")
    return found


def parse_tcx(text: str) -> list[Track]:
    root = tolerant_xml(text)
    out = []
    for one in [*root.deep("activity"), *root.deep("course")]:
        points = []
        for p in one.deep("trackpoint"):
            a, o = _float(p.said("position", "latitudedegrees")), _float(p.said("position", "longitudedegrees"))
            if _usable(a, o):
                points.append((a, o, _float(p.said("altitudemeters"))))
        if len(points) >= 2:
            out.append((one.said("name") or one.said("id"), points))
    if not out:
        raise ValueError("no track with two positions")
    return out


# Fixed values of the FIT protocol: base types (size, struct code, value that means none) by their number.
FIT_TYPES = {
    0x00: (1, "B", 0xFF), 0x01: (1, "b", 0x7F), 0x02: (1, "B", 0xFF), 0x83: (2, "h", 0x7FFF), 0x84: (2, "H", 0xFFFF), 0x85: (4, "i", 0x7FFFFFFF), 0x86: (4, "I", 0xFFFFFFFF),
    0x88: (4, "f", None), 0x89: (8, "d", None), 0x0A: (1, "B", 0), 0x8B: (2, "H", 0), 0x8C: (4, "I", 0), 0x0D: (1, "B", 0xFF), 0x8E: (8, "q", 2**63 - 1), 0x8F: (8, "Q", 2**64 - 1), 0x90: (8, "Q", 0),
}
FIT_RECORD = 20


def parse_fit(data: bytes) -> list[Track]:
    """Positions of the record messages of one file or of chained ones; a cut-off file keeps what was read."""
    points: list[tuple[float, float, float | None]] = []
    begin = 0
    while begin + 12 <= len(data) and data[begin + 8 : begin + 12] == b".FIT":
        header, size = data[begin], struct.unpack_from("<I", data, begin + 4)[0]
        at, end = begin + header, min(len(data), begin + header + size)
        known: dict[int, tuple[int, str, list[tuple[int, int, int]], int]] = {}
        while at < end:
            head = data[at]
            at += 1
            if head & 0x40 and not head & 0x80:  # a definition
                if at + 5 > end:
                    break
                order = ">" if data[at + 1] else "<"
                message, count = struct.unpack_from(order + "H", data, at + 2)[0], data[at + 4]
                at += 5
                fields = [tuple(data[at + 3 * i : at + 3 * i + 3]) for i in range(count) if at + 3 * i + 3 <= end]
                at += 3 * count
                extra = 0
                if head & 0x20 and at < end:
                    n = data[at]
                    extra = sum(data[at + 2 + 3 * i] for i in range(n) if at + 2 + 3 * i < end)
                    at += 1 + 3 * n
                known[head & 15] = (message, order, fields, extra)
                continue
            local = (head >> 5) & 3 if head & 0x80 else head & 15
            if local not in known:
                break
            message, order, fields, extra = known[local]
            if at + sum(f[1] for f in fields) + extra > end:
                break
            values: dict[int, float] = {}
            for number, length, kind in fields:
                width, code, none = FIT_TYPES.get(kind, (0, "", None))
                if message == FIT_RECORD and width and length == width:
                    value = struct.unpack_from(order + code, data, at)[0]
                    if value != none:
                        values[number] = value
                at += length
            at += extra
            if message == FIT_RECORD and 0 in values and 1 in values:
                a, o = values[0] * 180 / 2**31, values[1] * 180 / 2**31
                height = values.get(78, values.get(2))
                if _usable(a, o):
                    points.append((a, o, height / 5 - 500 if height is not None else None))
        begin += header + size + 2
    if len(points) < 2:
        raise ValueError("no positions")
    return [(None, points)]


def detect_format(content: bytes) -> str | None:
    head = content[:2048]
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if content[8:12] == b".FIT":
        return "fit"
    if head[:4] == b"PK\x03\x04":
        return "zip"
    low = head.lower()
    return "tcx" if b"<trainingcenterdatabase" in low else "gpx" if b"<gpx" in low else None


def format_column(content: Column) -> Column:
    """The same sniffing as a Column, without a Python worker."""
    head = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    return (
        F.when(F.hex(F.substring(content, 1, 2)) == "1F8B", "gzip").when(F.hex(F.substring(content, 9, 4)) == "2E464954", "fit").when(F.hex(F.substring(content, 1, 4)) == "504B0304", "zip")
        .when(F.contains(head, F.lit("<trainingcenterdatabase")), "tcx").when(F.contains(head, F.lit("<gpx")), "gpx")
    )


def parse_file(content: bytes, entry: str = "") -> Iterator[tuple[str, str, list[Track]]]:
    """(entry, format, tracks) of a file, through gzip and zip."""
    kind = detect_format(content)
    if kind == "gzip":
        yield from parse_file(gzip.decompress(content), entry)
    elif kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                if re.search(TRACK_NAMES, name):
                    yield from parse_file(z.read(name), name)
    elif kind == "fit":
        yield entry, "fit", parse_fit(content)
    elif kind == "tcx":
        yield entry, "tcx", parse_tcx(content.decode("utf-8", "replace"))
    else:
        yield entry, "gpx", parse_gpx(content.decode("utf-8", "replace"))


def _track_points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in POINTS.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"track_index": "Int32", "seq": "Int32", "lat": "float64", "lon": "float64", "ele": "float64"})
    rows: list[tuple] = []
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            kept = len(rows)
            try:
                for entry, kind, tracks in parse_file(bytes(content)):
                    for n, (name, points) in enumerate(tracks):
                        rows += [(path, entry, kind, n, name, i, a, o, e, None) for i, (a, o, e) in enumerate(points)]
            except Exception as error:  # noqa: BLE001 - any unreadable file is a row with its error
                del rows[kept:]
                rows.append((path, "", None, None, None, None, None, None, None, f"{type(error).__name__}: {error}"[:300]))
            if len(rows) >= 50_000:
                yield frame(rows)
                rows = []
    yield frame(rows)


def track_points(files: DataFrame) -> DataFrame:
    """Points of all tracks of ``files`` (path, content); unreadable files give one row with ``error``."""
    return files.select("path", "content").mapInPandas(_track_points, POINTS)


def read_track_files(spark: SparkSession, folder: str) -> DataFrame:
    return track_points(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def parse_kml(text: str) -> list[tuple[str, str, float, float, str | None]]:
    """(layer, name, lat, lon, description) of placemark points; folder names are joined."""
    out = []

    def walk(node: Node, layer: list[str]) -> None:
        for c in node.children:
            if c.tag == "placemark":
                point = next(c.deep("point"), None)
                numbers = [_float(v) for v in (point.said("coordinates") or "").split(",")] if point else []
                if len(numbers) >= 2 and _usable(numbers[1], numbers[0]):
                    out.append((" / ".join(layer), c.said("name") or "Unnamed place", numbers[1], numbers[0], c.said("description")))
            else:
                walk(c, [*layer, c.said("name")] if c.tag in ("folder", "document") and c.said("name") else layer)

    walk(tolerant_xml(text), [])
    return out


def _kml_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in PLACES.split(", ")]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                data = bytes(content)
                if data[:4] == b"PK\x03\x04":
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        names = [n for n in z.namelist() if n.lower().endswith(".kml")]
                        data = z.read("doc.kml" if "doc.kml" in names else names[0])
                rows = [(path, *place, None) for place in parse_kml(data.decode("utf-8", "replace"))]
            except Exception as error:  # noqa: BLE001
                rows = [(path, None, None, None, None, None, f"{type(error).__name__}: {error}"[:300])]
            yield pd.DataFrame(rows, columns=columns).astype({"lat": "float64", "lon": "float64"})


def kml_places(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(_kml_places, PLACES)


def gpx_texts(points: DataFrame) -> DataFrame:
    """(id, gpx) documents of (id, name, seq, lat, lon, ele): seven decimals, one for the elevation."""
    escaped = F.replace(F.replace(F.replace("name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    ele = F.when(F.col("ele").isNotNull(), F.format_string("<ele>%.1f</ele>", "ele")).otherwise("")
    point = F.concat(F.format_string('<trkpt lat="%.7f" lon="%.7f">', "lat", "lon"), ele, F.lit("</trkpt>"))
    lines = points.select("id", "name", F.struct("seq", point.alias("x")).alias("p")).groupBy("id").agg(F.max(escaped).alias("name"), F.array_sort(F.collect_list("p")).alias("p"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="ridgeline" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'
    return lines.select("id", F.concat(F.lit(head), F.coalesce("name", F.lit("")), F.lit("</name><trkseg>"), F.array_join("p.x", ""), F.lit("</trkseg></trk></gpx>\n")).alias("gpx"))
