"""Queries of tracks, tiles and spatial joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.operators import spatial as S
from ridgeline.operators import tiles as X
from ridgeline.operators import track as K
from ridgeline.plans import Registry
from ridgeline.plans.library_queries import ROUTES, routes_of
from ridgeline.session import load

registry = Registry()

LINES = ROUTES + ", lines AS (SELECT * FROM routes WHERE len(geometry) >= 2 AND len(list_filter(geometry, lambda p: NOT (p.lat BETWEEN -90 AND 90 AND p.lon BETWEEN -180 AND 180))) = 0) "
POINTS = LINES + ", pts AS (SELECT id, generate_subscripts(geometry, 1) - 1 AS seq, unnest(geometry) AS p FROM lines), points AS (SELECT id, seq, p.lat AS lat, p.lon AS lon FROM pts) "
SEGMENTS = POINTS + ", segs AS (SELECT a.id, a.seq, a.lat, a.lon, b.lat AS lat2, b.lon AS lon2 FROM points a JOIN points b ON a.id = b.id AND b.seq = a.seq + 1) "


def _laea_sql(source: str, columns: str, pairs: tuple[tuple[str, str, str], ...]) -> str:
    """Nested selects that add planar x<suffix>, y<suffix> for each (lat, lon, suffix)."""
    sb = ", ".join(
        f"(({1 - geo.E2!r} * (sin(radians({la})) / (1 - {geo.E2!r} * sin(radians({la})) * sin(radians({la}))) - ln((1 - {geo._E!r} * sin(radians({la}))) / (1 + {geo._E!r} * sin(radians({la})))) / {2 * geo._E!r})) / {geo._QP!r}) AS sb{s}"
        for la, _, s in pairs
    )
    k = ", ".join(f"{geo._RQ!r} * sqrt(2 / (1 + {geo._SB!r} * sb{s} + {geo._CB!r} * sqrt(1 - sb{s} * sb{s}) * cos(radians({lo}) - {geo.ORIGIN_LON!r}))) AS k{s}" for _, lo, s in pairs)
    xy = ", ".join(
        f"{geo.FALSE_EASTING} + k{s} * {geo._D!r} * sqrt(1 - sb{s} * sb{s}) * sin(radians({lo}) - {geo.ORIGIN_LON!r}) AS x{s}, "
        f"{geo.FALSE_NORTHING} + k{s} / {geo._D!r} * ({geo._CB!r} * sb{s} - {geo._SB!r} * sqrt(1 - sb{s} * sb{s}) * cos(radians({lo}) - {geo.ORIGIN_LON!r})) AS y{s}"
        for _, lo, s in pairs
    )
    return f"(SELECT *, {xy} FROM (SELECT *, {k} FROM (SELECT {columns}, {sb} FROM {source})))"


METRIC = SEGMENTS + ", metric AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS m FROM " + _laea_sql("segs", "*", (("lat", "lon", "1"), ("lat2", "lon2", "2"))) + ") "
FLAT = "sqrt(power((lat2 - lat) * 110540, 2) + power((lon2 - lon) * cos(radians((lat + lat2) / 2)) * 111320, 2))"
FX, FY = "least(16383, greatest(0, floor((lon + 180) / 360 * 16384)))", f"least(16383, greatest(0, floor((1 - ln(tan(radians(greatest(-85.0511, least(85.0511, lat)))) + 1 / cos(radians(greatest(-85.0511, least(85.0511, lat))))) / {math.pi!r}) / 2 * 16384)))"
PLACES = "places AS (SELECT DISTINCT id AS place_id, name, lat, lon FROM poi WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) "
#: Towns and stations derived from the suppliers by hashed keys.
TOWN_LAT, TOWN_LON = "50.5 + ((s_suppkey * 15485863) % 1000000) / 1000000.0", "2.6 + ((s_suppkey * 32452843) % 3200000) / 1000000.0"


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.usable_lines(routes_of(spark, sf_dir))


def towns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey AS bigint) AS id", "s_name AS name", "s_nationkey AS nation", "cast(s_acctbal AS double) AS population", f"cast({TOWN_LAT} AS double) AS lat", f"cast({TOWN_LON} AS double) AS lon")


_TOWNS = f"towns AS (SELECT s_suppkey AS id, s_nationkey AS nation, CAST({TOWN_LAT} AS DOUBLE) AS lat, CAST({TOWN_LON} AS DOUBLE) AS lon FROM supplier) "


@registry.query("planar_length", METRIC + "SELECT id, floor(sum(m) / 10 + 0.5) AS decametres FROM metric GROUP BY id")
def planar_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.planar_length(lines_of(spark, sf_dir)).select("id", F.floor(F.col("metres") / 10 + 0.5).alias("decametres"))


@registry.query("flat_length", SEGMENTS + f"SELECT id, floor(sum({FLAT}) / 10 + 0.5) AS decametres FROM segs GROUP BY id")
def flat_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.flat_length(lines_of(spark, sf_dir)).select("id", F.floor(F.col("metres") / 10 + 0.5).alias("decametres"))


@registry.query("flat_cumulative", SEGMENTS + f"SELECT id, seq, floor(sum({FLAT}) OVER (PARTITION BY id ORDER BY seq) / 10 + 0.5) AS decametres FROM segs")
def flat_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cumulative_flat(lines_of(spark, sf_dir)).select("id", "seq", F.floor(F.col("metres") / 10 + 0.5).alias("decametres"))


@registry.query("line_extents", LINES + "SELECT id, list_min(list_transform(geometry, lambda p: p.lat)) AS min_lat, list_max(list_transform(geometry, lambda p: p.lat)) AS max_lat, list_min(list_transform(geometry, lambda p: p.lon)) AS min_lon, list_max(list_transform(geometry, lambda p: p.lon)) AS max_lon, geometry[1].lat AS start_lat, geometry[1].lon AS start_lon, geometry[-1].lat AS end_lat, geometry[-1].lon AS end_lon FROM lines")
def line_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.extents(lines_of(spark, sf_dir)).drop("is_loop")


@registry.query("bearings", SEGMENTS + f", b AS (SELECT id, seq, degrees(atan2((lon2 - lon) * cos(radians((lat + lat2) / 2)), lat2 - lat)) AS d FROM segs WHERE lat <> lat2 OR lon <> lon2) SELECT id, seq, floor((d + 360) % 360 * 1000 + 0.5) % 360000 AS bearing_milli, (list_value({', '.join(repr(c) for c in geo.COMPASS)}))[CAST(floor((d + 360) % 360 / 22.5 + 0.5) AS INT) % 16 + 1] AS compass FROM b")
def bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = K.headings(lines_of(spark, sf_dir))
    return h.select("id", "seq", (F.floor(F.col("bearing") * 1000 + 0.5) % 360000).alias("bearing_milli"), geo.compass(F.col("bearing")).alias("compass"))


@registry.query("laea_roundtrip", POINTS + "SELECT id, seq, floor(floor(lat * 1e6 + 0.5) / 10 + 0.5) AS lat_e5, floor(floor(lon * 1e6 + 0.5) / 10 + 0.5) AS lon_e5 FROM points WHERE lat BETWEEN 30 AND 70 AND lon BETWEEN -20 AND 40")
def laea_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = K.route_points(lines_of(spark, sf_dir)).where("lat BETWEEN 30 AND 70 AND lon BETWEEN -20 AND 40").withColumn("sb", geo.sin_beta(F.col("lat")))
    x, y = geo.laea(F.col("sb"), F.col("lon"))
    # six decimals in, five compared: the series of the inverse is good to well under a metre
    m = p.select("id", "seq", x.alias("x"), y.alias("y"), "lat", "lon")
    la, lo = geo.laea_inverse(F.col("x"), F.col("y"))
    back = m.select("id", "seq", F.floor(la * 1e6 + 0.5).alias("la"), F.floor(lo * 1e6 + 0.5).alias("lo"))
    return back.select("id", "seq", F.floor(F.col("la") / 10 + 0.5).alias("lat_e5"), F.floor(F.col("lo") / 10 + 0.5).alias("lon_e5"))


@registry.query("point_tiles", POINTS + f"SELECT DISTINCT id, {FX} AS x, {FY} AS y FROM points")
def point_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.point_tiles(K.route_points(lines_of(spark, sf_dir)))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.point_tiles(K.route_points(lines_of(spark, sf_dir)))


def _visited(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Tiles of the positions of a table: a set of tiles that were explored."""
    there = load(spark, sf_dir, table).where("lat BETWEEN -85 AND 85 AND lon BETWEEN -180 AND 179.9")
    return X.point_tiles(there.select(F.lit(0).cast("bigint").alias("id"), "lat", "lon"))


_T = POINTS + f", tiles AS (SELECT DISTINCT id, {FX} AS x, {FY} AS y FROM points), even AS (SELECT DISTINCT {FX} AS x, {FY} AS y FROM (SELECT lat, lon FROM poi WHERE lat BETWEEN -85 AND 85 AND lon BETWEEN -180 AND 179.9)) "


@registry.query("tile_gain", _T + "SELECT id, count(*) AS tiles, count(*) FILTER (WHERE e.x IS NULL) AS fresh FROM tiles t LEFT JOIN even e USING (x, y) GROUP BY id")
def tile_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.gain(_tiles(spark, sf_dir), _visited(spark, sf_dir, "poi"))


@registry.query("tile_gain_missing", _T + "SELECT id, count(*) AS tiles, count(*) FILTER (WHERE e.x IS NOT NULL) AS fresh FROM tiles t LEFT JOIN even e USING (x, y) GROUP BY id")
def tile_gain_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.gain(_tiles(spark, sf_dir), _visited(spark, sf_dir, "poi"), missing_mode=True)


@registry.query("tile_boxes", _T + "SELECT id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM tiles GROUP BY id")
def tile_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.boxes(_tiles(spark, sf_dir))


@registry.query(
    "tile_compare",
    _T + ", odd AS (SELECT DISTINCT " + f"{FX} AS x, {FY} AS y" + " FROM (SELECT lat, lon FROM mybrevet_belfries WHERE lat BETWEEN -85 AND 85 AND lon BETWEEN -180 AND 179.9)), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM odd), s AS (SELECT t.x, t.y, CASE WHEN e.x IS NOT NULL THEN 'explored' ELSE 'missing' END AS sa, CASE WHEN o.x IS NOT NULL THEN 'missing' WHEN t.x BETWEEN x0 AND x1 AND t.y BETWEEN y0 AND y1 THEN 'explored' ELSE 'unknown' END AS sb FROM (SELECT DISTINCT x, y FROM tiles) t LEFT JOIN even e USING (x, y) LEFT JOIN odd o USING (x, y), b) "
    "SELECT x, y, CASE WHEN sa = 'explored' AND sb = 'explored' THEN 'both' WHEN sa = 'explored' THEN 'a' WHEN sb = 'explored' THEN 'b' WHEN sa = 'missing' AND sb = 'missing' THEN 'shared' END AS state FROM s",
)
def tile_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.compare(_tiles(spark, sf_dir), _visited(spark, sf_dir, "poi"), _visited(spark, sf_dir, "mybrevet_belfries"), b_missing=True)


@registry.query("tile_inner", _T + ", a AS (SELECT DISTINCT x, y FROM tiles) SELECT x, y FROM a WHERE EXISTS (SELECT 1 FROM a b WHERE b.x = a.x - 1 AND b.y = a.y) AND EXISTS (SELECT 1 FROM a b WHERE b.x = a.x + 1 AND b.y = a.y) AND EXISTS (SELECT 1 FROM a b WHERE b.x = a.x AND b.y = a.y - 1) AND EXISTS (SELECT 1 FROM a b WHERE b.x = a.x AND b.y = a.y + 1)")
def tile_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.inner_tiles(_tiles(spark, sf_dir))


@registry.query("tile_clusters")
def tile_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.clusters(X.walked_tiles(lines_of(spark, sf_dir)))


@registry.query("tiles_walked")
def tiles_walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.walked_tiles(lines_of(spark, sf_dir))


@registry.query("tile_largest_square")
def tile_largest_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.largest_squares(X.walked_tiles(lines_of(spark, sf_dir)).select((F.col("id") % 16).alias("id"), "x", "y"))


_PM = METRIC + ", " + PLACES + ", pm AS (SELECT place_id, px1 AS px, py1 AS py FROM (SELECT place_id, x1 AS px1, y1 AS py1 FROM " + _laea_sql("places", "place_id, lat, lon", (("lat", "lon", "1"),)) + ")) "


@registry.query(
    "places_along",
    _PM + ", cum AS (SELECT *, sum(m) OVER (PARTITION BY id ORDER BY seq) - m AS before, sum(m) OVER (PARTITION BY id) AS total FROM metric), c AS (SELECT cum.id AS route_id, place_id, seq, before, total, m, px, py, x1, y1, x2, y2, CASE WHEN m > 0 THEN greatest(0.0, least(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (m * m))) ELSE 0.0 END AS t FROM cum JOIN pm ON px BETWEEN least(x1, x2) - 200 AND greatest(x1, x2) + 200 AND py BETWEEN least(y1, y2) - 200 AND greatest(y1, y2) + 200), "
    "d AS (SELECT *, sqrt(power(px - (x1 + t * (x2 - x1)), 2) + power(py - (y1 + t * (y2 - y1)), 2)) AS d FROM c), best AS (SELECT *, row_number() OVER (PARTITION BY route_id, place_id ORDER BY d, seq) AS rn FROM d WHERE d <= 200) SELECT route_id, place_id, floor((before + t * m) * distance_km / total * 10 + 0.5) / 10 AS km, floor(d + 0.5) AS off_m FROM best JOIN routes ON routes.id = route_id WHERE best.rn = 1",
)
def places_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.places_along(lines_of(spark, sf_dir), load(spark, sf_dir, "poi"), 200.0)


def _nearest_sql(metres: int) -> str:
    a = _laea_sql("(SELECT id, start_lat AS lat, start_lon AS lon FROM routes WHERE start_lat BETWEEN -90 AND 90 AND start_lon BETWEEN -180 AND 180)", "*", (("lat", "lon", "1"),))
    b = _laea_sql("towns", "*", (("lat", "lon", "1"),))
    return ROUTES + f", {_TOWNS}, a AS (SELECT id, x1 AS px, y1 AS py FROM {a}), b AS (SELECT id AS target_id, nation, x1 AS tx, y1 AS ty FROM {b}), d AS (SELECT a.id, target_id, nation, sqrt(power(tx - px, 2) + power(ty - py, 2)) AS d FROM a JOIN b ON abs(tx - px) <= {metres} AND abs(ty - py) <= {metres}), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, target_id) AS rn FROM d WHERE d <= {metres}) "


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes_of(spark, sf_dir).select("id", F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"))


@registry.query("nearest_town", _nearest_sql(15000) + "SELECT id, target_id, floor(d + 0.5) AS metres FROM n WHERE rn = 1")
def nearest_town(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest(_starts(spark, sf_dir), towns_of(spark, sf_dir), 15_000.0)


@registry.query("region_rollup", _nearest_sql(15000) + ", g AS (SELECT r_name AS region, n_name AS province FROM n JOIN nation ON n_nationkey = n.nation JOIN region ON r_regionkey = n_regionkey WHERE rn = 1) SELECT region, province, grouping_id(region, province) AS level, count(*) AS routes FROM g GROUP BY ROLLUP (region, province) HAVING grouping_id(region, province) < 3")
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.operators.library import region_tree

    nations, regions = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    found = S.nearest(_starts(spark, sf_dir), towns_of(spark, sf_dir), 15_000.0).join(towns_of(spark, sf_dir).select(F.col("id").alias("target_id"), "nation"), "target_id")
    named = found.join(nations, F.col("nation") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return region_tree(named.select("id", F.col("r_name").alias("region"), F.col("n_name").alias("province")))


@registry.query("stations_near", _nearest_sql(8000) + "SELECT id, target_id, floor(d + 0.5) AS metres FROM n WHERE rn = 1")
def stations_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest(_starts(spark, sf_dir), towns_of(spark, sf_dir), 8_000.0)


@registry.query(
    "duplicate_places",
    "WITH places AS (SELECT DISTINCT id, lower(trim(name)) AS k, lat, lon FROM poi WHERE name IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180), m AS (SELECT id, k, x1 AS x, y1 AS y FROM " + _laea_sql("places", "*", (("lat", "lon", "1"),)) + ") SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM m a JOIN m b ON a.k = b.k AND a.id < b.id AND abs(a.x - b.x) <= 2500 AND abs(a.y - b.y) <= 2500 WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 2500",
)
def duplicate_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.duplicate_places(load(spark, sf_dir, "poi"), 2500.0)


@registry.query(
    "places_not_mine",
    "WITH p AS (SELECT DISTINCT id, name, category, lat, lon, list_id FROM poi WHERE list_id IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180), m AS (SELECT *, x1 AS x, y1 AS y FROM " + _laea_sql("p", "*", (("lat", "lon", "1"),)) + "), f AS (SELECT * FROM m WHERE list_id = 'osm'), k AS (SELECT * FROM m WHERE list_id <> 'osm') "
    "SELECT f.id AS place_id FROM f WHERE id NOT IN (SELECT id FROM k) AND NOT EXISTS (SELECT 1 FROM k WHERE lower(trim(k.name)) = lower(trim(f.name)) AND sqrt(power(k.x - f.x, 2) + power(k.y - f.y, 2)) <= 25) AND NOT EXISTS (SELECT 1 FROM k WHERE lower(trim(k.category)) = lower(trim(f.category)) AND sqrt(power(k.x - f.x, 2) + power(k.y - f.y, 2)) <= 10)",
)
def places_not_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the map (the list osm) that the own lists do not have."""
    p = load(spark, sf_dir, "poi").where("list_id IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180").select(F.col("id").alias("osm_id"), "name", "category", "lat", "lon", "list_id").distinct()
    return S.not_mine(p.where("list_id = 'osm'").drop("list_id"), p.where("list_id <> 'osm'").drop("list_id")).select(F.col("osm_id").alias("place_id"))


@registry.query("routes_in_areas", ROUTES + "SELECT id, r_regionkey AS area_id FROM routes, region WHERE start_lat BETWEEN -90 AND 90 AND start_lon BETWEEN -180 AND 180 AND start_lat >= 50.5 AND start_lat < 51.5 AND start_lon >= 2.6 + 0.6 * r_regionkey AND start_lon < 3.4 + 0.6 * r_regionkey")
def routes_in_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda la, lo: F.struct(F.lit(la).alias("lat"), (F.lit(lo) + 0.6 * F.col("r_regionkey")).alias("lon"))
    areas = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("area_id"), F.array(corner(50.5, 2.6), corner(50.5, 3.4), corner(51.5, 3.4), corner(51.5, 2.6)).alias("polygon"))
    return S.starts_in_areas(routes_of(spark, sf_dir), areas)


@registry.query("places_near_leg")
def places_near_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.places_near_leg(load(spark, sf_dir, "poi").select("id", "lat", "lon").distinct(), (50.88, 4.70), (51.05, 3.73))


@registry.query("proximity_pairs")
def proximity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.proximity_pairs(lines_of(spark, sf_dir), 100.0)


@registry.query("duplicate_pairs")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.duplicate_pairs(lines_of(spark, sf_dir), 50.0, 85.0)


@registry.query("similar_to_first")
def similar_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lines_of(spark, sf_dir).orderBy("id").select("geometry").first()
    if first is None:
        return spark.createDataFrame([], "other_id long, a_in_b double, b_in_a double, very_similar boolean")
    return S.similar_to(([p["lat"] for p in first[0]], [p["lon"] for p in first[0]]), routes_of(spark, sf_dir))


@registry.query("similar_to_set")
def similar_to_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of searches: every route whose id is divisible by 20, against all routes."""
    lines = lines_of(spark, sf_dir).select("id", "geometry")
    return S.similar_to_each(lines.where("id % 20 = 0"), lines)


def _with_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on a terrain that is a function of the position, as the tables hold no heights."""
    ele = F.transform("geometry", lambda p: 120 + 60 * F.sin(p["lat"] * 300) + 30 * F.cos(p["lon"] * 200))
    return lines_of(spark, sf_dir).select("id", F.col("geometry.lat").alias("lat"), F.col("geometry.lon").alias("lon"), ele.alias("ele"))


@registry.query("route_statistics")
def route_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.route_statistics(_with_heights(spark, sf_dir))


@registry.query("profile_columns")
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.line_columns(_with_heights(spark, sf_dir), 40)


_GAIN = "WITH e AS (SELECT user_id, ts, event_id, CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL), l AS (SELECT user_id, list(v ORDER BY ts, event_id) AS vs FROM e GROUP BY user_id), f AS (SELECT user_id, list_reduce(list_prepend({'r': vs[1], 'last': vs[1], 'g': 0.0::DOUBLE, 'l': 0.0::DOUBLE}, list_transform(vs, lambda v: {'r': v, 'last': v, 'g': 0.0::DOUBLE, 'l': 0.0::DOUBLE})), lambda a, b: {'r': CASE WHEN abs(b.last - a.r) >= 1 THEN b.last ELSE a.r END, 'last': b.last, 'g': a.g + CASE WHEN b.last - a.r >= 1 THEN b.last - a.r ELSE 0 END, 'l': a.l + CASE WHEN a.r - b.last >= 1 THEN a.r - b.last ELSE 0 END}) AS s FROM l) SELECT user_id, floor((s.g + greatest(s.last - s.r, 0)) * 100 + 0.5) AS gain_cm, floor((s.l + greatest(s.r - s.last, 0)) * 100 + 0.5) AS loss_cm FROM f"


@registry.query("gain_loss", _GAIN)
def gain_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("value").cast("double").alias("v")))).alias("s"))
    folded = e.select("user_id", K.gain_loss_column(F.col("s.v")).alias("f"))
    return folded.select("user_id", F.floor(F.col("f.gain") * 100 + 0.5).alias("gain_cm"), F.floor(F.col("f.loss") * 100 + 0.5).alias("loss_cm"))
