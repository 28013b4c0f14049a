"""Queries of nested collections, trips, ride weather and route construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import algebra as A
from ridgeline.operators import spatial as S
from ridgeline.operators import trees as C
from ridgeline.operators import weather as M
from ridgeline.plans import Registry
from ridgeline.plans.library_queries import routes_of
from ridgeline.plans.spatial_queries import LINES, SEGMENTS, lines_of, towns_of
from ridgeline.session import load

registry = Registry()

_TREE = "collections AS (SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey > 0 THEN CAST(floor((n_nationkey - 1) / 5) AS INT) END AS parent_id FROM nation)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS bigint) AS id", "n_name AS name", "CASE WHEN n_nationkey > 0 THEN cast(floor((n_nationkey - 1) / 5) AS bigint) END AS parent_id")


@registry.query("collection_family", f"WITH RECURSIVE {_TREE}, up AS (SELECT id, id AS ancestor FROM collections UNION SELECT u.id, c.parent_id FROM up u JOIN collections c ON c.id = u.ancestor WHERE c.parent_id IS NOT NULL) SELECT ancestor, id FROM up")
def collection_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.closure(_tree(spark, sf_dir))


@registry.query("collection_path", f"WITH RECURSIVE {_TREE}, up AS (SELECT id, parent_id AS up_id, 1 AS depth, name AS path FROM collections UNION ALL SELECT u.id, c.parent_id, u.depth + 1, c.name || ' › ' || u.path FROM up u JOIN collections c ON c.id = u.up_id) SELECT id, max_by(path, depth) AS path FROM up GROUP BY id")
def collection_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.paths(_tree(spark, sf_dir))


@registry.query("collection_counts", f"WITH RECURSIVE {_TREE}, up AS (SELECT id, id AS ancestor FROM collections UNION SELECT u.id, c.parent_id FROM up u JOIN collections c ON c.id = u.ancestor WHERE c.parent_id IS NOT NULL) SELECT ancestor AS id, count(DISTINCT r.id) AS routes FROM up LEFT JOIN library_routes r ON r.id % 25 = up.id GROUP BY 1")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = routes_of(spark, sf_dir).select((F.col("id") % 25).alias("collection_id"), F.col("id").alias("route_id"))
    return C.counts(_tree(spark, sf_dir), members)


@registry.query(
    "ride_log_summary",
    "SELECT r.id, count(*) AS rides, min(o_orderdate) AS first_ride, max(o_orderdate) AS last_ride FROM (SELECT DISTINCT id FROM library_routes) r JOIN orders ON o_custkey = r.id GROUP BY r.id",
)
def ride_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rides = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("rides"), F.min("o_orderdate").alias("first_ride"), F.max("o_orderdate").alias("last_ride"))
    return rides.join(routes_of(spark, sf_dir).select("id"), "id", "left_semi")


@registry.query(
    "timetable_asof",
    "WITH t AS (SELECT user_id % 20 AS line, ts, event_id FROM events WHERE event_id % 2 = 0), q AS (SELECT event_id AS id, user_id % 20 AS line, ts AS ready FROM events WHERE event_id % 2 = 1) SELECT id, departure FROM (SELECT id, line, ready + INTERVAL 10 MINUTE AS due FROM q) q ASOF JOIN (SELECT line, ts AS departure FROM t) t ON q.line = t.line AND q.due <= t.departure",
)
def timetable_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an as-of join without a range join: departures and requests of a line in one order, the next departure by a window
    from pyspark.sql import Window as W

    e = load(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("line"), "ts", "event_id")
    due = F.col("ts") + F.expr("INTERVAL 10 MINUTES")
    both = e.select("line", F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("departure"), F.when(F.col("event_id") % 2 == 1, F.col("event_id")).alias("id"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).otherwise(due).alias("at"))
    # latest first: the frame only ever grows by one row
    later = W.partitionBy("line").orderBy(F.col("at").desc(), F.col("departure").isNotNull().desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn("departure", F.last("departure", ignorenulls=True).over(later)).where("id IS NOT NULL AND departure IS NOT NULL").select("id", "departure")


@registry.query("wind_effect", SEGMENTS + ", b AS (SELECT id, seq, (degrees(atan2((lon2 - lon) * cos(radians((lat + lat2) / 2)), lat2 - lat)) + 360) % 360 AS h FROM segs WHERE lat <> lat2 OR lon <> lon2), a AS (SELECT id, seq, CASE WHEN abs(h - 225) > 180 THEN 360 - abs(h - 225) ELSE abs(h - 225) END AS angle, CASE WHEN id % 4 = 0 THEN 3.0 ELSE 20.0 END AS s FROM b) SELECT id, seq, CASE WHEN s < 5 THEN 'calm' WHEN angle <= 60 THEN 'head' WHEN angle >= 120 THEN 'tail' ELSE 'cross' END AS effect, floor(s * cos(radians(angle)) * 100 + 0.5) AS head_e2 FROM a")
def wind_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.operators.track import headings

    h = headings(lines_of(spark, sf_dir)).withColumn("s", F.when(F.col("id") % 4 == 0, 3.0).otherwise(20.0))
    effect, head = M.wind_effect(F.col("bearing"), F.lit(225.0), F.col("s"))
    return h.select("id", "seq", effect.alias("effect"), F.floor(head * 100 + 0.5).alias("head_e2"))


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("user_id").alias("u"), F.count(F.lit(1)).alias("n"))
    return e.selectExpr("hour", "cast(u % 30 AS double) AS temp", "cast(n % 5 AS double) AS rain", "cast(u % 40 AS double) AS wind_speed", "cast(u * 7 % 360 AS double) AS wind_dir")


def _start(spark: SparkSession, sf_dir: str):
    first = load(spark, sf_dir, "events").agg(F.min("ts")).first()[0]
    return F.lit(first) + F.expr("INTERVAL 1 HOUR")


@registry.query("ride_weather")
def ride_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ride_weather(lines_of(spark, sf_dir), _hourly(spark, sf_dir), _start(spark, sf_dir), 20.0)


@registry.query("reverse_advice")
def reverse_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, start, hourly = lines_of(spark, sf_dir), _start(spark, sf_dir), _hourly(spark, sf_dir)
    there = M.ride_weather(lines, hourly, start, 20.0)
    back = M.ride_weather(lines.withColumn("geometry", A.reversed_line(F.col("geometry"))), hourly, start, 20.0)
    return M.reverse_advice(there, back)


@registry.query("reversed_lines", LINES + "SELECT id, list_reverse(geometry)[1].lat AS lat, list_reverse(geometry)[1].lon AS lon, len(geometry) AS points FROM lines")
def reversed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.reversed_line(F.col("geometry"))
    return lines_of(spark, sf_dir).select("id", g[0]["lat"].alias("lat"), g[0]["lon"].alias("lon"), F.size(g).alias("points"))


@registry.query("restarted_loops", LINES + "SELECT id, list_concat(geometry[3:], geometry[2:3])[-1].lat AS lat, len(list_concat(geometry[3:], geometry[2:3])) AS points, geometry[3].lon AS lon FROM lines WHERE is_loop AND len(geometry) >= 5")
def restarted_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lines_of(spark, sf_dir).where(F.col("is_loop") & (F.size("geometry") >= 5)).select("id", A.restarted(F.col("geometry"), F.lit(2)).alias("g"))
    return r.select("id", F.element_at("g", -1)["lat"].alias("lat"), F.size("g").alias("points"), F.col("g")[0]["lon"].alias("lon"))


@registry.query("privacy_cut", SEGMENTS.replace("segs AS (SELECT", "outside AS (SELECT id, min(seq) AS f, max(seq) AS l FROM points WHERE sqrt(power((51.0 - lat) * 110540, 2) + power((4.0 - lon) * cos(radians((lat + 51.0) / 2)) * 111320, 2)) > 15000 GROUP BY id), segs AS (SELECT") + "SELECT id, l - f + 1 AS points FROM outside WHERE l - f >= 1")
def privacy_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines_of(spark, sf_dir).select("id", A.privacy_cut(F.col("geometry"), 51.0, 4.0, 15_000.0).alias("g")).where("g IS NOT NULL")
    return cut.select("id", F.size("g").alias("points"))


@registry.query("share_texts")
def share_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.share_texts(lines_of(spark, sf_dir))


@registry.query("train_candidates")
def train_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, stations = routes_of(spark, sf_dir), towns_of(spark, sf_dir)
    start = S.nearest(r.select("id", F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")), stations, 8_000.0)
    end = S.nearest(r.select("id", F.col("end_lat").alias("lat"), F.col("end_lon").alias("lon")), stations, 8_000.0)
    return C.train_candidates(r.select("id", "is_loop", "distance_km"), start, end, 1)


@registry.query(
    "round_robin_topk",
    "WITH c AS (SELECT DISTINCT lower(trim(activity)) AS pattern, id, distance_km AS cost FROM library_routes WHERE activity IS NOT NULL AND distance_km IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY cost, id) AS turn FROM c) SELECT pattern, id, cost, turn FROM n ORDER BY turn, pattern LIMIT 8",
)
def round_robin_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "library_routes").where("activity IS NOT NULL AND distance_km IS NOT NULL").select(F.lower(F.trim("activity")).alias("pattern"), "id", F.col("distance_km").alias("cost")).distinct()
    return C.round_robin(c, 8)


@registry.query("gpx_roundtrip", LINES + "SELECT id, generate_subscripts(geometry, 1) - 1 AS seq, floor(unnest(geometry).lat * 1e6 + 0.5) AS lat_e6 FROM lines")
def gpx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as GPX documents and parsed again."""
    from ridgeline.operators.track import route_points
    from ridgeline.sources.trackfiles import gpx_texts, track_points

    p = route_points(lines_of(spark, sf_dir)).select("id", F.col("id").cast("string").alias("name"), "seq", "lat", "lon", F.lit(None).cast("double").alias("ele"))
    files = gpx_texts(p).select(F.col("id").cast("string").alias("path"), F.encode("gpx", "UTF-8").alias("content"))
    return track_points(files).select(F.col("path").cast("bigint").alias("id"), "seq", F.floor(F.col("lat") * 1e6 + 0.5).alias("lat_e6"))
