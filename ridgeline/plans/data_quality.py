"""Queries of the general data-quality operators (problems 1 to 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeline.operators.near_points import NUMBER_OF_METRES, belfries_near_starts
from ridgeline.operators.references import library_orphans, orphans_by_period
from ridgeline.operators.rejects import loaded_places, parse_records, rejected_records
from ridgeline.plans import Registry
from ridgeline.session import load

registry = Registry()

_ORPHANS = r"""
WITH r AS (SELECT id, max_by(file_hash, updated_at) AS file_hash, max_by(derived_from, updated_at) AS derived_from, max_by(imported_at, updated_at) AS imported_at
  FROM library_routes WHERE id IS NOT NULL GROUP BY id),
refs AS (SELECT id AS route_id, 'file_hash' AS field, lower(regexp_replace(file_hash, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')) AS ref, imported_at FROM r
  UNION SELECT id, 'derived_from', CAST(x AS VARCHAR), imported_at FROM (SELECT id, unnest(derived_from) AS x, imported_at FROM r)),
rec AS (SELECT 'file_hash' AS field, hash AS ref, max(stored_at) AS own FROM library_files WHERE hash IS NOT NULL GROUP BY hash
  UNION ALL SELECT 'derived_from', CAST(id AS VARCHAR), imported_at FROM r),
del AS (SELECT CASE kind WHEN 'file' THEN 'file_hash' ELSE 'derived_from' END AS field, record_key AS ref, max(deleted_at) AS del FROM library_deleted GROUP BY 1, 2),
j AS (SELECT refs.*, rec.ref IS NOT NULL AS has, own, del FROM refs LEFT JOIN rec USING (field, ref) LEFT JOIN del USING (field, ref) WHERE refs.ref IS NOT NULL AND refs.ref <> ''),
k AS (SELECT route_id, field, ref, CASE WHEN NOT has AND del IS NULL THEN 'missing' WHEN del IS NOT NULL AND (NOT has OR own IS NULL OR own <= del) THEN 'deleted'
  WHEN has AND own > imported_at THEN 'late' END AS reason, strftime(imported_at, '%Y-%m') AS period FROM j),
orphans AS (SELECT * FROM k WHERE reason IS NOT NULL)
"""

_RECORDS = r"""
WITH d AS (SELECT DISTINCT line_id, file_name, regexp_replace(coalesce(raw_record, ''), '(\r\n|\n|\r)\z', '') AS rec FROM place_set_lines WHERE line_no > 0 AND line_id IS NOT NULL),
q AS (SELECT *, regexp_full_match(rec, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS quoted,
  regexp_replace(rec, '"(?:[^"]|"")*"', 'Q', 'g') AS plain FROM d),
f AS (SELECT *, length(plain) - length(replace(plain, ',', '')) + 1 AS n,
  regexp_extract(rec, '(?s)\A(?:"((?:[^"]|"")*)"|([^",]*))', 1) || regexp_extract(rec, '(?s)\A(?:"((?:[^"]|"")*)"|([^",]*))', 2) AS f1,
  regexp_extract(rec, '(?s)\A(?:"(?:[^"]|"")*"|[^",]*),(?:"((?:[^"]|"")*)"|([^",]*))', 1) || regexp_extract(rec, '(?s)\A(?:"(?:[^"]|"")*"|[^",]*),(?:"((?:[^"]|"")*)"|([^",]*))', 2) AS f2,
  regexp_extract(rec, '(?s),(?:"((?:[^"]|"")*)"|([^",]*))\z', 1) || regexp_extract(rec, '(?s),(?:"((?:[^"]|"")*)"|([^",]*))\z', 2) AS f3 FROM q),
v AS (SELECT *, CASE WHEN file_name LIKE '2%' THEN regexp_extract(f1, '(?i)\A[ \t]*POINT[ \t]*Z?[ \t]*\([ \t]*([-+0-9.eE]+)[ \t]+([-+0-9.eE]+)([ \t]+[-+0-9.eE]+)?[ \t]*\)[ \t]*\z', 2) ELSE trim(f2, ' ' || chr(9)) END AS lat,
  CASE WHEN file_name LIKE '2%' THEN regexp_extract(f1, '(?i)\A[ \t]*POINT[ \t]*Z?[ \t]*\([ \t]*([-+0-9.eE]+)[ \t]+([-+0-9.eE]+)([ \t]+[-+0-9.eE]+)?[ \t]*\)[ \t]*\z', 1) ELSE trim(f3, ' ' || chr(9)) END AS lon,
  CASE WHEN file_name LIKE '2%' THEN trim(regexp_extract(f1, '(?i)\A[ \t]*POINT[ \t]*Z?[ \t]*\([ \t]*([-+0-9.eE]+)[ \t]+([-+0-9.eE]+)([ \t]+[-+0-9.eE]+)?[ \t]*\)[ \t]*\z', 3), ' ' || chr(9)) ELSE '' END AS z,
  file_name LIKE '2%' AND regexp_matches(f1, '(?i)\A[ \t]*POINT[ \t]*Z') AS upright FROM f),
w AS (SELECT *, [x FOR x IN [lat, lon] IF regexp_full_match(x, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')] AS nums, z = '' OR regexp_full_match(z, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') AS zok FROM v),
p AS (SELECT line_id, CASE WHEN NOT quoted THEN 'quoting' WHEN n <> 3 THEN 'columns'
  WHEN len(nums) = 2 AND zok AND upright = (z <> '') AND coalesce(abs(try_cast(lat AS DOUBLE)) <= 90 AND abs(try_cast(lon AS DOUBLE)) <= 180, false) THEN NULL ELSE 'value' END AS reason,
  file_name, replace(CASE WHEN file_name LIKE '2%' THEN f2 ELSE f1 END, '""', '"') AS name, try_cast(lat AS DOUBLE) AS lat, try_cast(lon AS DOUBLE) AS lon FROM w)
"""

_NEAR = f"""
SELECT DISTINCT r.id AS route_id, b.belfry_id FROM library_routes r, mybrevet_belfries b
WHERE r.start_lat BETWEEN -90 AND 90 AND r.start_lon BETWEEN -180 AND 180 AND b.lat BETWEEN -90 AND 90 AND b.lon BETWEEN -180 AND 180
 AND abs(r.start_lat - b.lat) < 0.02 AND 2 * 6371008.8 * asin(least(1, sqrt(power(sin(radians(b.lat - r.start_lat) / 2), 2)
 + cos(radians(b.lat)) * cos(radians(r.start_lat)) * power(sin(radians(b.lon - r.start_lon) / 2), 2)))) <= {NUMBER_OF_METRES}
"""


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library_orphans(load(spark, sf_dir, "library_routes"), load(spark, sf_dir, "library_files"), load(spark, sf_dir, "library_deleted"))


@registry.query("p1_found", _ORPHANS + "SELECT * FROM orphans")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)


@registry.query("p1_by_period", _ORPHANS + "SELECT field, period, reason, count(*) AS orphan_refs, count(DISTINCT route_id) AS referring_routes FROM orphans GROUP BY 1, 2, 3")
def p1_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans_by_period(_orphans(spark, sf_dir))


@registry.query("p2_found", _RECORDS + "SELECT line_id, reason FROM p WHERE reason IS NOT NULL")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_records(parse_records(load(spark, sf_dir, "place_set_lines")))


@registry.query("p2_places", _RECORDS + "SELECT line_id, file_name, name, floor(lat * 1e6 + 0.5) AS lat_e6, floor(lon * 1e6 + 0.5) AS lon_e6 FROM p WHERE reason IS NULL")
def p2_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = loaded_places(parse_records(load(spark, sf_dir, "place_set_lines")))
    return places.selectExpr("line_id", "file_name", "name", "cast(floor(lat * 1e6D + 0.5D) AS double) AS lat_e6", "cast(floor(lon * 1e6D + 0.5D) AS double) AS lon_e6")


@registry.query("p3_found", _NEAR)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return belfries_near_starts(load(spark, sf_dir, "library_routes"), load(spark, sf_dir, "mybrevet_belfries")).select("route_id", "belfry_id")
