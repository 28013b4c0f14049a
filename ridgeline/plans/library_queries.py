"""Queries over the table of routes and its texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import text as T
from ridgeline.operators import library as L
from ridgeline.plans import Registry
from ridgeline.session import load

registry = Registry()
ROUTES = "WITH routes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM library_routes WHERE id IS NOT NULL) WHERE rn = 1) "


def routes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.current_versions(load(spark, sf_dir, "library_routes"))


def _filter(name: str, query: str, where: str) -> None:
    @registry.query(name, ROUTES + f"SELECT id, name, distance_km FROM routes WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return L.filter_routes(routes_of(spark, sf_dir), L.RouteFilter.parse(query)).select("id", "name", "distance_km")


_filter("filter_range", "min_distance=20&max_distance=60&min_gain=100", "distance_km >= 20 AND distance_km <= 60 AND elevation_gain_m >= 100")
_filter("filter_text", "q=By+Night", "contains(lower(name), 'by night') OR contains(lower(coalesce(notes, '')), 'by night')")
_filter("filter_tags_all", "tags=+Forest&tags=night", "list_contains(tags, 'forest') AND list_contains(tags, 'night')")
_filter("filter_loop", "loop=true&activity=gravel", "is_loop AND activity = 'gravel'")
_filter("filter_ids", "ids=1&ids=8&ids=x&ids=44", "id IN (1, 8, 44)")
_filter("filter_quality_paved", "min_quality=4&max_paved=50", "quality_rating >= 4 AND paved_pct <= 50")
_filter("filter_source", "source=Wielerclub+Olsingen&min_distance=abc", "source_name = 'Wielerclub Olsingen'")


def _order(name: str, query: str, order: str) -> None:
    """Every route with its position in the order."""

    @registry.query(name, ROUTES + f"SELECT row_number() OVER (ORDER BY {order}, lower(name) ASC NULLS LAST, id) AS position, id, name FROM routes")
    def run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
        return L.positions(routes_of(spark, sf_dir), L.RouteFilter.parse(query))


_order("sort_nulls_last", "sort=quality_rating", "quality_rating ASC NULLS LAST")
_order("sort_desc_nulls_last", "sort=elevation_gain_m&order=desc", "elevation_gain_m DESC NULLS LAST")
_order("sort_source_name", "sort=source_name&order=desc", "lower(source_name) DESC NULLS LAST")
_order("sort_unknown_key", "sort=nonsense", "lower(name) ASC NULLS LAST")


@registry.query("facets_sources", ROUTES + "SELECT source_name, count(*) AS routes FROM routes WHERE source_name IS NOT NULL GROUP BY 1")
def facets_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.source_facets(routes_of(spark, sf_dir))


@registry.query("facets_tags", ROUTES + "SELECT tag, count(DISTINCT id) AS routes FROM (SELECT id, unnest(tags) AS tag FROM routes) WHERE tag IS NOT NULL GROUP BY 1")
def facets_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tag_facets(routes_of(spark, sf_dir))


@registry.query("catalog_activity", ROUTES + "SELECT lower(trim(activity)) AS activity, count(*) AS routes FROM routes WHERE lower(trim(activity)) IN ('gravel', 'road', 'mtb', 'hiking') GROUP BY 1")
def catalog_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.activity_counts(routes_of(spark, sf_dir))


@registry.query(
    "catalog_grouping_sets",
    ROUTES + "SELECT activity, source_name, is_loop, grouping_id(activity, source_name, is_loop) AS level, count(*) AS routes FROM routes GROUP BY GROUPING SETS ((activity), (source_name), (is_loop), ())",
)
def catalog_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.catalog_counts(routes_of(spark, sf_dir))


@registry.query(
    "tags_normalise",
    ROUTES + r", e AS (SELECT id, generate_subscripts(tags, 1) AS place, unnest(tags) AS t FROM routes), n AS (SELECT id, lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS tag, min(place) AS place FROM e WHERE t IS NOT NULL GROUP BY 1, 2) SELECT id, string_agg(tag, '|' ORDER BY place) AS tags FROM n WHERE tag <> '' GROUP BY 1",
)
def tags_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes_of(spark, sf_dir).select("id", F.array_join(T.normalise_tags(F.col("tags")), "|").alias("tags")).where("tags <> ''")


@registry.query(
    "tags_change",
    ROUTES + "SELECT id, array_to_string(list_filter(coalesce(tags, []), lambda t: t <> 'forest'), '|') AS left_over FROM routes WHERE list_contains(tags, 'forest') AND len(list_distinct(tags)) = len(tags)",
)
def tags_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routes_of(spark, sf_dir).where(F.array_contains("tags", "forest") & (F.size(F.array_distinct("tags")) == F.size("tags")))
    return r.select("id", F.array_join(T.changed_tags(F.col("tags"), ["forest"], []), "|").alias("left_over"))


_FOLD = "translate(strip_accents(name), '{}', '{}')".format(*(x.replace("'", "''") for x in (T.FOLD_FROM, T.FOLD_TO)))


@registry.query(
    "slugify", ROUTES + f"SELECT id, CASE WHEN s IS NULL OR s = '' THEN 'route' ELSE s END AS slug FROM (SELECT id, lower(regexp_replace(regexp_replace({_FOLD}, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS s FROM routes)"
)
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes_of(spark, sf_dir).select("id", T.slugify(F.col("name")).alias("slug"))


@registry.query(
    "slug_numbering",
    ROUTES + f", b AS (SELECT id, coalesce(nullif(lower(regexp_replace(regexp_replace({_FOLD}, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'route') AS base FROM routes), n AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM b) SELECT id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM n",
)
def slug_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.numbered_slugs(routes_of(spark, sf_dir).select("id", T.slugify(F.col("name")).alias("base")))


@registry.query(
    "match_category",
    r"WITH c AS (SELECT row_number() OVER (ORDER BY id) AS pos, id, unnest(words) AS word FROM poi_categories), w AS (SELECT pos, id, trim(regexp_replace(lower(word), '[^\pL\pN&]+', ' ', 'g')) AS word FROM c), "
    r"p AS (SELECT DISTINCT id, ' ' || regexp_replace(lower(name), '[^\pL\pN&]+', ' ', 'g') || ' ' AS t FROM poi WHERE name IS NOT NULL) "
    "SELECT p.id AS poi_id, p.t, min_by(w.id, pos) AS category_id FROM p JOIN w ON word <> '' AND contains(t, ' ' || word) GROUP BY 1, 2",
)
def match_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = load(spark, sf_dir, "poi_categories").agg(F.array_sort(F.collect_list(F.struct("id", "words"))).alias("categories"))
    places = load(spark, sf_dir, "poi").where("name IS NOT NULL").select("id", "name").distinct().crossJoin(F.broadcast(listed))  # one row of at most the list
    return places.select(F.col("id").alias("poi_id"), T.plain_words(F.col("name")).alias("t"), T.match_category(F.col("name"), F.col("categories")).alias("category_id")).where("category_id IS NOT NULL").distinct()


@registry.query(
    "route_name_rules",
    ROUTES + r", s AS (SELECT *, trim(regexp_replace(regexp_extract(original_filename, '([^\\/]*)$', 1), '\.[^.]*$', '')) AS stem FROM routes WHERE original_filename IS NOT NULL) SELECT id, CASE WHEN coalesce(name, '') <> '' AND (regexp_matches(stem, '(?i)^\s*(start\b.*|route|track|export|gpx)?\s*(\(\d+\))?\s*$') OR regexp_matches(regexp_replace(stem, '\s*\(\d+\)$', ''), '^[a-z0-9]+(-[a-z0-9]+)+$')) THEN name WHEN stem <> '' THEN stem WHEN coalesce(name, '') <> '' THEN name ELSE 'Unnamed route' END AS route_name FROM s",
)
def route_name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routes_of(spark, sf_dir).where("original_filename IS NOT NULL")
    return r.select("id", T.route_name(F.col("original_filename"), F.col("name"), F.lit(1), F.lit(0)).alias("route_name"))


@registry.query("track_formats", ROUTES + r"SELECT f AS format, count(*) AS routes FROM (SELECT nullif(regexp_extract(lower(original_filename), '\.(gpx|tcx|fit)(?:\.gz)?$', 1), '') AS f FROM routes) GROUP BY 1")
def track_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes_of(spark, sf_dir).select(T.track_format(F.col("original_filename")).alias("format")).groupBy("format").agg(F.count(F.lit(1)).alias("routes"))


@registry.query(
    "route_links",
    ROUTES + r", u AS (SELECT id, CASE id % 5 WHEN 0 THEN 'https://ridewithgps.com/routes/' || id || '/' WHEN 1 THEN 'https://www.komoot.com/nl-nl/tour/' || id || '?share_token=ab' WHEN 2 THEN 'https://www.strava.com/routes/' || id WHEN 3 THEN 'https://ridewithgps.com/users/' || id ELSE source_url END AS url FROM routes) "
    r"SELECT id, CASE id % 5 WHEN 0 THEN 'ridewithgps' WHEN 1 THEN 'komoot' WHEN 2 THEN 'strava' ELSE 'web' END AS service, CASE id % 5 WHEN 0 THEN 'https://ridewithgps.com/routes/' || id WHEN 1 THEN 'https://www.komoot.com/tour/' || id || '?share_token=ab' WHEN 2 THEN url ELSE regexp_replace(trim(url), '#.*$', '') END AS link FROM u WHERE id % 5 <> 3 AND regexp_matches(url, '^\s*https?://')",
)
def route_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr(
        "CASE id % 5 WHEN 0 THEN 'https://ridewithgps.com/routes/' || id || '/' WHEN 1 THEN 'https://www.komoot.com/nl-nl/tour/' || id || '?share_token=ab' "
        "WHEN 2 THEN 'https://www.strava.com/routes/' || id WHEN 3 THEN 'https://ridewithgps.com/users/' || id ELSE source_url END"
    )
    links = routes_of(spark, sf_dir).select("id", T.route_link(url).alias("l"))
    return links.where("l.service IS NOT NULL").select("id", "l.service", F.col("l.url").alias("link"))


@registry.query("imported_by_url", ROUTES + r"SELECT url, count(DISTINCT id) AS routes FROM (SELECT id, lower(regexp_replace(regexp_replace(trim(source_url), '[?#].*$', ''), '/+$', '')) AS url FROM routes WHERE source_url IS NOT NULL) WHERE url <> '' GROUP BY 1")
def imported_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.imported_by_url(routes_of(spark, sf_dir))


@registry.query(
    "surface_classify",
    ROUTES + "SELECT id, CASE id % 7 WHEN 0 THEN 'paved' WHEN 1 THEN 'cobbles' WHEN 2 THEN 'unpaved' WHEN 3 THEN 'paved' WHEN 4 THEN 'unpaved' WHEN 5 THEN 'paved' ELSE 'unknown' END AS category, id % 7 > 2 AS inferred FROM routes",
)
def surface_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.expr(
        "CASE id % 7 WHEN 0 THEN map('surface', 'asphalt;gravel') WHEN 1 THEN map('surface', 'sett', 'highway', 'path') WHEN 2 THEN map('surface', ' fine_gravel') "
        "WHEN 3 THEN map('highway', 'track', 'tracktype', 'grade1') WHEN 4 THEN map('highway', 'track') WHEN 5 THEN map('surface', 'odd', 'highway', 'cycleway') ELSE map('highway', 'steps') END"
    )
    return routes_of(spark, sf_dir).select("id", T.surface_class(tags).alias("s")).select("id", "s.category", "s.inferred")


@registry.query("osm_category", "SELECT DISTINCT id AS poi_id, CASE id % 6 WHEN 0 THEN 'frituur' WHEN 2 THEN 'water' WHEN 3 THEN 'bike' WHEN 4 THEN 'shelter' END AS category FROM poi WHERE id % 6 NOT IN (1, 5)")
def osm_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.expr(
        "CASE id % 6 WHEN 0 THEN map('amenity', 'fast_food', 'cuisine', 'Friture') WHEN 1 THEN map('railway', 'station', 'station', 'subway') WHEN 2 THEN map('amenity', 'drinking_water') "
        "WHEN 3 THEN map('shop', 'bicycle') WHEN 4 THEN map('tourism', 'picnic_site') ELSE map('amenity', 'shelter', 'shelter_type', 'bus_stop') END"
    )
    return load(spark, sf_dir, "poi").select(F.col("id").alias("poi_id"), T.osm_category(tags).alias("category")).where("category IS NOT NULL").distinct()


@registry.query("activity_of_types", ROUTES + "SELECT id, CASE WHEN contains(lower(activity), 'gravel') THEN 'gravel' WHEN contains(lower(activity), 'mtb') THEN 'mtb' WHEN contains(lower(activity), 'road') THEN 'road' WHEN contains(lower(activity), 'hik') THEN 'hiking' ELSE 'road' END AS activity FROM routes")
def activity_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array(F.lit("kayak"), F.coalesce("activity", F.lit("?")), F.lit("racebike"))
    return routes_of(spark, sf_dir).select("id", T.activity_from(types).alias("activity"))


@registry.query("same_tracks", ROUTES + "SELECT track_hash, count(*) AS routes, min(id) AS first_id FROM routes WHERE track_hash <> '' GROUP BY 1 HAVING count(*) > 1")
def same_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.same_tracks(routes_of(spark, sf_dir))


@registry.query(
    "import_status",
    ROUTES + ", f AS (SELECT file_hash, track_index, min(id) AS m FROM routes WHERE file_hash IS NOT NULL GROUP BY 1, 2), t AS (SELECT track_hash, min(id) AS m FROM routes WHERE track_hash <> '' GROUP BY 1) SELECT r.id, CASE WHEN coalesce(len(geometry), 0) < 2 THEN 'error' WHEN f.m < r.id THEN 'duplicate file' WHEN t.m < r.id THEN 'duplicate track' ELSE 'imported' END AS status FROM routes r LEFT JOIN f USING (file_hash, track_index) LEFT JOIN t USING (track_hash)",
)
def import_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routes_of(spark, sf_dir).select("id", "file_hash", "track_index", "track_hash", F.size("geometry").alias("points"))
    return L.import_status(r, r)


@registry.query(
    "update_validation",
    ROUTES + "SELECT id, CASE WHEN length(name) > 300 THEN 'name too long' WHEN activity IS NOT NULL AND lower(trim(activity)) NOT IN ('gravel', 'road', 'mtb', 'hiking') THEN 'unknown activity' WHEN quality_rating NOT BETWEEN 1 AND 5 THEN 'quality out of range' WHEN paved_pct NOT BETWEEN 0 AND 100 THEN 'paved share out of range' END AS error FROM routes",
)
def update_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.validated_updates(routes_of(spark, sf_dir)).select("id", "error")


@registry.query(
    "upsert_by_key",
    ROUTES + "SELECT id, CASE WHEN id % 3 = 0 THEN 'changed' ELSE name END AS name FROM routes UNION ALL SELECT -1, 'new'",
)
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = routes_of(spark, sf_dir).select("id", "name")
    changes = table.where("id % 3 = 0").select("id", F.lit("changed").alias("name")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("new").alias("name")))
    return L.upsert(table, changes, "id")


@registry.query("ignored_pairs", ROUTES + "SELECT DISTINCT least(id, x) AS a_id, greatest(id, x) AS b_id FROM (SELECT id, unnest(derived_from) AS x FROM routes) WHERE id <> x")
def ignored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ignored_pairs(routes_of(spark, sf_dir).select(F.col("id").alias("a_id"), F.explode("derived_from").alias("b_id")))
