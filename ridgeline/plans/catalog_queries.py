"""Queries of the catalogue operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.operators import catalog as G
from ridgeline.operators import merge as B
from ridgeline.operators import tiles as X
from ridgeline.operators import trees as C
from ridgeline.plans import Registry
from ridgeline.plans.library_queries import ROUTES, routes_of
from ridgeline.plans.route_queries import _TREE, _tree
from ridgeline.plans.spatial_queries import FX, FY, LINES, POINTS, _tiles, lines_of
from ridgeline.session import load
from ridgeline.sources import exchange as Z

registry = Registry()

_HASH = "SELECT id, lower(trim(track_hash)) AS h FROM library_routes WHERE trim(track_hash) <> '' UNION SELECT id, lower(trim(file_hash)) FROM library_routes WHERE trim(file_hash) <> ''"
_GROUPS = (
    f"WITH RECURSIVE k AS ({_HASH}), m AS (SELECT h, min(id) AS id FROM k GROUP BY h), p AS (SELECT DISTINCT k.id AS a, m.id AS b FROM k JOIN m USING (h) WHERE k.id <> m.id), "
    "e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS id, a AS g FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.g = e.a), groups AS (SELECT id, min(g) AS grp FROM r GROUP BY id) "
)


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of routes that share a track or a file."""
    r = load(spark, sf_dir, "library_routes")
    keys = [r.select("id", F.lower(F.trim(c)).alias("h")).where("h <> ''") for c in ("track_hash", "file_hash")]
    every = keys[0].unionByName(keys[1]).distinct()
    least = every.groupBy("h").agg(F.min("id").alias("b_id"))
    return G.connected_groups(every.join(least, "h").select(F.col("id").alias("a_id"), "b_id"))


@registry.query("duplicate_groups", _GROUPS + "SELECT id, grp FROM groups")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


@registry.query(
    "duplicate_keep",
    _GROUPS + ", routes AS (SELECT id, max_by((quality_rating IS NOT NULL)::INT + (coalesce(len(tags), 0) > 0)::INT + (coalesce(notes, '') <> '')::INT, coalesce(epoch_us(updated_at), -1)) AS personal, "
    "max_by(coalesce(epoch_us(imported_at), 9e18::BIGINT), coalesce(epoch_us(updated_at), -1)) AS since FROM library_routes GROUP BY id) SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY personal DESC, since, id) AS place FROM groups JOIN routes USING (id)",
)
def duplicate_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.keep_ranking(_groups(spark, sf_dir), routes_of(spark, sf_dir))


@registry.query(
    "collection_members",
    f"WITH RECURSIVE {_TREE}, up AS (SELECT id, parent_id AS up_id, 1 AS depth, name AS path FROM collections UNION ALL SELECT u.id, c.parent_id, u.depth + 1, c.name || ' › ' || u.path FROM up u JOIN collections c ON c.id = u.up_id), "
    "paths AS (SELECT id, max_by(path, depth) AS path FROM up GROUP BY id) SELECT DISTINCT r.id AS route_id, path FROM library_routes r JOIN paths p ON r.id % 25 = p.id",
)
def collection_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = routes_of(spark, sf_dir).select((F.col("id") % 25).alias("collection_id"), F.col("id").alias("route_id"))
    return G.collections_of(members, C.paths(_tree(spark, sf_dir)))


@registry.query("collections_deleted", f"WITH {_TREE} SELECT id, CASE WHEN parent_id NOT IN (0, 1) THEN parent_id END AS parent_id, name FROM collections WHERE id NOT IN (0, 1)")
def collections_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.delete_collection(_tree(spark, sf_dir), F.col("id").isin(0, 1))


@registry.query(
    "collection_moves",
    f"WITH RECURSIVE {_TREE}, up AS (SELECT id, id AS ancestor FROM collections UNION SELECT u.id, c.parent_id FROM up u JOIN collections c ON c.id = u.ancestor WHERE c.parent_id IS NOT NULL), "
    "m AS (SELECT a.id, b.id AS new_parent FROM collections a JOIN collections b ON b.id BETWEEN a.id AND 5 * a.id + 3) SELECT m.id, new_parent FROM m JOIN up ON up.ancestor = m.id AND up.id = new_parent",
)
def collection_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    moves = t.select("id", F.explode(F.sequence(F.col("id"), F.least(5 * F.col("id") + 3, F.lit(24)))).alias("new_parent"))
    return G.moves_into_itself(C.closure(t), moves)


@registry.query("collection_twins", f"WITH {_TREE}, w AS (SELECT lower(name) AS name, parent_id FROM collections UNION ALL SELECT 'New ' || name, parent_id FROM collections) SELECT w.name, w.parent_id, c.id FROM w LEFT JOIN collections c ON lower(c.name) = lower(w.name) AND c.parent_id IS NOT DISTINCT FROM w.parent_id")
def collection_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    wanted = t.select(F.lower("name").alias("name"), "parent_id").unionByName(t.select(F.concat(F.lit("New "), "name").alias("name"), "parent_id"))
    return G.merged_collections(t, wanted)


@registry.query("collection_changes", ROUTES + "SELECT id, list_distinct(list_concat(d, [id, 7])) AS n FROM (SELECT id, list_filter(list_distinct(derived_from), lambda x: x IS NOT NULL) AS d FROM routes WHERE derived_from IS NOT NULL)".replace("list_distinct(list_concat(d, [id, 7])) AS n", "len(list_distinct(list_concat(d, [id, 7]))) AS n, len(list_filter(d, lambda x: x % 2 = 0)) AS even"))
def collection_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = routes_of(spark, sf_dir).where("derived_from IS NOT NULL").select("id", F.filter(F.array_distinct("derived_from"), lambda x: x.isNotNull()).alias("d"))
    odd = F.filter("d", lambda x: x % 2 != 0)
    return d.select("id", F.size(G.added_members(F.col("d"), F.array(F.col("id"), F.lit(7).cast("bigint")))).alias("n"), F.size(G.removed_members(F.col("d"), odd)).alias("even"))


_POI = "WITH places AS (SELECT DISTINCT id, name, category, list_id, notes FROM poi WHERE id IS NOT NULL) "


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "poi").where("id IS NOT NULL").select("id", "name", "category", "list_id", "notes").distinct()


@registry.query("places_visible", _POI + "SELECT id, list_id FROM places p WHERE NOT EXISTS (SELECT 1 FROM poi_list l WHERE l.id = p.list_id AND NOT l.visible)")
def places_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.visible_places(_places(spark, sf_dir), load(spark, sf_dir, "poi_list")).select("id", "list_id")


@registry.query("places_filtered", _POI + "SELECT id, name FROM places WHERE list_id = 'osm' AND (contains(lower(coalesce(name, '')), 'ca') OR contains(lower(coalesce(notes, '')), 'ca'))")
def places_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.filter_places(_places(spark, sf_dir), list_id="osm", text="Ca").select("id", "name")


@registry.query("places_both", _POI + "SELECT id, 'mine' AS origin FROM places WHERE list_id <> 'osm' UNION ALL SELECT id, 'osm' FROM places WHERE list_id = 'osm'")
def places_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _places(spark, sf_dir)
    return G.mine_and_found(p.where("list_id <> 'osm'"), p.where("list_id = 'osm'")).select("id", "origin")


@registry.query("category_use", "SELECT c.id, count(DISTINCT p.id) AS places FROM poi_categories c LEFT JOIN poi p ON p.category = c.id GROUP BY c.id")
def category_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.categories_in_use(load(spark, sf_dir, "poi_categories"), load(spark, sf_dir, "poi"))


@registry.query("category_ids", "SELECT id, coalesce(nullif(left(trim(regexp_replace(lower(strip_accents(label)), '[^a-z0-9]+', '-', 'g'), '-'), 30), ''), 'category') AS new_id FROM poi_categories")
def category_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "poi_categories").select("id", G.category_id(F.col("label")).alias("new_id"))


@registry.query("accounts_new", "SELECT DISTINCT source_url AS url FROM library_routes WHERE source_url IS NOT NULL AND source_url NOT IN (SELECT source_url FROM library_routes WHERE source_url IS NOT NULL AND imported_at < TIMESTAMP '2023-01-01')")
def accounts_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "library_routes").select(F.col("source_url").alias("url"), "imported_at")
    return G.new_accounts(r.select("url").where("url IS NOT NULL").distinct(), r.where("imported_at < timestamp'2023-01-01'"))


@registry.query("track_hashes", POINTS + "SELECT id, sha256(string_agg(printf('%.5f,%.5f;', lat, lon), '' ORDER BY seq)) AS hash FROM points GROUP BY id")
def track_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.track_hashes(lines_of(spark, sf_dir))


@registry.query(
    "import_positions",
    r"WITH f AS (SELECT DISTINCT path, regexp_extract(path, '([^/]*)$', 1) AS file FROM library_files WHERE path IS NOT NULL) SELECT path, row_number() OVER (ORDER BY CASE WHEN contains(path, '/') THEN left(path, len(path) - len(file) - 1) ELSE '' END, "
    r"lower(regexp_replace(regexp_replace(file, '\.[^.]*$', ''), '\s*\(\d+\)$', '')), len(file), file) AS position FROM f",
)
def import_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "library_files").select("path").where("path IS NOT NULL").distinct()
    return f.select("path", F.row_number().over(W.orderBy(*G.import_order(F.col("path")))).alias("position"))


@registry.query("notes_original", ROUTES + "SELECT id, CASE WHEN starts_with(trim(coalesce(notes, '')), 'Original name: ') THEN trim(notes) WHEN trim(coalesce(notes, '')) = '' THEN 'Original name: ' || original_filename ELSE 'Original name: ' || original_filename || chr(10) || chr(10) || trim(notes) END AS notes FROM routes WHERE original_filename IS NOT NULL")
def notes_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes_of(spark, sf_dir).where("original_filename IS NOT NULL").select("id", G.notes_with_original(F.col("notes"), F.col("original_filename")).alias("notes"))


@registry.query(
    "names_told_apart",
    ROUTES + ", n AS (SELECT id, name, CAST(floor(distance_km + 0.5) AS BIGINT) AS km, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS nth FROM routes WHERE name IS NOT NULL AND distance_km IS NOT NULL), "
    "m AS (SELECT *, row_number() OVER (PARTITION BY lower(name), km, nth > 1 ORDER BY id) AS m FROM n) SELECT id, CASE WHEN nth = 1 THEN name WHEN m = 1 THEN name || ' (' || km || ' km)' ELSE name || ' (' || km || ' km, ' || m || ')' END AS name FROM m",
)
def names_told_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.told_apart(routes_of(spark, sf_dir).where("name IS NOT NULL AND distance_km IS NOT NULL").select("id", "name", "distance_km"))


@registry.query("natural_order", "SELECT name, row_number() OVER (ORDER BY array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 10, '0') ELSE x END), ''), name) AS position FROM (SELECT n_name AS name FROM nation UNION SELECT s_name FROM supplier)")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(load(spark, sf_dir, "supplier").select("s_name")).distinct()
    return names.select("name", F.row_number().over(W.orderBy(G.natural_key(F.col("name")), "name")).alias("position"))


@registry.query("stored_keys", "SELECT k AS key, CASE WHEN regexp_matches(k, '^[0-9a-f]{64}$') THEN 'hash' WHEN regexp_matches(k, '^[0-9]+_[0-9]+$') THEN 'pair' WHEN regexp_matches(k, '^[a-z_]+:[A-Za-z0-9_-]+$') THEN 'doc' END AS kind FROM (SELECT hash AS k FROM library_files UNION SELECT record_key FROM library_deleted UNION SELECT doc_key FROM poi UNION SELECT id || '_' || (id + 1) FROM library_routes) WHERE k IS NOT NULL")
def stored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = load(spark, sf_dir, "library_files").select(F.col("hash").alias("key")).union(load(spark, sf_dir, "library_deleted").select("record_key")).union(load(spark, sf_dir, "poi").select("doc_key"))
    keys = keys.union(load(spark, sf_dir, "library_routes").select(F.concat_ws("_", "id", F.col("id") + 1))).where("key IS NOT NULL").distinct()
    return keys.select("key", G.key_kinds(F.col("key")).alias("kind"))


@registry.query("tile_ranges", POINTS + f", t AS (SELECT id, min({FX}) AS x0, max({FX}) AS x1, min({FY}) AS y0, max({FY}) AS y1 FROM points GROUP BY id) SELECT id, (x1 - x0 + 1) * (y1 - y0 + 1) AS tiles FROM t")
def tile_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.boxes(_tiles(spark, sf_dir)).select("id", F.size(G.tile_range(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"))).cast("bigint").alias("tiles"))


@registry.query("tiles_shared", POINTS + f", t AS (SELECT DISTINCT {FX} AS x, {FY} AS y FROM points), o AS (SELECT DISTINCT {FX} AS x, {FY} AS y FROM (SELECT lat, lon FROM poi WHERE lat BETWEEN -85 AND 85 AND lon BETWEEN -180 AND 179.9)) SELECT x, y FROM t JOIN o USING (x, y)")
def tiles_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = load(spark, sf_dir, "poi").where("lat BETWEEN -85 AND 85 AND lon BETWEEN -180 AND 179.9").select("id", "lat", "lon")
    return G.shared_tiles(_tiles(spark, sf_dir), X.point_tiles(places))


@registry.query("saturdays", "SELECT d, d + CAST((6 - dayofweek(d) + 7) % 7 AS INT) AS saturday FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)")
def saturdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct().select("d", G.next_saturday(F.col("d")).alias("saturday"))


@registry.query("arrival_times", "SELECT event_id, printf('%02d:%02d', ((hour(ts) * 60 + minute(ts) + user_id * 7) // 60) % 24, (hour(ts) * 60 + minute(ts) + user_id * 7) % 60) AS arrival FROM events")
def arrival_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", G.added_minutes(F.date_format("ts", "HH:mm"), (F.col("user_id") * 7).cast("int")).alias("arrival"))


@registry.query("weather_points", ROUTES + ", n AS (SELECT id, distance_km * 1000 AS m, CAST(greatest(2, least(21, floor(distance_km * 1000 / 5000 + 0.5) + 1)) AS INT) AS n FROM routes WHERE distance_km > 0) SELECT id, k, floor(k * m / (n - 1) + 0.5) AS metres FROM (SELECT id, m, n, unnest(range(n)) AS k FROM n)")
def weather_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routes_of(spark, sf_dir).where("distance_km > 0").select("id", F.posexplode(G.sample_distances(F.col("distance_km") * 1000)).alias("k", "m"))
    return r.select("id", F.col("k").cast("bigint").alias("k"), F.floor(F.col("m") + 0.5).cast("double").alias("metres"))


@registry.query("axis_ticks", ROUTES + ", s AS (SELECT id, distance_km AS d, distance_km / 6 AS raw, pow(10.0, floor(log10(distance_km / 6))) AS p FROM routes WHERE distance_km > 0), t AS (SELECT id, d, p * CASE WHEN raw / p <= 1 THEN 1 WHEN raw / p <= 2 THEN 2 WHEN raw / p <= 5 THEN 5 ELSE 10 END AS step FROM s) SELECT id, step, CAST(floor(d / step) + 1 AS INT) AS ticks FROM t")
def axis_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routes_of(spark, sf_dir).where("distance_km > 0").select("id", "distance_km", G.nice_step(F.col("distance_km"), 6).alias("step"))
    return r.select("id", "step", F.size(G.ticks(F.lit(0.0), F.col("distance_km"), F.col("step"))).alias("ticks"))


@registry.query("weather_kinds", "SELECT event_id, CASE WHEN c = 0 THEN 'clear' WHEN c <= 2 THEN 'fair' WHEN c = 3 THEN 'cloud' WHEN c IN (45, 48) THEN 'fog' WHEN c >= 95 THEN 'thunder' WHEN c BETWEEN 71 AND 77 OR c IN (85, 86) THEN 'snow' ELSE 'rain' END AS kind FROM (SELECT event_id, user_id % 100 AS c FROM events)")
def weather_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", G.weather_kind(F.col("user_id") % 100).alias("kind"))


# ways matched to pieces of a track: line items as pieces, their suppliers as surfaces
_MATCHED = (
    "WITH m AS (SELECT l_orderkey AS id, row_number() OVER w AS seq, sum(l_quantity * 10) OVER w - l_quantity * 10 AS from_m, sum(l_quantity * 10) OVER w AS to_m, "
    "CASE l_suppkey % 6 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'sett' WHEN 2 THEN 'gravel' WHEN 3 THEN 'mud' WHEN 4 THEN 'asphalt' END AS surface FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING)), "
    "c AS (SELECT *, CASE surface WHEN 'asphalt' THEN 'paved' WHEN 'sett' THEN 'cobbles' WHEN 'gravel' THEN 'unpaved' WHEN 'mud' THEN 'unpaved' ELSE 'unknown' END AS category FROM m) "
)


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    by = line.rowsBetween(W.unboundedPreceding, 0)
    at = F.sum(F.col("l_quantity").cast("double") * 10).over(by)
    surface = F.expr("CASE l_suppkey % 6 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'sett' WHEN 2 THEN 'gravel' WHEN 3 THEN 'mud' WHEN 4 THEN 'asphalt' END")
    m = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("id"), F.row_number().over(line).alias("seq"), (at - F.col("l_quantity") * 10).cast("double").alias("from_m"), at.alias("to_m"), surface.alias("surface"))
    return m.withColumn("tags", F.when(F.col("surface").isNotNull(), F.create_map(F.lit("surface"), F.col("surface"))))


@registry.query(
    "surface_shares",
    _MATCHED + "SELECT id, round(sum(CASE WHEN category = 'paved' THEN to_m - from_m ELSE 0 END) / 1000, 3) AS paved_km, round(sum(CASE WHEN category = 'unknown' THEN to_m - from_m ELSE 0 END) / 1000, 3) AS unknown_km, "
    "CASE WHEN sum(CASE WHEN category <> 'unknown' THEN to_m - from_m ELSE 0 END) >= 0.5 * sum(to_m - from_m) THEN floor(100 * sum(CASE WHEN category IN ('paved', 'cobbles') THEN to_m - from_m ELSE 0 END) / sum(CASE WHEN category <> 'unknown' THEN to_m - from_m ELSE 0 END) + 0.5) END AS paved_pct FROM c GROUP BY id",
)
def surface_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.surface_summary(_matched(spark, sf_dir)).select("id", "paved_km", "unknown_km", F.col("paved_pct").cast("double").alias("paved_pct"))


@registry.query(
    "surface_stretches",
    _MATCHED + ", n AS (SELECT *, sum(CASE WHEN category = prev THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY seq) AS stretch FROM (SELECT *, lag(category) OVER (PARTITION BY id ORDER BY seq) AS prev FROM c)) SELECT id, CAST(stretch AS BIGINT) AS stretch, min(category) AS category, min(from_m) AS from_m, max(to_m) AS to_m FROM n GROUP BY id, stretch",
)
def surface_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.surface_stretches(_matched(spark, sf_dir)).select("id", "stretch", "category", "from_m", "to_m")


@registry.query("surface_top", _MATCHED + "SELECT id, rank, surface, round(km, 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km DESC, surface) AS rank FROM (SELECT id, surface, sum(to_m - from_m) / 1000 AS km FROM c WHERE surface IS NOT NULL GROUP BY id, surface)) WHERE rank <= 8")
def surface_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.top_surfaces(_matched(spark, sf_dir))


@registry.query("paved_estimates", ROUTES + "SELECT id, CASE WHEN quality_rating = 5 THEN paved_pct WHEN elevation_gain_m IS NOT NULL THEN CAST(elevation_gain_m % 101 AS DOUBLE) ELSE paved_pct END AS paved_pct, CASE WHEN quality_rating = 5 THEN 'manual' WHEN elevation_gain_m IS NOT NULL THEN 'estimated' END AS paved_source FROM routes")
def paved_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routes_of(spark, sf_dir).withColumn("paved_source", F.when(F.col("quality_rating") == 5, "manual"))
    return B.applied_estimate(r.select("id", "paved_pct", "paved_source"), r.select("id", (F.col("elevation_gain_m") % 101).alias("paved_pct")))


_BACKUP = (
    ROUTES + ", lib AS (SELECT id, file_hash, track_index, track_hash FROM routes WHERE imported_at < TIMESTAMP '2023-01-01' OR imported_at IS NULL), bak AS (SELECT id AS old_id, file_hash, track_index, track_hash, derived_from FROM routes), "
    "f AS (SELECT file_hash, track_index, min(id) AS id FROM lib WHERE file_hash IS NOT NULL GROUP BY 1, 2), t AS (SELECT track_hash, min(id) AS id FROM lib WHERE track_hash IS NOT NULL GROUP BY 1), "
    "met AS (SELECT old_id, derived_from, coalesce(f.id, t.id) AS id FROM bak LEFT JOIN f ON f.file_hash = bak.file_hash AND f.track_index IS NOT DISTINCT FROM bak.track_index LEFT JOIN t ON t.track_hash = bak.track_hash), "
    "ids AS (SELECT old_id, id, false AS is_new FROM met WHERE id IS NOT NULL UNION ALL SELECT old_id, (SELECT max(id) FROM lib) + row_number() OVER (ORDER BY old_id), true FROM met WHERE id IS NULL) "
)


def _backup(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = routes_of(spark, sf_dir).select("id", "file_hash", "track_index", "track_hash", "derived_from", "imported_at")
    return B.id_map(r.where("imported_at < timestamp'2023-01-01' OR imported_at IS NULL"), r), r


@registry.query("backup_ids", _BACKUP + "SELECT * FROM ids")
def backup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backup(spark, sf_dir)[0]


@registry.query(
    "backup_references",
    _BACKUP + ", u AS (SELECT old_id, unnest(derived_from) AS ref, generate_subscripts(derived_from, 1) AS n FROM bak WHERE derived_from IS NOT NULL), x AS (SELECT o.id, i.id AS new_ref FROM u JOIN ids i ON i.old_id = u.ref JOIN ids o ON o.old_id = u.old_id) SELECT id, count(DISTINCT new_ref) AS refs FROM x GROUP BY id",
)
def backup_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, r = _backup(spark, sf_dir)
    return B.remapped_references(r, ids).select("id", F.size("derived_from").cast("bigint").alias("refs"))


@registry.query("selected_pairs", ROUTES + "SELECT DISTINCT least(id, x) AS a_id, greatest(id, x) AS b_id FROM (SELECT id, unnest(derived_from) AS x FROM routes) u WHERE x IS NOT NULL AND x <> id AND id IN (SELECT id FROM routes WHERE activity = 'gravel') AND x IN (SELECT id FROM routes WHERE activity = 'gravel')")
def selected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routes_of(spark, sf_dir)
    pairs = r.select("id", F.explode("derived_from").alias("x")).where("x IS NOT NULL AND x <> id").select(F.least("id", "x").alias("a_id"), F.greatest("id", "x").alias("b_id")).distinct()
    return B.pairs_inside(pairs, r.where("activity = 'gravel'")).select("a_id", "b_id")


@registry.query("selected_collections", f"WITH RECURSIVE {_TREE}, up AS (SELECT id, id AS ancestor FROM collections UNION SELECT u.id, c.parent_id FROM up u JOIN collections c ON c.id = u.ancestor WHERE c.parent_id IS NOT NULL), h AS (SELECT DISTINCT id % 25 AS id FROM library_routes WHERE quality_rating = 5 AND elevation_gain_m > 900) SELECT c.id, c.name FROM collections c WHERE c.id IN (SELECT ancestor FROM up JOIN h USING (id))")
def selected_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, r = _tree(spark, sf_dir), load(spark, sf_dir, "library_routes")
    members = r.select((F.col("id") % 25).alias("collection_id"), F.col("id").alias("route_id"))
    return B.selected_collections(t, members, r.where("quality_rating = 5 AND elevation_gain_m > 900"), C.closure(t)).select("id", "name")


_PASSED = "p AS (SELECT user_id AS id, event_type || ' ' || (event_id % 13) AS place, (event_id % 1000) / 1000.0 AS pos, CAST(value AS DOUBLE) AS score, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' END AS role FROM events WHERE value IS NOT NULL)"


@registry.query(
    "route_names",
    f"WITH {_PASSED}, e AS (SELECT id, min(CASE WHEN role = 'start' THEN place END) AS s, min(CASE WHEN role = 'end' THEN place END) AS f FROM p GROUP BY id), b AS (SELECT id, place, max(score) AS score FROM p WHERE role IS NULL AND pos BETWEEN 0.05 AND 0.95 GROUP BY id, place), "
    "c AS (SELECT b.id, b.place, b.score, min(p.pos) AS pos FROM b JOIN p ON p.id = b.id AND p.place = b.place AND p.score = b.score AND p.role IS NULL AND p.pos BETWEEN 0.05 AND 0.95 GROUP BY 1, 2, 3), "
    "o AS (SELECT c.* FROM c JOIN e USING (id) WHERE c.place IS DISTINCT FROM s AND c.place IS DISTINCT FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY id, least(floor(pos * 3), 2) ORDER BY score DESC, pos, place) AS rn FROM o), "
    "v AS (SELECT id, string_agg(place, ' – ' ORDER BY pos, place) AS via FROM r WHERE rn = 1 GROUP BY id) SELECT e.id, coalesce(nullif(concat_ws(' – ', s, via, CASE WHEN f IS DISTINCT FROM s THEN f END), ''), 'Unnamed route') AS name FROM e LEFT JOIN v USING (id)",
)
def route_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where("value IS NOT NULL")
    role = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end")
    place = F.concat_ws(" ", "event_type", F.col("event_id") % 13)
    return B.generated_names(e.select(F.col("user_id").alias("id"), place.alias("place"), (F.col("event_id") % 1000 / 1000).alias("pos"), F.col("value").cast("double").alias("score"), role.alias("role")))


@registry.query("file_checksums", ROUTES + "SELECT CAST(id AS VARCHAR) AS path, sha256(name) AS sha256 FROM routes WHERE name IS NOT NULL")
def file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = routes_of(spark, sf_dir).where("name IS NOT NULL").select(F.col("id").cast("string").alias("path"), F.encode("name", "UTF-8").alias("content"))
    return Z.checksums(files).select("path", "sha256")


@registry.query("map_layers", r"SELECT DISTINCT file_name, regexp_replace(file_name, '\.[^.]*$', '') AS layer FROM place_set_lines")
def map_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "place_set_lines").select("file_name").distinct().select("file_name", Z.map_and_layer(F.col("file_name"))["layer"].alias("layer"))
