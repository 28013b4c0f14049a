"""Operators of the library's catalogue: duplicate groups, collections, places and lists, tile sets, names, import order, axis and time helpers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions import text as T
from ridgeline.session import cut

# Keys as the store accepts them, and the words the library puts before an original name.
HASH_KEY = "^[0-9a-f]{64}$"
PAIR_KEY = "^[0-9]+_[0-9]+$"
DOC_KEY = "^[a-z_]+:[A-Za-z0-9_-]+$"
ORIGINAL_PREFIX = "Original name: "
ZOOM = 14


# ---- duplicate groups


def connected_groups(pairs: DataFrame) -> DataFrame:
    """(id, grp): connected groups of ``pairs`` (a_id, b_id), named by their least id.

    Alternating star contraction: every round hangs the neighbours of each node on the least of them, first the larger and then the
    smaller ones, until the edges stay; the number of rounds grows with the logarithm of the longest chain, the state is cut each time.
    Null ends and loops are no pairs. A hub's neighbours are aggregated with map-side combine, none are collected.
    """
    ends = pairs.where("a_id IS NOT NULL AND b_id IS NOT NULL AND a_id <> b_id")
    edges = cut(ends.select(F.greatest("a_id", "b_id").alias("u"), F.least("a_id", "b_id").alias("v")).distinct())

    def hung(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        near = both.where("v > u") if larger else both
        moved = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not larger:
            moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    while True:
        renewed = cut(hung(hung(edges, True), False))
        same = edges.count() == renewed.count() and not edges.join(renewed, ["u", "v"], "left_anti").head(1)
        edges = renewed
        if same:
            break
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("grp"))
    return stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("grp"))).distinct()


def without_ignored(pairs: DataFrame, ignored: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id) that are not among the ignored ones, in either order."""
    known = ignored.select(F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi")).distinct()
    return pairs.withColumns({"lo": F.least("a_id", "b_id"), "hi": F.greatest("a_id", "b_id")}).join(known, ["lo", "hi"], "left_anti").drop("lo", "hi")


def keep_ranking(groups: DataFrame, routes: DataFrame) -> DataFrame:
    """(grp, id, place): members of each group, the one to keep first: most personal data, then the oldest import, then the least id."""
    personal = F.col("quality_rating").isNotNull().cast("int") + (F.size(F.coalesce("tags", F.array())) > 0).cast("int") + (F.coalesce("notes", F.lit("")) != "").cast("int")
    members = groups.join(routes.select("id", "imported_at", personal.alias("personal")), "id")
    order = W.partitionBy("grp").orderBy(F.col("personal").desc(), F.col("imported_at").asc_nulls_last(), "id")
    return members.select("grp", "id", F.row_number().over(order).alias("place"))


def variants(pairs: DataFrame, similar: float, least: float) -> DataFrame:
    """(part_id, whole_id, covered_pct): routes that lie on another, of pairs (a_id, b_id, a_in_b, b_in_a) that are not alike both ways."""
    part_is_a = F.col("a_in_b") >= F.col("b_in_a")
    apart = pairs.where((F.least("a_in_b", "b_in_a") < similar) & (F.greatest("a_in_b", "b_in_a") >= least))
    return apart.select(
        F.when(part_is_a, F.col("a_id")).otherwise(F.col("b_id")).alias("part_id"), F.when(part_is_a, F.col("b_id")).otherwise(F.col("a_id")).alias("whole_id"),
        F.floor(F.greatest("a_in_b", "b_in_a") * 100 + 0.5).alias("covered_pct"),
    )


def pairs_in_order(pairs: DataFrame) -> DataFrame:
    """Pairs with their position: largest shared part first, then the nearest."""
    order = W.orderBy(F.greatest("a_in_b", "b_in_a").desc(), F.col("min_distance_m").asc(), "a_id", "b_id")
    return pairs.withColumn("position", F.row_number().over(order))


def best_ride_match(rides: DataFrame, least: float = 0.8) -> DataFrame:
    """(ride_id, route_id): of (ride_id, route_id, b_in_a) the route that the ride covers most, if at least so much of it."""
    best = rides.where(F.col("b_in_a") >= least).groupBy("ride_id").agg(F.min(F.struct((-F.col("b_in_a")).alias("share"), "route_id")).alias("best"))
    return best.select("ride_id", F.col("best.route_id").alias("route_id"))


# ---- collections


def collections_of(members: DataFrame, paths: DataFrame) -> DataFrame:
    """(route_id, path): every collection a route is in, with its full path; ``paths`` is (id, path)."""
    return members.join(paths, F.col("collection_id") == F.col("id")).select("route_id", "path").distinct()


def delete_collection(collections: DataFrame, gone: Column) -> DataFrame:
    """The tree without the collections for which ``gone`` holds; their children move up to the next that stays."""
    kept = collections.select("id", "parent_id", "name", gone.alias("gone"))
    dropped = kept.where("gone").select(F.col("id").alias("parent_id"), F.col("parent_id").alias("up"))
    out = kept.where("NOT gone").drop("gone")
    # chains of dropped collections: their length is bounded by their number
    while True:
        moved = out.join(dropped.withColumn("hit", F.lit(True)), "parent_id", "left")
        if not moved.where("hit").head(1):
            return out
        out = cut(moved.select("id", F.when(F.col("hit"), F.col("up")).otherwise(F.col("parent_id")).alias("parent_id"), "name"))


def moves_into_itself(closure: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves (id, new_parent) that would put a collection below itself; ``closure`` is (ancestor, id)."""
    below = closure.select(F.col("ancestor").alias("id"), F.col("id").alias("new_parent"))
    return moves.join(below, ["id", "new_parent"], "left_semi")


def merged_collections(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, parent_id, id): collections asked for, with the id of the twin of the same name, whatever its case, under the same parent, or null."""
    key = lambda df: df.withColumn("k", F.lower(F.trim("name")))
    twin = key(existing).groupBy("parent_id", "k").agg(F.min("id").alias("id"))
    asked = key(wanted).alias("w").join(twin.alias("t"), (F.col("w.k") == F.col("t.k")) & F.col("w.parent_id").eqNullSafe(F.col("t.parent_id")), "left")
    return asked.select("w.name", "w.parent_id", "t.id")


def added_members(members: Column, added: Column) -> Column:
    """Ids of a collection with those appended, in order, that are not in it yet."""
    return F.array_union(members, added)


def removed_members(members: Column, removed: Column) -> Column:
    return F.filter(members, lambda x: ~F.array_contains(removed, x))


# ---- places and lists


def visible_places(places: DataFrame, lists: DataFrame) -> DataFrame:
    """Places whose list is not hidden; a place without a list, or of an unknown one, is shown."""
    hidden = lists.where(~F.col("visible")).select(F.col("id").alias("list_id")).distinct()
    return places.join(hidden, "list_id", "left_anti")


def filter_places(places: DataFrame, category: str | None = None, list_id: str | None = None, text: str | None = None) -> DataFrame:
    """Places of a category, a list, and with a text in name or notes; what is not given does not filter."""
    out = places
    if category:
        out = out.where(F.col("category") == category)
    if list_id:
        out = out.where(F.col("list_id") == list_id)
    if text:
        said = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
        out = out.where(said(F.col("name")) | said(F.col("notes")))
    return out


def mine_and_found(mine: DataFrame, found: DataFrame) -> DataFrame:
    """Places of both kinds in one table, told apart by ``origin``."""
    return mine.withColumn("origin", F.lit("mine")).unionByName(found.withColumn("origin", F.lit("osm")))


def category_id(label: Column) -> Column:
    """An id for a new category: its label as at most 30 plain characters."""
    return T.slugify(label, "category", 30)


def suggested_category(category: Column, icon: Column, layer: Column, categories: Column) -> Column:
    """The category of an uploaded place: by its own column (label or id, then words), else by the icon's file name, else by the layer's."""
    own = F.lower(F.trim(category))
    literal = F.get(F.filter(categories, lambda c: (F.lower(F.trim(c["label"])) == own) | (c["id"] == own)), F.lit(0))["id"]
    icon_words = F.translate(F.regexp_replace(F.substring_index(icon, "/", -1), r"\.\w+$", ""), "-_", "  ")
    return F.coalesce(literal, *(T.match_category(x, categories) for x in (category, icon_words, layer)))


def categories_in_use(categories: DataFrame, places: DataFrame) -> DataFrame:
    """(id, places): how many places stand in the way of deleting a category; only those with none may go."""
    used = places.groupBy(F.col("category").alias("id")).agg(F.countDistinct(F.col("id")).alias("places"))
    return categories.select("id").join(used, "id", "left").select("id", F.coalesce("places", F.lit(0)).alias("places"))


def new_accounts(listed: DataFrame, imported: DataFrame) -> DataFrame:
    """What of an account's list (url) is not in the library yet."""
    return listed.join(imported.where(F.col("url").isNotNull()).select("url").distinct(), "url", "left_anti")


# ---- names and files


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = ("".join(f"{a:.5f},{o:.5f};" for a, o in zip(lat, lon, strict=True)) for lat, lon in zip(pdf["lat"], pdf["lon"], strict=True))
        yield pd.DataFrame({"id": pdf["id"], "hash": [hashlib.sha256(t.encode()).hexdigest() for t in texts]})


def track_hashes(lines: DataFrame) -> DataFrame:
    """(id, hash): SHA-256 of the coordinates of each line rounded to five places; the same track in another file has the same.

    In Arrow batches: Spark's format rounds the shortest decimal, the hash the binary value.
    """
    arrays = lines.where("geometry IS NOT NULL").select("id", F.col("geometry.lat").alias("lat"), F.col("geometry.lon").alias("lon"))
    return arrays.mapInPandas(_hashes, "id long, hash string")


def import_order(filename: Column) -> list[Column]:
    """Sort keys of an import: folder, name without the number of a copy, shorter names first, name."""
    file = F.substring_index(filename, "/", -1)
    folder = F.when(F.instr(filename, "/") > 0, F.substring(filename, F.lit(1), F.length(filename) - F.length(file) - 1)).otherwise("")
    bare = F.lower(F.regexp_replace(T.stem_of(filename), r"\s*\(\d+\)$", ""))
    return [folder, bare, F.length(file), file]


def notes_with_original(notes: Column, original: Column) -> Column:
    """Notes that begin with the original name, put there only once."""
    bare = F.trim(F.coalesce(notes, F.lit("")))
    named = F.concat(F.lit(ORIGINAL_PREFIX), original)
    return F.when(bare.startswith(ORIGINAL_PREFIX), bare).when(bare == "", named).otherwise(F.concat(named, F.lit("\n\n"), bare))


def told_apart(names: DataFrame) -> DataFrame:
    """(id, name): of (id, name, distance_km) the later routes of one name get their distance, and a number where that is taken as well."""
    key, km = F.lower("name"), F.floor(F.col("distance_km") + 0.5).cast("string")
    again = names.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy("id"))).withColumn("km", km)
    same_km = F.row_number().over(W.partitionBy(key, "km", F.col("nth") > 1).orderBy("id"))
    again = again.withColumn("m", same_km)
    named = F.when(F.col("nth") == 1, F.col("name")).when(F.col("m") == 1, F.concat("name", F.lit(" ("), "km", F.lit(" km)"))).otherwise(
        F.concat("name", F.lit(" ("), "km", F.lit(" km, "), F.col("m").cast("string"), F.lit(")"))
    )
    return again.select("id", named.alias("name"))


def natural_key(text: Column) -> Column:
    """Sort key in which numbers count by value: digits padded to ten places, case and marks left out."""
    parts = F.regexp_extract_all(T.fold(F.lower(text)), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]{1,9}$"), F.lpad(x, 10, "0")).otherwise(x)), "")


def key_kinds(key: Column) -> Column:
    """What a stored key is: a file's hash, a pair of routes, a document's key, or null."""
    return F.when(key.rlike(HASH_KEY), "hash").when(key.rlike(PAIR_KEY), "pair").when(key.rlike(DOC_KEY), "doc")


# ---- tiles


def tile_range(x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame | Column:
    """All tiles of a box, as an array of (x, y)."""
    return F.flatten(F.transform(F.sequence(x0, x1), lambda x: F.transform(F.sequence(y0, y1), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def shared_tiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tiles (x, y) of both sets."""
    return a.select("x", "y").distinct().join(b.select("x", "y").distinct(), ["x", "y"], "left_semi")


def chosen_sets(sets: DataFrame) -> DataFrame:
    """(role, id): the active tile set (marked, else the first by name) and the one compared with it, which is another."""
    order = W.orderBy(F.col("active").desc_nulls_last(), F.lower("name"), "id")
    ranked = sets.withColumn("rank", F.row_number().over(order)).where("rank <= 2")  # a handful of sets
    return ranked.select(F.when(F.col("rank") == 1, "active").otherwise("compare").alias("role"), "id")


# ---- axes, times


def nice_step(span: Column, most: int) -> Column:
    """The least step of 1, 2 or 5 times a power of ten that gives at most so many ticks."""
    raw = span / most
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    part = raw / power
    return F.when(span > 0, power * F.when(part <= 1, 1).when(part <= 2, 2).when(part <= 5, 5).otherwise(10)).otherwise(F.lit(1.0))


def ticks(low: Column, high: Column, step: Column) -> Column:
    """Multiples of the step within the range."""
    return F.transform(F.sequence(F.ceil(low / step), F.floor(high / step)), lambda k: k * step)


def next_saturday(day: Column) -> Column:
    """The Saturday of the week, the day itself if it is one."""
    return F.next_day(F.date_sub(day, 1), "SAT")


def added_minutes(time: Column, minutes: Column) -> Column:
    """HH:MM plus minutes, around the clock."""
    total = F.pmod(F.substring(time, 1, 2).cast("int") * 60 + F.substring(time, 4, 2).cast("int") + minutes, F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(total / 60).cast("int"), F.pmod(total, F.lit(60)).cast("int"))


def sample_distances(total_m: Column) -> Column:
    """Distances at which the weather of a route is asked: every 5 km or so, 2 to 21 of them, both ends included."""
    n = F.greatest(F.lit(2), F.least(F.lit(21), F.floor(total_m / 5000 + 0.5) + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: k * total_m / (n - 1))


def weather_kind(code: Column) -> Column:
    """WMO weather code by kind."""
    return (
        F.when(code == 0, "clear").when(code <= 2, "fair").when(code == 3, "cloud").when(code.isin(45, 48), "fog").when(code >= 95, "thunder")
        .when(code.between(71, 77) | code.isin(85, 86), "snow").when(code.isNotNull(), "rain")
    )


# ---- answers of services


def daily_rows(answers: DataFrame) -> DataFrame:
    """(id, day, t_min, t_max, rain_mm): rows of daily forecasts that come as JSON with one array a field; arrays of unequal length are filled with nulls."""
    schema = "struct<daily: struct<time: array<string>, temperature_2m_min: array<double>, temperature_2m_max: array<double>, precipitation_sum: array<double>>>"
    d = F.from_json("answer", schema)["daily"]
    of = lambda name, kind: F.coalesce(d[name], F.array().cast(f"array<{kind}>"))
    zipped = F.arrays_zip(
        of("time", "string").alias("day"), of("temperature_2m_min", "double").alias("t_min"), of("temperature_2m_max", "double").alias("t_max"),
        of("precipitation_sum", "double").alias("rain_mm"),
    )
    return answers.select("id", F.explode(zipped).alias("r")).select("id", "r.*").where("day IS NOT NULL")


def found_places(answers: DataFrame) -> DataFrame:
    """(id, osm_id, name, lat, lon, category): elements of map answers in JSON that have a place category; ways and areas stand at their centre."""
    schema = "struct<elements: array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>>"
    e = answers.select("id", F.explode(F.from_json("answer", schema)["elements"]).alias("e"))
    found = e.select(
        "id", F.concat_ws("/", "e.type", "e.id").alias("osm_id"), F.coalesce(F.col("e.tags")["name"], F.lit("")).alias("name"),
        F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), T.osm_category(F.col("e.tags")).alias("category"),
    )
    return found.where("category IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
