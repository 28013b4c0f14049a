"""Surface of a matched track, generated names, and merging one library into another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions import text as T

#: Known surface needed for a paved share, and surfaces listed.
LEAST_KNOWN, LISTED = 0.5, 8


# ---- surface along a track


def surface_stretches(matched: DataFrame) -> DataFrame:
    """(id, stretch, category, inferred, from_m, to_m): neighbouring pieces of one category joined.

    ``matched`` is (id, seq, from_m, to_m, tags): pieces of a track in order with the tags of the way they run on; null tags are unknown.
    """
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    pieces = matched.withColumn("s", T.surface_class(tags)).select("id", "seq", "from_m", "to_m", "s.category", "s.inferred")
    order = W.partitionBy("id").orderBy("seq")
    before = F.lag("category").over(order).eqNullSafe(F.col("category")) & F.lag("to_m").over(order).eqNullSafe(F.col("from_m"))
    number = F.sum((~before).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return pieces.withColumn("stretch", number).groupBy("id", "stretch").agg(
        F.first("category").alias("category"), F.max("inferred").alias("inferred"), F.min("from_m").alias("from_m"), F.max("to_m").alias("to_m")
    )


def surface_summary(matched: DataFrame) -> DataFrame:
    """(id, paved_km, cobbles_km, unpaved_km, unknown_km, inferred_km, match_ratio, paved_pct) of matched tracks; the paved share only where half is known."""
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    p = matched.withColumn("s", T.surface_class(tags)).withColumn("m", F.col("to_m") - F.col("from_m"))
    of = lambda condition: F.sum(F.when(condition, F.col("m")).otherwise(0.0))
    total = p.groupBy("id").agg(
        *(of(F.col("s.category") == c).alias(f"{c}_m") for c in ("paved", "cobbles", "unpaved", "unknown")),
        of(F.col("s.inferred") & (F.col("s.category") != "unknown")).alias("inferred_m"), of(F.col("tags").isNotNull()).alias("matched_m"), F.sum("m").alias("route_m"),
    )
    known = F.col("paved_m") + F.col("cobbles_m") + F.col("unpaved_m")
    share = F.when(known >= LEAST_KNOWN * F.col("route_m"), F.floor(100 * (F.col("paved_m") + F.col("cobbles_m")) / known + 0.5))
    return total.select(
        "id", *(F.round(F.col(f"{c}_m") / 1000, 3).alias(f"{c}_km") for c in ("paved", "cobbles", "unpaved", "unknown", "inferred")),
        F.round(F.col("matched_m") / F.nullif(F.col("route_m"), F.lit(0.0)), 3).alias("match_ratio"), share.alias("paved_pct"),
    )


def top_surfaces(matched: DataFrame) -> DataFrame:
    """(id, rank, surface, km): the longest surfaces of each track, LISTED of them as the report shows."""
    km = matched.where(F.col("tags")["surface"].isNotNull()).groupBy("id", F.col("tags")["surface"].alias("surface")).agg((F.sum(F.col("to_m") - F.col("from_m")) / 1000).alias("km"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.col("km").desc(), "surface"))
    return km.withColumn("rank", rank).where(F.col("rank") <= LISTED).select("id", "rank", "surface", F.round("km", 3).alias("km"))


def applied_estimate(routes: DataFrame, estimates: DataFrame, overwrite: bool = False) -> DataFrame:
    """Routes (id, paved_pct, paved_source) with the estimated share (id, paved_pct); what was entered by hand stays unless overwritten."""
    e = estimates.select("id", F.col("paved_pct").alias("guess"))
    manual = F.coalesce(F.col("paved_source") == "manual", F.lit(False)) & F.lit(not overwrite)
    use = F.col("guess").isNotNull() & ~manual
    return routes.join(e, "id", "left").select("id", F.when(use, F.col("guess").cast("double")).otherwise(F.col("paved_pct")).alias("paved_pct"), F.when(use, "estimated").otherwise(F.col("paved_source")).alias("paved_source"))


# ---- generated names


def generated_names(visits: DataFrame, parts: int = 3, skip: float = 0.05) -> DataFrame:
    """(id, name): names of routes made of the places they pass, joined by a dash.

    ``visits`` is (id, place, pos, score, role): places along a route at a part ``pos`` of its length; ``role`` is start, end or null. The start comes first
    and the end, if it is another place, last; between them the best place of each third, without the first and last twentieth, each name once.
    """
    named = visits.where("place IS NOT NULL AND trim(place) <> ''")
    ends = named.where("role IN ('start', 'end')").groupBy("id").agg(F.min(F.when(F.col("role") == "start", F.col("place"))).alias("start"), F.min(F.when(F.col("role") == "end", F.col("place"))).alias("finish"))
    inside = named.where("role IS NULL").where(F.col("pos").between(skip, 1 - skip))
    best = inside.groupBy("id", "place").agg(F.max(F.struct("score", (-F.col("pos")).alias("early"))).alias("b")).select("id", "place", F.col("b.score").alias("score"), (-F.col("b.early")).alias("pos"))
    other = best.join(ends, "id", "left").where("NOT (place <=> start) AND NOT (place <=> finish)")
    part = F.least(F.floor(F.col("pos") * parts), F.lit(parts - 1))
    chosen = other.withColumn("rank", F.row_number().over(W.partitionBy("id", part).orderBy(F.col("score").desc(), "pos", "place"))).where("rank = 1")
    via = chosen.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "place"))).alias("via"))  # at most ``parts`` of them
    every = visits.select("id").distinct().join(ends, "id", "left").join(via, "id", "left")
    last = F.when(~F.col("finish").eqNullSafe(F.col("start")), F.col("finish"))
    names = F.filter(F.concat(F.array("start"), F.coalesce(F.col("via.place"), F.array().cast("array<string>")), F.array(last)), lambda x: x.isNotNull())
    return every.select("id", F.coalesce(F.nullif(F.array_join(names, " – "), F.lit("")), F.lit("Unnamed route")).alias("name"))


def backfilled_regions(routes: DataFrame, regions: DataFrame) -> DataFrame:
    """(id, region): routes without a region take that of their start from ``regions`` (id, region); the others keep theirs."""
    found = regions.select("id", F.col("region").alias("found"))
    return routes.select("id", "region").join(found, "id", "left").select("id", F.coalesce("region", "found").alias("region"))


# ---- merging a backup into a library


def id_map(library: DataFrame, backup: DataFrame) -> DataFrame:
    """(old_id, id, is_new): where each route of a backup goes: to the route of the same file and track, else of the same track, else to a new id.

    Both are (id, file_hash, track_index, track_hash). New ids follow the greatest of the library in the order of the old ones: numbered by range
    partitions, so that no task sees all rows.
    """
    key = F.concat_ws(":", "file_hash", F.col("track_index").cast("string"))
    files = library.where("file_hash IS NOT NULL").groupBy(key.alias("k")).agg(F.min("id").alias("by_file"))
    tracks = library.where("track_hash IS NOT NULL").groupBy("track_hash").agg(F.min("id").alias("by_track"))
    old = backup.select(F.col("id").alias("old_id"), F.when(F.col("file_hash").isNotNull(), key).alias("k"), "track_hash")
    met = old.join(files, "k", "left").join(tracks, "track_hash", "left").select("old_id", F.coalesce("by_file", "by_track").alias("id"))
    fresh = met.where("id IS NULL").select("old_id")
    parts = fresh.repartitionByRange("old_id").withColumn("part", F.spark_partition_id())
    before = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.sum("n").over(W.orderBy("part")) - F.col("n")).select("part", "offset")
    within = F.row_number().over(W.partitionBy("part").orderBy("old_id"))
    most = library.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))
    numbered = parts.withColumn("nth", within).join(before, "part").crossJoin(F.broadcast(most)).select("old_id", (F.col("most") + F.col("offset") + F.col("nth")).alias("id"), F.lit(True).alias("is_new"))
    return met.where("id IS NOT NULL").select("old_id", "id", F.lit(False).alias("is_new")).unionByName(numbered)


def remapped_references(backup: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, derived_from): references of a backup's routes (id, derived_from array) under their new ids; those that lead out of the backup are dropped."""
    refs = backup.select(F.col("id").alias("old_id"), F.posexplode("derived_from").alias("n", "ref"))
    to = ids.select(F.col("old_id").alias("ref"), F.col("id").alias("new_ref"))
    owner = ids.select("old_id", "id")
    found = refs.join(to, "ref").join(owner, "old_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "new_ref"))).alias("refs"))
    return found.select("id", F.array_distinct(F.col("refs.new_ref")).alias("derived_from"))


def pairs_inside(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id) of which both routes are chosen (id)."""
    one = chosen.select("id").distinct()
    return pairs.join(one.withColumnRenamed("id", "a_id"), "a_id", "left_semi").join(one.withColumnRenamed("id", "b_id"), "b_id", "left_semi")


def selected_collections(collections: DataFrame, members: DataFrame, chosen: DataFrame, closure: DataFrame) -> DataFrame:
    """Collections (id, parent_id, name) that hold a chosen route, with all those they lie in; ``closure`` is (ancestor, id)."""
    holding = members.join(chosen.select(F.col("id").alias("route_id")).distinct(), "route_id", "left_semi").select(F.col("collection_id").alias("id")).distinct()
    kept = closure.join(holding, "id", "left_semi").select(F.col("ancestor").alias("id")).distinct()
    return collections.join(kept, "id", "left_semi")
