"""Library queries: filters, sorting, facets, catalog counts, tags and text rules over the table of routes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions.text import normalise_tags
from ridgeline.session import cut

SORTABLE = ("name", "distance_km", "elevation_gain_m", "paved_pct", "quality_rating", "source_name", "imported_at", "is_loop", "activity")
ACTIVITIES = ("gravel", "road", "mtb", "hiking")
#: Filter keys a smart collection keeps, in the order of its canonical text.
FILTER_KEYS = ("q", "min_distance", "max_distance", "min_gain", "max_gain", "min_paved", "max_paved", "min_quality", "tags", "source", "loop", "activity", "coll", "region", "area")


def current_versions(routes: DataFrame) -> DataFrame:
    """The latest version of each route, all columns."""
    newest = W.partitionBy("id").orderBy(F.col("updated_at").desc_nulls_last())
    return routes.where(F.col("id").isNotNull()).withColumn("version_rank", F.row_number().over(newest)).where("version_rank = 1").drop("version_rank")


@dataclass
class RouteFilter:
    """Typed filters; what is None or empty does not filter. Null values never satisfy a bound."""

    q: str | None = None
    min_distance: float | None = None
    max_distance: float | None = None
    min_gain: float | None = None
    max_gain: float | None = None
    min_paved: float | None = None
    max_paved: float | None = None
    min_quality: float | None = None
    tags: list[str] = field(default_factory=list)
    source: str | None = None
    loop: bool | None = None
    activity: str | None = None
    coll: str | None = None
    region: str | None = None
    area: str | None = None
    ids: list[int] = field(default_factory=list)
    sort: str = "name"
    order: str = "asc"

    @classmethod
    def parse(cls, query: str) -> RouteFilter:
        """From a query string; what is no number where one is wanted does not filter."""
        got = parse_qs(query.lstrip("?"), keep_blank_values=True)
        first = lambda k: (got.get(k) or [""])[0]

        def number(key: str) -> float | None:
            try:
                value = float(first(key))
            except ValueError:
                return None
            return value if abs(value) != float("inf") and value == value else None

        numbers = {k: number(k) for k in FILTER_KEYS if k.startswith(("min_", "max_"))}
        texts = {k: first(k) or None for k in ("q", "source", "activity", "coll", "region", "area")}
        return cls(
            **numbers, **texts, tags=got.get("tags", []), loop={"true": True, "false": False}.get(first("loop")),
            ids=[int(x) for x in got.get("ids", []) if x.isdigit() and int(x)], sort=first("sort") or "name", order=first("order") or "asc",
        )

    def canonical(self) -> str:
        """The query string of a smart collection: its filters in fixed order; an empty one is refused."""
        pairs: list[tuple[str, str]] = []
        for key in FILTER_KEYS:
            value = getattr(self, key)
            for one in value if isinstance(value, list) else [value]:
                if one is not None and one != "":
                    pairs.append((key, str(one).lower() if isinstance(one, bool) else f"{one:g}" if isinstance(one, float) else str(one)))
        if not pairs:
            raise ValueError("a smart collection needs a filter")
        return urlencode(pairs)

    def predicate(self) -> Column:
        bounds = (("distance_km", self.min_distance, self.max_distance), ("elevation_gain_m", self.min_gain, self.max_gain), ("paved_pct", self.min_paved, self.max_paved), ("quality_rating", self.min_quality, None))
        tests = [F.lit(True)]
        for column, low, high in bounds:
            if low is not None:
                tests.append(F.col(column) >= low)
            if high is not None:
                tests.append(F.col(column) <= high)
        if self.q:
            tests.append(F.contains(F.lower("name"), F.lit(self.q.lower())) | F.contains(F.lower(F.coalesce("notes", F.lit(""))), F.lit(self.q.lower())))
        if self.source:
            tests.append(F.col("source_name") == self.source)
        if self.loop is not None:
            tests.append(F.col("is_loop") == self.loop)
        if self.activity:
            tests.append(F.col("activity") == self.activity)
        if self.ids:
            tests.append(F.col("id").isin(self.ids))
        if self.tags:
            wanted = normalise_tags(F.array(*map(F.lit, self.tags)))
            tests.append(F.size(F.array_except(wanted, F.coalesce("tags", F.array().cast("array<string>")))) == 0)
        if self.region:
            tests.append((F.col("region") == self.region) | (F.col("province") == self.region))
        return reduce(lambda a, b: a & b, tests)

    def ordering(self) -> list[Column]:
        """Empty values last in both directions, then by name, then by id."""
        key = self.sort if self.sort in SORTABLE else "name"
        value = F.lower(key) if key in ("name", "source_name") else F.col(key)
        return [value.desc_nulls_last() if self.order == "desc" else value.asc_nulls_last(), F.lower("name").asc_nulls_last(), F.col("id").asc()]


def filter_routes(routes: DataFrame, wanted: RouteFilter, members: DataFrame | None = None, starting: DataFrame | None = None) -> DataFrame:
    """Filtered, unsorted; ``members`` (id) of a collection's subtree and ``starting`` (id) in an area are semi-joined."""
    out = routes.where(wanted.predicate())
    if wanted.coll:
        out = out.join(members.select("id").distinct(), "id", "left_semi") if members is not None else out.where(F.lit(False))
    if wanted.area:
        out = out.join(starting.select("id").distinct(), "id", "left_semi") if starting is not None else out.where(F.lit(False))
    return out


def list_routes(routes: DataFrame, wanted: RouteFilter, **joins: DataFrame) -> DataFrame:
    return filter_routes(routes, wanted, **joins).orderBy(*wanted.ordering())


def positions(routes: DataFrame, wanted: RouteFilter, **joins: DataFrame) -> DataFrame:
    """(position, id, name): every filtered route with its place, from 1, in the whole order.

    A range-partitioned sort, checkpointed so that its partitions stay as they are; only their sizes come to the driver.
    """
    at = F.monotonically_increasing_id()  # partition number in the upper bits, row of the partition in the lower 33
    numbered = cut(list_routes(routes, wanted, **joins).select("id", "name")).withColumn("at", at).withColumn("partition", F.shiftrightunsigned("at", 33))
    before, total = [], 0
    for part, n in sorted(map(tuple, numbered.groupBy("partition").count().collect())):
        before.append((part, total))
        total += n
    offsets = F.broadcast(routes.sparkSession.createDataFrame(before, "partition long, before long"))  # one row a partition
    return numbered.join(offsets, "partition").select((F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("position"), "id", "name")


def source_facets(routes: DataFrame) -> DataFrame:
    return routes.where(F.col("source_name").isNotNull()).groupBy("source_name").agg(F.count(F.lit(1)).alias("routes"))


def tag_facets(routes: DataFrame) -> DataFrame:
    """(tag, routes): how many routes carry each tag; a tag a route repeats counts once."""
    return routes.select(F.explode(F.array_distinct("tags")).alias("tag")).where(F.col("tag").isNotNull()).groupBy("tag").agg(F.count(F.lit(1)).alias("routes"))


def catalog_counts(routes: DataFrame) -> DataFrame:
    """All catalog counts in one pass: grouping sets over activity, source, loop flag and the total."""
    r = routes.select("activity", "source_name", "is_loop")
    return (
        r.groupingSets([["activity"], ["source_name"], ["is_loop"], []], "activity", "source_name", "is_loop")
        .agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("routes"))
    )


def activity_counts(routes: DataFrame) -> DataFrame:
    """Routes of each known activity (trimmed, lower case); others are left out."""
    known = F.lower(F.trim("activity"))
    return routes.select(known.alias("activity")).where(F.col("activity").isin(*ACTIVITIES)).groupBy("activity").agg(F.count(F.lit(1)).alias("routes"))


def region_tree(routes: DataFrame) -> DataFrame:
    """Two-level roll-up (region, province, routes) without the grand total."""
    return routes.where(F.col("region").isNotNull()).rollup("region", "province").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("routes")).where("level < 3")


def validated_updates(changes: DataFrame) -> DataFrame:
    """Edits with the rules of the library applied and an ``error`` where one is broken; blank texts become null."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    activity = F.lower(F.trim("activity"))
    error = (
        F.when(F.length("name") > 300, "name too long").when((F.col("activity").isNotNull()) & ~activity.isin(*ACTIVITIES), "unknown activity")
        .when(~F.col("quality_rating").between(1, 5), "quality out of range").when(~F.col("paved_pct").between(0, 100), "paved share out of range")
    )
    return changes.select("id", blank(F.col("name")).alias("name"), activity.alias("activity"), "quality_rating", "paved_pct", blank(F.col("notes")).alias("notes"), error.alias("error"))


def same_tracks(routes: DataFrame) -> DataFrame:
    """(track_hash, routes, first_id) of hashes that several routes share."""
    return (
        routes.where(F.col("track_hash").isNotNull() & (F.col("track_hash") != "")).groupBy("track_hash")
        .agg(F.countDistinct("id").alias("routes"), F.min("id").alias("first_id")).where("routes > 1")
    )


def import_status(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """(id, status) of incoming tracks: error without a line, duplicate by file and track or by track hash, else imported.

    Both sides are (id, file_hash, track_index, track_hash); a row is not held against itself or later ones.
    """
    has_line = F.col("points") >= 2
    by_file = library.where(F.col("file_hash").isNotNull()).groupBy("file_hash", "track_index").agg(F.min("id").alias("file_first"))
    by_track = library.where(F.col("track_hash").isNotNull() & (F.col("track_hash") != "")).groupBy("track_hash").agg(F.min("id").alias("track_first"))
    flagged = incoming.join(by_file, ["file_hash", "track_index"], "left").join(by_track, "track_hash", "left")
    status = F.when(~F.coalesce(has_line, F.lit(False)), "error").when(F.col("file_first") < F.col("id"), "duplicate file").when(F.col("track_first") < F.col("id"), "duplicate track").otherwise("imported")
    return flagged.select("id", status.alias("status"))


def imported_by_url(routes: DataFrame) -> DataFrame:
    """(url, routes): routes by their canonical source address."""
    url = F.lower(F.regexp_replace(F.regexp_replace(F.trim("source_url"), "[?#].*$", ""), "/+$", ""))
    return routes.where(F.col("source_url").isNotNull()).select(url.alias("url"), "id").where("url <> ''").groupBy("url").agg(F.countDistinct("id").alias("routes"))


def numbered_slugs(slugs: DataFrame) -> DataFrame:
    """(id, slug): the first holder of a base keeps it, later ones get -2, -3, ... by id."""
    n = F.row_number().over(W.partitionBy("base").orderBy("id"))
    return slugs.select("id", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string"))).alias("slug"))


def upsert(table: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """Changed rows replace those of the same key, new ones are added."""
    return table.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes)


def deleted(table: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return table.join(keys, list(on), "left_anti")


def conflicting(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Ids whose stored version is not the one a change was made on: a batch with any is refused."""
    return changes.join(base.select("id", F.col("updated_at").alias("stored_at")), "id").where(~F.col("base_version").eqNullSafe(F.col("stored_at"))).select("id")


def ignored_pairs(pairs: DataFrame) -> DataFrame:
    """Sorted distinct pairs of different ids."""
    return pairs.where("a_id <> b_id").select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()
