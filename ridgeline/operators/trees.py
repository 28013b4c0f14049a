"""Nested collections (a parent-pointer tree), rides, timetables and round-robin choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.session import cut

def closure(collections: DataFrame) -> DataFrame:
    """(ancestor, id): every collection with all it lies in, itself included, however deep; a cycle ends where it began.

    By doubling: the pairs found so far are joined with themselves, so a tree of depth d takes log2 d rounds; the state is cut each time.
    """
    steps = collections.where("parent_id IS NOT NULL AND parent_id <> id").select("id", F.col("parent_id").alias("ancestor"))
    known = collections.select(F.col("id").alias("ancestor"))
    found = cut(steps.join(known, "ancestor", "left_semi").select("id", "ancestor").distinct())
    while True:
        further = found.join(found.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next")), "ancestor").select("id", F.col("next").alias("ancestor"))
        more = cut(found.unionByName(further).distinct())
        if more.count() == found.count():
            break
        found = more
    itself = collections.select(F.col("id").alias("ancestor"), "id")
    return itself.unionByName(more.select("ancestor", "id")).distinct()


def paths(collections: DataFrame) -> DataFrame:
    """(id, path): names from the root, joined by the sign the library shows; the path of a collection in a cycle begins after it comes back to itself.

    By doubling: each row holds the names up to the ancestor it has reached, and takes over the names of that ancestor.
    """
    names = collections.select("id", "name", "parent_id")
    known = names.select(F.col("id").alias("up"))
    at = names.join(known, F.col("parent_id") == F.col("up"), "left").select("id", F.array("name").alias("names"), F.when(F.col("up") != F.col("id"), F.col("up")).alias("up"), F.array("id").alias("seen"))
    at = cut(at)
    while at.where("up IS NOT NULL").head(1):
        above = at.select(F.col("id").alias("up"), F.col("names").alias("more"), F.col("up").alias("next"), F.col("seen").alias("over"))
        both = at.join(above, "up", "left")
        loop = F.arrays_overlap("seen", "over")
        at = cut(both.select(
            "id", F.when(F.col("up").isNull() | loop, F.col("names")).otherwise(F.concat("more", "names")).alias("names"),
            F.when(~F.coalesce(loop, F.lit(True)), F.col("next")).alias("up"), F.when(F.col("up").isNull() | loop, F.col("seen")).otherwise(F.concat("over", "seen")).alias("seen"),
        ))
    return at.select("id", F.array_join("names", " › ").alias("path"))


def counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    """(id, routes): distinct routes of each collection with its sub-collections; ``members`` is (collection_id, route_id)."""
    inside = closure(collections).join(members, F.col("id") == F.col("collection_id"), "left")
    return inside.groupBy(F.col("ancestor").alias("id")).agg(F.countDistinct("route_id").alias("routes"))


def first_connection(trips: DataFrame, timetable: DataFrame, wait_minutes: int = 10) -> DataFrame:
    """As-of join: for each trip (id, origin, target, ready) the first departure at least the wait after it is ready."""
    t = timetable.select(F.col("origin"), F.col("target"), "departure", "arrival")
    due = F.col("ready") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(wait_minutes))
    return trips.join(t, ["origin", "target"]).where(F.col("departure") >= due).groupBy("id").agg(F.min(F.struct("departure", "arrival")).alias("c")).select("id", "c.departure", "c.arrival")


def round_robin(candidates: DataFrame, most: int) -> DataFrame:
    """Take the best of each pattern in turn until there are enough; candidates are (pattern, id, cost)."""
    rank = F.row_number().over(W.partitionBy("pattern").orderBy("cost", "id"))
    return candidates.withColumn("turn", rank).where(F.col("turn") <= most).orderBy("turn", "pattern").limit(most)


def best_per(candidates: DataFrame, keys: list[str], *order: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return candidates.withColumn("kept", rank).where("kept = 1").drop("kept")


def train_candidates(routes: DataFrame, near_start: DataFrame, near_end: DataFrame, home_id: int, home_radius_km: float = 10.0, reach_factor: float = 1.3) -> DataFrame:
    """Rides that begin or end at a station: (id, pattern, from_id, to_id, reversed, ride_km, connector_m), the best of each route and pattern.

    ``near_start`` and ``near_end`` are (id, target_id, metres), the stations near each end; ``home_id`` is the home station. Patterns: ``out`` (by
    train, ride home), ``back`` (ride from home, return by train), ``between`` (two other stations) and ``loop`` (one station and back). A route that is
    no loop is tried both ways; the way with less riding to and from the stations is kept. Connectors beyond ``home_radius_km`` do not count.
    """
    near = lambda df, p: df.where(F.col("metres") <= home_radius_km * 1000).select("id", F.col("target_id").alias(f"{p}_id"), F.col("metres").alias(f"{p}_m"))
    a, b = near(near_start, "one"), near(near_end, "two")
    ends = routes.join(a, "id").join(b, "id")
    loop = F.coalesce("is_loop", F.lit(False))
    there = ends.select("id", "distance_km", loop.alias("loop"), F.col("one_id").alias("from_id"), F.col("two_id").alias("to_id"), F.col("one_m").alias("from_m"), F.col("two_m").alias("to_m"), F.lit(False).alias("reversed"))
    back = there.where("NOT loop").select("id", "distance_km", "loop", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.col("to_m").alias("from_m"), F.col("from_m").alias("to_m"), F.lit(True).alias("reversed"))
    pattern = (
        F.when(F.col("loop") & (F.col("from_id") == F.col("to_id")) & (F.col("from_id") != home_id), "loop").when(F.col("loop"), None)
        .when(F.col("from_id") == F.col("to_id"), None).when(F.col("to_id") == home_id, "out").when(F.col("from_id") == home_id, "back").otherwise("between")
    )
    tried = there.unionByName(back).withColumns({"pattern": pattern, "connector_m": reach_factor * (F.col("from_m") + F.col("to_m"))}).where("pattern IS NOT NULL")
    ride = F.floor((F.col("distance_km") + F.col("connector_m") / 1000) * 10 + 0.5) / 10
    best = best_per(tried, ["id", "pattern"], "connector_m", "reversed", "from_id", "to_id")
    return best.select("id", "pattern", "from_id", "to_id", "reversed", ride.alias("ride_km"), F.floor("connector_m").alias("connector_m"))
