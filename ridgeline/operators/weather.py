"""Ride weather: wind on the riding direction, readings between hours, stretches and the summary of a ride."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.operators.track import route_segments

CALM_KMH, HEAD_DEG, TAIL_DEG = 5.0, 60.0, 120.0
REVERSE_GAIN_KMH = 2.0


def wind_effect(heading: Column, wind_from: Column, speed: Column) -> tuple[Column, Column]:
    """(effect, headwind in km/h, negative from behind)."""
    angle = geo.angle_between(heading, wind_from)
    effect = F.when(speed < CALM_KMH, "calm").when(angle <= HEAD_DEG, "head").when(angle >= TAIL_DEG, "tail").otherwise("cross")
    return effect, speed * F.cos(F.radians(angle))


def wind_effort(head: Column, speed: Column) -> Column:
    """Air drag grows with the square of the air speed, so a headwind costs more than a tailwind gives back."""
    air = speed + head
    return (air * F.abs(air) - speed * speed) / (2 * speed)


def reading_at(rides: DataFrame, hourly: DataFrame) -> DataFrame:
    """The weather at ``t`` of each row: an as-of join on the hour before and the next one, by equality.

    Temperature and wind are interpolated, wind as a vector; rain is that of the hour ending at or after t. Rows outside the series are dropped.
    """
    before = F.date_trunc("hour", "t")
    part = (F.unix_micros("t") - F.unix_micros(before)) / F.lit(3.6e9)
    east, north = F.col("wind_speed") * F.sin(F.radians("wind_dir")), F.col("wind_speed") * F.cos(F.radians("wind_dir"))
    h = hourly.select("hour", "temp", "rain", east.alias("u"), north.alias("v"))
    one = h.select(*[F.col(c).alias(f"{c}_a") for c in h.columns])
    two = h.select(*[F.col(c).alias(f"{c}_b") for c in h.columns])
    timed = rides.withColumns({"hour_a": before, "part": part}).withColumn("hour_b", F.when(F.col("part") > 0, F.col("hour_a") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("hour_a")))
    both = timed.join(one, "hour_a").join(two, "hour_b")
    mix = lambda c: F.col(f"{c}_a") + F.col("part") * (F.col(f"{c}_b") - F.col(f"{c}_a"))
    mixed = both.withColumns({"temp": mix("temp"), "u": mix("u"), "v": mix("v"), "rain": F.when(F.col("part") > 0, F.col("rain_b")).otherwise(F.col("rain_a"))})
    return mixed.select(*rides.columns, "temp", "rain", F.hypot("u", "v").alias("wind_speed"), F.pmod(F.degrees(F.atan2("u", "v")) + 360, F.lit(360.0)).alias("wind_dir"))


def ride_steps(routes: DataFrame, start: Column, speed_kmh: float) -> DataFrame:
    """(id, seq, len, mid, total, heading, t): each step of a ride with the time at its middle."""
    s = route_segments(routes).withColumn("len", geo.flat_metres(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).where("len > 0")
    s = s.withColumn("heading", geo.bearing(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    run = W.partitionBy("id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = s.withColumn("mid", F.sum("len").over(run) - F.col("len") / 2).withColumn("total", F.sum("len").over(W.partitionBy("id")))
    t = F.timestamp_micros((F.unix_micros(start) + F.floor(F.col("mid") / (speed_kmh / 3.6) * 1e6)).cast("long"))
    return s.select("id", "seq", "len", "mid", "total", "heading", t.alias("t"))


def ride_weather(routes: DataFrame, hourly: DataFrame, start: Column, speed_kmh: float) -> DataFrame:
    """One row per ride: shares of head, tail and cross wind, mean headwind of the halves, rain, temperatures and the wind score."""
    steps = ride_steps(routes, start, speed_kmh)
    r = reading_at(steps, hourly)
    effect, head = wind_effect(F.col("heading"), F.col("wind_dir"), F.col("wind_speed"))
    r = r.withColumns({"effect": effect, "head": head}).withColumn("weight", F.col("len") * (0.75 + 0.5 * F.col("mid") / F.col("total")))
    first = F.col("mid") < F.col("total") / 2
    share = lambda e: (F.sum(F.when(F.col("effect") == e, F.col("len")).otherwise(0.0)) / F.sum("len")).alias(f"{e}_share")
    mean = lambda c, name: (F.sum(F.when(c, F.col("head") * F.col("len"))) / F.sum(F.when(c, F.col("len")))).alias(name)
    return r.groupBy("id").agg(
        share("head"), share("tail"), share("cross"), share("calm"), mean(F.lit(True), "mean_head"), mean(first, "first_half_head"), mean(~first, "second_half_head"),
        F.sum(F.col("rain") * F.col("len") / 1000 / speed_kmh).alias("rain_mm"), F.min("temp").alias("temp_min"), F.max("temp").alias("temp_max"),
        (F.sum(wind_effort(F.col("head"), F.lit(speed_kmh)) * F.col("weight")) / F.sum("weight")).alias("score"),
        (F.abs(F.sum("len") / F.max("total") - 1) < 1e-9).alias("complete"),
    )


def wind_stretches(steps: DataFrame) -> DataFrame:
    """(id, stretch, effect, from_seq, to_seq, metres): neighbouring steps of one effect merged (gaps and islands)."""
    w = W.partitionBy("id").orderBy("seq")
    changed = F.when((F.lag("effect").over(w) == F.col("effect")) & (F.lag("seq").over(w) == F.col("seq") - 1), 0).otherwise(1)
    numbered = steps.withColumn("changed", changed).withColumn("stretch", F.sum("changed").over(w))
    return numbered.groupBy("id", "stretch").agg(F.first("effect").alias("effect"), F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.sum("len").alias("metres"))


def reverse_advice(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(id, gain): rides clearly easier the other way round."""
    b = backward.select("id", F.col("score").alias("other"), F.col("complete").alias("other_complete"))
    return forward.join(b, "id").where(F.col("complete") & F.col("other_complete") & (F.col("score") - F.col("other") >= REVERSE_GAIN_KMH)).select("id", (F.col("score") - F.col("other")).alias("gain"))
