"""References to records that do not exist.

Keys of each reference field are dictionary-encoded to dense integers per key range; per range and
period compressed bitmaps are held - keys referred to, keys of records that were there before the period, keys of
records there by their first reference in it - and ``references AND-NOT records`` leaves the bits that are decoded back to
keys: every key that is missing or deleted, and those of which some reference in the period was too early.
Only those survivors are joined back to the single references for the exact reason.

Skew: references are made distinct per (key, period) before any shuffle, so a key that a third of all
rows refer to costs one row per period; the join back is salted where a key has more than HOT references.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.session import cut, shuffle_partitions

#: Period number of references whose time is unknown: later than all others, so that only absence or deletion is found.
UNKNOWN_PERIOD = 2**31 - 1
#: Microseconds of records that are there from the beginning (no own time), or never.
ALWAYS, NEVER = -(2**62), 2**62
#: Rows of a bitmap group; more key ranges are made as the tables grow.
GROUP_ROWS = 200_000
#: References of one key and period that a task may join; more are salted.
HOT = 100_000
ARRAY_LIMIT = 4096


class CompressedBitmap:
    """Set of non-negative integers in chunks of 2**16: sorted 16-bit arrays when sparse, bit words when dense."""

    def __init__(self, chunks: dict[int, np.ndarray]):
        self.chunks = chunks

    @classmethod
    def of(cls, values: np.ndarray) -> CompressedBitmap:
        values = np.unique(np.asarray(values, dtype=np.int64))
        chunks: dict[int, np.ndarray] = {}
        highs, starts = np.unique(values >> 16, return_index=True)
        for high, low in zip(highs, np.split(values & 0xFFFF, starts[1:]), strict=False):
            chunks[int(high)] = cls._pack(low.astype(np.uint16))
        return cls(chunks)

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        if len(low) <= ARRAY_LIMIT:
            return low
        bits = np.zeros(65536, dtype=np.uint8)
        bits[low] = 1
        return np.packbits(bits, bitorder="little").view(np.uint64)

    @staticmethod
    def _low(chunk: np.ndarray) -> np.ndarray:
        if chunk.dtype == np.uint16:
            return chunk
        return np.flatnonzero(np.unpackbits(chunk.view(np.uint8), bitorder="little")).astype(np.uint16)

    def and_not(self, other: CompressedBitmap) -> CompressedBitmap:
        out: dict[int, np.ndarray] = {}
        for high, mine in self.chunks.items():
            theirs = other.chunks.get(high)
            if theirs is None:
                out[high] = mine
            elif mine.dtype == np.uint64 and theirs.dtype == np.uint64:
                left = mine & ~theirs
                if left.any():
                    out[high] = self._pack(self._low(left))
            elif theirs.dtype == np.uint64:
                word, bit = mine >> 6, (mine & 63).astype(np.uint64)
                left = mine[((theirs[word] >> bit) & np.uint64(1)) == 0]
                if len(left):
                    out[high] = left
            else:
                left = np.setdiff1d(self._low(mine), theirs, assume_unique=True)
                if len(left):
                    out[high] = self._pack(left)
        return CompressedBitmap(out)

    def union(self, other: CompressedBitmap) -> CompressedBitmap:
        out = dict(self.chunks)
        for high, theirs in other.chunks.items():
            mine = out.get(high)
            if mine is None:
                out[high] = theirs
            elif mine.dtype == np.uint64 and theirs.dtype == np.uint64:
                out[high] = mine | theirs
            else:
                out[high] = self._pack(np.union1d(self._low(mine), self._low(theirs)))
        return CompressedBitmap(out)

    def decode(self) -> np.ndarray:
        parts = [(high << 16) + self._low(chunk).astype(np.int64) for high, chunk in sorted(self.chunks.items())]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def _surviving_bits(pdf: pd.DataFrame) -> pd.DataFrame:
    """One key range: encode keys, build bitmaps per period, AND-NOT, decode.

    A record is there for the references of a period if it was there before the period began (one bitmap, grown from period to
    period) or, within the period, by the time of the first reference to it (a bitmap of the period).
    """
    keys, codes = np.unique(pdf["ref_key"].to_numpy(dtype=object).astype(str), return_inverse=True)
    is_ref = pdf["is_ref"].to_numpy(dtype=bool)
    period = pdf["period_no"].to_numpy(dtype=np.int64)
    first = pdf["first_time"].to_numpy(dtype=np.int64)
    info = pdf.loc[~is_ref, ["has_record", "own_time", "deleted_at"]].set_axis(codes[~is_ref])
    there_from = np.full(len(keys), NEVER)
    there_from[codes[~is_ref]] = first[~is_ref]
    there_period = np.full(len(keys), UNKNOWN_PERIOD + 1)
    there_period[codes[~is_ref]] = period[~is_ref]
    found: list[pd.DataFrame] = []
    before = CompressedBitmap({})
    added = -1
    ref_periods = np.unique(period[is_ref])
    for p in ref_periods:
        before = before.union(CompressedBitmap.of(np.flatnonzero((there_period > added) & (there_period < p))))
        added = p - 1
        mine = is_ref & (period == p)
        referred = CompressedBitmap.of(codes[mine])
        in_time = CompressedBitmap.of(codes[mine][there_from[codes[mine]] <= first[mine]])
        left = referred.and_not(before).and_not(in_time).decode()
        if len(left):
            found.append(pd.DataFrame({"code": left, "period_no": int(p)}))
    columns = ["field", "ref_key", "period_no", "has_record", "own_time", "deleted_at"]
    if not found:
        return pdf.iloc[:0].reindex(columns=columns)
    out = pd.concat(found, ignore_index=True)
    out["ref_key"] = keys[out["code"].to_numpy()]
    out["field"] = pdf["field"].iloc[0]
    out = out.join(info, on="code")
    out["has_record"] = out["has_record"].astype("boolean").fillna(False).astype(bool)
    return out[columns]


def period_number(time: Column) -> Column:
    return F.coalesce(F.year(time) * 12 + F.month(time), F.lit(UNKNOWN_PERIOD))


def orphan_references(references: DataFrame, records: DataFrame, deletions: DataFrame, ranges: int | None = None) -> DataFrame:
    """References that lead nowhere, with the reason and the period.

    ``references``: (owner_id, field, ref_key, ref_time); a null key refers to nothing; repeated rows give one case.
    ``records``: (field, ref_key, own_time), ``deletions``: (field, ref_key, deleted_at); of repeated keys the latest
    time counts, null keys are dropped. Empty tables give an empty result (no references) or all references missing.
    Returns (owner_id, field, ref, reason, period); ``reason`` is missing, deleted or late; ``period`` is yyyy-MM or null.
    Other columns of the inputs are ignored whatever their names.
    """
    refs = (
        references.where(F.col("ref_key").isNotNull())
        .select("owner_id", "field", "ref_key", "ref_time", period_number(F.col("ref_time")).alias("period_no"))
        .distinct()
    )
    # an unknown time is later than all others, so that only absence or deletion is found
    when = F.coalesce(F.unix_micros("ref_time"), F.lit(NEVER - 1))
    wanted = cut(refs.groupBy("field", "ref_key", "period_no").agg(F.min(when).alias("first_time"), F.count(F.lit(1)).alias("n")))
    # one row per key of the records and deletions: what is needed to judge it
    known = (
        records.where(F.col("ref_key").isNotNull())
        .select("field", "ref_key", F.lit(True).alias("has_record"), "own_time", F.lit(None).cast("timestamp").alias("deleted_at"))
        .unionByName(
            deletions.where(F.col("ref_key").isNotNull()).select(
                "field", "ref_key", F.lit(False).alias("has_record"), F.lit(None).cast("timestamp").alias("own_time"), "deleted_at"
            )
        )
        .groupBy("field", "ref_key")
        .agg(F.max("has_record").alias("has_record"), F.max("own_time").alias("own_time"), F.max("deleted_at").alias("deleted_at"))
    )
    alive = F.col("has_record") & (F.col("deleted_at").isNull() | F.coalesce(F.col("own_time") > F.col("deleted_at"), F.lit(False)))
    # a record without its own time is there from the beginning
    there = F.when(alive, F.coalesce(F.unix_micros("own_time"), F.lit(ALWAYS))).otherwise(F.lit(NEVER))
    there_period = F.when(alive, F.when(F.col("own_time").isNull(), F.lit(0)).otherwise(period_number(F.col("own_time")))).otherwise(F.lit(UNKNOWN_PERIOD))
    rows = wanted.select(
        "field", "ref_key", F.lit(True).alias("is_ref"), "period_no", "first_time", F.lit(False).alias("has_record"),
        F.lit(None).cast("timestamp").alias("own_time"), F.lit(None).cast("timestamp").alias("deleted_at"),
    ).unionByName(
        known.select("field", "ref_key", F.lit(False).alias("is_ref"), there_period.alias("period_no"), there.alias("first_time"), "has_record", "own_time", "deleted_at")
    )
    sizes = wanted.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("most")).first()
    ranges = ranges or max(shuffle_partitions(references.sparkSession), -(-2 * sizes["groups"] // GROUP_ROWS))
    survivors = (
        rows.withColumn("key_range", F.pmod(F.xxhash64("field", "ref_key"), F.lit(ranges)))
        .groupBy("field", "key_range")
        .applyInPandas(
            lambda pdf: _surviving_bits(pdf),
            "field string, ref_key string, period_no int, has_record boolean, own_time timestamp, deleted_at timestamp",
        )
    )
    keys = ["field", "ref_key", "period_no"]
    if (sizes["most"] or 0) > HOT:
        # only keys of more than HOT references are salted, each by its own count: at most 1 in HOT rows is listed
        hot = wanted.where(F.col("n") > HOT).select(*keys, F.ceil(F.col("n") / HOT).cast("int").alias("salts"))
        survivors = survivors.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        refs = refs.join(hot, keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("owner_id"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
        keys.append("salt")
    gone = ~F.col("has_record") | F.col("own_time").isNull() | (F.col("own_time") <= F.col("deleted_at"))
    reason = (
        F.when(F.col("deleted_at").isNull() & ~F.col("has_record"), F.lit("missing"))
        .when(F.col("deleted_at").isNotNull() & gone, F.lit("deleted"))
        .when(F.col("own_time") > F.col("ref_time"), F.lit("late"))
    )
    return (
        refs.join(survivors, keys)
        .select(
            "owner_id", "field", F.col("ref_key").alias("ref"), reason.alias("reason"), F.date_format("ref_time", "yyyy-MM").alias("period")
        )
        .where(F.col("reason").isNotNull())
    )


def trimmed_key(text: Column) -> Column:
    """Trimmed of white space and in lower case; null when nothing is left."""
    bare = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.when(bare != "", bare)


def latest_routes(routes: DataFrame, *columns: str) -> DataFrame:
    """One row per route id: of several versions the one with the latest ``updated_at``; rows without id are dropped."""
    top = F.max(F.struct("updated_at", *columns)).alias("top")
    return routes.where(F.col("id").isNotNull()).groupBy("id").agg(top).select("id", *[F.col(f"top.{c}").alias(c) for c in columns])


def library_orphans(routes: DataFrame, files: DataFrame, deleted: DataFrame) -> DataFrame:
    """Orphans of ``library_routes.file_hash`` and ``library_routes.derived_from``: (route_id, field, ref, reason, period).

    Null references and blank hashes refer to nothing; malformed hashes are references; nulls inside ``derived_from`` are skipped.
    """
    latest = latest_routes(routes, "imported_at", "file_hash", "derived_from")
    by_file = latest.select(F.col("id").alias("owner_id"), F.lit("file_hash").alias("field"), trimmed_key(F.col("file_hash")).alias("ref_key"), F.col("imported_at").alias("ref_time"))
    by_route = latest.select(
        F.col("id").alias("owner_id"), F.lit("derived_from").alias("field"), F.explode("derived_from").alias("ref_key"), F.col("imported_at").alias("ref_time")
    ).withColumn("ref_key", F.col("ref_key").cast("string"))
    records = files.select(F.lit("file_hash").alias("field"), trimmed_key(F.col("hash")).alias("ref_key"), F.col("stored_at").alias("own_time")).unionByName(
        latest.select(F.lit("derived_from").alias("field"), F.col("id").cast("string").alias("ref_key"), F.col("imported_at").alias("own_time"))
    )
    field = F.when(F.col("kind") == "file", "file_hash").when(F.col("kind") == "route", "derived_from")
    deletions = deleted.select(field.alias("field"), trimmed_key(F.col("record_key")).alias("ref_key"), "deleted_at").where(F.col("field").isNotNull() & F.col("deleted_at").isNotNull())
    return orphan_references(by_file.unionByName(by_route), records, deletions).withColumnRenamed("owner_id", "route_id")


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Report per field, period and reason: (field, period, reason, orphan_refs, referring_routes)."""
    return orphans.groupBy("field", "period", "reason").agg(
        F.count(F.lit(1)).alias("orphan_refs"), F.countDistinct("route_id").alias("referring_routes")
    )


__all__ = ["CompressedBitmap", "latest_routes", "library_orphans", "orphan_references", "orphans_by_period", "trimmed_key"]
