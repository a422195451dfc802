"""The newest live version of every key: reads over a change log.

A log is a DataFrame of key, value, tomb and columns of recency; newest wins, whatever file or level a
row comes from. Keys and values may be strings or bytes; both are ordered by unsigned bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.model import Bound, excluded, included, unbounded, within


def normalised(log: DataFrame) -> DataFrame:
    """The log with an empty or null value as a deletion: putting nothing is deleting."""
    tomb = F.coalesce(F.col("tomb"), F.lit(False)) | F.col("value").isNull() | (F.octet_length("value") == 0)
    return log.withColumns({"tomb": tomb, "value": F.when(~tomb, F.col("value"))})


def latest(log: DataFrame, recency: list[str] | None = None) -> DataFrame:
    """(key, value, tomb, recency ...) of the newest version of each key; deletions stay.

    One aggregation with map-side combining: a hot key is one row for each task before the shuffle."""
    recency = recency or ["seq"]
    order = F.struct(*recency) if len(recency) > 1 else F.col(recency[0])
    won = log.groupBy("key").agg(F.max_by(F.struct("value", "tomb", *recency), order).alias("_v"))
    return won.select("key", "_v.value", "_v.tomb", *[F.col(f"_v.{c}").alias(c) for c in recency])


def live(log: DataFrame, recency: list[str] | None = None) -> DataFrame:
    """(key, value) of the keys whose newest version isn't a deletion."""
    return latest(normalised(log), recency).where(~F.col("tomb")).select("key", "value")


def scan(log: DataFrame, lo: Bound = unbounded, hi: Bound = unbounded, recency: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """Live entries of a range in key order; the range reaches the file scan."""
    out = live(log.where(within(F.col("key"), lo, hi)), recency)
    return out.orderBy("key") if ordered else out


def get(log: DataFrame, key: bytes | str, recency: list[str] | None = None) -> DataFrame:
    """The live entry of one key, or no row."""
    return live(log.where(F.col("key") == F.lit(key)), recency)


def multi_get(log: DataFrame, keys: DataFrame, recency: list[str] | None = None) -> DataFrame:
    """(key, value, found) of every distinct key asked for; the log is reduced to those keys first."""
    asked = keys.select("key").distinct()
    found = live(log.join(asked, "key", "left_semi"), recency).withColumn("found", F.lit(True))
    return asked.join(found, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def prefix_bounds(prefix: bytes) -> tuple[Bound, Bound]:
    """The range of the keys that start with these bytes."""
    head = prefix.rstrip(b"\xff")
    return included(prefix) if prefix else unbounded, excluded(head[:-1] + bytes([head[-1] + 1])) if head else unbounded


def prefix_scan(log: DataFrame, prefix: bytes, recency: list[str] | None = None) -> DataFrame:
    """Live entries whose key starts with these bytes."""
    return scan(log, *prefix_bounds(prefix), recency)


def merged(sources: list[DataFrame], keep_deleted: bool = False) -> DataFrame:
    """One ordered run of sources of (key, value), oldest first: the last source that has a key wins.
    Empty values are deletions."""
    log = reduce(DataFrame.unionByName, [s.select("key", "value", F.lit(False).alias("tomb"), F.lit(i).alias("seq")) for i, s in enumerate(sources)])
    if keep_deleted:
        return latest(normalised(log)).select("key", "value", "tomb").orderBy("key")
    return live(log).orderBy("key")


def tombstones(log: DataFrame, recency: list[str] | None = None) -> DataFrame:
    """Keys whose newest version is a deletion."""
    return latest(normalised(log), recency).where("tomb").select("key")


def overlaps(first: Column, last: Column, lo: Bound = unbounded, hi: Bound = unbounded) -> Column:
    """Files of these key ranges that may hold keys of the range."""
    parts = [p for p in (lo.lower(last), hi.upper(first)) if p is not None]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
