"""Sizes, counts, ranges and indexes of segments, as aggregations and windows over the log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.binary import byte_length, entries_hint, entry_bytes
from sedimenta.operators.view import normalised

STRIDE = 16
"""Every so many entries one is in the sparse index."""


def memtable_stats(log: DataFrame, by: str = "seg") -> DataFrame:
    """(by, entries, approximate_size): distinct keys, and the bytes of all mutations, overwritten ones too."""
    size = byte_length(F.col("key")) + F.when(F.col("tomb"), 0).otherwise(byte_length(F.col("value")))
    return log.groupBy(by).agg(F.count_distinct("key").alias("entries"), F.sum(size).alias("approximate_size"))


def segment_entries(log: DataFrame, by: str = "seg") -> DataFrame:
    """The sorted file that each part of the log gives: its newest versions, deletions as empty values."""
    won = normalised(log).groupBy(by, "key").agg(F.max_by(F.struct("value", "tomb"), "seq").alias("v"))
    return won.select(by, "key", "v.value", "v.tomb")


def segment_log(log: DataFrame, by: str = "seg") -> DataFrame:
    """The log without the versions that a newer one of the same part hides."""
    won = log.groupBy(by, "key").agg(F.max_by(F.struct("value", "tomb", "seq"), "seq").alias("v"))
    return won.select(by, "key", "v.value", "v.tomb", "v.seq")


def footer_stats(entries: DataFrame, by: str = "seg") -> DataFrame:
    """(by, first_key, last_key, num_entries, data_len, size_hint) of sorted files."""
    size = F.sum(entry_bytes(F.col("key"), F.col("value")))
    out = entries.groupBy(by).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("num_entries"), size.alias("data_len"))
    return out.withColumn("size_hint", entries_hint(F.col("data_len")))


def offsets(entries: DataFrame, by: str = "seg") -> DataFrame:
    """entries with their ordinal and byte offset in the file."""
    order = Window.partitionBy(by).orderBy("key")
    before = F.sum(entry_bytes(F.col("key"), F.col("value"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return entries.withColumns({"ordinal": (F.row_number().over(order) - 1).cast("long"), "offset": F.coalesce(before, F.lit(0)).cast("long")})


def sparse_index(entries: DataFrame, by: str = "seg", stride: int = STRIDE) -> DataFrame:
    """(by, key, offset) of every stride-th entry."""
    return offsets(entries, by).where(F.col("ordinal") % stride == 0).select(by, "key", "offset")


def index_seek(index: DataFrame, key: bytes | str, by: str = "seg") -> DataFrame:
    """(by, offset) from which to read for a key: of the last indexed key up to it, 0 if there is none."""
    below = F.col("key") <= F.lit(key)
    hit = F.max_by(F.when(below, F.col("offset")), F.when(below, F.col("key")))
    return index.groupBy(by).agg(F.coalesce(hit, F.lit(0)).cast("long").alias("offset"))


def index_seek_all(index: DataFrame, probes: DataFrame, by: str = "seg") -> DataFrame:
    """probes (by, key) with the offset from which to read for each: of the last indexed key up to it, 0 if there
    is none. An as-of join in one exchange: index rows and probes of a file are put in key order and each
    probe takes the last offset before it."""
    rows = index.select(by, "key", "offset", F.lit(0).alias("_side")).unionByName(probes.select(by, "key", F.lit(None).cast("long").alias("offset"), F.lit(1).alias("_side")))
    order = Window.partitionBy(by).orderBy("key", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("offset", F.coalesce(F.last("offset", ignorenulls=True).over(order), F.lit(0))).where("_side = 1").select(by, "key", "offset")


BLOCK = 64
"""Files whose indexes are sought together."""


def index_seek_each(index: DataFrame, keys: DataFrame, by: str = "seg") -> DataFrame:
    """(by, key, offset) of every key, of distinct ones, in every file of an index, as index_seek_all gives it.

    Indexes of a block of files meet sorted batches of keys: in a batch an index entry answers all keys from its own
    to the next one's, so probes are neither shuffled nor sorted, and a task holds one block and one batch."""
    kind, number = index.schema["key"].dataType.simpleString(), index.schema[by].dataType.simpleString()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = b.column(0).take(pc.sort_indices(b.column(0), null_placement="at_start"))
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], ["keys"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in (b.slice(lo, BLOCK) for lo in range(0, b.num_rows, BLOCK)):
                own = pa.StructArray.from_arrays(s.columns, fields=list(s.schema))
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], ["files"])

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for files, probes in zip(b.column("files"), b.column("keys"), strict=True):
                own = probes.values
                held = np.array(own.drop_null().to_pylist(), object)
                for f in files.as_py():
                    entries = [e for e in f["entries"] if e["key"] is not None]
                    at = own.null_count + np.searchsorted(held, np.array([e["key"] for e in entries], object)) if entries else np.zeros(0, np.int64)
                    found = np.repeat([0, *(e["offset"] for e in entries)], np.diff([0, *at, len(own)]))
                    yield pa.record_batch([pa.repeat(pa.scalar(f["file"], b.schema.field("files").type.value_type.field("file").type), len(own)), own, pa.array(found, pa.int64())], [by, "key", "offset"])

    files = index.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("key", "offset"))).alias("entries"))
    files = files.select(F.col(by).alias("file"), "entries").mapInArrow(block, f"files array<struct<file: {number}, entries: array<struct<key: {kind}, offset: bigint>>>>")
    batches = keys.select("key").mapInArrow(sort, f"keys array<{kind}>")
    met = files.crossJoin(batches).repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.mapInArrow(seek, f"`{by}` {number}, key {kind}, offset long").withColumn("offset", F.coalesce("offset", F.lit(0)))


def overlap_pairs(footers: DataFrame, by: str = "seg") -> DataFrame:
    """Pairs of files whose key ranges meet. Files sorted by first key meet those that begin before they
    end: a range join over file statistics, whose rows are files and not data."""
    a, b = footers.alias("a"), footers.alias("b")
    meet = (F.col("a.first_key") <= F.col("b.last_key")) & (F.col("b.first_key") <= F.col("a.last_key"))
    return a.join(b, (F.col(f"a.{by}") < F.col(f"b.{by}")) & meet).select(F.col(f"a.{by}").alias("a"), F.col(f"b.{by}").alias("b"))


def level_stats(files: DataFrame) -> DataFrame:
    """(level, files, bytes) of a file list with level and data_len."""
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("data_len").cast("long").alias("bytes"))


def key_range(files: DataFrame) -> DataFrame:
    """The smallest first and the largest last key."""
    return files.agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))


def oldest_file(files: DataFrame) -> DataFrame:
    """By level, the file of the smallest id."""
    return files.groupBy("level").agg(F.min("file_id").alias("file_id"))


def most_overfull(levels: DataFrame, last: int) -> DataFrame:
    """(level, ratio) of the level, between the first and the last, most above its target; the shallower in ties."""
    ratio = F.col("bytes") / F.col("target")
    some = levels.where((F.col("level") > 0) & (F.col("level") < last) & (F.col("target") > 0)).withColumn("ratio", ratio).where("ratio > 1")
    return some.orderBy(F.desc("ratio"), "level").limit(1).select("level", "ratio")


def next_id(files: DataFrame) -> DataFrame:
    return files.agg((F.coalesce(F.max("file_id"), F.lit(-1)) + 1).cast("long").alias("next_id"))


def freeze_boundaries(log: DataFrame, limit: int, stream: str = "stream") -> DataFrame:
    """(stream, segment, first_seq, last_seq, records, bytes): where a write buffer of `limit` bytes is cut.

    The size starts anew at each cut and the record that reaches the limit belongs to the old buffer, so
    no window expresses it: each stream of writes is read once in order, batch by batch, with two
    numbers of state. Streams are cut independently of each other."""
    size = byte_length(F.col("key")) + F.when(F.col("tomb"), 0).otherwise(byte_length(F.col("value")))
    rows = log.select(stream, "seq", size.alias("size")).repartition(stream).sortWithinPartitions(stream, "seq")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None  # stream, segment, first, last, records, bytes
        for batch in batches:
            done = []
            for name, seq, n in zip(batch[stream].tolist(), batch["seq"].tolist(), batch["size"].tolist()):
                if state is None or state[0] != name:
                    if state and state[4]:
                        done.append(tuple(state))
                    state = [name, 0, seq, seq, 0, 0]
                if not state[4]:
                    state[2] = seq
                state[3], state[4], state[5] = seq, state[4] + 1, state[5] + n
                if state[5] >= limit:
                    done.append(tuple(state))
                    state = [name, state[1] + 1, seq, seq, 0, 0]
            yield pd.DataFrame(done, columns=[stream, "segment", "first_seq", "last_seq", "records", "bytes"])
        if state and state[4]:
            yield pd.DataFrame([state], columns=[stream, "segment", "first_seq", "last_seq", "records", "bytes"])

    return rows.mapInPandas(cut, f"{stream} {log.schema[stream].dataType.simpleString()}, segment long, first_seq long, last_seq long, records long, bytes long")


def latest_by_join(log: DataFrame) -> DataFrame:
    """The newest versions by a hash aggregation of seq and a join back; (key, seq) must be unique."""
    top = log.groupBy("key").agg(F.max("seq").alias("seq"))
    return log.join(top, ["key", "seq"], "left_semi").select("key", "value", "tomb", "seq")

