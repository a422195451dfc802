"""Hilbert-curve ordering of documents into shards.

Several metadata columns are quantised at their quantiles (strings by their first bytes, which keeps
their order), the cells are put on a Hilbert curve, rows are numbered along it, and the run is cut into
shards of equal row counts: each shard covers a compact box in all dimensions, so that files can be
pruned by any of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.llm.shared import numbered, stored

BITS = 6


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of axes (rows x dimensions), by Skilling's transform."""
    x = axes.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _code(df: DataFrame, name: str) -> Column:
    """An order-preserving number of a column."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.conv(F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise ValueError(f"{name} has no order: {kind.simpleString()}")
    return F.col(name).cast("double") if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)) else F.col(name).cast("long")


def shard(docs: DataFrame, dims: list[str] | None = None, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, curve), a row for each row of docs.

    The law is `rows`: shard sizes differ by one row at most. `size` is the bytes of the text plus 1. A
    null in a dimension lies in its first cell; a null text has size 1 and the crc of no bytes. Ties on
    the curve go by id, size and crc, and repeated rows follow each other. Other columns are ignored;
    an empty table gives none. dims: columns of docs, of any type with an order (else a ValueError); default
    lang, source, size and id, as present."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    dims = dims if dims is not None else [c for c in ("lang", "source", id_col) if c in docs.columns]
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[_code(docs, c).alias(f"d{i}") for i, c in enumerate(dims)])
    rows = stored(rows.withColumn(f"d{len(dims)}", F.col("size")), "metadata")
    names = [f"d{i}" for i in range(len(dims) + 1)]
    steps = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    cuts = rows.agg(*[F.percentile_approx(c, F.array(*map(F.lit, steps)), 2000).alias(c) for c in names]).first()
    cuts = [np.array(cuts[c] or [], np.float64) for c in names]

    def place(batches):
        for b in batches:
            cell = np.zeros((b.num_rows, len(names)), np.int64)
            for i, c in enumerate(names):
                v = b.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
                cell[:, i] = np.where(np.isnan(v), 0, np.searchsorted(cuts[i], v, "right"))
            yield pa.record_batch([b.column("id"), b.column("size"), b.column("text_crc32"), pa.array(hilbert(cell, BITS))], ["id", "size", "text_crc32", "curve"])

    kind = docs.schema[id_col].dataType.simpleString()
    put = rows.mapInArrow(place, f"id {kind}, size long, text_crc32 long, curve long")
    ranked = numbered(put, [F.col("curve"), F.col("id"), F.col("size"), F.col("text_crc32")], "curve")
    total = ranked.count()
    number = F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", number).select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The rows of docs as Parquet, a folder for each shard, along the curve; ids are unique here."""
    rows = docs.join(placed.select(id_col, "shard", "slot"), id_col)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
