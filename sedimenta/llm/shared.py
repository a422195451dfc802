"""What several operators share: tables in the shared folder, Bloom bitmaps, union-find grouping."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.session import scratch_dir as shared_dir
from sedimenta.sources.files import Files

_tables: ContextVar[tuple[list[str], ...]] = ContextVar("tables", default=())


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here and lost executors cost nothing.
    Within a workspace the table goes when that ends; if it is to be kept, with the workspace around that, if any."""
    spark = df.sparkSession
    folder, own = f"{shared_dir(spark)}/tables", f"{name}-{uuid.uuid4().hex}"
    if len(spaces := _tables.get()) > keep:
        spaces[-1 - keep].append(own)
    df.write.option("compression", "zstd").parquet(f"{folder}/{own}")
    out = spark.read.schema(df.schema).parquet(f"{folder}/{own}")
    out.stored_as = own
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables of the workspace, if there is one, that nothing will read again. What was shuffled and broadcast
    for them goes too, once the driver's references to it are collected, so that is done here."""
    if not (spaces := _tables.get()):
        return
    files = Files(tables[0].sparkSession, f"{shared_dir(tables[0].sparkSession)}/tables")
    for t in tables:
        spaces[-1].remove(t.stored_as)
        files.fs.delete(files.path(t.stored_as), True)
    gc.collect()
    files._jvm.System.gc()


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Removes at its end, also after a failure, the tables that were stored within and are not kept. No
    DataFrame that reads them may be used later, so the result is stored with keep before the end."""
    made: list[str] = []
    token = _tables.set((*_tables.get(), made))
    try:
        yield
    finally:
        _tables.reset(token)
        files = Files(spark, f"{shared_dir(spark)}/tables")
        for own in made:
            files.fs.delete(files.path(own), True)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table. Batches to Python workers are bounded by bytes, since texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lean(work):
    """work, a function of batches, that gives its worker's free memory back to the system at its end: Spark keeps
    more workers than run at once, and each would hold on to the most that it ever used."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
                trim(0)

    return run


def partitions(df: DataFrame) -> int:
    """A partition count for explicit exchanges: the session's, which grows with the cluster."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def positional(df: DataFrame, names: list[str], text_col: str):
    """(df as text, c0, c1 ..., a function that gives the columns their names back), so that no name of a
    caller's columns can clash with an operator's."""
    rows = df.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    return rows, lambda out, *more: out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *more)


def ddl(rows: DataFrame, start: int) -> str:
    """The schema of the columns from `start` on, ready for others to follow."""
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[start:])


# ---- Bloom bitmaps -------------------------------------------------------------------------

BLOOM_BITS = 1 << 24
"""Bits of a Bloom bitmap, fixed: 2 MB to driver and executors at any input size. Beyond what it can
tell apart it lets more rows through to the exact join behind it; it never loses one."""

_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = keys.astype(np.uint64, copy=False)
    s = np.uint64(64 - BLOOM_BITS.bit_length() + 1)
    return (k * np.uint64(_M1)) >> s, (k * np.uint64(_M2)) >> s


def bloom(df: DataFrame, col: str) -> np.ndarray:
    """Bitmap (uint64 words) of a bigint column; aggregated on the executors to at most BLOOM_BITS / 64 rows."""
    s = 64 - BLOOM_BITS.bit_length() + 1

    def slots(batches):
        for b in batches:
            k = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            slot = np.unique(np.concatenate(_slots(k)))
            word, start = np.unique(slot >> np.uint64(6), return_index=True)
            if len(word):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), start)
                yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    rows = df.select(col).mapInArrow(lean(slots), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BLOOM_BITS // 64, np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out


def in_bloom(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    a, b = _slots(keys)
    six, low = np.uint64(6), np.uint64(63)
    one = np.uint64(1)
    return ((bits[a >> six] >> (a & low)) & (bits[b >> six] >> (b & low)) & one).astype(bool)


# ---- union-find grouping -------------------------------------------------------------------


def _local_forest(batches):
    """The links of one task as a spanning forest of (node, root)."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def out():
        rows = [(v, find(v)) for v in parent]
        rows = [(v, r) for v, r in rows if v != r]
        parent.clear()
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
        if len(parent) > 1 << 20:
            yield out()
    yield out()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (u, v), for every id in a link to another.

    Union-find within each task thins the links to a forest; then rounds contract the rest: every
    vertex points at its smallest neighbour, and links move to those. Each round is a written table,
    so that no lineage builds up, and the number of rounds grows with the logarithm of a chain."""
    edges = stored(links.select(F.col(links.columns[0]).cast("long").alias("u"), F.col(links.columns[1]).cast("long").alias("v")).where("u <> v").mapInArrow(lean(_local_forest), "u long, v long"), "links")
    member: DataFrame | None = None
    while True:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        jump = stored(near.alias("a").join(near.alias("b"), F.col("a.p") == F.col("b.u"), "left").select(F.col("a.u").alias("u"), F.coalesce("b.p", "a.p").alias("p")), "jumps")
        if member is None:
            member = jump.select(F.col("u").alias("id"), F.col("p").alias("component"))
        else:
            member = member.join(jump, member.component == jump.u, "left").select("id", F.coalesce("p", "component").alias("component"))
        a, b = jump.select("u", F.col("p").alias("pu")), jump.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = stored(edges.join(a, "u").join(b, "v").where("pu <> pv").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(), "links")
        if edges.isEmpty():
            return stored(member, "members")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `rank` (0-based, gapless) by a total order: range-partitioned, sorted, written, and
    numbered from the sizes of the partitions; no task sees more than its own range."""
    n = partitions(df)
    part = F.spark_partition_id()
    seen = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", part), name)
    low = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = seen.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each partition
    base = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return seen.join(F.broadcast(base), "_part").withColumn("rank", F.col("_base") + low).drop("_part", "_base", "_at")
