"""The registered queries, one or more for each operator, and the SQL that gives the same rows.

The change log is the events table: a key for each user, values from props, errors as deletions, and
the event id as recency; 500 events make a segment."""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import binary as B
from sedimenta.model import Bound, Config, excluded, included, unbounded
from sedimenta.operators import compaction as C
from sedimenta.operators import stats as S
from sedimenta.operators import view as V
from sedimenta.session import scratch_dir
from sedimenta.sources.manifest import replayed
from sedimenta.sources.records import read_logs, read_sorted_files, sorted_file, write_files
from sedimenta.store import Store
from sedimenta.streaming.ingest import ingest, latest_values

LO, HI, SEEK, PREFIX = "user:0010", "user:0020", "user:0042", "user:001"
LEVELS = Config(base_level_bytes=20_000)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LOG = """log AS (SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS key, props AS value, event_type = 'error' AS tomb,
  event_id AS seq, CAST(event_id // 500 AS INTEGER) AS seg FROM events)"""
LATEST = LOG + """, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log) WHERE r = 1),
  alive AS (SELECT key, value FROM newest WHERE NOT tomb)"""
ENTRIES = LOG + """, entries AS (SELECT seg, key, CASE WHEN tomb THEN NULL ELSE value END AS value, tomb FROM
  (SELECT *, row_number() OVER (PARTITION BY seg, key ORDER BY seq DESC) AS r FROM log) WHERE r = 1)"""
FOOTERS = ENTRIES + """, footers AS (SELECT seg, min(key) AS first_key, max(key) AS last_key, count(*) AS num_entries,
  CAST(sum(4 + strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS data_len FROM entries GROUP BY seg)"""
FILES = FOOTERS + """, files AS (SELECT CAST(CASE WHEN seg < 4 THEN 0 ELSE 1 + seg % 6 END AS INTEGER) AS level, CAST(seg AS BIGINT) AS file_id,
  first_key, last_key, data_len FROM footers)"""
TARGETS = FILES + """, goal AS (SELECT greatest(coalesce((SELECT sum(data_len) FROM files WHERE level = 6), 0), 20000) AS last),
  targets AS (SELECT CAST(l AS INTEGER) AS level, CAST(CASE WHEN l = 0 THEN 0 ELSE last // CAST(power(10, 6 - l) AS BIGINT) END AS BIGINT) AS target
  FROM goal, range(7) t(l))"""
OFFSETS = ENTRIES + """, offsets AS (SELECT seg, key, row_number() OVER w - 1 AS ordinal,
  CAST(coalesce(sum(4 + strlen(key) + coalesce(strlen(value), 0)) OVER (PARTITION BY seg ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM entries WINDOW w AS (PARTITION BY seg ORDER BY key)), sparse AS (SELECT seg, key, "offset" FROM offsets WHERE ordinal % 16 = 0)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value, tomb, seq, seg) of the events."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("key"),
        F.col("props").alias("value"),
        (F.col("event_type") == "error").alias("tomb"),
        F.col("event_id").alias("seq"),
        F.floor(F.col("event_id") / 500).cast("int").alias("seg"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segment_entries(change_log(spark, sf_dir))


def footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.footer_stats(entries(spark, sf_dir))


def level_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments dealt to levels: the first four flushed ones on top."""
    level = F.when(F.col("seg") < 4, 0).otherwise(1 + F.col("seg") % 6).cast("int")
    return footers(spark, sf_dir).select(level.alias("level"), F.col("seg").cast("long").alias("file_id"), "first_key", "last_key", "data_len")


# ---- reads ----


@query(f"WITH {LATEST} SELECT key, value FROM alive")
def kv_latest(spark, sf_dir):
    return V.live(change_log(spark, sf_dir))


def _scan(name: str, lo: Bound, hi: Bound, where: str):
    def run(spark, sf_dir):
        return V.scan(change_log(spark, sf_dir), lo, hi)

    run.__name__ = f"kv_scan_{name}"
    query(f"WITH {LATEST} SELECT key, value FROM alive WHERE {where}")(run)


for _a, _lo, _x in (("incl", included(LO), f"key >= '{LO}'"), ("excl", excluded(LO), f"key > '{LO}'"), ("unb", unbounded, "true")):
    for _b, _hi, _y in (("incl", included(HI), f"key <= '{HI}'"), ("excl", excluded(HI), f"key < '{HI}'"), ("unb", unbounded, "true")):
        _scan(f"{_a}_{_b}", _lo, _hi, f"{_x} AND {_y}")


def _get(name: str, key: str):
    def run(spark, sf_dir):
        return V.get(change_log(spark, sf_dir), key)

    run.__name__ = f"kv_get_{name}"
    query(f"WITH {LATEST} SELECT key, value FROM alive WHERE key = '{key}'")(run)


_get("hit", "user:0001")
_get("deleted", "user:0005")
_get("missing", "user:x")

_ASKED = "SELECT DISTINCT 'user:' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') AS key FROM orders"


@query(f"WITH {LATEST}, asked AS ({_ASKED}) SELECT a.key, v.value, v.key IS NOT NULL AS found FROM asked a LEFT JOIN alive v ON a.key = v.key")
def kv_multi_get(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    keys = orders.select(F.concat(F.lit("user:"), F.lpad(F.col("o_custkey").cast("string"), 4, "0")).alias("key"))
    return V.multi_get(change_log(spark, sf_dir), keys)


@query(f"WITH {LATEST} SELECT key, value FROM alive WHERE starts_with(key, '{PREFIX}')")
def kv_prefix_scan(spark, sf_dir):
    log = change_log(spark, sf_dir).withColumns({"key": F.col("key").cast("binary"), "value": F.col("value").cast("binary")})
    return V.prefix_scan(log, PREFIX.encode()).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(f"WITH {LATEST} SELECT key FROM newest WHERE tomb")
def kv_tombstones(spark, sf_dir):
    return V.tombstones(change_log(spark, sf_dir))


@query(f"WITH {LATEST} SELECT key, value FROM alive")
def merge_newest_wins(spark, sf_dir):
    """Four runs of the whole log, each a sorted source of its newest versions."""
    log = change_log(spark, sf_dir)
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
    rows = S.segment_entries(log.withColumn("run", F.expr(f"cast(seq * 4 div {top} as int)")), "run")
    return V.merged([rows.where(F.col("run") == i).select("key", F.coalesce("value", F.lit("")).alias("value")) for i in range(4)])


@query(f"WITH {LATEST} SELECT key, value, tomb, seq FROM newest")
def latest_by_hash_join(spark, sf_dir):
    return S.latest_by_join(change_log(spark, sf_dir))


# ---- sizes, codecs ----


@query(f"WITH {LOG} SELECT seg, count(DISTINCT key) AS entries FROM log GROUP BY seg")
def memtable_entry_count(spark, sf_dir):
    return S.memtable_stats(change_log(spark, sf_dir)).select("seg", "entries")


@query(f"WITH {LOG} SELECT seg, CAST(sum(strlen(key) + CASE WHEN tomb THEN 0 ELSE strlen(value) END) AS BIGINT) AS approximate_size FROM log GROUP BY seg")
def memtable_approx_size(spark, sf_dir):
    return S.memtable_stats(change_log(spark, sf_dir)).select("seg", "approximate_size")


@query(f"WITH {LOG} SELECT seg, CAST(sum(9 + strlen(key) + CASE WHEN tomb THEN 0 ELSE strlen(value) END) AS BIGINT) AS bytes FROM log GROUP BY seg")
def wal_record_bytes(spark, sf_dir):
    value = F.when(~F.col("tomb"), F.col("value"))
    return change_log(spark, sf_dir).groupBy("seg").agg(F.sum(B.log_record_bytes(F.col("key"), value)).alias("bytes"))


_CRC = f"""WITH {LOG}, tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
  body AS (SELECT seq, CASE WHEN tomb THEN '00' ELSE '01' END || le(strlen(key), 2) || hex(encode(key)) || CASE WHEN tomb THEN '0000' ELSE le(strlen(value), 2) || hex(encode(value)) END AS h FROM log),
  sums AS (SELECT seq, h, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM body, tab)
  SELECT seq, h || le(crc, 4) AS record, crc AS crc32 FROM sums"""
for _width in ("2", "4"):  # little-endian hexadecimal, written out: the driver runs one statement
    _CRC = re.sub(rf"le\(((?:strlen\(\w+\))|crc), {_width}\)", lambda m, n=int(_width): "(" + " || ".join(f"printf('%02X', ({m[1]} >> {8 * i}) & 255)" for i in range(n)) + ")", _CRC)


@query(_CRC)
def wal_crc32(spark, sf_dir):
    log = change_log(spark, sf_dir)
    record = B.log_record((~F.col("tomb")).cast("int"), F.col("key"), F.when(~F.col("tomb"), F.col("value")))
    body = F.substring(record, F.lit(1), F.octet_length(record) - 4)
    return log.select("seq", F.hex(record).alias("record"), B.checksum(body).alias("crc32"))


def _written_logs(spark, sf_dir) -> str:
    """Log files of the whole log, one for each segment."""
    path = f"{scratch_dir(spark)}/logs-{uuid.uuid4().hex}"
    log = change_log(spark, sf_dir)
    record = B.log_record((~F.col("tomb")).cast("int"), F.col("key"), F.when(~F.col("tomb"), F.col("value")))
    write_files(log.select(B.file_name(F.col("seg"), ".wal").alias("file"), F.col("seq").alias("ord"), record.alias("record")), path)
    return path


def _written_sorted_files(spark, sf_dir) -> str:
    """Sorted files of the whole log, one for each segment."""
    path = f"{scratch_dir(spark)}/files-{uuid.uuid4().hex}"
    rows = S.segment_entries(change_log(spark, sf_dir))
    entry = B.sorted_entry(F.col("key"), F.col("value"))
    write_files(rows.select(B.file_name(F.col("seg"), ".sst").alias("file"), F.col("key").alias("ord"), entry.alias("record")), path, sorted_file([]))
    return path


@query(f"WITH {LOG} SELECT seq, key, CASE WHEN tomb THEN NULL ELSE value END AS value, tomb FROM log")
def wal_replay(spark, sf_dir):
    """Records written by column functions, stored as log files, and read back by the parser."""
    out = read_logs(spark, _written_logs(spark, sf_dir))
    base = B.file_id(F.col("file")) * 500
    return out.select((base + F.col("ord")).alias("seq"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "tomb")


@query(f"WITH {ENTRIES} SELECT CAST(seg AS BIGINT) AS seg, row_number() OVER (PARTITION BY seg ORDER BY key) - 1 AS ord, key, value, tomb FROM entries")
def sst_codec(spark, sf_dir):
    """Sorted files written by column functions and read back by the parser, in key order."""
    out = read_sorted_files(spark, _written_sorted_files(spark, sf_dir))
    return out.select(B.file_id(F.col("file")).alias("seg"), "ord", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "tomb")


# ---- sorted files ----


@query(f"WITH {FOOTERS} SELECT seg, first_key, last_key, num_entries FROM footers")
def sst_footer_stats(spark, sf_dir):
    return footers(spark, sf_dir).select("seg", "first_key", "last_key", "num_entries")


@query(f"WITH {FOOTERS} SELECT seg, data_len, data_len // 32 AS size_hint FROM footers")
def sst_data_len(spark, sf_dir):
    return footers(spark, sf_dir).select("seg", "data_len", "size_hint")


@query(f'WITH {OFFSETS} SELECT seg, key, "offset" FROM sparse')
def sst_sparse_index(spark, sf_dir):
    return S.sparse_index(entries(spark, sf_dir))


@query(f"WITH {OFFSETS} SELECT seg, coalesce(max(\"offset\") FILTER (WHERE key <= '{SEEK}'), 0) AS \"offset\" FROM sparse GROUP BY seg")
def sst_index_seek(spark, sf_dir):
    return S.index_seek(S.sparse_index(entries(spark, sf_dir)), SEEK)


@query(f"WITH {OFFSETS} SELECT seg, coalesce(max(\"offset\") FILTER (WHERE key <= 'a'), 0) AS \"offset\" FROM sparse GROUP BY seg")
def sst_index_seek_before_first(spark, sf_dir):
    return S.index_seek(S.sparse_index(entries(spark, sf_dir)), "a")


@query(f"WITH {OFFSETS}, probes AS (SELECT DISTINCT l.seg, p.key FROM log l, (SELECT DISTINCT key FROM log) p) SELECT p.seg, p.key, coalesce(s.\"offset\", 0) AS \"offset\" FROM probes p ASOF LEFT JOIN sparse s ON p.seg = s.seg AND p.key >= s.key")
def sst_index_seek_all(spark, sf_dir):
    """Every key sought in every file: an as-of join."""
    rows = entries(spark, sf_dir)
    return S.index_seek_each(S.sparse_index(rows), rows.select("key").distinct())


@query(f"WITH {ENTRIES} SELECT seg, key, value, tomb FROM entries WHERE key = '{LO}'")
def sst_point_get(spark, sf_dir):
    return entries(spark, sf_dir).where(F.col("key") == LO)


_ORDERS = "SELECT CAST(o_orderkey // 1000 AS BIGINT) AS seg, lpad(CAST(o_orderkey AS VARCHAR), 16, '0') AS key, o_orderstatus AS value FROM orders"


@query(f"WITH e AS ({_ORDERS}), f AS (SELECT seg, min(key) AS first_key, max(key) AS last_key FROM e GROUP BY seg) SELECT * FROM f WHERE last_key >= '0000000000001200' AND first_key < '0000000000003000'")
def sst_prune_range(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor(F.col("o_orderkey") / 1000).cast("long").alias("seg"), F.lpad(F.col("o_orderkey").cast("string"), 16, "0").alias("key"), F.col("o_orderstatus").alias("value"))
    files = S.footer_stats(rows).select("seg", "first_key", "last_key")
    return files.where(V.overlaps(F.col("first_key"), F.col("last_key"), included("0000000000001200"), excluded("0000000000003000")))


@query(f"WITH {FOOTERS} SELECT a.seg AS a, b.seg AS b FROM footers a JOIN footers b ON a.seg < b.seg AND a.first_key <= b.last_key AND b.first_key <= a.last_key")
def sst_overlap_pairs(spark, sf_dir):
    return S.overlap_pairs(footers(spark, sf_dir))


# ---- levels, manifest, compaction ----


@query(f"WITH {FILES} SELECT level, count(*) AS files, CAST(sum(data_len) AS BIGINT) AS bytes FROM files GROUP BY level")
def level_bytes(spark, sf_dir):
    return S.level_stats(level_files(spark, sf_dir))


@query(f"WITH {TARGETS} SELECT level, target FROM targets")
def level_targets(spark, sf_dir):
    return _targets(spark, sf_dir)


def _targets(spark, sf_dir) -> DataFrame:
    last = LEVELS.num_levels - 1
    held = level_files(spark, sf_dir).where(F.col("level") == last).agg(F.coalesce(F.sum("data_len"), F.lit(0))).first()[0]
    return spark.createDataFrame(list(enumerate(C.level_targets(held, LEVELS))), "level int, target long")


@query(f"WITH {TARGETS}, held AS (SELECT level, sum(data_len) AS bytes FROM files GROUP BY level), r AS (SELECT level, CAST(bytes AS DOUBLE) / target AS ratio FROM held JOIN targets USING (level) WHERE level BETWEEN 1 AND 5 AND target > 0) SELECT level, ratio FROM r WHERE ratio > 1 ORDER BY ratio DESC, level LIMIT 1")
def level_ratio_pick(spark, sf_dir):
    return S.most_overfull(S.level_stats(level_files(spark, sf_dir)).join(_targets(spark, sf_dir), "level"), LEVELS.num_levels - 1)


@query(f"WITH {FILES} SELECT level, min(file_id) AS file_id FROM files GROUP BY level")
def oldest_file(spark, sf_dir):
    return S.oldest_file(level_files(spark, sf_dir))


@query(f"WITH {FILES} SELECT min(first_key) AS first_key, max(last_key) AS last_key FROM files WHERE level = 0")
def l0_key_range(spark, sf_dir):
    return S.key_range(level_files(spark, sf_dir).where("level = 0"))


@query(f"WITH {FILES} SELECT CAST(coalesce(max(file_id), -1) + 1 AS BIGINT) AS next_id FROM files")
def next_id(spark, sf_dir):
    return S.next_id(level_files(spark, sf_dir))


@query(f"WITH {TARGETS}, l0 AS (SELECT min(first_key) AS a, max(last_key) AS z FROM files WHERE level = 0), base AS (SELECT min(level) AS b FROM targets WHERE level > 0 AND target > 0) SELECT file_id, level, b AS output FROM files, l0, base WHERE (SELECT count(*) FROM files WHERE level = 0) >= 4 AND (level = 0 OR (level = b AND last_key >= a AND first_key <= z))")
def compaction_pick(spark, sf_dir):
    rows = [C.Segment(r.level, r.file_id, r.first_key.encode(), r.last_key.encode(), 0, r.data_len, 0, 0, "") for r in level_files(spark, sf_dir).collect()]  # a row for each file
    task = C.Leveled().pick(rows, LEVELS)
    return spark.createDataFrame([(s.file_id, s.level, task.level) for s in task.inputs] if task else [], "file_id long, level int, output int")


@query(f"WITH {LOG}, last AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log) SELECT key, value, seq FROM last WHERE r = 1 AND NOT tomb")
def compaction_l0_output(spark, sf_dir):
    rows = V.normalised(S.segment_log(change_log(spark, sf_dir))).withColumns({"commit": F.col("seg").cast("long"), "ord": F.col("seq")})
    return C.compacted(rows, True).select("key", "value", F.col("ord").alias("seq"))


@query(f"WITH {LOG}, last AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM log) SELECT key, CASE WHEN tomb THEN NULL ELSE value END AS value, tomb FROM last WHERE r = 1")
def compaction_keeps_tombstones(spark, sf_dir):
    rows = V.normalised(S.segment_log(change_log(spark, sf_dir))).withColumns({"commit": F.col("seg").cast("long"), "ord": F.col("seq")})
    return C.compacted(rows, False).select("key", "value", "tomb")


@query(
    f"""WITH RECURSIVE {LOG}, sized AS (SELECT seg, seq, row_number() OVER (PARTITION BY seg ORDER BY seq) AS n, strlen(key) + CASE WHEN tomb THEN 0 ELSE strlen(value) END AS b FROM log),
  walk AS (SELECT seg, seq, n, b AS total, 0 AS cut FROM sized WHERE n = 1
    UNION ALL SELECT s.seg, s.seq, s.n, CASE WHEN w.total >= 2000 THEN s.b ELSE w.total + s.b END, w.cut + CASE WHEN w.total >= 2000 THEN 1 ELSE 0 END FROM walk w JOIN sized s ON s.seg = w.seg AND s.n = w.n + 1)
  SELECT seg, CAST(cut AS BIGINT) AS segment, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS records, CAST(max(total) AS BIGINT) AS bytes FROM walk GROUP BY seg, cut"""
)
def freeze_boundaries(spark, sf_dir):
    return S.freeze_boundaries(change_log(spark, sf_dir), 2000, "seg")


_ACTIONS = """acts AS (SELECT event_id // 50 AS "commit", CASE WHEN event_type IN ('click', 'error') THEN 'remove' ELSE 'add' END AS action,
  CAST(user_id % 4 AS INTEGER) AS level, user_id AS file_id FROM events)"""


@query(f"WITH {_ACTIONS}, last AS (SELECT *, row_number() OVER (PARTITION BY level, file_id ORDER BY \"commit\" DESC, action = 'add' DESC) AS r FROM acts) SELECT level, file_id FROM last WHERE r = 1 AND action = 'add'")
def manifest_replay(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    action = F.when(F.col("event_type").isin("click", "error"), "remove").otherwise("add")
    return replayed(e.select(F.floor(F.col("event_id") / 50).alias("commit"), action.alias("action"), (F.col("user_id") % 4).cast("int").alias("level"), F.col("user_id").alias("file_id")))


@query(f"WITH {_ACTIONS}, last AS (SELECT *, row_number() OVER (PARTITION BY level, file_id ORDER BY \"commit\" DESC, action = 'add' DESC) AS r FROM acts) SELECT level, count(*) AS files FROM last WHERE r = 1 AND action = 'add' GROUP BY level")
def level_counts(spark, sf_dir):
    return manifest_replay(spark, sf_dir).groupBy("level").agg(F.count("*").alias("files"))


# ---- the store ----


def _loaded(spark, sf_dir) -> Store:
    """A store that took the log in five commits and compacted as it went."""
    store = Store.create(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}", Config(base_level_bytes=4000, max_l0_files=3, num_levels=4))
    log = change_log(spark, sf_dir)
    top = log.agg(F.max("seq")).first()[0] + 1
    for i in range(5):
        store.append(log.where((F.col("seq") >= top * i // 5) & (F.col("seq") < top * (i + 1) // 5)), order_by="seq")
        store.compact()
    return store


def _text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in ("key", "value")})


@query(f"WITH {LATEST} SELECT key, value FROM alive")
def store_scan(spark, sf_dir):
    return _text(_loaded(spark, sf_dir).scan())


@query(f"WITH {LATEST} SELECT key, value FROM alive WHERE key >= '{LO}' AND key < '{HI}'")
def store_reopened_scan(spark, sf_dir):
    store = _loaded(spark, sf_dir)
    return _text(Store.open(spark, store.path).scan(included(LO.encode()), excluded(HI.encode())))


@query(f"WITH {LATEST}, asked AS ({_ASKED}) SELECT a.key, v.value, v.key IS NOT NULL AS found FROM asked a LEFT JOIN alive v ON a.key = v.key")
def store_multi_get(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    keys = orders.select(F.concat(F.lit("user:"), F.lpad(F.col("o_custkey").cast("string"), 4, "0")).cast("binary").alias("key"))
    return _text(_loaded(spark, sf_dir).multi_get(keys))


@query(f"WITH {LATEST} SELECT key, value FROM alive")
def stream_latest(spark, sf_dir):
    """The events as a stream into a store, and its scan."""
    root = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    store = Store.create(spark, f"{root}/store")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    log = events.select(F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("key"), F.col("props").alias("value"), (F.col("event_type") == "error").alias("tomb"), F.col("event_id").alias("seq"))
    ingest(log, store, f"{root}/checkpoint").awaitTermination()
    return _text(store.scan())


@query(f"WITH {LATEST} SELECT key, value FROM alive")
def stream_latest_values(spark, sf_dir):
    """The newest values as state of a stream: what its updates leave."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    log = events.select(F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("key"), F.col("props").alias("value"), (F.col("event_type") == "error").alias("tomb"), F.col("event_id").alias("seq"))
    out = f"{scratch_dir(spark)}/updates-{uuid.uuid4().hex}"
    write = lambda batch, number: batch.write.parquet(f"{out}/batch={number}")
    latest_values(log).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return V.live(spark.read.parquet(out))


def _put_one_by_one(spark, sf_dir) -> Store:
    """A store that got every record through put and delete, froze its buffer and compacted as it went."""
    store = Store.create(spark, f"{scratch_dir(spark)}/puts-{uuid.uuid4().hex}", Config(memtable_size_limit=500_000, base_level_bytes=4000, max_l0_files=2, num_levels=4))

    def packed(batches):
        for b in batches:
            yield pa.record_batch([pa.array([pickle.dumps(list(zip(*(c.to_pylist() for c in b.columns), strict=True)))], pa.binary())], ["rows"])

    log = change_log(spark, sf_dir).orderBy("seq").select(F.col("key").cast("binary").alias("key"), F.when(~F.col("tomb"), F.col("value")).cast("binary").alias("value"))
    batch: list[tuple[bytes, bytes | None]] = []
    for r in log.mapInArrow(packed, "rows binary").toLocalIterator():  # a client's writes, one partition at a time
        batch += pickle.loads(r.rows)
        full = len(batch) // 1000 * 1000
        for i in range(0, full, 1000):
            store.write(batch[i : i + 1000])
        batch = batch[full:]
    store.write(batch)
    return store


@query(f"WITH {LATEST} SELECT key, value FROM alive")
def store_puts(spark, sf_dir):
    """put, delete, freeze, flush and background compaction; what is buffered is read too."""
    store = _put_one_by_one(spark, sf_dir)
    store.poll_compaction(wait=True)
    return _text(store.scan())


@query(f"WITH {LATEST} SELECT key, value FROM alive")
def store_recovered(spark, sf_dir):
    """The same after a reopening that replays the log, a flush and a compaction."""
    store = _put_one_by_one(spark, sf_dir)
    store.close()
    store = Store.open(spark, store.path, Config(base_level_bytes=4000, max_l0_files=1, num_levels=4))
    store.flush()
    store.compact()
    store.vacuum()
    return _text(store.scan())


@query(f"WITH {LATEST} SELECT key, value FROM alive")
def import_sorted_files(spark, sf_dir):
    """A folder of sorted files without a manifest becomes a store; later files are newer."""
    return _text(Store.import_files(spark, _written_sorted_files(spark, sf_dir), f"{scratch_dir(spark)}/import-{uuid.uuid4().hex}").scan())


@query(f"WITH {LATEST} SELECT key, value FROM alive")
def import_log_files(spark, sf_dir):
    """The same from log files."""
    return _text(Store.import_files(spark, _written_logs(spark, sf_dir), f"{scratch_dir(spark)}/import-{uuid.uuid4().hex}").scan())
