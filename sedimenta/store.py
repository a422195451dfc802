"""A store: one ordered keyspace in a folder, of segments, a write buffer with its log, and snapshots."""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import asdict, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.binary import entry_bytes
from sedimenta.model import ENTRY, MAX_FIELD, MUTATION, Bound, Config, included, unbounded, within
from sedimenta.operators import view
from sedimenta.operators.compaction import Leveled, Segment, Strategy, Task, compacted, may_drop_deletions, moves
from sedimenta.sources.files import Files
from sedimenta.sources.manifest import Conflict, Manifest, Snapshot, to_json
from sedimenta.sources.records import DELETE, PUT, read_logs, read_sorted_files, record, records

RECENCY = ["commit", "ord"]


def _table(rows: list[tuple]) -> pa.Table:
    """Rows of MUTATION."""
    kinds = (pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64())
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=MUTATION.names)


class _Flight:
    """A compaction that runs in a thread of its own; the store applies its result."""

    def __init__(self, task: Task, work):
        self.task, self._made, self._error = task, None, None

        def run():
            try:
                self._made = work()
            except Exception as e:  # raised again by whoever polls
                self._error = e

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def ended(self, wait: bool) -> bool:
        if wait:
            self._thread.join()
        return not self._thread.is_alive()

    def result(self) -> list[Segment]:
        if self._error:
            raise self._error
        return self._made


class Store:
    """Single writer, many readers: a reader sees the snapshot that it opened.

    put and delete go to the end of a log file and to a buffer that is frozen at memtable_size_limit; append
    writes a DataFrame of any size as segments in one commit. Reads take the newest version by (commit, ord)."""

    def __init__(self, spark: SparkSession, path: str, snapshot: Snapshot, strategy: Strategy | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        self.manifest, self.snapshot = Manifest(self.files), snapshot
        self.config = Config(**snapshot.config)
        self.strategy = strategy or Leveled()
        self._buffer: dict[bytes, tuple[bytes | None, int]] = {}
        self._size = self._ord = self._log_file = 0
        self._log = None  # the open log file
        self._flight: _Flight | None = None
        self._closed = False

    # ---- lifecycle ----

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: Config | None = None) -> Store:
        """A new store; an error if the folder has one."""
        files = Files(spark, path)
        files.mkdirs("_log")
        manifest, snapshot = Manifest(files), Snapshot()
        if manifest.versions():
            raise FileExistsError(f"{path} has a store")
        manifest.commit(snapshot, {"config": asdict(config or Config()), "next_file": 0, "next_commit": 0})
        return cls(spark, path, snapshot)

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config | None = None, version: int | None = None) -> Store:
        """The store at its newest snapshot (or an older version, to read), with what its log holds beyond it.

        config may change sizes; fewer levels than there are files on are refused."""
        files = Files(spark, path)
        manifest = Manifest(files)
        snapshot = manifest.replay(version)
        if snapshot.version < 0:
            raise FileNotFoundError(f"no store in {path}")
        if config:
            if any(s.level >= config.num_levels for s in snapshot.segments.values()):
                raise ValueError("files lie on deeper levels than this configuration has")
            snapshot.config = asdict(config)
        store = cls(spark, path, snapshot)
        if version is None:
            store._recover()
        return store

    @classmethod
    def import_files(cls, spark: SparkSession, source: str, path: str, config: Config | None = None) -> Store:
        """A new store from a folder of byte-format files without a manifest: sorted files by their ids,
        then log files by theirs; later ids are newer."""
        store = cls.create(spark, path, config)
        held = Files(spark, source)
        for pattern, reader in (("*.sst", read_sorted_files), ("*.wal", read_logs)):
            if held.any(pattern):
                rows = reader(spark, source, pattern)
                number = F.coalesce(F.regexp_extract("file", r"^(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
                store.append(rows.select("key", "value", "tomb", F.struct(number, "ord").alias("_o")), order_by="_o")
        return store

    def _recover(self) -> None:
        """The buffer from the log: whole batches; one that is cut off at its end gives its sound records."""
        for name in self.files.list("wal"):
            number = int(name.split(".")[0])
            if number <= self.snapshot.flushed_log:
                continue
            for op, key, value in records(self.files.read(f"wal/{name}")):
                self._note(key, value if op == PUT else None)
            self._log_file = max(self._log_file, number + 1)
        self._log_file = max(self._log_file, self.snapshot.flushed_log + 1)

    def close(self) -> None:
        """Waits for the compaction in flight and applies it; the buffer stays in its log."""
        self.poll_compaction(wait=True)
        self._roll_log()
        self._closed = True

    def _roll_log(self) -> None:
        if self._log:
            self._log.close()
            self._log = None
            self._log_file += 1

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # ---- writes ----

    def _note(self, key: bytes, value: bytes | None) -> None:
        self._buffer[key] = (value or None, self._ord)
        self._ord += 1
        self._size += len(key) + len(value or b"")

    def put(self, key: bytes, value: bytes) -> None:
        """Upsert; an empty value deletes."""
        self.write([(key, value)])

    def delete(self, key: bytes) -> None:
        """Blind: the key need not exist."""
        self.write([(key, None)])

    def write(self, batch: list[tuple[bytes, bytes | None]]) -> None:
        """Puts and deletions (value None) in order, at the end of the open log file: all or a sound head survive
        a crash. A full buffer is frozen, and a compaction starts in the background unless one is in flight."""
        if self._closed:
            raise RuntimeError("the store is closed")
        if any(max(len(k), len(v or b"")) > MAX_FIELD for k, v in batch):
            raise ValueError(f"keys and values have at most {MAX_FIELD} bytes here; append takes longer ones")
        if self._log is None:
            self.files.mkdirs("wal")
            self._log = self.files.appender(f"wal/{self._log_file:08d}.wal")
            if self._log is None:
                raise Conflict("another writer has this log file")
        self._log.write(b"".join(record(PUT if v else DELETE, k, v or b"") for k, v in batch))
        for k, v in batch:
            self._note(k, v)
        if self._size >= self.config.memtable_size_limit:
            self.freeze()
            self.poll_compaction()
            self.schedule_compaction()

    def freeze(self) -> None:
        """The buffer becomes a segment of the first level, in one commit; its log goes after it."""
        self._roll_log()
        if not self._buffer:
            return
        commit = self.snapshot.next_commit
        rows = [(k, v, v is None, commit, o) for k, (v, o) in sorted(self._buffer.items())]
        folder = self._written(self.spark.createDataFrame(_table(rows), MUTATION).coalesce(1), 0, len(rows))
        (name,) = (n for n in self.files.list(folder) if n.endswith(".parquet"))
        size = sum(len(k) + len(v or b"") + 4 for k, v, *_ in rows)  # known here: no job reads the file again
        made = Segment(0, -1, rows[0][0], rows[-1][0], len(rows), size, commit, commit, f"{folder}/{name}", sum(r[2] for r in rows))
        self._commit([made], {"next_commit": commit + 1, "flushed_log": self._log_file - 1})
        self._buffer.clear()
        self._size = self._ord = 0
        for name in self.files.list("wal"):
            if int(name.split(".")[0]) <= self.snapshot.flushed_log:
                self.files.delete(f"wal/{name}")

    def flush(self) -> None:
        """Freezes and commits whatever is buffered."""
        self.freeze()

    def append(self, df: DataFrame, order_by: str | None = None, source: tuple[str, int] | None = None) -> bool:
        """A DataFrame of key, value and optionally tomb as one commit, newer than all before.

        order_by: the column that ranks versions of a key in df; without it keys must be unique there
        (of several, any one wins). source: (name, batch) written at most once; False if it was."""
        if source and self.snapshot.sources.get(source[0], -1) >= source[1]:
            return False
        self.freeze()
        commit = self.snapshot.next_commit
        tomb = F.col("tomb") if "tomb" in df.columns else F.lit(False)
        rank = F.col(order_by) if order_by else F.lit(0)
        rows = view.normalised(df.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), tomb.alias("tomb"), rank.alias("_rank")))
        stamp = [F.lit(commit).cast("long").alias("commit"), F.lit(0).cast("long").alias("ord")]
        if order_by:  # combined before the exchange: a hot key is a row for each task
            won = view.latest(rows, ["_rank"]).select("key", "value", "tomb", *stamp).repartitionByRange("key").sortWithinPartitions("key")
        else:  # a key once, as a rule: one exchange and one sort
            won = compacted(rows.select("key", "value", "tomb", *stamp), False)
        self._commit(self._data(won, 0), {"next_commit": commit + 1} | ({"sources": {source[0]: source[1]}} if source else {}))
        return True

    def _written(self, rows: DataFrame, level: int, keys: int | None = None) -> str:
        """Rows, which are in key ranges and in key order, as Parquet with key Blooms: their folder.
        keys: how many a file will have at most, which sizes its Bloom; unknown, the writer tries several."""
        name = f"data/L{level}-{self.snapshot.next_file:08d}-{uuid.uuid4().hex[:12]}"  # a writer that loses leaves it to vacuum
        writer = rows.write.option("parquet.bloom.filter.enabled#key", "true")
        writer = writer.option("parquet.bloom.filter.expected.ndv#key", str(max(keys, 1))) if keys is not None else writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.path}/{name}")
        return name

    def _data(self, rows: DataFrame, level: int, keys: int | None = None) -> list[Segment]:
        """As _written: the files' statistics, not live yet."""
        name = self._written(rows, level, keys)
        made = self.spark.read.schema(MUTATION).parquet(f"{self.path}/{name}").withColumn("file", F.col("_metadata.file_path"))
        size = F.sum(entry_bytes(F.col("key"), F.col("value")))
        stats = made.groupBy("file").agg(F.min("key").alias("a"), F.max("key").alias("z"), F.count("*").alias("n"), size.alias("bytes"), F.min("commit").alias("lo"), F.max("commit").alias("hi"), F.count_if("tomb").alias("gone"))
        found = sorted(stats.collect(), key=lambda r: bytes(r.a))  # a row for each file
        return [Segment(level, -1, bytes(r.a), bytes(r.z), r.n, r.bytes, r.lo, r.hi, f"{name}/{r.file.rpartition('/')[2]}", r.gone) for r in found]

    def _commit(self, made: list[Segment], edit: dict, remove: tuple[int, ...] = ()) -> None:
        """Makes files live, under new ids, and takes others out."""
        first = self.snapshot.next_file
        add = [to_json(replace(s, file_id=first + i)) for i, s in enumerate(made)]
        self.manifest.commit(self.snapshot, edit | {"add": add, "remove": list(remove), "next_file": first + max(len(add), 1)})

    # ---- reads ----

    def segments(self, lo: Bound = unbounded, hi: Bound = unbounded) -> list[Segment]:
        """Live files that may hold keys of a range, by their statistics."""

        def may(s: Segment) -> bool:
            above = lo.kind == "unbounded" or (s.last_key >= lo.key if lo.kind == "included" else s.last_key > lo.key)
            return above and (hi.kind == "unbounded" or (s.first_key <= hi.key if hi.kind == "included" else s.first_key < hi.key))

        return [s for s in self.snapshot.segments.values() if may(s)]

    def _buffered(self) -> DataFrame:
        return self.spark.createDataFrame(_table([(k, v, v is None, self.snapshot.next_commit, o) for k, (v, o) in self._buffer.items()]), MUTATION)

    def _files(self, segments: list[Segment]) -> DataFrame:
        return self.spark.read.schema(MUTATION).parquet(*[f"{self.path}/{s.path}" for s in segments])

    def changes(self, lo: Bound = unbounded, hi: Bound = unbounded) -> DataFrame:
        """All retained versions of a range: files that can hold it, and the buffer."""
        some = self.segments(lo, hi)
        parts = ([self._files(some)] if some else []) + ([self._buffered()] if self._buffer or not some else [])
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return out.where(within(F.col("key"), lo, hi))

    def scan(self, lo: Bound = unbounded, hi: Bound = unbounded, ordered: bool = True) -> DataFrame:
        """Live (key, value) of a range, in key order."""
        some = self.segments(lo, hi)
        if not self._buffer and (len(some) == 1 or self._disjoint(some)) and some:
            rows = self._files(some).where(within(F.col("key"), lo, hi) & ~F.col("tomb")).select("key", "value")  # one version of each key
            return rows.orderBy("key") if ordered else rows
        return view.scan(self.changes(lo, hi), lo, hi, RECENCY, ordered)

    @staticmethod
    def _disjoint(segments: list[Segment]) -> bool:
        own = sorted(segments, key=lambda s: s.first_key)
        return all(a.last_key < b.first_key for a, b in zip(own, own[1:]))

    def get(self, key: bytes) -> bytes | None:
        """The newest value of a key; None if it has none or was deleted."""
        if key in self._buffer:
            return self._buffer[key][0]
        some = self.segments(included(key), included(key))
        if not some:
            return None
        row = view.get(self._files(some), key, RECENCY).first()
        return bytes(row.value) if row else None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """(key, value, found) of a DataFrame of keys, in one pass over the files of their range."""
        ends = keys.agg(F.min("key").alias("a"), F.max("key").alias("z")).first()
        lo, hi = (unbounded, unbounded) if ends.a is None else (included(bytes(ends.a)), included(bytes(ends.z)))
        return view.multi_get(self.changes(lo, hi), keys, RECENCY)

    def prefix(self, prefix: bytes) -> DataFrame:
        """Live entries whose key starts with these bytes, from the files of their range."""
        lo, hi = view.prefix_bounds(prefix)
        return view.prefix_scan(self.changes(lo, hi), prefix, RECENCY)

    def snapshot_entries(self) -> DataFrame:
        """All live entries, in no order."""
        return self.scan(ordered=False) if self.snapshot.segments or self._buffer else self.spark.createDataFrame([], ENTRY)

    # ---- maintenance ----

    def compact(self, most: int | None = None) -> int:
        """Runs what the strategy asks for until it is content; the number of compactions."""
        n = int(self.poll_compaction(wait=True))
        while (most is None or n < most) and (task := self._pick()):
            self.run(task)
            n += 1
        return n

    def _pick(self) -> Task | None:
        return self.strategy.pick(list(self.snapshot.segments.values()), self.config)

    def run(self, task: Task) -> None:
        """One compaction: a move in the manifest where no rewrite is needed, else one Spark job."""
        self._commit(self._output(task), {}, tuple(s.file_id for s in task.inputs))

    def _output(self, task: Task) -> list[Segment]:
        drop = may_drop_deletions(task, list(self.snapshot.segments.values()))
        if moves(task, drop):
            return [replace(task.inputs[0], level=task.level)]
        parts = max(1, -(-sum(s.data_len for s in task.inputs) // self.config.target_file_bytes))
        keys = -(-sum(s.num_entries for s in task.inputs) // parts)
        return self._data(compacted(self._files(list(task.inputs)), drop, parts), task.level, keys)

    def schedule_compaction(self) -> bool:
        """Starts what the strategy asks for in the background; False if one is in flight or none is due.
        Files that are flushed meanwhile are newer than its inputs, so it stays right."""
        if self._flight or not (task := self._pick()):
            return False
        self._flight = _Flight(task, lambda: self._output(task))
        return True

    def poll_compaction(self, wait: bool = False) -> bool:
        """Applies the compaction in flight if it has ended (wait: once it has); an error in it is raised here."""
        if not self._flight or not self._flight.ended(wait):
            return False
        flight, self._flight = self._flight, None
        self._commit(flight.result(), {}, tuple(s.file_id for s in flight.task.inputs))
        return True

    def vacuum(self, retain: int = 1) -> int:
        """Deletes data folders that none of the newest `retain` snapshots and no later one uses."""
        self.poll_compaction(wait=True)
        versions = self.manifest.versions()
        used = {s.path.split("/")[1] for v in versions[-max(retain, 1) :] for s in self.manifest.replay(v).segments.values()}
        gone = [n for n in self.files.list("data") if n not in used]
        for n in gone:
            self.files.delete(f"data/{n}")
        return len(gone)

    # ---- figures ----

    @property
    def compaction_config(self) -> Config:
        return self.config

    def level_count(self, level: int) -> int:
        return sum(s.level == level for s in self.snapshot.segments.values())

    def l0_count(self) -> int:
        return self.level_count(0)

    def num_levels(self) -> int:
        return self.config.num_levels

    def total_file_count(self) -> int:
        return len(self.snapshot.segments)

    def buffered_bytes(self) -> int:
        """Bytes of all buffered mutations, overwritten ones too."""
        return self._size

    def describe(self) -> str:
        return json.dumps({"version": self.snapshot.version, "files": [to_json(s) for s in self.snapshot.segments.values()]})

