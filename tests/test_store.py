import os
import random
from dataclasses import replace

import pytest

from sedimenta.model import Config, excluded, included
from sedimenta.operators.compaction import Task
from sedimenta.sources import manifest
from sedimenta.sources.files import Files
from sedimenta.sources.manifest import Conflict, replayed
from sedimenta.sources.records import record, sorted_file
from sedimenta.store import Store
from sedimenta.streaming.ingest import ingest, latest_values

SMALL = Config(base_level_bytes=60, max_l0_files=2, num_levels=4, level_multiplier=3)


def rows(df):
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


def kv(spark, *pairs):
    return spark.createDataFrame([(k, v, v is None) for k, v in pairs], "key binary, value binary, tomb boolean")


def test_put_get_delete_reopen(spark, tmp_path):
    s = Store.create(spark, f"{tmp_path}/s")
    s.put(b"user:1", b"alice")
    s.put(b"user:2", b"bob")
    s.delete(b"user:2")
    s.delete(b"never")
    assert s.get(b"user:1") == b"alice" and s.get(b"user:2") is None and s.get(b"x") is None
    s.close()
    with Store.open(spark, f"{tmp_path}/s") as t:
        assert rows(t.scan()) == {b"user:1": b"alice"}
        t.flush()
        assert (t.l0_count(), t.total_file_count(), t.num_levels(), t.buffered_bytes()) == (1, 1, 7, 0)
        assert t.get(b"user:1") == b"alice" and t.get(b"user:2") is None
    assert rows(Store.open(spark, f"{tmp_path}/s").scan(included(b"user:1"), excluded(b"user:2"))) == {b"user:1": b"alice"}
    with pytest.raises(FileExistsError):
        Store.create(spark, f"{tmp_path}/s")
    with pytest.raises(FileNotFoundError):
        Store.open(spark, f"{tmp_path}/none")


def test_torn_log_and_second_reopen(spark, tmp_path):
    s = Store.create(spark, f"{tmp_path}/s")
    s.write([(b"user:1", b"alice"), (b"user:2", b"bob"), (b"user:3", b"charlie")])
    with open(f"{tmp_path}/s/wal/00000001.wal", "wb") as f:
        f.write(record(1, b"user:4", b"dan") + bytes([1, 6, 0, 117, 115, 101, 114]))
    t = Store.open(spark, f"{tmp_path}/s")
    t.put(b"user:5", b"eve")
    assert set(rows(Store.open(spark, f"{tmp_path}/s").scan())) == {b"user:1", b"user:2", b"user:3", b"user:4", b"user:5"}


def test_newest_wins_across_levels(spark, tmp_path):
    s = Store.create(spark, f"{tmp_path}/s", SMALL)
    for v in (b"v1", b"other"):
        s.append(kv(spark, (b"k", v), (b"a" + v, v)))
    assert s.compact() >= 1 and s.l0_count() == 0
    s.put(b"k", b"v2")
    s.freeze()
    assert s.get(b"k") == b"v2" and rows(s.scan())[b"k"] == b"v2"
    s.append(kv(spark, (b"z", b"1")))
    s.compact()
    assert s.get(b"k") == b"v2" and rows(s.scan())[b"k"] == b"v2"
    s.append(kv(spark, (b"k", None)))
    s.append(kv(spark, (b"zz", b"1")))
    s.compact()
    assert s.get(b"k") is None and b"k" not in rows(s.scan())


def test_model(spark, tmp_path):
    rng, want = random.Random(5), {}
    s = Store.create(spark, f"{tmp_path}/s", SMALL)
    for step in range(14):
        ops = [(b"k%02d" % rng.randrange(12), rng.choice([None, b"v%d" % step])) for _ in range(6)]
        if rng.random() < 0.5:
            s.write(ops)
            want |= dict(ops)
        else:
            last = dict(ops)
            s.append(kv(spark, *last.items()))
            want |= last
        act = rng.choice(["freeze", "compact", "reopen", "none"])
        if act == "freeze":
            s.freeze()
        elif act == "compact":
            s.freeze()
            s.compact()
        elif act == "reopen":
            s = Store.open(spark, s.path)
        alive = {k: v for k, v in want.items() if v}
        assert rows(s.scan()) == alive
        k = b"k%02d" % rng.randrange(12)
        assert s.get(k) == alive.get(k)
    assert s.vacuum() > 0 and rows(s.scan()) == alive


def test_writers_conflict_and_old_versions(spark, tmp_path):
    a = Store.create(spark, f"{tmp_path}/s")
    b = Store.open(spark, f"{tmp_path}/s")
    a.append(kv(spark, (b"k", b"1")))
    with pytest.raises(Conflict):
        b.append(kv(spark, (b"k", b"2")))
    a.append(kv(spark, (b"k", b"3")))
    assert rows(Store.open(spark, f"{tmp_path}/s", version=1).scan()) == {b"k": b"1"}
    with pytest.raises(ValueError):
        a.put(b"x" * 70_000, b"v")


def test_pruning_and_files(spark, tmp_path):
    s = Store.create(spark, f"{tmp_path}/s", Config(max_l0_files=100))
    for i in range(4):
        s.append(kv(spark, *((b"%d%03d" % (i, j), b"v") for j in range(40))))
    assert {x.first_key[:1] for x in s.segments(included(b"2"), excluded(b"3"))} == {b"2"}
    plan = s.scan(included(b"2"), excluded(b"3"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan or "FileScan" in plan
    assert s.multi_get(spark.createDataFrame([(b"2001",), (b"9",)], "key binary")).where("found").count() == 1
    assert s.prefix(b"30").count() == 40
    assert s.level_count(0) == s.total_file_count()


def test_import_of_byte_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/00000001.sst").write_bytes(sorted_file([(b"a", b"old"), (b"b", b"1"), (b"c", b"1")]))
    (tmp_path / "in/00000002.sst").write_bytes(sorted_file([(b"a", b"new"), (b"b", b"")]))
    (tmp_path / "in/00000003.wal").write_bytes(record(1, b"d", b"4") + record(0, b"c"))
    s = Store.import_files(spark, f"{tmp_path}/in", f"{tmp_path}/s")
    assert rows(s.scan()) == {b"a": b"new", b"d": b"4"}


def test_manifest_removes_before_it_adds(spark):
    acts = spark.createDataFrame([(0, "add", 0, 1), (1, "add", 1, 2), (1, "remove", 0, 1), (2, "remove", 1, 2), (2, "add", 1, 2), (2, "add", 1, 2)], "commit long, action string, level int, file_id long")
    assert [(r.level, r.file_id) for r in replayed(acts).collect()] == [(1, 2)]


def test_whole_snapshots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "EVERY", 3)
    s = Store.create(spark, f"{tmp_path}/s")
    for i in range(7):
        s.append(kv(spark, (b"k%d" % i, b"1")))
    assert [n for n in s.files.list("_log") if n.endswith(".whole")] == ["00000003.whole", "00000006.whole"]
    for v in (2, 3, 5, 7):
        assert len(rows(Store.open(spark, s.path, version=v).scan())) == v
    assert vars(Store.open(spark, s.path).snapshot) == vars(s.snapshot)


def test_stream_is_written_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "key binary, value binary, tomb boolean, seq long"
    spark.createDataFrame([(b"a", b"1", False, 0), (b"a", b"2", False, 1), (b"b", None, True, 2)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/x")
    s = Store.create(spark, f"{tmp_path}/s")
    read = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in/x")
    ingest(read(), s, f"{tmp_path}/c1").awaitTermination()
    version = s.snapshot.version
    assert not s.append(kv(spark, (b"a", b"9")), source=("ingest", 0))
    assert s.snapshot.version == version and rows(s.scan()) == {b"a": b"2"}
    q = latest_values(read()).writeStream.format("memory").queryName("lv").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(bytes(r.key), r.seq, r.tomb) for r in spark.table("lv").collect()} == {(b"a", 1, False), (b"b", 2, True)}


def test_one_log_file_for_many_records(spark, tmp_path):
    s = Store.create(spark, f"{tmp_path}/s")
    for i in range(50):
        s.put(b"k%d" % i, b"v")
    assert s.files.list("wal") == ["00000000.wal"]
    t = Store.open(spark, f"{tmp_path}/s")  # s has crashed
    t.delete(b"k7")
    assert t.files.list("wal") == ["00000000.wal", "00000001.wal"]
    assert len(rows(Store.open(spark, f"{tmp_path}/s").scan())) == 49
    with open(f"{tmp_path}/s/wal/00000001.wal", "ab") as f:
        f.write(record(1, b"torn", b"x")[:-2])
    u = Store.open(spark, f"{tmp_path}/s")
    u.flush()
    assert u.files.list("wal") == [] and len(rows(u.scan())) == 49


def test_compaction_moves_files(spark, tmp_path):
    s = Store.create(spark, f"{tmp_path}/s", Config(base_level_bytes=60, max_l0_files=1, num_levels=4, level_multiplier=3))
    s.append(kv(spark, *((b"k%03d" % i, b"v" * 20) for i in range(20))))
    (path,) = [x.path for x in s.segments()]
    assert s.compact() >= 1
    (moved,) = s.segments()
    assert moved.path == path and moved.level > 0 and len(rows(s.scan())) == 20
    s.append(kv(spark, (b"k001", None), (b"zzz", None)))
    s.compact()
    assert all(not x.num_deletions for x in s.segments() if x.level == 3)
    s.vacuum()
    assert len(rows(s.scan())) == 19 and len(rows(Store.open(spark, s.path).scan())) == 19


def test_background_compaction(spark, tmp_path):
    s = Store.create(spark, f"{tmp_path}/s", Config(memtable_size_limit=100, max_l0_files=2, base_level_bytes=60, num_levels=3))
    want = {}
    for i in range(12):
        k, v = b"k%d" % (i % 5), b"v%02d" % i * 20
        s.put(k, v)
        want[k] = v
        assert s.get(k) == v
    assert not (s._flight and s.schedule_compaction())  # one in flight at most
    s.close()
    t = Store.open(spark, f"{tmp_path}/s")
    assert rows(t.scan()) == want and any(x.level for x in t.segments())
    t.strategy = type("Broken", (), {"pick": lambda *_: Task((), 1)})()
    assert t.schedule_compaction() and not t.schedule_compaction()
    with pytest.raises(ValueError):
        t.poll_compaction(wait=True)


def test_lookups_open_the_files_of_their_range(spark, tmp_path):
    s = Store.create(spark, f"{tmp_path}/s", Config(max_l0_files=100))
    for i in range(4):
        s.append(kv(spark, *((b"%d%03d" % (i, j), b"v") for j in range(40))))
    opened = []
    files = s._files
    s._files = lambda some: opened.append(len(some)) or files(some)
    assert s.multi_get(spark.createDataFrame([(b"2001",), (b"2039",)], "key binary")).where("found").count() == 2
    assert s.prefix(b"30").count() == 40
    assert opened == [sum(x.first_key[:1] == c for x in s.segments()) for c in (b"2", b"3")]
    assert s.multi_get(spark.createDataFrame([], "key binary")).count() == 0


def test_freeze_reads_nothing_again(spark, tmp_path, monkeypatch):
    """A frozen buffer's statistics are known to the writer, and equal those of its file."""
    s = Store.create(spark, f"{tmp_path}/s")
    s.write([(b"b", b"2"), (b"\xff", b"x" * 300), (b"a", None), (b"b", b"22"), (b"c", b"")])
    with monkeypatch.context() as m:
        m.setattr(Store, "_data", lambda *_: pytest.fail("the file was read again"))
        s.freeze()
    (own,) = s.segments()
    (want,) = s._data(s._files([own]).coalesce(1), 0)
    assert replace(own, file_id=-1, path="") == replace(want, path="")
    assert [(bytes(r.key), bytes(r.value)) for r in s.scan().collect()] == [(b"b", b"22"), (b"\xff", b"x" * 300)]
    assert s.get(b"a") is None and own.num_deletions == 2


def test_local_log_is_not_sent_through_the_gateway(spark, tmp_path, monkeypatch):
    """Batches are synced one by one, and readable at once; the name can't be taken twice."""
    files, synced, real = Files(spark, f"file:{tmp_path}"), [], os.fsync
    monkeypatch.setattr(os, "fsync", lambda n: (synced.append(n), real(n))[1])
    log = files.appender("wal/a b%20.wal")
    for i in range(3):
        log.write(b"x" * i)
        assert files.read("wal/a b%20.wal") == b"x" * (i * (i + 1) // 2)
    assert len(synced) == 3 and files.appender("wal/a b%20.wal") is None
    log.close()
