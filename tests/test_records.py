import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimenta.functions import binary as B
from sedimenta.sources import records as R

LOG = R.record(1, b"key1", b"val1") + R.record(1, b"key2", b"val2")


def test_replay_in_order():
    assert list(R.records(LOG)) == [(1, b"key1", b"val1"), (1, b"key2", b"val2")]


def test_delete_record():
    assert list(R.records(R.record(1, b"k", b"v") + R.record(0, b"k")))[1] == (0, b"k", b"")


@pytest.mark.parametrize("tail", [bytes([1, 0, 4, 116, 114, 117]), bytes([1, 6, 0]) + b"user", b"\x01", LOG[:7]])
def test_torn_tail_is_left_out(tail):
    assert len(list(R.records(LOG + tail))) == 2


def test_damaged_record_stops_the_replay():
    bad = bytearray(LOG)
    bad[5] ^= 1
    assert list(R.records(bytes(bad))) == []


def test_unknown_op_is_an_error():
    with pytest.raises(ValueError):
        list(R.records(R.record(7, b"k", b"v")))


def test_too_long_key():
    with pytest.raises(ValueError):
        R.record(1, b"x" * 65_536)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1]), st.binary(max_size=40), st.binary(max_size=40)), max_size=12), st.integers(0, 30))
def test_round_trip_and_any_cut(ops, cut):
    raw = b"".join(R.record(*o) for o in ops)
    assert list(R.records(raw)) == ops
    assert list(R.records(raw[: max(0, len(raw) - cut)])) == ops[: len(list(R.records(raw[: max(0, len(raw) - cut)])))]


def test_sorted_file_round_trip():
    rows = [(b"a", b"1"), (b"b", b""), (b"c", b"3" * 300)]
    assert list(R.entries(R.sorted_file(rows, b"footer"))) == rows


def test_readers(spark, tmp_path):
    (tmp_path / "00000001.wal").write_bytes(LOG + b"\x01\x00")
    (tmp_path / "00000002.sst").write_bytes(R.sorted_file([(b"a", b"1"), (b"b", b"")], b"ff"))
    got = [(r.file, r.ord, bytes(r.key), r.tomb) for r in R.read_logs(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [("00000001.wal", 0, b"key1", False), ("00000001.wal", 1, b"key2", False)]
    got = [(bytes(r.key), r.tomb) for r in R.read_sorted_files(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [(b"a", False), (b"b", True)]


def test_columns_write_the_same_record(spark):
    df = spark.createDataFrame([(1, b"key", b"value"), (0, b"gone", None), (1, b"", b"x" * 700)], "op int, key binary, value binary")
    for r in df.withColumn("rec", B.log_record(F.col("op"), F.col("key"), F.col("value"))).collect():
        assert bytes(r.rec) == R.record(r.op, bytes(r.key), bytes(r.value or b""))


def test_little_endian_and_names(spark):
    df = spark.createDataFrame([(0x1234,), (0,), (65_535,)], "n int")
    for r in df.select("n", B.little_endian(F.col("n"), 2).alias("b"), B.from_little_endian(B.little_endian(F.col("n"), 2), 2).alias("back")).collect():
        assert bytes(r.b) == r.n.to_bytes(2, "little") and r.back == r.n
    names = spark.createDataFrame([("/x/00000042.sst",), ("MANIFEST",), ("a/7.wal",)], "f string").select(B.file_id(F.col("f")).alias("i"))
    assert [r.i for r in names.collect()] == [42, 0, 7]
    assert spark.range(1).select(B.file_name(F.lit(7), ".sst").alias("n")).first().n == "00000007.sst"
    assert spark.range(1).select(B.lossy_utf8(F.lit(b"a\xffb")).alias("n")).first().n == "a�b"
    assert spark.range(1).select(B.checksum(F.lit(b"123456789")).alias("n")).first().n == 0xCBF43926
    assert os.sep == "/"


def test_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """Files of any number of records, in order, with the tail; none passes the driver, and a name that is taken is an error."""
    monkeypatch.setattr(R.Files, "create", lambda *_: pytest.fail("a file passed the driver"))
    rows = [(f"{i % 7:08d}.wal", i, b"%d," % i) for i in range(300)] + [("00000009.wal", 0, b"")]
    df = spark.createDataFrame(rows, "file string, ord long, record binary").repartition(5)
    assert R.write_files(df, f"{tmp_path}/out", b"tail") == 8
    for n in {r[0] for r in rows}:
        assert (tmp_path / "out" / n).read_bytes() == b"".join(r[2] for r in rows if r[0] == n) + b"tail"
    assert len(os.listdir(tmp_path / "out")) == 8
    with pytest.raises(Exception, match="FileExistsError"):
        R.write_files(df, f"{tmp_path}/out", b"other")


def test_files_that_executors_do_not_reach_pass_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R.remote, "reaches", lambda _: False)
    df = spark.createDataFrame([("a.wal", 1, b"2"), ("a.wal", 0, b"1"), ("b.wal", 0, b"3")], "file string, ord long, record binary")
    assert R.write_files(df, f"{tmp_path}/out") == 2
    assert (tmp_path / "out" / "a.wal").read_bytes() == b"12"
