import pytest
from pyspark.sql import functions as F

from sedimenta.model import Bound, Config, excluded, included, unbounded
from sedimenta.operators import compaction as C
from sedimenta.operators import stats as S
from sedimenta.operators import view as V

SCHEMA = "key binary, value binary, tomb boolean, seq long"


def log(spark, rows):
    return spark.createDataFrame([(k, v, v is None, i) for i, (k, v) in enumerate(rows)], SCHEMA)


def out(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def test_put_overwrite_delete(spark):
    assert out(V.live(log(spark, [(b"k", b"v1"), (b"k", b"v2")]))) == [(b"k", b"v2")]
    assert out(V.live(log(spark, [(b"k", b"v1"), (b"k", None)]))) == []
    assert out(V.live(log(spark, [(b"k", b"v1"), (b"k", b"")]))) == []  # putting nothing deletes
    assert out(V.live(log(spark, [(b"k", None), (b"k", b"v")]))) == [(b"k", b"v")]
    assert out(V.live(log(spark, []))) == []


def test_unsigned_byte_order(spark):
    keys = [b"\xff", b"", b"\x80", b"\x00\x00", b"\x7f", b"\x00"]
    assert [k for k, _ in out(V.scan(log(spark, [(k, b"x") for k in keys])))] == sorted(keys)


@pytest.mark.parametrize("lo", [unbounded, included(b"b"), excluded(b"b"), included(b"z")])
@pytest.mark.parametrize("hi", [unbounded, included(b"c"), excluded(b"c"), included(b"a")])
def test_bounds(spark, lo, hi):
    keys = [b"a", b"b", b"c", b"d"]
    want = [k for k in keys if (lo.kind == "unbounded" or k > lo.key or (lo.kind == "included" and k == lo.key)) and (hi.kind == "unbounded" or k < hi.key or (hi.kind == "included" and k == hi.key))]
    assert [k for k, _ in out(V.scan(log(spark, [(k, b"1") for k in keys]), lo, hi))] == want


def test_bad_bounds():
    for args in (("included", None), ("unbounded", b"a"), ("near", b"a")):
        with pytest.raises(ValueError):
            Bound(*args)


def test_get_multi_get_prefix(spark):
    rows = log(spark, [(b"a1", b"1"), (b"a2", b"2"), (b"b", b"3"), (b"a2", None), (b"a\xff", b"4")])
    assert out(V.get(rows, b"a1")) == [(b"a1", b"1")] and out(V.get(rows, b"a2")) == [] and out(V.get(rows, b"zz")) == []
    asked = spark.createDataFrame([(b"a1",), (b"a2",), (b"x",), (b"a1",)], "key binary")
    assert sorted((bytes(r.key), r.found) for r in V.multi_get(rows, asked).collect()) == [(b"a1", True), (b"a2", False), (b"x", False)]
    assert [k for k, _ in out(V.prefix_scan(rows, b"a"))] == [b"a1", b"a\xff"]
    assert [k for k, _ in out(V.prefix_scan(rows, b"a\xff"))] == [b"a\xff"]
    assert len(out(V.prefix_scan(rows, b""))) == 3


def test_merge(spark):
    src = lambda *rows: spark.createDataFrame(list(rows), "key binary, value binary")
    assert [k for k, _ in out(V.merged([src((b"a", b"1"), (b"c", b"3")), src((b"b", b"2"), (b"d", b"4"))]))] == [b"a", b"b", b"c", b"d"]
    assert out(V.merged([src((b"k", b"oldest")), src((b"k", b"middle")), src((b"k", b"newest"))])) == [(b"k", b"newest")]
    assert out(V.merged([src((b"k", b"old")), src((b"k", b""))])) == []
    assert len(V.merged([src((b"k", b"old")), src((b"k", b""))], keep_deleted=True).collect()) == 1


def test_stats(spark):
    rows = spark.createDataFrame([("a", "11", False, 0, 0), ("b", "2", False, 1, 0), ("a", "3", False, 2, 0), ("b", None, True, 3, 0)], "key string, value string, tomb boolean, seq long, seg int")
    r = S.memtable_stats(rows).first()
    assert (r.entries, r.approximate_size) == (2, 3 + 2 + 2 + 1)
    f = S.footer_stats(S.segment_entries(rows)).first()
    assert (f.first_key, f.last_key, f.num_entries, f.data_len) == ("a", "b", 2, 4 + 2 + 4 + 1)


@pytest.mark.parametrize("n", [1, 16, 17, 33, 1000])
def test_sparse_index(spark, n):
    rows = spark.createDataFrame([(f"{i:05}", "v", 0) for i in range(n)], "key string, value string, seg int")
    index = S.sparse_index(rows)
    assert sorted((r.key, r.offset) for r in index.collect()) == [(f"{i:05}", i * 10) for i in range(0, n, 16)]
    assert S.index_seek(index, f"{n - 1:05}").first().offset == (n - 1) // 16 * 160
    assert S.index_seek(index, "").first().offset == 0


def test_freeze_boundaries_reset(spark):
    sizes = [3, 3, 5, 1, 9, 1]
    rows = spark.createDataFrame([(0, i, "k", "v" * (n - 1), False) for i, n in enumerate(sizes)], "stream int, seq long, key string, value string, tomb boolean")
    got = [(r.segment, r.first_seq, r.last_seq, r.bytes) for r in S.freeze_boundaries(rows, 6).orderBy("segment").collect()]
    assert got == [(0, 0, 1, 6), (1, 2, 3, 6), (2, 4, 4, 9), (3, 5, 5, 1)]


def seg(level, i, a, z, size=10, lo=0, hi=0):
    return C.Segment(level, i, a, z, 1, size, lo, hi, "")


def test_level_targets():
    assert C.level_targets(0, Config()) == [0, 2097, 20971, 209715, 2097152, 20971520, 209715200]
    assert C.base_level(C.level_targets(0, Config())) == 1
    assert C.base_level(C.level_targets(0, Config(base_level_bytes=1000))) == 3
    assert Config().max_level_files(2) == 400
    for bad in ({"level_multiplier": 0}, {"num_levels": 1}, {"max_l0_files": 0}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_policy():
    pick, cfg = C.Leveled().pick, Config()
    assert pick([], cfg) is None and pick([seg(0, i, b"a", b"b") for i in range(3)], cfg) is None
    task = pick([*(seg(0, i, bytes([97 + i]), bytes([98 + i])) for i in range(4)), seg(1, 9, b"c", b"x"), seg(1, 10, b"x", b"z")], cfg)
    assert task.level == 1 and {s.file_id for s in task.inputs} == {0, 1, 2, 3, 9}
    task = pick([seg(1, 5, b"a", b"c", 3000), seg(1, 4, b"d", b"f", 1), seg(2, 1, b"e", b"z"), seg(2, 2, b"a", b"b")], cfg)
    assert task.level == 2 and {s.file_id for s in task.inputs} == {4, 1}
    two = pick([seg(1, 1, b"a", b"b", 2 * 2097), seg(2, 2, b"a", b"b", 3 * 20971)], cfg)
    assert two.inputs[0].file_id == 2
    assert pick([seg(6, 1, b"a", b"b", 10**12)], cfg) is None


def test_deletions_stay_while_older_versions_may_exist():
    task = C.Task((seg(0, 1, b"a", b"m", lo=5, hi=6),), 1)
    assert not C.may_drop_deletions(task, [*task.inputs, seg(3, 2, b"k", b"z", lo=0, hi=1)])
    assert C.may_drop_deletions(task, [*task.inputs, seg(3, 2, b"n", b"z", lo=0, hi=1)])
    assert C.may_drop_deletions(task, [*task.inputs, seg(0, 2, b"a", b"z", lo=9, hi=9)])


def test_every_key_is_sought_in_every_file_by_batches(spark):
    """As the as-of join of all pairs, with files that begin late, keys before, between and behind, a null key, and many
    files; only index and keys are shuffled, not their pairs."""
    index = spark.createDataFrame([(f, k, o) for f in range(150) for o, k in enumerate([None, *(f"{i:03d}" for i in range(f, 300, 17))]) if o or f % 2], "seg int, key string, offset long")
    keys = spark.createDataFrame([(None,), *((f"{i:03d}",) for i in range(0, 300, 7)), ("",), ("zé",)], "key string")
    probes = index.select("seg").distinct().crossJoin(keys)
    got = S.index_seek_each(index, keys)
    assert got.columns == ["seg", "key", "offset"] and got.schema == S.index_seek_all(index, probes).schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, S.index_seek_all(index, probes).collect()))
    assert S.index_seek_each(index.where("false"), keys).count() == S.index_seek_each(index, keys.where("false")).count() == 0
    binary = S.index_seek_each(index.withColumn("key", F.col("key").cast("binary")), keys.select(F.col("key").cast("binary")))
    assert sorted(map(repr, binary.withColumn("key", F.col("key").cast("string")).collect())) == sorted(map(repr, got.collect()))


def test_seek_all_query_sorts_no_probes(spark):
    from sedimenta.plans import catalog

    plan = catalog.sst_index_seek_all(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 2  # the index's own
    assert "_side" not in plan
