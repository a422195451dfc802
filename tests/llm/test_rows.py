import zlib

import numpy as np
from fixtures import documents, texts

from sedimenta.llm import chat, langid, sharding

LANGS = {
    "en": "the quick brown fox jumps over the lazy dog and then it runs through the old town with other animals",
    "de": "der schnelle braune fuchs springt über den faulen hund und läuft dann durch die alte stadt mit anderen",
    "fr": "le renard brun rapide saute par dessus le chien paresseux et court ensuite dans la vieille ville",
    "es": "el rápido zorro marrón salta sobre el perro perezoso y luego corre por la ciudad vieja con otros",
}


def test_language(spark):
    rng, rows = np.random.default_rng(0), []
    for i in range(200):
        lang = list(LANGS)[i % 4]
        rows.append((i, " ".join(rng.choice(LANGS[lang].split(), 25)), lang if i % 7 else None))
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "日本", None), (None, "the dog runs", None)]
    df = spark.createDataFrame([(i, t, n, 5, "old") for i, t, n in rows], "doc_id long, text string, lang string, score int, lang_pred string")
    model = langid.train(df, ~langid.held_out("doc_id"))
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i].lang_pred == list(LANGS)[i % 4] for i in range(200)]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901)] == ["und", "und"] and got[902].lang_pred != "und"
    assert langid.train(df.where("false"), ~langid.held_out("doc_id")) is None
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}
    one = langid.identify(df, langid.train(df.where("lang = 'en'"), ~langid.held_out("doc_id"))).where("lang_pred <> 'und'")
    assert {(r.lang_pred, r.score) for r in one.collect()} == {("en", 1.0)}
    odd = [(1, "政府今天早上宣布新的措施将在下个月底之前提交给议会" * 3), (2, "QWxhZGRpbjpvcGVuIHNlc2FtZQ0K" * 8), (3, "правительство сообщило что новые меры будут представлены " * 3)]
    assert all(r.typical < 0.75 for r in langid.identify(spark.createDataFrame(odd, "doc_id long, text string"), model).collect())
    assert all(got[i].typical > 0.9 for i in range(200)) and got[900].typical == got[901].typical == 0
    assert langid.identify(df.where("false"), model).count() == 0
    again = langid.identify(df.where("doc_id = 3").union(df.where("doc_id = 3")), model).collect()
    assert len(again) == 2 and again[0] == again[1] == got[3]
    long = spark.createDataFrame([(1, LANGS["de"] * 20_000)], "doc_id long, text string")
    assert langid.identify(long, model).first().lang_pred == "de"
    held = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out("doc_id").alias("h")).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(200)) and held[None] is False


def test_hilbert_is_a_walk():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        h = sharding.hilbert(cells, bits)
        assert sorted(h) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(h)], axis=0)).sum(1) == 1).all()


def test_shards(spark, tmp_path):
    rows = list(enumerate(texts())) + [(None, "x"), (3, "again"), (3, "again")]
    for own in (rows, rows[:5], []):
        got = sharding.shard(documents(spark, own)).collect()
        assert len(got) == len(own)
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        sizes = [len(by.get(i, ())) for i in range(8)]
        assert max(sizes) - min(sizes) <= 1
        want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in own)
        assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    docs = documents(spark)
    sharding.write(docs, sharding.shard(docs), f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == docs.count()


def test_shards_prune_in_every_dimension(spark):
    """A value of any dimension lies between the ends of fewer shards than all."""
    rng = np.random.default_rng(4)
    rows = [(int(i), "x" * int(rng.integers(1, 3000)), f"l{rng.integers(0, 8)}", f"s{rng.integers(0, 8)}") for i in rng.permutation(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    shard = {r.doc_id: r.shard for r in sharding.shard(docs, shards=64).collect()}
    for value in (lambda r: r[0], lambda r: len(r[1]), lambda r: r[2], lambda r: r[3]):
        ends = {}
        for r in rows:
            a, z = ends.get(shard[r[0]], (value(r), value(r)))
            ends[shard[r[0]]] = min(a, value(r)), max(z, value(r))
        read = np.mean([sum(a <= value(r) <= z for a, z in ends.values()) for r in rows[:200]])
        assert read < 0.75 * 64, read


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "pair_id long, turn long, role string, text string, part string, pos int")


def brute_segments(a, b):
    out = []
    key = lambda r: tuple((x is not None, x) for x in r[1:])
    for p in sorted({r[0] for r in a + b if r[0] is not None}):
        x, y = (sorted((r for r in s if r[0] == p), key=key) for s in (a, b))
        n = 0
        while n < min(len(x), len(y)) and x[n][2:] == y[n][2:]:
            n += 1
        for part, own, first in (("prompt", x[:n], 1), ("chosen", x[n:], n + 1), ("rejected", y[n:], n + 1)):
            at = 0
            for i, (_, _, role, text) in enumerate(own):
                seg = f"<|turn|>{(role or '').replace('<|', '< |')}\n{(text or '').replace('<|', '< |')}<|end|>\n"
                out.append((p, part, first + i, role, seg, part != "prompt" and role == "assistant", at))
                at += len(seg)
    return sorted(out, key=lambda r: r[:3])


def test_preferences(spark):
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "q"), (3, 0, "user", None), (3, 1, None, "x"), (4, 1, "user", "tie"), (4, 1, "user", "tie"), (4, 1, "assistant", "a<|end|>b"), (None, 0, "user", "lost"), (5, None, "user", "é"), (5, 2, "assistant", "")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "more"), (3, 7, "user", None), (3, 9, None, "y"), (4, 0, "assistant", "a<|end|>b"), (4, 1, "user", "tie"), (6, 0, "assistant", "only here"), (5, 0, "user", "é"), (5, 1, "assistant", "")]
    got = chat.preference_segments(turns(spark, a), turns(spark, b)).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[:3]) == brute_segments(a, b)
    assert chat.preference_segments(turns(spark, []), turns(spark, [])).count() == 0


def test_reply_pairs(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "after"), (2, 0, "user", "c"), (2, 1, "assistant", "d"), (4, 0, "user", "alone"), (7, None, "user", "x"), (7, 3, "assistant", None), (None, 0, "assistant", "y")]
    long = [(8, i, "user" if i % 2 == 0 else "assistant", "t" * i) for i in range(3000)]  # the last turn differs
    df = spark.createDataFrame(rows + long, "conv_id long, turn long, role string, text string")
    chosen = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "assistant", "d"), (7, None, "user", "x"), (7, 3, "assistant", None), *long]
    rejected = [(1, 0, "user", "a"), (1, 1, "assistant", "d"), (7, None, "user", "x"), (7, 3, "assistant", long[-1][3])]
    out = chat.reply_segments(df)
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[:3]) == brute_segments(chosen, rejected)
    plan = chat.reply_segments(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("EvalPython", "MapIn", "PythonUDF", "InPandas")) and plan.count("Exchange hashpartitioning") <= 3
    assert chat.reply_segments(df.where("false")).count() == 0


