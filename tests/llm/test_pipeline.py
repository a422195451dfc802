import os
import random

from fixtures import documents, prose

import corpus_pipeline
from sedimenta.llm.shared import stored
from sedimenta.session import scratch_dir


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    own = lambda n: " ".join(f"{rng.choice(['river', 'stone', 'cloud', 'window'])}{rng.randrange(10**6)}" for _ in range(n))
    item, passage = prose(rng, 30), own(60)
    base = own(120)
    near = base.split(" ")
    near[50] = "changed"
    rows = [(i, own(80)) for i in range(12)] + [(20, base), (21, base), (22, " ".join(near)), (30, own(80) + " " + passage), (31, passage + " " + own(80)), (40, own(80) + " " + item), (50, "123 456"), (51, None)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = documents(spark, rows), {}
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "pack" or docs.columns == cols
    assert set(seen["language"]) == {i for i, _ in rows} - {50, 51}
    assert set(seen["near_dedup"]) == set(seen["language"]) - {21, 22}
    cut = seen["substring_dedup"]
    assert set(cut) == set(seen["near_dedup"]) and passage in cut[30].text and passage[:200] not in cut[31].text
    assert all(cut[i].text == t for i, t in rows if i < 12)
    assert set(seen["decontaminate"]) == set(cut) - {40}
    assert set(seen["pack"]) == set(seen["decontaminate"])
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    tables = f"{scratch_dir(spark)}/tables"
    before = set(os.listdir(tables))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == set(seen["pack"])
    left = {x.rpartition("-")[0] for x in set(os.listdir(tables)) - before}
    assert left == {"language", "near_dedup", "substring_dedup", "decontaminate", "pieces"}


def test_stages_leave_what_they_decide(spark, tmp_path):
    """Also outside of run(): a stage's own tables go, but for the ids or passages that its result reads."""
    rng = random.Random(9)
    spark.createDataFrame([(1, prose(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [(i, prose(rng, 90)) for i in range(12)])
    tables = f"{scratch_dir(spark)}/tables"
    for stage, name in ((corpus_pipeline.near_dedup, "copies"), (corpus_pipeline.substring_dedup, "repeated"), (corpus_pipeline.decontaminate, "contaminated")):
        before = set(os.listdir(tables))
        assert stage(spark, docs, str(tmp_path)).count() == 12
        assert [x.rpartition("-")[0] for x in set(os.listdir(tables)) - before] == [name]


def test_language_goes_by_likeness(spark, tmp_path):
    """Texts of scripts that no labelled row has go; columns named like the judgement's stay as they are."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 60)) for i in range(60)] + [(70, "правительство сообщило что новые меры будут представлены " * 5), (72, "政府今天早上宣布新的措施" * 12)]
    docs = documents(spark, rows).selectExpr("*", "doc_id * 2 AS score", "'mine' AS lang_pred", "'own' AS typical")
    docs = docs.drop("lang").selectExpr("*", "CASE WHEN doc_id < 60 THEN 'en' END AS lang").select(*docs.columns)
    got = {r.doc_id: r for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert set(got) == set(range(60))
    assert all((r.score, r.lang_pred, r.typical) == (2 * i, "mine", "own") for i, r in got.items())


def test_odd_tables(spark, tmp_path):
    """Empty, and one with nulls, empties, repeated rows and a very long text."""
    rng = random.Random(3)
    spark.createDataFrame([(1, prose(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = lambda n: " ".join(f"stone{rng.randrange(10**7)}" for _ in range(n))
    text = own(60)
    for rows, want in (([], set()), ([(1, None), (2, ""), (3, text), (3, text), (4, own(60_000)), (None, own(20))], {3, 4, None})):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, str(tmp_path)), name)
        assert {r.doc_id for r in docs.collect()} == want
