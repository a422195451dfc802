"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, packing.

Stages take (spark, docs, sf_dir); docs has the columns of documents, and so has what every stage but
the last returns. An empty table gives an empty one. Rows without an id stay up to packing: they are in no
group, hold no passage and are no copy; their contamination isn't asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import decontam, langid, neardup, packing, passages
from sedimenta.llm.shared import documents, stored, workspace

LEAST_TYPICAL = 0.5
"""Texts whose nearness to a learned language is a smaller multiple of the least that labelled ones of their size have are of none."""


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; without letters, or unlike all of them, they go,
    and so do null and empty texts. Repeated rows are judged alike."""
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no column's name clashes with the judgement's
    at = {name: f"c{docs.columns.index(name)}" for name in ("doc_id", "text", "lang")}
    model = langid.train(rows, F.lit(True), at["doc_id"], at["text"], at["lang"])
    judged = langid.identify(rows, model, text_col=at["text"])
    kept = judged.where(F.col("lang_pred") != "und").where(F.col("typical") >= LEAST_TYPICAL)
    return kept.select(*rows.columns).toDF(*docs.columns)


def _settled(spark: SparkSession, find: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of find(), stored: what a stage decides, not its documents. The tables made on the way are removed."""
    with workspace(spark):
        return stored(find(), name, keep=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id. Null, empty and
    wordless texts are near nothing and stay; all rows of an id that stays stay."""
    gone = _settled(spark, lambda: neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of at least 50 words that an earlier one has. A document of
    nothing else goes; null texts stay, and rows of one id are cut alike."""
    found = _settled(spark, lambda: passages.repeated_passages(docs), "repeated")
    return passages.without_passages(docs, found).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no 8-word window of a benchmark item. Null and wordless texts hold none
    and stay; all rows of an id go if one does."""
    find = lambda: decontam.contamination(docs, documents(spark, sf_dir, "benchmark"), least_items=1)
    gone = _settled(spark, lambda: find().where("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens. A null text is its end token; repeated rows are
    packed as often as they come."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage stored for itself is removed once its result is written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with workspace(spark):
            docs = stored(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
