"""The registered queries of the operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import chat, decontam, idcodec, langid, media, neardup, packing, passages, sharding, textkit, tokencount
from sedimenta.llm.shared import documents, stored, workspace
from sedimenta.llm.sql import ORACLE_SQL


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(media.media_of(documents(spark, sf_dir, "embeddings")))


def op2_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = idcodec.write(documents(spark, sf_dir), end=2)
    return idcodec.read(spark, path, idcodec.ids_crc32, "long").withColumnRenamed("ids", "ids_crc32")


def op3_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op4_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    with workspace(spark):
        return stored(passages.repeated_passages(documents(spark, sf_dir)), "repeated", keep=True)


def op5_family_svm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = langid.held_out("doc_id")
    model = langid.train(docs, ~out)
    return langid.identify(docs.select("doc_id", "text", out.alias("held_out")), model, ["doc_id", "held_out"])


def op6_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir))


def op7_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), cap=2048, end=0)


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op9_preference_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.reply_segments(documents(spark, sf_dir, "conversations"))


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), k=3, num=85, bands=32, rows=6, table=textkit.SPACED)

OPERATORS = (
    op1_image_copies,
    op2_huffman_ids,
    op3_winnowing_decontamination,
    op4_chained_passages,
    op5_family_svm_language,
    op6_pretoken_counts,
    op7_exact_complement_packing,
    op8_hilbert_shards,
    op9_preference_segments,
    op10_superminhash,
)
QUERIES = {f.__name__: f for f in OPERATORS}

__all__ = ["ORACLE_SQL", "QUERIES"]
