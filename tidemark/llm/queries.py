"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, langid, lines, lm, media, neardup, packing, quality, warc
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


TWO_WORDS = neardup.Near(words=2)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), how=TWO_WORDS)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_verdicts(table(spark, sf_dir, "documents"), with_text=False)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.vectors_as_recordings(table(spark, sf_dir, "embeddings"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.neighbours(table(spark, sf_dir, "conversations"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality_rules": op3_quality_rules,
    "op4_bpe": op4_bpe,
    "op5_media": op5_media,
    "op6_language": op6_language,
    "op7_chat": op7_chat,
    "op8_packing": op8_packing,
    "op9_language_model": op9_language_model,
    "op10_quality": op10_quality,
}

ORACLES = {
    "op7_chat": chat.ORACLE,
    "op1_warc": warc.ORACLE,
    "op2_near_duplicates": neardup.oracle_sql(TWO_WORDS),
    "op3_quality_rules": lines.oracle_sql(),
}
