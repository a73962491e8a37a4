"""The corpus pipeline: language, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the documents that
stay, with their columns; the last returns the pieces of the packed windows.

Every stage takes any table with the columns doc_id, text and lang, whatever others there are, nulls in any of them included; an
empty table gives an empty result. Rows that repeat others are judged alike, and the near-duplicate stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, lines, neardup, packing
from tidemark.llm.common import stored, table
from tidemark.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages, with a score of one half at least: it outweighs all others together.

    Predicted language and score can't be carried along, as the columns stay those of documents. Null and empty texts and texts without a
    letter go. Where no row has a language to learn from, all documents with a letter stay."""
    return langid.known_language(docs, langid.train(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail them; n_chars is counted anew. Null and empty texts go."""
    return lines.clean_documents(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: shingles of five words, similarity 0.8.

    Of rows that share an id one stays; rows with a null id and texts without words are in no group and stay."""
    return neardup.first_of_each(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed; a null or empty text is the end id alone, repeated rows are packed each."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("packing", pack_windows),
]

# a learned classifier and a heuristic packing are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
