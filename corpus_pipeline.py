"""From raw documents to token ids in five stages.

Each stage takes the documents that the one before kept, and returns documents
(the last one: their ids). ``run`` writes each stage's result as Parquet in the
shared checkpoint folder and reads it again for the next; what it wrote before
is deleted once a later stage's result stands.

Defined results, of all stages: an empty table gives an empty one; texts of any
length are taken whole; columns other than those of documents aren't returned,
whatever their names. Each stage states what becomes of nulls, ties and repeated
rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, near_dedup, quality_rules, secrets
from millrace.llm.text import documents, drop, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now is."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the current policy, as they are.

    A null or empty text has no words and goes; rows without a key are judged by their text; repeated rows are judged alike, and all stay or go.
    """
    return quality_rules.quality_rules(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more: the one of least doc_id.

    Of rows of one doc_id that of the least text stays, and of rows without doc_id and of one text, one. Texts without words are like no other and stay.
    """
    return near_dedup.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every stretch of secrets replaced by a mark, and n_chars as the text now is; null texts stay null, with null n_chars."""
    found = secrets.scan(docs)
    return _documents(found.withColumn("text", secrets.redact(F.col("text"), F.col("secret_spans"))))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, and n_chars as the text now is.

    A shard (about 512 documents of a source) may cut one document after some of its words. Null and empty texts take no words
    and go; rows without a source are a source of their own; repeated rows are documents of their own.
    """
    return _documents(mixing.materialize(mixing.mix(docs)))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document, in no order; a null text has no ids, repeated rows have equal ones."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.drop("text")


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mix),
    ("bpe_encode", token_ids),
]
#: Near-duplicate groups and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs)
            if before is not None:
                drop(before)
            before = docs
    return docs
