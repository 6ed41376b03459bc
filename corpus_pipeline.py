"""A corpus from raw documents to token ids, as a chain of the numbered operators.

Every stage takes all that the one before kept and returns the columns of documents, the last one
token counts and digests. Stages are written and read again, so a lost executor costs no more than
its own stage's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievewright.llm import bpe, langid, line_dedup, mixing, ngram_join
from sievewright.llm.queries import vocabulary
from sievewright.session import settled

ORACLE_SQL = None       # a trained network, hashed draws and merge rounds are beyond SQL; tests compare each stage with brute force


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter; null texts and texts without one go.

    The network names the language but its score rejects nothing: a text with a single letter stays. Only a
    language that the training rows themselves call `und` is rejected with the unknown. When no
    language could be learned, every text with a letter passes.
    """
    net = langid.train(docs.where(langid.fold() != 1))
    if not net.languages:
        return langid.with_letters(docs)
    return langid.predict(docs, net, lang_out="__lang", score_out="__score").where(
        F.col("__lang") != langid.UNKNOWN).select(docs.columns)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut; a document of which nothing is left goes."""
    cut = line_dedup.dedup_lines(docs)
    left = cut.where("NOT (__n_removed > 0 AND __n_removed = __n_lines)")
    length = F.when(F.col("__n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", length).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest id stays (repeated rows stay together); other texts of a removed row's id stay."""
    found = ngram_join.keyed_groups(docs).where("doc_id <> class_id")
    gone = found.select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__key")).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col("__gone")) & (F.xxhash64("text") == F.col("__key")), "left_anti")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document as often as its source's share takes it."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.round_trip_digests(docs, vocabulary())


STAGES = [("language", known_language), ("lines", unique_lines), ("near_duplicates", one_of_each_group),
          ("mix", mixed_sources), ("tokens", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
