"""Corpus pipeline over ``documents``: toxicity, near duplicates, repeated passages, leaks, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. Null texts pass
through as they are; extra columns of ``docs`` are kept; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, ngram_join, pieces_bpe, suffix_dedup, toxicity
from panelwright.llm.queries import PIECE_MODEL, table
from panelwright.llm.store import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=toxicity.fold(F.col("doc_id")) != 0)
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id."""
    return ngram_join.one_of_each(docs).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that occur elsewhere; characters stay whole."""
    kept = suffix_dedup.without_repeats(docs)
    text = F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.col("kept_text"))
    replaced = kept.withColumn("text", text)
    if "n_chars" in docs.columns:
        replaced = replaced.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return replaced.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    found = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"), out="_leaks")
    return found.where(F.size("_leaks") == 0).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text with an end id, their number, and the text they decode to."""
    vocabulary = pieces_bpe.Vocabulary.load(PIECE_MODEL)
    coded = pieces_bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), vocabulary)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("sentencepiece", encode_texts),
]
#: Compression, suffix arrays and byte-pair merging have no SQL form; tests compare with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each result stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
