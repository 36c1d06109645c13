"""A corpus pipeline of five stages: language, near-duplicates, personal data, source mix, pieces."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorehouse.llm import langid, mixing, neardup, pieces, pii
from lorehouse.llm.common import discard, settled

#: A text whose score against its nearest language profile is lower has no known language.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predict each document's language; those without one (no letters, a null text, or unlike all profiles) go.

    Labels of all rows but the held-out third teach the profiles; without any labels no language is known and all go.
    Rows alike get the same answer. An empty table gives an empty one.
    """
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest id.

    Of rows alike in id any one stays, also where their ids are null; documents without words are in no class and stay.
    """
    return neardup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Marks take the place of personal data; n_chars follows. All rows stay, null texts too; rows alike stay alike."""
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get their target weights: a document is left out, or taken once or twice.

    A null source is one of its own; rows with one id and source, or with null ids, are taken alike; documents without
    words are taken like others of their hash; sources without words are not taken. An empty table gives an empty one.
    """
    sized, bounds = mixing.plan(docs)
    discard(sized)
    rows = docs.select(F.struct(docs.columns).alias("row"))
    taken = mixing.take(rows, bounds, F.col("row.source"), mixing.row_hash(F.col("row.doc_id"))).where("times > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each document, and whether decoding gives the text back; a null text counts as empty. Copies of a row are segmented alike."""
    out = pieces.encode(docs.select("doc_id", "lang", "source", "text"), check=True)
    return out.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "lossless")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("encode", encode)]

#: The stages are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's result is written and read again for the next, and deleted once that is written, with all that was written on the way."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, before = settled(partial(stage, spark, docs, sf_dir)), docs
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
