"""A corpus pipeline: each stage reads what its predecessor kept, as a Parquet table in the shared folder.

Stages take (spark, docs, sf_dir). All but the last return the columns of docs; n_chars, where it is there, follows the
text. Columns whatever their names travel in one struct beside what an operator adds.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyx.llm import bpe, langid, packing, pii, simhash, substring
from canopyx.llm.common import discard, materialize

#: Documents whose most likely language has a lower posterior go.
MIN_POSTERIOR = 0.5


def _carried(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text").alias("text"), *more)


def _with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs out of _row, with the text from column _new."""
    own = {"text": F.col("_new")} | ({"n_chars": F.length("_new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*(own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (null and empty ones too), or of no clear language, go. Where no row has a language, only texts
    without a letter go. Ids are not looked at; repeated rows each stay or go alike."""
    model = langid.train(docs, langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    if not model[0]:  # nothing was learned: one language that takes every word
        model = ["any"], model[1], np.full((len(model[1]), 1), 1 / max(1, len(model[1]))), np.zeros(1)
    found = langid.predict(_carried(docs), model, keep=("_row",))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_POSTERIOR))
    return kept.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose five-word shingles have a similarity of 0.8 or more stays: the one with the
    smallest id, null ids last, then by the text's hash. Ids need be neither unique nor there: rows have keys of their own.
    Null and empty texts are one group. Equal rows are one group; which of them stays makes no difference."""
    rows = materialize(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")).withColumn("_key", F.monotonically_increasing_id()), "keyed")
    found = simhash.similar(rows.select("_key", F.col("_row.text").alias("text")), key="_key")
    order = F.struct(F.col("_row.doc_id").isNull(), F.col("_row.doc_id"), F.xxhash64("_row.text"), F.col("_key").alias("key"))
    first = rows.select("_key", order.alias("_order")).join(found, F.col("_key") == F.col("key")).groupBy("component_id").agg(F.min("_order").alias("_first"))
    kept = rows.join(first.select(F.col("_first.key").alias("_kept")), F.col("_key") == F.col("_kept"), "left_semi")
    return kept.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of 13 words go; texts that lose none stay as they are (null too), others have their words joined by
    spaces. A null id counts as larger than any other; rows under one id keep what they share with each other."""
    found = substring.remove_repeats(_carried(docs, "doc_id"), keep=("_row",))
    text = F.when(F.col("n_removed") == 0, F.col("_row.text")).otherwise(F.col("kept").cast("string"))
    return _with_text(found.withColumn("_new", text), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind. Null texts stay null; every row stays."""
    found = pii.find(_carried(docs), keep=("_row",), masked=True)
    return _with_text(found.withColumn("_new", F.when(F.col("_row.text").isNotNull(), F.col("masked"))), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and place. Null texts are one piece with the end id alone; rows
    with equal or null ids are packed each for itself. An empty table gives an empty result."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.readlines())
    return packing.pack_documents(docs, ranks, public_tokenizers.PATTERN, added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: The stages' models and tokenizers are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before:  # a stage's table goes once its successor's is written
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
