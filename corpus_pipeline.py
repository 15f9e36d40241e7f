"""The training-data pipeline: five stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import bpe, exact_dedup, jaccard, langid, mixing
from siftwork.llm.queries import RANKS
from siftwork.llm.scratch import free_name, kept

#: Documents whose language is less certain than this are rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or of uncertain language; a language that is not known is filled in.

    Predictions come beside all columns of their row, so nothing is joined and rows that repeat a doc_id keep their own.
    """
    told, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    rows = langid.predict(docs, langid.train(docs), names=(told, score), carry=True).where((F.col(told) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return rows.select(*[F.coalesce("lang", told).alias("lang") if c == "lang" else c for c in docs.columns])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their five-word shingles the one with the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.mixed_texts(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document as a count and digests, and the digest of the text that they decode to."""
    out = bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("source_mix", source_mix),
    ("byte_bpe", tokens),
]
#: SQL cannot express the language model and the byte-pair encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = kept(docs, name)
    return docs
