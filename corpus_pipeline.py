"""Preparing a text corpus: language, exact copies, near copies, benchmark leaks, token ids.

Each stage takes (spark, docs, folder) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm import decontaminate, exact_dedup, language_cnn, piece_codec, signature_join
from shopflow.llm.registry import table, vocabulary
from shopflow.llm.sampling import not_held_out
from shopflow.llm.staging import stage


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a letter, however sure the language; all with a letter if no row has a lang to learn from."""
    return language_cnn.keep_identified(docs, language_cnn.fit(docs, not_held_out()))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts (up to runs of white space) the one with the least doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 on five-word shingles the one with the least doc_id."""
    return signature_join.keep_one_of_each(docs, words=5, numerator=8, denominator=10)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, folder, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Piece ids and the text they decode to."""
    coded = piece_codec.encode_decode(docs, vocabulary("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]

#: Language identification and the codec cannot be said in SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, folder, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
