"""Bounded samples of labelled rows for fitting classifiers, and the fold rule of the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_held_out(doc_id: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


def bounded_sample(rows: DataFrame, size: int) -> DataFrame:
    """At most ``size`` rows with distinct ids: those of least id hash, whatever the file order.

    Ids that repeat around the cut may add rows; twice ``size`` is the firm bound.
    """
    rank = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    ranks = rows.select(rank.alias("rank"))
    if ranks.count() <= size:
        return rows
    cut = ranks.orderBy("rank").limit(size).agg(F.max("rank")).first()[0]
    return rows.where(rank <= cut).limit(2 * size)
