"""Keyed load of a delivered table: rows that cannot be used are kept apart with a reason.

A delivery may hold columns in other types (ids as text or ``int``, times with a
zone, money as ``double``) and rows that came twice. Every column is cast to its
declared type where that loses nothing; rows with a value that does not fit,
without a required value, or beyond the first of their key go to the reject
table instead of failing the load. What is left has one row per key, so the
analyses' counts are those of ``COUNT(DISTINCT key)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.sources import store
from shopflow.sources.schema import KEYS, SCHEMAS, TEXT_ALLOWED

_EXACT = T.DecimalType(38, 18)


@dataclass
class Delivery:
    """``accepted`` in the declared columns; ``rejected``: table_name, reason, key, copies, row (as JSON)."""

    accepted: DataFrame
    rejected: DataFrame


def _wanted(have: T.DataType, f: T.StructField) -> T.DataType:
    return have if f.name in TEXT_ALLOWED and have == T.StringType() else f.dataType


def _fits(raw: Column, have: T.DataType, want: T.DataType) -> Column:
    """Whether the value is the same in the declared type."""
    value = raw.try_cast(want)
    if have == want or not isinstance(want, T.NumericType):
        return value.isNotNull()
    if isinstance(have, T.StringType) and isinstance(want, T.DecimalType):
        return F.coalesce(value == raw.try_cast(_EXACT), F.lit(False))
    if isinstance(have, T.NumericType):
        return F.coalesce(value.try_cast(have) == raw, F.lit(False))
    return value.isNotNull()


def _typed(stored: DataFrame, table: str) -> DataFrame:
    """The declared columns, ``_why`` (null for usable rows), ``_key`` and ``_row`` as they were delivered."""
    have = {f.name: f.dataType for f in stored.schema.fields}
    missing = [c for c in SCHEMAS[table].names if c not in have]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    why, columns = [], []
    for f in SCHEMAS[table].fields:
        raw, want = F.col(f"`{f.name}`"), _wanted(have[f.name], f)
        why.append(F.when(raw.isNotNull() & ~_fits(raw, have[f.name], want),
                          F.lit(f"{f.name} is not {want.simpleString()}")))
        if not f.nullable:
            why.append(F.when(raw.isNull(), F.lit(f"{f.name} is missing")))
        columns.append(raw.try_cast(want).alias(f.name))
    names = [F.col(f"`{c}`") for c in SCHEMAS[table].names]
    return stored.select(*columns, F.coalesce(*why).alias("_why"),
                         F.col(KEYS[table]).cast("string").alias("_key"), F.to_json(F.struct(*names)).alias("_row"))


def split(stored: DataFrame, table: str, keep=lambda name, factory: factory()) -> Delivery:
    """The usable rows of a delivered ``table``, one per key, and the others.

    Of rows with one key the least in column order stays, so the earliest where
    the table has a time. Rows equal to it are rejected as ``repeated row``,
    others as ``other row of the key``; equal rejected rows are one row with
    their number of ``copies``. A missing column is an error, not a reject; an
    empty table gives two empty ones; columns that are not declared are left out.

    Only the repeated keys are shuffled in whole rows: ``keep(name, factory)``
    may write them (and the results) down.
    """
    key, names = KEYS[table], SCHEMAS[table].names
    rest = [c for c in names if c != key]
    typed = _typed(stored, table)
    good = typed.where("_why IS NULL").select(*names)
    again = keep("repeated", lambda: good.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key))
    rows = good.join(again, key, "left_semi").groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))
    first = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_first"))
    accepted = keep("accepted", lambda: good.join(again, key, "left_anti").unionByName(
        first.select(key, *[F.col(f"_first.{c}").alias(c) for c in rest])).select(*names))

    stays = F.col("_first").eqNullSafe(F.struct(*rest))
    later = (rows.join(first, key).select(
        F.when(stays, "repeated row").otherwise("other row of the key").alias("reason"),
        F.col(key).cast("string").alias("key"), (F.col("copies") - stays.cast("int")).alias("copies"),
        F.to_json(F.struct(*names)).alias("row")).where("copies > 0"))
    unfit = (typed.where("_why IS NOT NULL").groupBy(F.col("_why").alias("reason"), F.col("_key").alias("key"),
                                                     F.col("_row").alias("row"))
             .agg(F.count(F.lit(1)).alias("copies")))
    rejected = keep("rejected", lambda: unfit.unionByName(later).select(
        F.lit(table).alias("table_name"), "reason", "key", "copies", "row"))
    return Delivery(accepted, rejected)


def load(spark: SparkSession, path: str, table: str, materialize: bool = True) -> Delivery:
    """The delivery at ``path``, split once per state of its files and session time zone and written down."""
    stored = spark.read.parquet(path)
    if not materialize:
        return split(stored, table)
    zone = spark.conf.get("spark.sql.session.timeZone").replace("/", "_")
    signature = f"{store.input_signature(spark, [path])}-{zone}"
    time = "created_at" if "created_at" in SCHEMAS[table].names else None
    size = store.input_size(spark, path)
    return split(stored, table, lambda name, factory: store.materialize(
        spark, factory, f"{table}_{name}", signature, cluster_by=time if name == "accepted" else None, input_bytes=size))
