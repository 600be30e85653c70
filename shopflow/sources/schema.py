"""Schemas of the five base tables the analyses read.

Types follow the columns' use in the analyses: integer keys as ``long``,
0/1 flags as ``int``, money as ``decimal(18,2)``, event times as
``timestamp_ntz`` (wall-clock times without a zone).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

WEBSITE_SESSIONS = T.StructType([
    T.StructField("website_session_id", T.LongType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("is_repeat_session", T.IntegerType(), True),
    T.StructField("utm_source", T.StringType(), True),
    T.StructField("utm_campaign", T.StringType(), True),
    T.StructField("device_type", T.StringType(), True),
    T.StructField("http_referer", T.StringType(), True),
])

WEBSITE_PAGEVIEWS = T.StructType([
    T.StructField("website_pageview_id", T.LongType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("website_session_id", T.LongType(), False),
    T.StructField("pageview_url", T.StringType(), True),
])

ORDERS = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("website_session_id", T.LongType(), True),
    T.StructField("primary_product_id", T.LongType(), True),
    T.StructField("items_purchased", T.IntegerType(), True),
    T.StructField("price_usd", MONEY, True),
    T.StructField("cogs_usd", MONEY, True),
])

ORDER_ITEMS = T.StructType([
    T.StructField("order_item_id", T.LongType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("order_id", T.LongType(), False),
    T.StructField("product_id", T.LongType(), True),
    T.StructField("is_primary_item", T.IntegerType(), True),
    T.StructField("price_usd", MONEY, True),
    T.StructField("cogs_usd", MONEY, True),
])

ORDER_ITEM_REFUNDS = T.StructType([
    T.StructField("order_item_id", T.LongType(), False),
    T.StructField("order_id", T.LongType(), True),
])

SCHEMAS = {
    "website_sessions": WEBSITE_SESSIONS,
    "website_pageviews": WEBSITE_PAGEVIEWS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "order_item_refunds": ORDER_ITEM_REFUNDS,
}

#: Product ids are opaque keys: a shop may name its products by text.
TEXT_ALLOWED = {"product_id", "primary_product_id"}


def check_columns(df: DataFrame, table: str) -> DataFrame:
    """Fail early when a table lacks a column its analyses read, or has it in another type."""
    want = {f.name: f.dataType for f in SCHEMAS[table].fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in want if c not in have]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    wrong = [c for c, t in want.items()
             if have[c] != t and not (c in TEXT_ALLOWED and have[c] == T.StringType())]
    if wrong:
        raise TypeError(f"{table}: columns {wrong} have types "
                        f"{[have[c].simpleString() for c in wrong]}, expected "
                        f"{[want[c].simpleString() for c in wrong]}")
    return df


KEYS = {
    "website_sessions": "website_session_id",
    "website_pageviews": "website_pageview_id",
    "orders": "order_id",
    "order_items": "order_item_id",
    "order_item_refunds": "order_item_id",
}


def check_unique(df: DataFrame, table: str) -> DataFrame:
    """Raise when a key repeats (a row delivered twice): the analyses count rows at key grain."""
    key = KEYS[table]
    again = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key).take(3)
    if again:
        raise ValueError(f"{table}: {key} repeats, e.g. {[r[0] for r in again]}")
    return df


def read_table(spark, path: str, table: str) -> DataFrame:
    """Read a Parquet base table whose files have the declared columns and types.

    The files' own schema is checked first: Spark would fill a column that
    the files lack with NULL.
    """
    stored = check_columns(spark.read.parquet(path), table)
    return stored.select(*SCHEMAS[table].names)
