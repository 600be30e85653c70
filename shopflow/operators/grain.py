"""Session-grain facts: the base of most analyses.

Orders are reduced to one row per session (Spark pre-aggregates them on the
map side) and left-joined to sessions once. Counting sessions is then a row
count and counting distinct orders a sum of per-session order counts (an
order belongs to one session), so the analyses need no ``COUNT(DISTINCT)``
and Spark plans no ``Expand`` that would copy each row once per distinct
expression.

This needs unique session and order ids: ``ShopTables.facts`` checks both
when it builds the facts, ``ShopTables.check_keys`` all five tables. A row
delivered twice would be counted twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SESSION_COLUMNS = ["website_session_id", "created_at", "user_id", "is_repeat_session",
                   "utm_source", "utm_campaign", "device_type", "http_referer"]


def orders_per_session(orders: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """One row per session with orders: ``n_orders``, ``revenue``, ``items``."""
    return (orders.filter(F.col("website_session_id").isNotNull())
            .groupBy("website_session_id")
            .agg(F.count("order_id").alias("n_orders"),
                 F.sum("price_usd").alias("revenue"),
                 F.sum("items_purchased").alias("items"),
                 *(extra or [])))


def session_facts(sessions: DataFrame, orders: DataFrame,
                  extra: list[Column] | None = None) -> DataFrame:
    """Sessions with ``n_orders`` (0 when none), ``revenue`` and ``items`` (NULL when none)."""
    per = orders_per_session(orders, extra)
    return (sessions.select(*SESSION_COLUMNS)
            .join(per, "website_session_id", "left")
            .withColumn("n_orders", F.coalesce("n_orders", F.lit(0)).cast("long")))


def has_order() -> Column:
    return F.col("n_orders") > 0


def count_sessions(cond: Column | None = None) -> Column:
    """Sessions meeting ``cond`` (at session grain a distinct count is a count)."""
    return F.count(F.lit(1)) if cond is None else F.count_if(cond)


def count_orders(cond: Column | None = None) -> Column:
    """Distinct orders of the sessions meeting ``cond``."""
    n = F.col("n_orders") if cond is None else F.when(cond, F.col("n_orders")).otherwise(0)
    return F.sum(n).cast("long")


def sum_revenue(cond: Column | None = None) -> Column:
    r = F.col("revenue") if cond is None else F.when(cond, F.col("revenue"))
    return F.sum(r).cast("double")
