"""Build the five web-shop tables from the generic test tables.

Clickstream (``events``): a user's events split into sessions where the gap
to the previous event is more than ``gap`` (a gap of exactly ``gap`` stays
in the session); page views are the events, web orders the ``purchase``
events. Traffic-source columns are made from the integer ``k`` in
``props`` by the fixed rules below; they exercise the analyses and say
nothing about real channels.

Commerce (``orders``, ``lineitem``, ``part``): items are line items,
products are part types, refunds are returned items.

Sessionisation is the heaviest step and must not put one busy user into a
single task, so the ordered pass runs per (user, time split): the previous
event and the open session crossing a split boundary come from a one-row
per (user, split) summary, which stays small whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.sources.schema import MONEY

# fixed values: referer URLs and the k thresholds of the fixture rules
GSEARCH_URL = "https://www.gsearch.com"
BSEARCH_URL = "https://www.bsearch.com"
SOCIALBOOK_URL = "https://www.socialbook.com"


def _k() -> Column:
    return F.col("k")


def utm_source(k: Column) -> Column:
    return (F.when(k < 50, "gsearch").when(k < 70, "bsearch")
            .when(k < 75, "socialbook"))


def utm_campaign(k: Column) -> Column:
    return (F.when(k < 70, F.when(k % 5 == 0, "brand").otherwise("nonbrand"))
            .when(k < 75, "pilot"))


def device_type(k: Column) -> Column:
    return F.when(k % 3 == 0, "mobile").otherwise("desktop")


def http_referer(k: Column) -> Column:
    return (F.when(k < 50, GSEARCH_URL).when(k < 70, BSEARCH_URL)
            .when(k < 75, SOCIALBOOK_URL).when(k < 82, GSEARCH_URL)
            .when(k < 88, BSEARCH_URL))


def tag_sessions(events: DataFrame, gap: str = "12 hours",
                 split_hours: int = 24) -> DataFrame:
    """Events with ``website_session_id``, ``is_start`` and ``is_first``.

    Order inside a user is (``ts``, ``event_id``). ``website_session_id`` is
    the ``event_id`` of the session's first event. An event without a user is
    a new visitor's session of its own. Work is partitioned by
    (``user_id``, ``split``), where ``split`` is ``split_hours`` of wall
    time, so a user's busy period spreads over many tasks:

    1. one ordered pass per (user, split) finds, for every event but the
       split's first, whether it starts a session and the last start so far;
    2. one summary row per (user, split) (first and last event, last start
       after the first event), scanned in split order per user, decides
       whether each split's first event starts a session and which session
       is open when the split begins;
    3. events take their session from (1), else from the split's first
       event, else from the open session of (2).
    """
    hours = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) * 24 + F.hour("ts")
    gap_iv = F.expr(f"INTERVAL {gap}")
    in_split = Window.partitionBy("user_id", "split").orderBy("ts", "event_id")
    upto_here = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    parsed = events.select("event_id", "ts", "user_id", "event_type", "value",
                           F.get_json_object("props", "$.k").cast("int").alias("k"),
                           F.floor(hours / split_hours).alias("split"))
    ev = (parsed.filter(F.col("user_id").isNotNull())
          .withColumn("prev_in", F.lag("ts").over(in_split))
          .withColumn("local_start", F.col("prev_in").isNotNull() & (F.col("ts") > F.col("prev_in") + gap_iv))
          .withColumn("sid_local", F.last(F.when(F.col("local_start"), F.col("event_id")), ignorenulls=True)
                      .over(upto_here)))

    per_user = Window.partitionBy("user_id").orderBy("split")
    splits = (ev.groupBy("user_id", "split").agg(
                  F.min(F.struct("ts", "event_id")).alias("first"),
                  F.max("ts").alias("last_ts"),
                  F.max_by(F.when(F.col("local_start"), F.col("event_id")),
                           F.when(F.col("local_start"), F.struct("ts", "event_id"))).alias("last_local"))
              .withColumn("carry_ts", F.lag("last_ts").over(per_user))
              .withColumn("first_is_start", F.col("carry_ts").isNull()
                          | (F.col("first.ts") > F.col("carry_ts") + gap_iv))
              .withColumn("last_start", F.coalesce(
                  "last_local", F.when(F.col("first_is_start"), F.col("first.event_id"))))
              .withColumn("carry_sid", F.last("last_start", ignorenulls=True)
                          .over(per_user.rowsBetween(Window.unboundedPreceding, -1)))
              .select("user_id", "split", F.col("first.event_id").alias("first_id"),
                      "carry_ts", "first_is_start", "carry_sid"))

    is_split_first = F.col("prev_in").isNull()
    known = (ev.join(splits, ["user_id", "split"])
            .withColumn("is_first", is_split_first & F.col("carry_ts").isNull())
            .withColumn("is_start", F.when(is_split_first, F.col("first_is_start"))
                        .otherwise(F.col("local_start")))
            .withColumn("website_session_id", F.coalesce(
                "sid_local", F.when(F.col("first_is_start"), F.col("first_id")), "carry_sid"))
            .drop("prev_in", "local_start", "sid_local", "first_id", "carry_ts", "first_is_start",
                  "carry_sid"))
    # nobody's events belong to no visitor's run: each is a session of its own
    nobody = (parsed.filter(F.col("user_id").isNull())
              .select("*", F.lit(True).alias("is_first"), F.lit(True).alias("is_start"),
                      F.col("event_id").alias("website_session_id")))
    return known.unionByName(nobody)


def sessions_from_tagged(tagged: DataFrame) -> DataFrame:
    k = _k()
    return tagged.filter("is_start").select(
        F.col("event_id").alias("website_session_id"),
        F.col("ts").alias("created_at"),
        "user_id",
        F.when(F.col("is_first"), 0).otherwise(1).cast("int").alias("is_repeat_session"),
        utm_source(k).alias("utm_source"),
        utm_campaign(k).alias("utm_campaign"),
        device_type(k).alias("device_type"),
        http_referer(k).alias("http_referer"))


def pageviews_from_tagged(tagged: DataFrame) -> DataFrame:
    return tagged.select(
        F.col("event_id").alias("website_pageview_id"),
        F.col("ts").alias("created_at"),
        "website_session_id",
        F.col("event_type").alias("pageview_url"))


def web_orders_from_tagged(tagged: DataFrame) -> DataFrame:
    k = _k()
    price = F.col("value").cast(MONEY)
    return tagged.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("order_id"),
        F.col("ts").alias("created_at"),
        "website_session_id",
        (k % 4 + 1).cast("long").alias("primary_product_id"),
        (k % 3 + 1).cast("int").alias("items_purchased"),
        price.alias("price_usd"),
        (price * F.lit(0.40).cast("decimal(3,2)")).cast(MONEY).alias("cogs_usd"))


def clickstream(events: DataFrame, gap: str = "12 hours",
                split_hours: int = 24) -> dict[str, DataFrame]:
    """``website_sessions``, ``website_pageviews`` and ``orders`` from events (lazy)."""
    tagged = tag_sessions(events, gap, split_hours)
    return {"website_sessions": sessions_from_tagged(tagged),
            "website_pageviews": pageviews_from_tagged(tagged),
            "orders": web_orders_from_tagged(tagged)}


ITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            "l_quantity", "l_extendedprice"]
RANK_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def commerce_items(orders: DataFrame, lineitem: DataFrame, part: DataFrame,
                   partitions: int | None = None) -> DataFrame:
    """Order items (with ``l_returnflag``) from line items, orders and parts.

    The primary item of an order is its first item by (line number, part,
    supplier, quantity, price): a per-order minimum over a window. The join
    on the order key already leaves the items partitioned and sorted by
    order, so the window adds no shuffle and no sort (an aggregate joined
    back would scan and shuffle the line items a second time).

    ``partitions`` deals the items by order into so many partitions, whatever
    shuffles have by default, and joins the parts by a hash table of each
    partition's parts: the line items are sorted once, by order.
    """
    li = lineitem.select(*ITEM_KEY, "l_returnflag")
    parts = part.select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_retailprice")
    dates = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    # parts first, orders last: the per-order minimum and its join back then
    # reuse the partitioning by order key instead of shuffling the items again
    typed = li.join(parts if partitions is None else parts.hint("shuffle_hash"), "l_partkey")
    if partitions is not None:
        typed, dates = (df.repartition(partitions, "l_orderkey") for df in (typed, dates))
    items = (typed.join(dates, "l_orderkey")
             .withColumn("rank_key", F.struct(*RANK_KEY))
             .withColumn("first_key", F.min("rank_key").over(Window.partitionBy("l_orderkey"))))
    return items.select(
        F.xxhash64(*ITEM_KEY).alias("order_item_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("l_orderkey").alias("order_id"),
        F.col("p_type").alias("product_id"),
        (F.col("rank_key") == F.col("first_key")).cast("int").alias("is_primary_item"),
        F.col("l_extendedprice").cast(MONEY).alias("price_usd"),
        (F.col("l_quantity") * F.col("p_retailprice")).cast(MONEY).alias("cogs_usd"),
        "l_returnflag")


def commerce_from_items(orders: DataFrame, order_items: DataFrame,
                        partitions: int | None = None) -> dict[str, DataFrame]:
    """``orders`` (one row per order, items summed) and ``order_item_refunds``.

    Items in ``partitions`` buckets of the order are not shuffled: the orders are dealt into as many.
    """
    if partitions is not None:
        orders = orders.select("o_orderkey", "o_orderdate").repartition(partitions, "o_orderkey")
    per_order = order_items.groupBy("order_id").agg(
        F.max(F.when(F.col("is_primary_item") == 1, F.col("product_id"))).alias("primary_product_id"),
        F.count(F.lit(1)).cast("int").alias("items_purchased"),
        F.sum("price_usd").cast(MONEY).alias("price_usd"),
        F.sum("cogs_usd").cast(MONEY).alias("cogs_usd"))
    shop_orders = (orders.select(F.col("o_orderkey").alias("order_id"),
                                 F.col("o_orderdate").alias("created_at"))
                   .join(per_order, "order_id", "left")
                   .select("order_id", "created_at",
                           F.lit(None).cast("long").alias("website_session_id"),
                           "primary_product_id",
                           F.coalesce("items_purchased", F.lit(0)).alias("items_purchased"),
                           "price_usd", "cogs_usd"))
    refunds = (order_items.filter(F.col("l_returnflag") == "R")
               .select("order_item_id", "order_id"))
    return {"orders": shop_orders, "order_item_refunds": refunds}


def commerce(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> dict[str, DataFrame]:
    """``orders``, ``order_items`` and ``order_item_refunds`` (lazy)."""
    items = commerce_items(orders, lineitem, part)
    return {**commerce_from_items(orders, items), "order_items": items.drop("l_returnflag")}


def careless(df: DataFrame, key: str) -> DataFrame:
    """``df`` as a careless delivery: the key as text, times with a zone, money as doubles, flags as longs, and
    besides every row, for one key in 300 each: the row again, a later row of the same key, the row under an
    unreadable key and the row without a time."""
    def copies(rest: int, **changed) -> DataFrame:
        return df.where(F.pmod(F.col(key), F.lit(300)) == rest).withColumns(changed)

    df = df.withColumn(key, F.col(key).cast("long"))
    text = F.col(key).cast("string")
    rows = (df.unionByName(copies(7)).unionByName(copies(31, created_at=F.col("created_at") + F.expr("INTERVAL 1 HOUR")))
            .withColumn(key, text)
            .unionByName(copies(13, **{key: F.concat(F.lit("#"), text)}))
            .unionByName(copies(21, **{key: F.concat(F.lit("-"), text), "created_at": F.lit(None).cast("timestamp_ntz")})))
    forms = {"timestamp_ntz": "timestamp", "decimal(18,2)": "double", "int": "bigint"}
    return rows.select(*[F.col(f.name).cast(forms.get(f.dataType.simpleString(), f.dataType.simpleString())).alias(f.name)
                         for f in rows.schema.fields])
