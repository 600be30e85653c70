"""Product analyses: sales, launches, pathing, product funnels, cross-sell,
refunds.

"What happened after page X" questions are answered without a range self
join: per (group, session) the earliest anchor view is found by an
aggregate, then an equi-join on the session with a "later id" condition
feeds a ``min`` aggregate (inner join, so a hot session's page views can
be split by adaptive execution), and the result is left-joined back to
keep sessions with nothing after the anchor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.functions.buckets import at, bucket_columns, bucket_names, period_label
from shopflow.functions.filters import where as apply_where, url_is
from shopflow.functions.ratio import ratio
from shopflow.operators.grain import SESSION_COLUMNS, orders_per_session
from shopflow.operators.pages import PVID, SID


def _name(v) -> str:
    return str(v).lower().replace(" ", "_").replace("-", "_")


def sales_trend(orders: DataFrame, grain: str = "month", where: Column | None = None) -> DataFrame:
    """Orders, revenue and margin per bucket of order time."""
    return apply_where(orders, where).groupBy(*bucket_columns("created_at", grain)).agg(
        F.count("order_id").alias("number_of_sales"),
        F.sum("price_usd").cast("double").alias("total_revenue"),
        F.sum(F.col("price_usd") - F.col("cogs_usd")).cast("double").alias("total_margin"))


def launch_trend(sessions: DataFrame, orders: DataFrame, products: list, grain: str = "month",
                 where: Column | None = None, legacy: bool = False) -> DataFrame:
    """Orders, conversion, revenue per session and orders per primary
    product, per bucket of session time.

    As in the original, the denominator counts session rows of the
    session-order join (a session with two orders counts twice).
    ``revenue_per_session`` is revenue over that count; ``legacy=True``
    gives the original's count of priced orders over it instead.
    """
    extra = [F.count("price_usd").alias("n_priced")] + [
        F.count_if(F.col("primary_product_id") == F.lit(p)).alias(f"n_p{i}") for i, p in enumerate(products)]
    per = orders_per_session(orders, extra)
    rows = apply_where(sessions.select(*SESSION_COLUMNS), where).join(per, SID, "left")
    keys = bucket_names(grain)
    agg = rows.groupBy(*bucket_columns("created_at", grain)).agg(
        F.coalesce(F.sum("n_orders"), F.lit(0)).alias("orders"),
        F.sum(F.greatest(F.coalesce("n_orders", F.lit(0)), F.lit(1))).alias("join_rows"),
        F.sum("revenue").cast("double").alias("rev"),
        F.coalesce(F.sum("n_priced"), F.lit(0)).alias("priced"),
        *[F.coalesce(F.sum(f"n_p{i}"), F.lit(0)).alias(f"product_{_name(p)}_orders")
          for i, p in enumerate(products)])
    rps = ratio("priced", "join_rows") if legacy else ratio("rev", "join_rows")
    return agg.select(*keys, "orders", ratio("orders", "join_rows").alias("conv_rate"),
                      rps.alias("revenue_per_session"),
                      *[f"product_{_name(p)}_orders" for p in products])


def product_revenue_trend(items: DataFrame, products: list, grain: str = "month",
                          where: Column | None = None) -> DataFrame:
    """Revenue and margin per product (NULL when it sold nothing) and in
    total, per bucket of item time, sorted by bucket."""
    margin = F.col("price_usd") - F.col("cogs_usd")
    aggs = []
    for p in products:
        is_p = F.col("product_id") == F.lit(p)
        aggs += [F.sum(F.when(is_p, F.col("price_usd"))).cast("double").alias(f"{_name(p)}_rev"),
                 F.sum(F.when(is_p, margin)).cast("double").alias(f"{_name(p)}_marg")]
    keys = bucket_names(grain)
    return (apply_where(items, where).groupBy(*bucket_columns("created_at", grain))
            .agg(*aggs, F.sum("price_usd").cast("double").alias("total_revenue"),
                 F.sum(margin).cast("double").alias("total_margin"))
            .orderBy(*keys))


def period_tag(pageviews: DataFrame, url, lo, hi, cut, labels=("pre", "post"),
               other: str = "other", after_inclusive: bool = True) -> DataFrame:
    """Views of ``url`` in the closed range [lo, hi], labelled by ``cut``."""
    return (pageviews.filter(url_is(url) & F.col("created_at").between(at(lo), at(hi)))
            .select(SID, PVID, "created_at",
                    period_label("created_at", cut, labels[0], labels[1], other,
                                 after_inclusive).alias("time_period")))


def first_after(anchors: DataFrame, pageviews: DataFrame, keys: list[str],
                keep_missing: bool = True, counted: bool = False) -> DataFrame:
    """Per group ``keys`` (which include the session): the first page view of
    the session after the group's earliest anchor, as ``next_id`` and
    ``next_url``, with ``counted`` also the number of anchors (``c``).

    The first view after any anchor of a group is the first view after its
    earliest anchor, so one anchor per group suffices. The anchor itself is
    among the session's views joined to the group (anchors are page views),
    so a group without a later view keeps its row with NULLs and nothing is
    joined back. Page-view ids are unique.
    """
    earliest = anchors.groupBy(*keys).agg(F.min(PVID).alias("anchor_id"), F.count(PVID).alias("c"))
    pv = pageviews.select(F.col(SID).alias("_sid"), F.col(PVID).alias("_id"), "pageview_url")
    later = F.when(F.col("_id") > F.col("anchor_id"), F.struct("_id", "pageview_url"))
    near = F.col("_id") >= F.col("anchor_id") if keep_missing else F.col("_id") > F.col("anchor_id")
    found = (earliest.join(pv, (F.col(SID) == F.col("_sid")) & near)
             .groupBy(*keys).agg(F.min(later).alias("n"), F.max("c").alias("c")))
    return found.select(*keys, *(["c"] if counted else []), F.col("n._id").alias("next_id"),
                        F.col("n.pageview_url").alias("next_url"))


def next_pageview(anchors: DataFrame, pageviews: DataFrame) -> DataFrame:
    """Per (period, session): the next page view after the anchor and its url
    (NULL when the anchor was the session's last view)."""
    return (first_after(anchors, pageviews, ["time_period", SID])
            .select("time_period", SID, F.col("next_id").alias("min_next_pageview_id"),
                    F.col("next_url").alias("pageview_url")))


def pathing_summary(next_views: DataFrame, pages: dict[str, str]) -> DataFrame:
    """Per period: sessions, share with a next page, share going to each of
    ``pages`` ({label: url})."""
    aggs = [F.count(SID).alias("sessions"),
            F.count_if(F.col("min_next_pageview_id").isNotNull()).alias("w_next_pg")]
    for label, url in pages.items():
        aggs.append(F.count_if(F.col("pageview_url") == F.lit(url)).alias(f"to_{label}"))
    agg = next_views.groupBy("time_period").agg(*aggs)
    cols = ["time_period", "sessions", "w_next_pg", ratio("w_next_pg", "sessions").alias("pct_w_next_pg")]
    for label in pages:
        cols += [f"to_{label}", ratio(f"to_{label}", "sessions").alias(f"pct_to_{label}")]
    return agg.select(*cols)


def pages_after(pageviews: DataFrame, anchors: DataFrame) -> DataFrame:
    """Distinct urls viewed after an anchor view in the same session, plus
    NULL when some anchor was the last view of its session.

    Anchors are page views: a (session, url) pair keeps its largest id, which
    tells both whether the url came after the session's first anchor and
    whether its last anchor was the session's last view.
    """
    bounds = anchors.groupBy(SID).agg(F.min(PVID).alias("a_min"), F.max(PVID).alias("a_max"))
    pv = pageviews.select(F.col(SID).alias("_sid"), F.col(PVID).alias("_id"), "pageview_url")
    per = (bounds.join(pv, (F.col(SID) == F.col("_sid")) & (F.col("_id") >= F.col("a_min")))
           .groupBy(SID).agg(F.collect_set(F.when(F.col("_id") > F.col("a_min"), F.struct("pageview_url"))).alias("u"),
                             F.max("_id").alias("s_max"), F.max("a_max").alias("a_max")))
    dead_end = F.when(F.col("a_max") >= F.col("s_max"),
                      F.array(F.struct(F.lit(None).cast("string").alias("pageview_url"))))
    return (per.select(F.explode(F.concat("u", F.coalesce(dead_end, F.array_except("u", "u")))).alias("p"))
            .select("p.pageview_url").distinct())


def product_funnel_counts(pageviews: DataFrame, products: dict[str, str], steps: list[str],
                          lo, hi) -> DataFrame:
    """Funnel step counts per product page seen.

    Steps reached are taken from the session's views in [lo, hi]; each of
    the session's views of a product page (any time) is a row, so steps
    count product-page views while ``sessions`` is distinct.
    """
    flags = (pageviews.filter(F.col("created_at").between(at(lo), at(hi)))
             .groupBy(SID).agg(*[F.max((F.col("pageview_url") == F.lit(s)).cast("int")).alias(f"f_{s}")
                                 for s in steps]))
    seen = (pageviews.filter(url_is(list(products.values())))
            .groupBy(SID, "pageview_url").agg(F.count(PVID).alias("views")))
    label = None
    for name, url in products.items():
        cond = F.col("pageview_url") == F.lit(url)
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    rows = seen.join(flags, SID).withColumn("product_seen", label)
    return rows.groupBy("product_seen").agg(
        F.count(SID).alias("sessions"),
        *[F.coalesce(F.sum(F.when(F.col(f"f_{s}") == 1, F.col("views"))), F.lit(0)).alias(f"to_{s}")
          for s in steps])


def product_funnel_rates(pageviews: DataFrame, products: dict[str, str], steps: list[str],
                         lo, hi) -> DataFrame:
    """Click rates of :func:`product_funnel_counts`: ``product_page_click_rt``
    is the first step over sessions, ``{step}_click_rt`` the next over it."""
    counts = product_funnel_counts(pageviews, products, steps, lo, hi)
    prev = ["sessions"] + [f"to_{s}" for s in steps]
    names = ["product_page"] + list(steps[:-1])
    return counts.select("product_seen", "sessions",
                         *[ratio(f"to_{s}", p).alias(f"{n}_click_rt") for s, p, n in zip(steps, prev, names)])


def listing_page_trend(pageviews: DataFrame, orders: DataFrame, listing_url: str,
                       grain: str = "quarter") -> DataFrame:
    """Per bucket of the listing-page view time: sessions viewing it, share
    viewing any later page, orders per such session."""
    # the first listing view per bucket and the last view per session, from one pass over the views
    keys = bucket_names(grain)
    per = (pageviews.select(SID, PVID, url_is(listing_url).alias("listed"), *bucket_columns("created_at", grain))
           .groupBy(SID, *keys).agg(F.min(F.when(F.col("listed"), F.col(PVID))).alias("a"), F.max(PVID).alias("last")))
    rows = (per.withColumn("s_max", F.max("last").over(Window.partitionBy(SID))).filter(F.col("a").isNotNull())
            .join(orders_per_session(orders).select(SID, "n_orders"), SID, "left"))
    agg = rows.groupBy(*keys).agg(F.count(SID).alias("sessions_to_product"),
                                  F.count_if(F.col("s_max") > F.col("a")).alias("clicked"),
                                  F.coalesce(F.sum("n_orders"), F.lit(0)).alias("orders"))
    return agg.select(*keys, "sessions_to_product",
                      ratio("clicked", "sessions_to_product").alias("click_thro_rate"),
                      ratio("orders", "sessions_to_product").alias("conversion_rate"))


def clickthrough_after(anchors: DataFrame, pageviews: DataFrame) -> DataFrame:
    """Per (period, session) with a view after the anchor: its first id."""
    return (first_after(anchors, pageviews, ["time_period", SID], keep_missing=False)
            .select("time_period", SID, F.col("next_id").alias("after_cart_pageview_id")))


def cross_sell_period_summary(anchors: DataFrame, pageviews: DataFrame, orders: DataFrame,
                              legacy: bool = False) -> DataFrame:
    """Per period of cart views: cart sessions, click-throughs, products per
    order, order value and revenue per cart session.

    Default: one row per (period, session); orders count for sessions that
    clicked through. ``legacy=True`` returns the original's figures, whose
    session-only joins repeat rows (cart views x click-through periods^2 x
    orders); they are computed by arithmetic at session grain, never by
    materialising the repeated rows.
    """
    keys = ["time_period", SID]
    carts = (first_after(anchors, pageviews, keys, counted=True)
             .select(*keys, "c", F.col("next_id").isNotNull().alias("clicked")))
    return summarise_carts(carts, orders_per_session(orders).select(SID, "n_orders", "items", "revenue"), legacy)


def summarise_carts(carts: DataFrame, per_order: DataFrame, legacy: bool = False) -> DataFrame:
    """Figures of :func:`cross_sell_period_summary` from one row per (period, session) with the number of
    cart views ``c`` and whether the session ``clicked`` on, and the orders of each session."""
    if not legacy:
        rows = carts.join(per_order, SID, "left")
        on = F.col("clicked")
        agg = rows.groupBy("time_period").agg(
            F.count(SID).alias("sessions"),
            F.count_if(on).alias("clickthroughs"),
            F.sum(F.when(on, F.col("n_orders")).otherwise(0)).alias("orders"),
            F.sum(F.when(on, F.col("items"))).alias("items"),
            F.sum(F.when(on, F.col("revenue"))).cast("double").alias("rev"))
    else:
        # click-through periods of the session: a window over its (at most three) period rows
        rows = (carts.withColumn("a", F.count_if("clicked").over(Window.partitionBy(SID)))
                .join(per_order, SID, "left")
                .withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))
                .withColumn("w", F.col("c") * F.col("a") * F.col("a")))
        agg = rows.groupBy("time_period").agg(
            F.count(SID).alias("sessions"),
            F.sum(F.col("w") * F.greatest("n_orders", F.lit(1))).alias("clickthroughs"),
            F.sum(F.col("w") * F.col("n_orders")).alias("orders"),
            F.sum(F.when(F.col("a") > 0, F.col("w") * F.col("items"))).alias("items"),
            F.sum(F.when(F.col("a") > 0, F.col("w") * F.col("revenue"))).cast("double").alias("rev"))
    return agg.select("time_period", "sessions", F.col("clickthroughs").cast("long").alias("clickthroughs"),
                      ratio("clickthroughs", "sessions").alias("cart_ctr"),
                      ratio("items", "orders").alias("products_per_order"),
                      ratio("rev", "orders").alias("aov"),
                      ratio("rev", "sessions").alias("rev_per_cart_session"))


def portfolio_period_summary(facts: DataFrame, cut, lo, hi,
                             labels=("A.pre", "B.post"), other: str = "other") -> DataFrame:
    """Sessions in [lo, hi] before and after ``cut``: conversion, order
    value, products per order and revenue per session."""
    rows = facts.filter(F.col("created_at").between(at(lo), at(hi)))
    agg = rows.groupBy(period_label("created_at", cut, labels[0], labels[1], other).alias("time_period")).agg(
        F.count(SID).alias("s"), F.sum("n_orders").alias("o"),
        F.sum("revenue").cast("double").alias("rev"), F.sum("items").alias("items"))
    return agg.select("time_period", ratio("o", "s").alias("conv_rate"), ratio("rev", "o").alias("aov"),
                      ratio("items", "o").alias("products_per_order"),
                      ratio("rev", "s").alias("rev_per_session"))


def cross_sell_matrix(orders: DataFrame, items: DataFrame, products: list,
                      since=None) -> DataFrame:
    """Per primary product: orders with each product as an add-on (a
    non-primary item), as a count and as a share of the primary product's
    orders (all of them, with or without add-ons)."""
    base = orders if since is None else orders.filter(F.col("created_at") > at(since))
    addons = (items.filter(F.col("is_primary_item") == 0)
              .groupBy("order_id").agg(*[F.max((F.col("product_id") == F.lit(p)).cast("int")).alias(f"x{i}")
                                         for i, p in enumerate(products)]))
    rows = base.select("order_id", "primary_product_id").join(addons, "order_id", "left")
    agg = rows.groupBy("primary_product_id").agg(
        F.count("order_id").alias("orders"),
        *[F.count_if(F.col(f"x{i}") == 1).alias(f"cross_sell_{_name(p)}") for i, p in enumerate(products)])
    return agg.select("primary_product_id",
                      *[f"cross_sell_{_name(p)}" for p in products],
                      *[ratio(f"cross_sell_{_name(p)}", "orders").alias(f"cross_sell_{_name(p)}_rt")
                        for p in products])


def refund_rate_trend(items: DataFrame, refunds: DataFrame, products: list, grain: str = "month",
                      where: Column | None = None, legacy: bool = False) -> DataFrame:
    """Per bucket and product: orders holding the product and the share of
    them with a refunded item of that product.

    Reduced to (bucket, order, product) first, then counted, instead of one
    ``COUNT(DISTINCT)`` per product. ``legacy=True`` divides the refunds of
    the third and later products by the orders of the second product, as
    the original does.
    """
    keys = bucket_names(grain)
    refunded = refunds.select("order_item_id", F.col("order_id").alias("refund_order_id"))
    rows = (apply_where(items, where).join(refunded, "order_item_id", "left")
            .groupBy(*bucket_columns("created_at", grain), "order_id", "product_id")
            .agg(F.max(F.col("refund_order_id").isNotNull()).alias("refunded")))
    aggs = []
    for i, p in enumerate(products):
        is_p = F.col("product_id") == F.lit(p)
        aggs += [F.count_if(is_p).alias(f"{_name(p)}_orders"),
                 F.count_if(is_p & F.col("refunded")).alias(f"r{i}")]
    agg = rows.groupBy(*keys).agg(*aggs)
    cols = list(keys)
    for i, p in enumerate(products):
        den = f"{_name(products[1])}_orders" if legacy and i >= 2 else f"{_name(p)}_orders"
        cols += [f"{_name(p)}_orders", ratio(f"r{i}", den).alias(f"{_name(p)}_refund_rt")]
    return agg.select(*cols)
