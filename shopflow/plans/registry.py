"""Every analysis as a named query over a folder of test tables.

Each entry is ``fn(spark, folder) -> DataFrame``. Arguments (dates, pages,
sources, products) are the fixture values: the clickstream covers January
2024, the commerce tables 1995 to 2001.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.functions.buckets import after, before, between
from shopflow.functions.channels import campaign, src
from shopflow.operators import distinct, funnels, pages, paths, products, traffic, users
from shopflow.sources.daily import read_days
from shopflow.sources.testdata import shop_data

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}

# fixture arguments
CUT = "2024-01-27"


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


def data(spark, folder):
    return shop_data(spark, folder)


# --- traffic and channels ---------------------------------------------------

@query("volume_trend")
def q_volume_trend(spark, folder):
    return traffic.volume_trend(data(spark, folder).facts, "day",
                                before("created_at", CUT) & src("gsearch"))


@query("volume_trend_sessions_with_order")
def q_volume_trend_swo(spark, folder):
    return traffic.volume_trend(data(spark, folder).facts, "week",
                                orders_as="sessions_with_order")


@query("segment_trend")
def q_segment_trend(spark, folder):
    return traffic.segment_trend(data(spark, folder).facts, "utm_campaign", ["nonbrand", "brand"],
                                 "day", before("created_at", CUT) & src("gsearch"))


@query("segment_trend_device")
def q_segment_trend_device(spark, folder):
    return traffic.segment_trend(data(spark, folder).facts, "device_type", ["mobile", "desktop"],
                                 "day", before("created_at", CUT) & src("gsearch") & campaign("nonbrand"))


@query("distinct_values")
def q_distinct_sources(spark, folder):
    return traffic.distinct_values(data(spark, folder).sessions, ["utm_source"])


@query("distinct_values_rows")
def q_distinct_rows(spark, folder):
    return traffic.distinct_values(data(spark, folder).sessions)


@query("distinct_values_triples")
def q_distinct_triples(spark, folder):
    return traffic.distinct_values(data(spark, folder).sessions,
                                   ["utm_source", "utm_campaign", "http_referer"],
                                   before("created_at", CUT))


@query("channel_mix_trend")
def q_channel_mix(spark, folder):
    return traffic.channel_mix_trend(data(spark, folder).facts, "day", before("created_at", CUT))


@query("direct_brand_vs_nonbrand")
def q_direct_brand(spark, folder):
    return traffic.direct_brand_vs_nonbrand(data(spark, folder).facts, "week",
                                            before("created_at", "2024-01-23"))


@query("conversion_trend")
def q_conversion_trend(spark, folder):
    return traffic.conversion_trend(data(spark, folder).facts, "day", before("created_at", CUT))


@query("efficiency_trend")
def q_efficiency(spark, folder):
    return traffic.efficiency_trend(data(spark, folder).facts, "week")


@query("orders_by_channel")
def q_orders_by_channel(spark, folder):
    return traffic.orders_by_channel(data(spark, folder).facts, "week")


@query("conversion_by_channel")
def q_conversion_by_channel(spark, folder):
    return traffic.conversion_by_channel(data(spark, folder).facts, "week")


@query("channel_characteristics")
def q_channel_characteristics(spark, folder):
    return traffic.channel_characteristics(
        data(spark, folder).facts,
        campaign("nonbrand") & after("created_at", "2024-01-05") & before("created_at", "2024-01-25"))


@query("conversion_by")
def q_conversion_by(spark, folder):
    return traffic.conversion_by(
        data(spark, folder).facts, ["device_type", "utm_source"],
        F.col("utm_source").isin("gsearch", "bsearch") & after("created_at", "2024-01-05")
        & before("created_at", "2024-01-20") & campaign("nonbrand"))


@query("weekly_portfolio")
def q_weekly_portfolio(spark, folder):
    return traffic.weekly_portfolio(
        data(spark, folder).facts,
        after("created_at", "2024-01-04") & before("created_at", "2024-01-29") & campaign("nonbrand"))


@query("hour_by_weekday")
def q_hour_by_weekday(spark, folder):
    return traffic.hour_by_weekday(data(spark, folder).sessions,
                                   between("created_at", "2024-01-03", "2024-01-28"))


# --- pages, landing pages, bounce --------------------------------------------

LANDERS = ["view", "signup"]
MARKER_URL = "signup"


def gsearch_nonbrand():
    return src("gsearch") & campaign("nonbrand")


def qual_sessions():
    return gsearch_nonbrand() & before("created_at", "2024-01-28")


@query("first_seen")
def q_first_seen(spark, folder):
    d = data(spark, folder)
    return pages.first_seen(pages.qualifying_pageviews(d.sessions, d.pageviews, qual_sessions()),
                            MARKER_URL)


@query("first_seen_row")
def q_first_seen_row(spark, folder):
    return pages.first_seen(data(spark, folder).pageviews, MARKER_URL, mode="row")


def _last_control(d):
    return pages.last_seen(d.sessions, d.pageviews, LANDERS[0],
                           gsearch_nonbrand() & before("created_at", CUT))


@query("last_seen")
def q_last_seen(spark, folder):
    return _last_control(data(spark, folder))


@query("sessions_since")
def q_sessions_since(spark, folder):
    d = data(spark, folder)
    return pages.sessions_since(d.sessions, _last_control(d).scalar(),
                                gsearch_nonbrand() & before("created_at", CUT))


@query("top_pages")
def q_top_pages(spark, folder):
    return pages.top_pages(data(spark, folder).pageviews, before("created_at", "2024-01-09"))


@query("first_pageview")
def q_first_pageview(spark, folder):
    return pages.first_pageview(data(spark, folder).pageviews, before("created_at", "2024-01-12"))


@query("landing_page")
def q_landing_page(spark, folder):
    return pages.landing_page(data(spark, folder).pageviews, before("created_at", "2024-01-14"))


@query("top_entry_pages")
def q_top_entry_pages(spark, folder):
    return pages.top_entry_pages(data(spark, folder).pageviews, before("created_at", "2024-01-12"))


@query("bounced_sessions")
def q_bounced_sessions(spark, folder):
    return pages.bounced_sessions(data(spark, folder).pageviews, before("created_at", "2024-01-14"))


@query("bounce_rate")
def q_bounce_rate(spark, folder):
    return pages.bounce_rate(data(spark, folder).pageviews, before("created_at", "2024-01-14"))


@query("bounce_rate_by_landing")
def q_bounce_by_landing(spark, folder):
    d = data(spark, folder)
    return pages.bounce_rate_by_landing(d.sessions, d.pageviews, LANDERS, MARKER_URL, qual_sessions())


def _trend_sessions():
    return gsearch_nonbrand() & before("created_at", "2024-01-31") & ~before("created_at", "2024-01-01")


@query("weekly_bounce_trend")
def q_weekly_bounce(spark, folder):
    d = data(spark, folder)
    return pages.weekly_bounce_trend(d.sessions, d.pageviews, LANDERS, session_where=_trend_sessions())


@query("weekly_bounce_trend_legacy")
def q_weekly_bounce_legacy(spark, folder):
    d = data(spark, folder)
    return pages.weekly_bounce_trend(d.sessions, d.pageviews, LANDERS, session_where=_trend_sessions(),
                                     legacy=True)


@query("qualifying_pageviews")
def q_qualifying_pageviews(spark, folder):
    d = data(spark, folder)
    return pages.qualifying_pageviews(d.sessions, d.pageviews, qual_sessions())


# --- tests and funnels -------------------------------------------------------

STEPS = ["view", "click", "signup", "purchase"]
VERSIONS = ["click", "signup"]
SEGMENTS = [("saw_view", "saw_view"), ("saw_signup", "saw_signup")]


@query("conversion_by_landing")
def q_conversion_by_landing(spark, folder):
    d = data(spark, folder)
    return funnels.conversion_by_landing(d.facts, d.pageviews, LANDERS, session_where=qual_sessions())


@query("landing_test_lift")
def q_landing_test_lift(spark, folder):
    d = data(spark, folder)
    return funnels.landing_test_lift(d.facts, d.pageviews, LANDERS, qual_sessions(),
                                     gsearch_nonbrand() & before("created_at", CUT))


def _flags(d, lo, hi, segments=True):
    cols = {"saw_view": "view", "saw_signup": "signup"} if segments else {}
    cols.update({f"{s}_made_it": s for s in STEPS})
    return funnels.funnel_flags(d.sessions, d.pageviews, cols,
                                gsearch_nonbrand() & after("created_at", lo) & before("created_at", hi))


@query("funnel_flags")
def q_funnel_flags(spark, folder):
    return _flags(data(spark, folder), "2024-01-05", "2024-01-28")


@query("funnel_counts")
def q_funnel_counts(spark, folder):
    return funnels.funnel_counts(_flags(data(spark, folder), "2024-01-05", "2024-01-25", False), STEPS)


@query("funnel_counts_by_segment")
def q_funnel_counts_by_segment(spark, folder):
    return funnels.funnel_counts(_flags(data(spark, folder), "2024-01-05", "2024-01-28"), STEPS[1:],
                                 SEGMENTS)


@query("funnel_rates")
def q_funnel_rates(spark, folder):
    return funnels.funnel_rates(_flags(data(spark, folder), "2024-01-05", "2024-01-28"), STEPS[1:],
                                SEGMENTS)


@query("page_version_conversion")
def q_page_version_conversion(spark, folder):
    d = data(spark, folder)
    return funnels.page_version_conversion(d.pageviews, d.web_orders, VERSIONS, until="2024-01-25")


@query("page_version_revenue")
def q_page_version_revenue(spark, folder):
    d = data(spark, folder)
    return funnels.page_version_revenue(d.pageviews, d.web_orders, VERSIONS, "2024-01-05", "2024-01-25")


@query("page_test_value")
def q_page_test_value(spark, folder):
    d = data(spark, folder)
    return funnels.page_test_value(d.pageviews, d.web_orders, VERSIONS, "2024-01-05", "2024-01-25",
                                   "2024-01-20", "2024-01-27")


@query("sessions_detail")
def q_sessions_detail(spark, folder):
    d = data(spark, folder)
    return funnels.sessions_detail(d.pageviews, F.col("website_session_id") > _last_control(d).scalar())


# --- products ----------------------------------------------------------------

# fixture values: the part types of the commerce tables are the products
PRODUCT_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PRODUCT_PAGES = {"click": "click", "signup": "signup"}
PATH_CUT = "2024-01-16"


@query("sales_trend")
def q_sales_trend(spark, folder):
    return products.sales_trend(data(spark, folder).shop_orders, "month",
                                before("created_at", "2001-01-04"))


@query("sales_trend_quarterly")
def q_sales_trend_q(spark, folder):
    return products.sales_trend(data(spark, folder).shop_orders, "quarter")


def _launch(spark, folder, legacy):
    d = data(spark, folder)
    return products.launch_trend(d.sessions, d.web_orders, [1, 2], "week",
                                 between("created_at", "2024-01-02", "2024-01-29"), legacy=legacy)


@query("launch_trend")
def q_launch_trend(spark, folder):
    return _launch(spark, folder, False)


@query("launch_trend_legacy")
def q_launch_trend_legacy(spark, folder):
    return _launch(spark, folder, True)


@query("product_revenue_trend")
def q_product_revenue_trend(spark, folder):
    return products.product_revenue_trend(data(spark, folder).order_items, PRODUCT_TYPES, "month")


def _view_anchors(d):
    return products.period_tag(d.pageviews, "view", "2024-01-06", "2024-01-27", PATH_CUT,
                               ("pre_product_2", "post_product_2"))


@query("period_tag")
def q_period_tag(spark, folder):
    return _view_anchors(data(spark, folder))


@query("next_pageview")
def q_next_pageview(spark, folder):
    d = data(spark, folder)
    return products.next_pageview(_view_anchors(d), d.pageviews)


@query("pathing_summary")
def q_pathing_summary(spark, folder):
    d = data(spark, folder)
    return products.pathing_summary(products.next_pageview(_view_anchors(d), d.pageviews),
                                    PRODUCT_PAGES)


@query("pages_after")
def q_pages_after(spark, folder):
    d = data(spark, folder)
    anchors = d.pageviews.filter(F.col("pageview_url").isin(*PRODUCT_PAGES.values())
                                 & between("created_at", "2024-01-06", "2024-01-20"))
    return products.pages_after(d.pageviews, anchors)


@query("product_funnel_counts")
def q_product_funnel_counts(spark, folder):
    return products.product_funnel_counts(data(spark, folder).pageviews, PRODUCT_PAGES,
                                          ["view", "purchase"], "2024-01-06", "2024-01-20")


@query("product_funnel_rates")
def q_product_funnel_rates(spark, folder):
    return products.product_funnel_rates(data(spark, folder).pageviews, PRODUCT_PAGES,
                                         ["view", "purchase"], "2024-01-06", "2024-01-20")


@query("listing_page_trend")
def q_listing_page_trend(spark, folder):
    d = data(spark, folder)
    return products.listing_page_trend(d.pageviews, d.web_orders, "view", "week")


def _cart_anchors(d, after_inclusive=True):
    return products.period_tag(d.pageviews, "click", "2024-01-06", "2024-01-26", PATH_CUT,
                               ("A.pre_cross_sell", "B.post_cross_sell"), after_inclusive=after_inclusive)


@query("clickthrough_after")
def q_clickthrough_after(spark, folder):
    d = data(spark, folder)
    return products.clickthrough_after(_cart_anchors(d), d.pageviews)


@query("cross_sell_period_summary")
def q_cross_sell_summary(spark, folder):
    d = data(spark, folder)
    return products.cross_sell_period_summary(_cart_anchors(d), d.pageviews, d.web_orders)


@query("cross_sell_period_summary_legacy")
def q_cross_sell_summary_legacy(spark, folder):
    """As originally written: a view at the cut itself is in neither period."""
    d = data(spark, folder)
    return products.cross_sell_period_summary(_cart_anchors(d, False), d.pageviews, d.web_orders, legacy=True)


@query("portfolio_period_summary")
def q_portfolio_summary(spark, folder):
    return products.portfolio_period_summary(data(spark, folder).facts, PATH_CUT, "2024-01-02",
                                             "2024-01-29", ("A.Pre_Launch", "B.Post_Launch"))


@query("cross_sell_matrix")
def q_cross_sell_matrix(spark, folder):
    d = data(spark, folder)
    return products.cross_sell_matrix(d.shop_orders, d.order_items, PRODUCT_TYPES, since="1997-06-30")


@query("refund_rate_trend")
def q_refund_rate_trend(spark, folder):
    d = data(spark, folder)
    return products.refund_rate_trend(d.order_items, d.refunds, PRODUCT_TYPES, "month",
                                      before("created_at", "2001-01-01"))


@query("refund_rate_trend_legacy")
def q_refund_rate_trend_legacy(spark, folder):
    d = data(spark, folder)
    return products.refund_rate_trend(d.order_items, d.refunds, PRODUCT_TYPES, "month",
                                      before("created_at", "2001-01-01"), legacy=True)


# --- users -------------------------------------------------------------------

P_LO, P_HI = "2024-01-01", "2024-01-31"


@query("repeat_sessions")
def q_repeat_sessions(spark, folder):
    return users.repeat_sessions(data(spark, folder).sessions, P_LO, P_HI)


@query("repeat_histogram")
def q_repeat_histogram(spark, folder):
    return users.repeat_histogram(data(spark, folder).sessions, P_LO, P_HI)


@query("first_to_second")
def q_first_to_second(spark, folder):
    return users.first_to_second(data(spark, folder).sessions, P_LO, "2024-01-29")


@query("time_to_repeat")
def q_time_to_repeat(spark, folder):
    return users.time_to_repeat(data(spark, folder).sessions, P_LO, "2024-01-29")


@query("channel_new_vs_repeat")
def q_channel_new_vs_repeat(spark, folder):
    return users.channel_new_vs_repeat(data(spark, folder).sessions, P_LO, P_HI)


@query("new_vs_repeat_value")
def q_new_vs_repeat_value(spark, folder):
    return users.new_vs_repeat_value(data(spark, folder).facts, P_LO, P_HI)


@query("customer_value")
def q_customer_value(spark, folder):
    return users.customer_value(data(spark, folder).facts)


@query("customer_value_top")
def q_customer_value_top(spark, folder):
    return users.customer_value(data(spark, folder).facts, n=25)


@query("customer_value_by_channel")
def q_customer_value_by_channel(spark, folder):
    return users.customer_value_by_channel(data(spark, folder).facts)


# --- other grains and forms ---------------------------------------------------

@query("volume_trend_month")
def q_volume_trend_month(spark, folder):
    return traffic.volume_trend(data(spark, folder).facts, "month", before("created_at", CUT) & src("gsearch"))


@query("volume_trend_quarter")
def q_volume_trend_quarter(spark, folder):
    return traffic.volume_trend(data(spark, folder).facts, "quarter", before("created_at", CUT) & src("gsearch"))


@query("segment_trend_month")
def q_segment_trend_month(spark, folder):
    return traffic.segment_trend(data(spark, folder).facts, "utm_campaign", ["nonbrand", "brand"],
                                 "month", before("created_at", CUT) & src("gsearch"))


@query("channel_mix_trend_month")
def q_channel_mix_month(spark, folder):
    return traffic.channel_mix_trend(data(spark, folder).facts, "month", before("created_at", CUT))


@query("direct_brand_vs_nonbrand_month")
def q_direct_brand_month(spark, folder):
    return traffic.direct_brand_vs_nonbrand(data(spark, folder).facts, "month", before("created_at", "2024-01-23"))


@query("conversion_trend_month")
def q_conversion_trend_month(spark, folder):
    return traffic.conversion_trend(data(spark, folder).facts, "month", before("created_at", CUT))


@query("efficiency_trend_quarter")
def q_efficiency_quarter(spark, folder):
    return traffic.efficiency_trend(data(spark, folder).facts, "quarter")


@query("orders_by_channel_quarter")
def q_orders_by_channel_quarter(spark, folder):
    return traffic.orders_by_channel(data(spark, folder).facts, "quarter")


@query("conversion_by_channel_quarter")
def q_conversion_by_channel_quarter(spark, folder):
    return traffic.conversion_by_channel(data(spark, folder).facts, "quarter")


@query("listing_page_trend_quarter")
def q_listing_page_trend_quarter(spark, folder):
    d = data(spark, folder)
    return products.listing_page_trend(d.pageviews, d.web_orders, "view", "quarter")


@query("bounce_rate_by_landing_exclusive")
def q_bounce_by_landing_exclusive(spark, folder):
    d = data(spark, folder)
    return pages.bounce_rate_by_landing(d.sessions, d.pageviews, LANDERS, MARKER_URL, qual_sessions(),
                                        inclusive=False)


# --- the five tables opened from their paths, as a deployment does --------------

@query("tables_conversion_trend")
def q_tables_conversion_trend(spark, folder):
    return traffic.conversion_trend(data(spark, folder).deployment("sessions", "orders").facts, "day", before("created_at", CUT))


@query("tables_top_pages")
def q_tables_top_pages(spark, folder):
    return pages.top_pages(data(spark, folder).deployment("pageviews").pageviews, before("created_at", "2024-01-09"))


@query("tables_distinct_values_rows")
def q_tables_distinct_rows(spark, folder):
    return traffic.distinct_values(data(spark, folder).deployment("sessions").sessions)


@query("tables_product_revenue_trend")
def q_tables_product_revenue(spark, folder):
    return products.product_revenue_trend(data(spark, folder).deployment("order_items").order_items, PRODUCT_TYPES, "month")


@query("tables_refund_rate_trend")
def q_tables_refund_rate_trend(spark, folder):
    t = data(spark, folder).deployment("order_items", "refunds")
    return products.refund_rate_trend(t.order_items, t.refunds, PRODUCT_TYPES, "month",
                                      before("created_at", "2001-01-01"))


# --- session paths and tables in the same buckets: the same analyses without moving page views -----

def _paths(name: str, fn) -> None:
    """Register ``fn(ShopData)`` as the path form of the query ``name``."""
    QUERIES[f"paths_{name}"] = lambda spark, folder: fn(data(spark, folder))


VIEW_ANCHORS = {"url": "view", "lo": "2024-01-06", "hi": "2024-01-27", "cut": PATH_CUT,
                "labels": ("pre_product_2", "post_product_2")}
CART_ANCHORS = {"url": "click", "lo": "2024-01-06", "hi": "2024-01-26", "cut": PATH_CUT,
                "labels": ("A.pre_cross_sell", "B.post_cross_sell")}


def _path_flags(d, lo, hi, segments=True):
    cols = {"saw_view": "view", "saw_signup": "signup"} if segments else {}
    cols.update({f"{s}_made_it": s for s in STEPS})
    return paths.funnel_flags(d.paths, cols, gsearch_nonbrand() & after("created_at", lo) & before("created_at", hi))


_paths("first_pageview", lambda d: paths.first_pageview(d.paths, paths.seen_before("2024-01-12")))
_paths("landing_page", lambda d: paths.landing_page(d.paths, paths.seen_before("2024-01-14")))
_paths("top_entry_pages", lambda d: paths.top_entry_pages(d.paths, paths.seen_before("2024-01-12")))
_paths("bounced_sessions", lambda d: paths.bounced_sessions(d.paths, paths.seen_before("2024-01-14")))
_paths("bounce_rate", lambda d: paths.bounce_rate(d.paths, paths.seen_before("2024-01-14")))
_paths("bounce_rate_by_landing", lambda d: paths.bounce_rate_by_landing(d.paths, LANDERS, MARKER_URL, qual_sessions()))
_paths("weekly_bounce_trend", lambda d: paths.weekly_bounce_trend(d.paths, LANDERS, where=_trend_sessions()))
_paths("qualifying_pageviews", lambda d: paths.qualifying_pageviews(d.paths, qual_sessions()))
_paths("funnel_flags", lambda d: _path_flags(d, "2024-01-05", "2024-01-28"))
_paths("funnel_counts", lambda d: funnels.funnel_counts(_path_flags(d, "2024-01-05", "2024-01-25", False), STEPS))
_paths("funnel_rates", lambda d: funnels.funnel_rates(_path_flags(d, "2024-01-05", "2024-01-28"), STEPS[1:], SEGMENTS))
_paths("page_version_conversion", lambda d: paths.page_version_conversion(d.paths, VERSIONS, until="2024-01-25"))
_paths("next_pageview", lambda d: paths.next_pageview(d.paths, **VIEW_ANCHORS))
_paths("pathing_summary", lambda d: products.pathing_summary(paths.next_pageview(d.paths, **VIEW_ANCHORS), PRODUCT_PAGES))
_paths("pages_after", lambda d: paths.pages_after(d.paths, paths.both(
    paths.of_url(PRODUCT_PAGES.values()), paths.seen_between("2024-01-06", "2024-01-20"))))
_paths("product_funnel_counts", lambda d: paths.product_funnel_counts(
    d.paths, PRODUCT_PAGES, ["view", "purchase"], "2024-01-06", "2024-01-20"))
_paths("product_funnel_rates", lambda d: paths.product_funnel_rates(
    d.paths, PRODUCT_PAGES, ["view", "purchase"], "2024-01-06", "2024-01-20"))
_paths("listing_page_trend", lambda d: paths.listing_page_trend(d.paths, "view", "week"))
_paths("clickthrough_after", lambda d: paths.clickthrough_after(d.paths, **CART_ANCHORS))
_paths("cross_sell_period_summary", lambda d: paths.cross_sell_period_summary(d.paths, **CART_ANCHORS))
_paths("cross_sell_period_summary_legacy", lambda d: paths.cross_sell_period_summary(
    d.paths, legacy=True, after_inclusive=False, **CART_ANCHORS))


@query("buckets_cross_sell_matrix")
def q_buckets_cross_sell_matrix(spark, folder):
    orders, items = data(spark, folder).orders_and_items
    return products.cross_sell_matrix(orders, items, PRODUCT_TYPES, since="1997-06-30")


@query("buckets_refund_rate_trend")
def q_buckets_refund_rate_trend(spark, folder):
    items, refunds = data(spark, folder).items_and_refunds
    return products.refund_rate_trend(items, refunds, PRODUCT_TYPES, "month", before("created_at", "2001-01-01"))


# --- base tables in day folders, facts kept up to date by day ------------------------------------

@query("daily_conversion_trend")
def q_daily_conversion_trend(spark, folder):
    return traffic.conversion_trend(data(spark, folder).daily.read(until="2024-01-26"), "day", before("created_at", CUT))


@query("daily_conversion_by")
def q_daily_conversion_by(spark, folder):
    return traffic.conversion_by(
        data(spark, folder).daily.read("2024-01-05", "2024-01-19"), ["device_type", "utm_source"],
        F.col("utm_source").isin("gsearch", "bsearch") & after("created_at", "2024-01-05")
        & before("created_at", "2024-01-20") & campaign("nonbrand"))


@query("daily_new_vs_repeat_value")
def q_daily_new_vs_repeat_value(spark, folder):
    return users.new_vs_repeat_value(data(spark, folder).daily.read(), P_LO, P_HI)


@query("daily_page_version_conversion")
def q_daily_page_version_conversion(spark, folder):
    """Days before the marker's are pruned while the query runs: the marker is known only then."""
    d = data(spark, folder)
    return funnels.page_version_conversion_by_day(d.landed_pageviews(), d.daily.read(), VERSIONS, until="2024-01-25")


# --- a careless delivery through the keyed load: results of the clean tables, and what was left out ----

@query("loaded_conversion_trend")
def q_loaded_conversion_trend(spark, folder):
    return traffic.conversion_trend(data(spark, folder).delivery().facts, "day", before("created_at", CUT))


@query("loaded_top_pages")
def q_loaded_top_pages(spark, folder):
    return pages.top_pages(data(spark, folder).delivery().pageviews, before("created_at", "2024-01-09"))


@query("loaded_distinct_values_rows")
def q_loaded_distinct_rows(spark, folder):
    return traffic.distinct_values(data(spark, folder).delivery().sessions)


@query("loaded_rejects")
def q_loaded_rejects(spark, folder):
    return (data(spark, folder).delivery().rejects().groupBy("table_name", "reason")
            .agg(F.sum("copies").alias("n_rows"), F.countDistinct("key").alias("n_keys")))


# --- distinct counts merged from words by day, over tables with repeated rows -----------------------

def words(spark, folder):
    return data(spark, folder).daily_words.read(until="2024-01-26")


@query("distinct_volume_trend")
def q_distinct_volume(spark, folder):
    return distinct.volume_trend(words(spark, folder), "day", src("gsearch"))


@query("distinct_volume_trend_month")
def q_distinct_volume_month(spark, folder):
    return distinct.volume_trend(words(spark, folder), "month", src("gsearch"))


@query("distinct_volume_trend_quarter")
def q_distinct_volume_quarter(spark, folder):
    return distinct.volume_trend(words(spark, folder), "quarter", src("gsearch"))


@query("distinct_volume_trend_sessions_with_order")
def q_distinct_volume_swo(spark, folder):
    return distinct.volume_trend(data(spark, folder).daily_words.read(), "week", orders_as="sessions_with_order")


@query("distinct_segment_trend")
def q_distinct_segment(spark, folder):
    return distinct.segment_trend(words(spark, folder), "utm_campaign", ["nonbrand", "brand"], "day", src("gsearch"))


@query("distinct_segment_trend_month")
def q_distinct_segment_month(spark, folder):
    return distinct.segment_trend(words(spark, folder), "utm_campaign", ["nonbrand", "brand"], "month", src("gsearch"))


@query("distinct_segment_trend_device")
def q_distinct_segment_device(spark, folder):
    return distinct.segment_trend(words(spark, folder), "device_type", ["mobile", "desktop"], "day",
                                  src("gsearch") & campaign("nonbrand"))


@query("distinct_channel_mix_trend")
def q_distinct_channel_mix(spark, folder):
    return distinct.channel_mix_trend(words(spark, folder), "day")


@query("distinct_channel_mix_trend_month")
def q_distinct_channel_mix_month(spark, folder):
    return distinct.channel_mix_trend(words(spark, folder), "month")


@query("distinct_conversion_trend")
def q_distinct_conversion(spark, folder):
    return distinct.conversion_trend(words(spark, folder), "day")


@query("distinct_conversion_trend_month")
def q_distinct_conversion_month(spark, folder):
    return distinct.conversion_trend(words(spark, folder), "month")


@query("distinct_conversion_by")
def q_distinct_conversion_by(spark, folder):
    """The period starts inside a day, so the words are built from the rows it leaves."""
    d = data(spark, folder)
    sessions = read_days(spark, d.repeated["website_sessions"], "website_sessions").where(
        F.col("utm_source").isin("gsearch", "bsearch") & after("created_at", "2024-01-05")
        & before("created_at", "2024-01-20") & campaign("nonbrand"))
    return distinct.conversion_by(distinct.session_words(sessions, read_days(spark, d.repeated["orders"], "orders")),
                                  ["device_type", "utm_source"])


@query("distinct_top_pages")
def q_distinct_top_pages(spark, folder):
    return distinct.top_pages(data(spark, folder).page_words, F.col("day") < "2024-01-09")
