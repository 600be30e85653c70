"""Fixture tables: figures stated for sf0.01, and split-independence of the
sessionisation."""

import pytest
from pyspark.sql import functions as F

from shopflow.operators import products, users
from shopflow.sources import fixtures
from shopflow.sources.testdata import ShopData


@pytest.fixture(scope="module")
def d(spark, sf001):
    return ShopData(spark, sf001, materialize=False)


def test_session_counts(d):
    s = d.sessions
    assert s.count() == 3292
    assert s.filter("is_repeat_session = 1").count() == 3142
    assert s.select("user_id").distinct().count() == 150


def test_sessions_and_orders_by_source(d):
    per = {r["utm_source"]: (r["s"], r["o"]) for r in
           d.facts.groupBy("utm_source").agg(F.count("*").alias("s"), F.sum("n_orders").alias("o")).collect()}
    assert per == {"gsearch": (1621, 954), "bsearch": (662, 377), "socialbook": (163, 94), None: (846, 556)}


@pytest.mark.parametrize("split_hours", [1, 7, 24 * 40])
def test_sessionisation_does_not_depend_on_split(spark, sf0001, split_hours):
    ev = spark.read.parquet(f"{sf0001}/events.parquet")
    base = fixtures.tag_sessions(ev, split_hours=24).select("event_id", "website_session_id", "is_start", "is_first")
    other = fixtures.tag_sessions(ev, split_hours=split_hours).select(
        "event_id", "website_session_id", "is_start", "is_first")
    assert base.exceptAll(other).count() == 0 and other.exceptAll(base).count() == 0


def test_commerce_known_results(d):
    q1 = products.sales_trend(d.shop_orders, "quarter").filter("yr = 1995 AND qtr = 1").first()
    assert round(q1["total_revenue"], 2) == 117141210.54
    assert round(q1["total_margin"], 2) == 64243353.04
    m = products.cross_sell_matrix(d.shop_orders, d.order_items, ["PROMO"]).filter(
        "primary_product_id = 'PROMO'").first()
    assert m["cross_sell_promo"] == 912
    assert round(m["cross_sell_promo"] / m["cross_sell_promo_rt"]) == 2393
    ref = (d.order_items.filter("year(created_at) = 1995 AND quarter(created_at) = 1")
           .join(d.refunds.select("order_item_id", F.lit(1).alias("r")), "order_item_id", "left")
           .groupBy("order_id").agg(F.max("r").alias("r")))
    assert round(ref.filter("r = 1").count() / ref.count(), 4) == 0.7076


def test_user_known_results(d):
    t = users.time_to_repeat(d.sessions, "2024-01-01", "2024-01-31").first()
    assert (t["min_days_first_to_second"], t["max_days_first_to_second"]) == (0, 3)
    assert round(t["avg_days_first_to_second"], 4) == 1.1333
    assert users.repeat_histogram(d.sessions, "2024-01-01", "2024-01-31").count() == 13


def test_pathing_known_results(d):
    anchors = d.pageviews.filter("pageview_url = 'view'").withColumn("time_period", F.lit("all"))
    nxt = products.next_pageview(anchors, d.pageviews)
    assert nxt.count() == 1412
    assert nxt.filter(F.col("min_next_pageview_id").isNotNull()).count() == 971


def test_funnel_known_results(d):
    from shopflow.operators import funnels
    flags = funnels.funnel_flags(d.sessions, d.pageviews,
                                 {f"{s}_made_it": s for s in ["view", "click", "signup", "purchase"]},
                                 (F.col("utm_source") == "gsearch") & (F.col("utm_campaign") == "nonbrand"))
    r = funnels.funnel_counts(flags, ["view", "click", "signup", "purchase"]).first()
    assert (r["sessions"], r["to_view"], r["to_click"], r["to_signup"], r["to_purchase"]) == (
        1280, 539, 571, 552, 543)


def test_bounce_by_landing_known_results(d):
    from shopflow.operators import pages
    per = pages.session_pages(d.pageviews).select(
        F.col("first.pageview_url").alias("land"), (F.col("pgv") == 1).alias("b"))
    got = {r["land"]: (r["n"], r["nb"]) for r in
           per.groupBy("land").agg(F.count("*").alias("n"), F.count_if("b").alias("nb")).collect()}
    assert got == {"click": (640, 199), "error": (677, 252), "purchase": (642, 235),
                   "signup": (691, 241), "view": (642, 209)}
