"""Edge cases on hand-made rows: empty sessions, repeated orders, NULL
channels, bounds, zero denominators, weeks across new year, gaps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shopflow.functions.buckets import before, between, sunday_week
from shopflow.functions.ratio import ratio, round_avg_half_up
from shopflow.operators import funnels, grain, pages, products, traffic, users
from shopflow.sources import fixtures
from tests import rows as R

G, B, S = "https://www.gsearch.com", "https://www.bsearch.com", "https://www.socialbook.com"


@pytest.fixture(scope="module")
def shop(spark):
    s = R.sessions(spark, [
        (1, "2023-12-31 10:00:00", 7, 0, "gsearch", "nonbrand", "mobile", G),
        (2, "2024-01-06 23:59:59", 7, 1, None, None, "desktop", None),       # direct
        (3, "2024-01-07 00:00:00", 8, 0, None, None, "desktop", B),          # organic
        (4, "2024-01-08 00:00:00", 8, 1, "bsearch", "brand", "mobile", B),   # no page view
        (5, "2024-01-09 00:00:00", 9, 0, None, None, "desktop", S),          # organic (any referer)
    ])
    p = R.pageviews(spark, [
        (10, "2023-12-31 10:00:00", 1, "home"), (11, "2023-12-31 10:01:00", 1, "cart"),
        (12, "2023-12-31 10:02:00", 1, "cart"), (13, "2023-12-31 10:03:00", 1, "thanks"),
        (20, "2024-01-06 23:59:59", 2, "lander"),
        (30, "2024-01-07 00:00:00", 3, "home"), (31, "2024-01-07 00:05:00", 3, "cart"),
        (50, "2024-01-09 00:00:00", 5, "cart"),
    ])
    o = R.orders(spark, [
        (100, "2023-12-31 10:03:00", 1, 1, 1, 10.00),
        (101, "2023-12-31 10:04:00", 1, 2, 2, 30.00),   # second order of session 1
        (102, "2024-01-07 00:06:00", 3, 1, 1, 20.00),
    ])
    return s, p, o, grain.session_facts(s, o)


def test_session_facts(shop):
    _, _, _, f = shop
    got = {r["website_session_id"]: (r["n_orders"], r["revenue"]) for r in f.collect()}
    assert got[1][0] == 2 and float(got[1][1]) == 40.0
    assert got[4] == (0, None)


def test_week_across_new_year_stays_whole(shop):
    _, _, _, f = shop
    wk = {r["website_session_id"]: r["w"] for r in f.select("website_session_id", sunday_week("created_at").alias("w")).collect()}
    assert wk[1] == wk[2] == dt.date(2023, 12, 31)
    assert wk[3] == wk[4] == wk[5] == dt.date(2024, 1, 7)


def test_conversion_counts_each_order_once(shop):
    _, _, _, f = shop
    r = traffic.conversion_trend(f, "week").orderBy("wk_start").collect()
    assert [(x["sessions"], x["orders"]) for x in r] == [(2, 2), (3, 1)]
    assert r[0]["conversion_rate"] == 1.0


def test_channels_and_organic_definitions(shop):
    _, _, _, f = shop
    def total(df, col):
        return df.agg(F.sum(col)).first()[0]
    mix = traffic.channel_mix_trend(f, "year")
    assert (total(mix, "organic_search_sessions"), total(mix, "direct_type_in_sessions")) == (2, 1)
    listed = traffic.channel_mix_trend(f, "year", organic=[G, B])
    assert total(listed, "organic_search_sessions") == 1
    groups = {r["channel_group"]: r["new_sessions"] + r["repeat_sessions"]
              for r in users.channel_new_vs_repeat(f, "2023-01-01", "2025-01-01").collect()}
    assert groups == {"paid_nonbrand": 1, "direct_type_in": 1, "organic_search": 1, "paid_brand": 1, None: 1}


def test_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "a int, b int")
    assert [r[0] for r in df.select(ratio("a", "b")).collect()] == [None, None]


def test_closed_and_open_bounds(shop):
    s = shop[0]
    assert s.filter(between("created_at", "2024-01-01", "2024-01-07")).count() == 2   # 01-06 and 01-07 00:00
    assert s.filter(before("created_at", "2024-01-07")).count() == 2


def test_round_half_up_exact(spark):
    df = spark.createDataFrame([(23, 20), (5, 4), (1, 20), (0, 3), (7, 0)], "t long, n long")
    assert [r[0] for r in df.select(round_avg_half_up("t", "n")).collect()] == [1.2, 1.3, 0.1, 0.0, None]


def test_funnel_keeps_sessions_without_views(shop):
    s, p, _, _ = shop
    flags = funnels.funnel_flags(s, p, {"cart_made_it": "cart", "thanks_made_it": "thanks"})
    got = {r["website_session_id"]: (r["cart_made_it"], r["thanks_made_it"]) for r in flags.collect()}
    assert got[4] == (0, 0) and got[1] == (1, 1) and got[3] == (1, 0)
    counts = funnels.funnel_counts(flags, ["cart", "thanks"]).first()
    assert counts["sessions"] == 5 and counts["to_cart"] <= counts["sessions"]
    nulls = funnels.funnel_flags(s, p, {"cart_made_it": "cart"}, zero=None)
    assert {r["cart_made_it"] for r in nulls.collect()} == {1, None}


def test_landing_and_bounce(shop):
    _, p, _, _ = shop
    land = {r["website_session_id"]: r["landing_page"] for r in pages.landing_page(p).collect()}
    assert land == {1: "home", 2: "lander", 3: "home", 5: "cart"}
    b = pages.bounce_rate(p).first()
    assert (b["sessions"], b["bounced_sessions"]) == (4, 2)
    # bounce counts every view of the session, also those after the cut-off
    late = pages.bounced_sessions(p, before("created_at", "2023-12-31 10:00:30")).count()
    assert late == 0


def test_two_anchors_take_the_first_later_view(shop):
    _, p, _, _ = shop
    anchors = p.filter("pageview_url = 'cart'").withColumn("time_period", F.lit("all"))
    nxt = {r["website_session_id"]: (r["min_next_pageview_id"], r["pageview_url"])
           for r in products.next_pageview(anchors, p).collect()}
    assert nxt == {1: (12, "cart"), 3: (None, None), 5: (None, None)}
    urls = {r[0] for r in products.pages_after(p, p.filter("pageview_url = 'cart'")).collect()}
    assert urls == {"cart", "thanks", None}


def test_next_view_matches_literal_range_join(spark, sf0001):
    from shopflow.sources.testdata import ShopData
    d = ShopData(spark, sf0001, materialize=False)
    pv = d.pageviews
    anchors = products.period_tag(pv, "view", "2024-01-01", "2024-02-01", "2024-01-15")
    fast = products.next_pageview(anchors, pv)
    a, b = anchors.alias("a"), pv.alias("b")
    literal = (a.join(b, (F.col("a.website_session_id") == F.col("b.website_session_id"))
                      & (F.col("b.website_pageview_id") > F.col("a.website_pageview_id")), "left")
               .groupBy("a.time_period", "a.website_session_id")
               .agg(F.min("b.website_pageview_id").alias("min_next_pageview_id")))
    assert fast.select("time_period", "website_session_id", "min_next_pageview_id").exceptAll(literal).count() == 0
    assert fast.count() == literal.count()


@pytest.mark.parametrize("width", [1, 3, 50])
def test_later_repeats_independent_of_id_ranges(spark, sf0001, width):
    from shopflow.sources.testdata import ShopData
    s = ShopData(spark, sf0001, materialize=False).sessions
    wide = users.later_repeats(s, "2024-01-01", "2024-02-01", id_bucket=1 << 40)
    narrow = users.later_repeats(s, "2024-01-01", "2024-02-01", id_bucket=width)
    assert wide.exceptAll(narrow).count() == 0 and narrow.exceptAll(wide).count() == 0
    hist = users.repeat_histogram(s, "2024-01-01", "2024-02-01", id_bucket=width)
    new = s.filter("is_repeat_session = 0").count()
    assert hist.agg(F.sum("users")).first()[0] == new


def test_gap_of_exactly_the_limit_stays_in_session(spark):
    ev = spark.createDataFrame([
        (1, R.ts("2024-01-01 00:00:00"), 1, "view", 1.0, '{"k": 1}'),
        (2, R.ts("2024-01-01 12:00:00"), 1, "view", 1.0, '{"k": 2}'),   # exactly 12h: same session
        (3, R.ts("2024-01-02 00:00:00.000001"), 1, "view", 1.0, '{"k": 3}'),  # 12h + 1us: new
        (4, R.ts("2024-01-05 00:00:00"), 1, "purchase", 9.99, '{"k": 4}'),
        (5, R.ts("2024-01-05 00:00:00"), 2, "view", 1.0, '{"k": 5}'),
    ], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    for split in (1, 24):
        t = {r["event_id"]: (r["website_session_id"], r["is_start"], r["is_first"])
             for r in fixtures.tag_sessions(ev, split_hours=split).collect()}
        assert t == {1: (1, True, True), 2: (1, False, False), 3: (3, True, False),
                     4: (4, True, False), 5: (5, True, True)}
    o = fixtures.clickstream(ev)["orders"].first()
    assert (o["primary_product_id"], o["items_purchased"], str(o["price_usd"]), str(o["cogs_usd"])) == (
        1, 2, "9.99", "4.00")


def test_legacy_and_fixed_cross_sell_agree_without_repeats(spark):
    # one cart view per session and one period: the fan-out of the original vanishes
    p = R.pageviews(spark, [(1, "2024-01-02 00:00:00", 1, "cart"), (2, "2024-01-02 00:01:00", 1, "ship"),
                            (3, "2024-01-03 00:00:00", 2, "cart")])
    o = R.orders(spark, [(9, "2024-01-02 00:02:00", 1, 1, 2, 50.0)])
    anchors = products.period_tag(p, "cart", "2024-01-01", "2024-01-31", "2024-01-20", ("A", "B"))
    fixed = products.cross_sell_period_summary(anchors, p, o).collect()
    legacy = products.cross_sell_period_summary(anchors, p, o, legacy=True).collect()
    assert fixed == legacy
    assert fixed[0]["sessions"] == 2 and fixed[0]["clickthroughs"] == 1 and fixed[0]["aov"] == 50.0
