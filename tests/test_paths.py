"""Session paths: the same results as from page views, in rows of two ids and with long sessions kept apart; no shuffle of views."""

import pytest
from pyspark.sql import functions as F

from shopflow.functions import before
from shopflow.operators import funnels, pages, paths, products
from shopflow.operators.grain import session_facts
from shopflow.plans import checks
from shopflow.plans.registry import QUERIES
from shopflow.sources.paths import build_paths, nest_views
from shopflow.sources.testdata import shop_data
from tests import rows as R

URLS = ["/home", "/lander", "/cart", "/billing", "/products"]


@pytest.fixture(scope="module")
def shop(spark):
    """Sessions of 1 to 40 views with ids dealt over all sessions; a view without url, one of an unknown session."""
    sessions, views, orders, n = [], [], [], 0
    for s in range(1, 25):
        source = ("gsearch", "nonbrand") if s % 3 else (None, None)
        sessions.append((s, f"2024-01-{s:02d} 08:00:00", s % 7, int(s > 12), *source, "mobile", None))
        if s % 4 == 0:
            orders.append((900 + s, f"2024-01-{s:02d} 10:00:00", s, 1, 2, 10.5 + s))
    for step in range(40):
        for s in range(1, 25):
            if s != 9 and step < (s * s) % 41:
                n += 1
                url = URLS[(s * 7 + step * step) % 5] if (s, step) != (5, 1) else None
                views.append((n, f"2024-01-{s:02d} 08:{step:02d}:00", s, url))
    views.append((n + 5, "2024-01-30 09:00:00", 777, "/lander"))
    return R.sessions(spark, sessions), R.pageviews(spark, views), R.orders(spark, orders)


ANCHORS = {"url": "/cart", "lo": "2024-01-02", "hi": "2024-01-24", "cut": "2024-01-11", "labels": ("a", "b")}
WHERE_SQL = "utm_source = 'gsearch'"
STEPS = {"x": "/cart", "y": "/billing"}


def cases(s, pv, o, p):
    WHERE = F.expr(WHERE_SQL)
    anchors = products.period_tag(pv, "/cart", "2024-01-02", "2024-01-24", "2024-01-11", ("a", "b"))
    picked = pv.filter(F.col("pageview_url").isin("/cart", "/billing") & (F.col("created_at") < F.lit("2024-01-20").cast("timestamp_ntz")))
    cut = "2024-01-15"
    return {
        "first_pageview": (pages.first_pageview(pv, before("created_at", cut)), paths.first_pageview(p, paths.seen_before(cut))),
        "landing_page": (pages.landing_page(pv, before("created_at", cut)), paths.landing_page(p, paths.seen_before(cut))),
        "top_entry_pages": (pages.top_entry_pages(pv), paths.top_entry_pages(p)),
        "bounced_sessions": (pages.bounced_sessions(pv), paths.bounced_sessions(p)),
        "bounce_rate": (pages.bounce_rate(pv, before("created_at", cut)), paths.bounce_rate(p, paths.seen_before(cut))),
        "bounce_rate_by_landing": (pages.bounce_rate_by_landing(s, pv, ["/home", "/lander"], "/lander", WHERE),
                                   paths.bounce_rate_by_landing(p, ["/home", "/lander"], "/lander", WHERE)),
        "exclusive": (pages.bounce_rate_by_landing(s, pv, ["/home", "/lander"], "/lander", WHERE, False),
                      paths.bounce_rate_by_landing(p, ["/home", "/lander"], "/lander", WHERE, False)),
        "weekly_bounce_trend": (pages.weekly_bounce_trend(s, pv, ["/home", "/lander"], session_where=WHERE),
                                paths.weekly_bounce_trend(p, ["/home", "/lander"], where=WHERE)),
        "qualifying_pageviews": (pages.qualifying_pageviews(s, pv, WHERE), paths.qualifying_pageviews(p, WHERE)),
        "funnel_flags": (funnels.funnel_flags(s, pv, STEPS, WHERE), paths.funnel_flags(p, STEPS, WHERE)),
        "page_version_conversion": (funnels.page_version_conversion(pv, o, ["/cart", "/billing"], "2024-01-22"),
                                    paths.page_version_conversion(p, ["/cart", "/billing"], "2024-01-22")),
        "next_pageview": (products.next_pageview(anchors, pv), paths.next_pageview(p, **ANCHORS)),
        "clickthrough_after": (products.clickthrough_after(anchors, pv), paths.clickthrough_after(p, **ANCHORS)),
        "cross_sell": (products.cross_sell_period_summary(anchors, pv, o), paths.cross_sell_period_summary(p, **ANCHORS)),
        "cross_sell_legacy": (products.cross_sell_period_summary(anchors, pv, o, legacy=True),
                              paths.cross_sell_period_summary(p, legacy=True, **ANCHORS)),
        "pages_after": (products.pages_after(pv, picked), paths.pages_after(
            p, paths.both(paths.of_url(["/cart", "/billing"]), paths.seen_before("2024-01-20")))),
        "product_funnel_counts": (products.product_funnel_counts(pv, {"c": "/cart", "p": "/products"}, ["/billing"], "2024-01-05", "2024-01-20"),
                                  paths.product_funnel_counts(p, {"c": "/cart", "p": "/products"}, ["/billing"], "2024-01-05", "2024-01-20")),
        "listing_page_trend": (products.listing_page_trend(pv, o, "/lander", "week"), paths.listing_page_trend(p, "/lander", "week")),
    }


@pytest.fixture(scope="module", params=[(1 << 16, 1 << 16), (50, 20), (3, 1 << 16), (2, 0)], ids=str)
def both(request, spark, shop):
    s, pv, o = shop
    chunk, long = request.param
    p = build_paths(spark, session_facts(s, o), pv, "test", 0, chunk, long, name="test_paths")
    assert (p.long is None) == (long == 1 << 16)
    return cases(s, pv, o, p)


@pytest.mark.parametrize("name", ["first_pageview", "landing_page", "top_entry_pages", "bounced_sessions", "bounce_rate",
                                  "bounce_rate_by_landing", "exclusive", "weekly_bounce_trend", "qualifying_pageviews",
                                  "funnel_flags", "page_version_conversion", "next_pageview", "clickthrough_after", "cross_sell",
                                  "cross_sell_legacy", "pages_after", "product_funnel_counts", "listing_page_trend"])
def test_same_as_from_page_views(both, name):
    want, got = both[name]
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) != []


def test_rows_are_bounded(spark, shop):
    nested = nest_views(shop[1], 10)
    assert nested.agg(F.max(F.size("views"))).first()[0] <= 10
    assert nested.agg(F.sum(F.size("views"))).first()[0] == shop[1].count()


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("paths_")))
def test_no_page_view_moves(spark, sf0001, no_broadcast, name):
    """What is shuffled has been grouped by something else than the session, as a partial aggregate."""
    keys = checks.shuffle_keys(QUERIES[name](spark, sf0001))
    assert not [k for k in keys if "session_id" in k]


@pytest.mark.parametrize("name", ["paths_first_pageview", "paths_landing_page", "paths_funnel_flags", "paths_qualifying_pageviews",
                                  "paths_next_pageview"])
def test_no_shuffle_at_all(spark, sf0001, no_broadcast, name):
    assert checks.shuffle_keys(QUERIES[name](spark, sf0001)) == []


def test_bucketed_joins_do_not_shuffle(spark, sf0001, no_broadcast):
    assert not [k for k in checks.shuffle_keys(QUERIES["buckets_refund_rate_trend"](spark, sf0001)) if "order_item_id" in k]
    assert not [k for k in checks.shuffle_keys(QUERIES["buckets_cross_sell_matrix"](spark, sf0001)) if "order_id" in k]


def test_buckets_are_known_to_a_new_session(spark, sf0001, no_broadcast):
    """Files written before are opened with their buckets where the catalog does not know them."""
    shop = shop_data(spark, sf0001)
    shop.items_and_refunds
    for t in spark.catalog.listTables():
        if t.name.startswith("shopflow_"):
            spark.sql(f"DROP TABLE {t.name}")
    del shop.items_and_refunds
    items, refunds = shop.items_and_refunds
    assert checks.shuffle_keys(items.join(refunds, "order_item_id")) == []
    assert items.count() == shop.order_items.count()
    shop.__dict__.pop("paths", None)
    shop.__dict__.pop("orders_and_items", None)


def test_paths_of_a_deployment(spark, sf0001):
    t = shop_data(spark, sf0001).deployment()
    got = paths.bounce_rate(t.session_paths).collect()
    assert got == pages.bounce_rate(t.pageviews).collect()
    assert t.items_and_refunds[1].count() == t.refunds.count()
    assert t.orders_and_items[0].count() == t.orders.count()
