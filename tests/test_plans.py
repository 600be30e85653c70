"""Plan shape of every registered query."""

import pytest

from shopflow.plans import checks
from shopflow.plans.registry import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_unscalable_plan_shapes(spark, sf0001, name):
    df = QUERIES[name](spark, sf0001)
    assert checks.problems(df) == []


def test_filters_reach_the_scan(spark, sf0001):
    df = QUERIES["volume_trend"](spark, sf0001)
    pushed = " ".join(checks.pushed_filters(df))
    assert "utm_source" in pushed and "created_at" in pushed


def test_columns_are_pruned(spark, sf0001):
    df = QUERIES["channel_characteristics"](spark, sf0001)
    schemas = checks.read_schemas(df)
    assert schemas and all("http_referer" not in s and "user_id" not in s for s in schemas)


@pytest.mark.parametrize("name,scans", [("cross_sell_period_summary", 3), ("cross_sell_period_summary_legacy", 3),
                                        ("pages_after", 2), ("listing_page_trend", 2), ("bounce_rate_by_landing", 4),
                                        ("repeat_sessions", 4), ("landing_test_lift", 3), ("page_test_value", 2)])
def test_scans_where_no_side_is_small(spark, sf0001, name, scans):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        assert checks.digest(QUERIES[name](spark, sf0001))["scans"] <= scans
    finally:
        spark.conf.set(key, before)


def test_sessions_are_chosen_before_views_are_aggregated(spark, sf0001):
    """The views of other sessions are dropped by a semi join below the aggregate, not after it."""
    text = checks.plan_text(QUERIES["weekly_bounce_trend"](spark, sf0001), "simple")
    last_aggregate = max(i for i, line in enumerate(text.splitlines()) if "Aggregate(key" in line and "[website_session_id#" in line)
    assert "LeftSemi" in "".join(text.splitlines()[last_aggregate:])


def test_ranked_users_are_not_sorted_as_a_whole(spark, sf0001):
    text = checks.plan_text(QUERIES["customer_value_top"](spark, sf0001))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
