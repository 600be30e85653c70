"""Distinct counts from words: repeated rows, odd ids, merging over days, refresh by changed days."""

import datetime as dt
import tempfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopflow.operators import distinct
from shopflow.sources.daily import DailyWords, land
from shopflow.sources.schema import SCHEMAS
from shopflow.sources.tables import ShopTables


def at(day, hour=12, month=1):
    return dt.datetime(2024, month, day, hour)


def session(sid, when, source="gsearch", device="mobile"):
    return (sid, when, 1, 0, source, "nonbrand", device, None)


def sessions_of(spark, rows):
    return spark.createDataFrame(rows, "website_session_id bigint, created_at timestamp_ntz, user_id bigint, is_repeat_session int, "
                                 "utm_source string, utm_campaign string, device_type string, http_referer string")


def orders_of(spark, rows):
    return spark.createDataFrame(rows, "order_id bigint, website_session_id bigint, created_at timestamp_ntz")


def counted(df):
    return sorted(tuple(r) for r in df.collect())


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]),
                          st.one_of(st.none(), st.integers(-130, 130), st.integers(-2**63, 2**63 - 1)))))
def test_words_count_distinct_ids(spark, rows):
    df = spark.createDataFrame(rows * 2, "k string, id bigint")
    want = df.groupBy("k").agg(F.countDistinct("id").alias("n"))
    got = distinct.count_words(distinct.id_words(df, "id", ["k"]), ["k"], {"n": None})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rows_that_repeat_on_several_days_count_once_a_month(spark):
    s = sessions_of(spark, [session(1, at(2)), session(1, at(2)), session(1, at(3)), session(1, at(3, month=2)),
                            session(2, at(2), device="desktop"), session(None, at(4)), session(3, None)])
    o = orders_of(spark, [(10, 1, at(2)), (10, 1, at(2)), (11, 1, at(2)), (12, 9, at(2)), (None, 2, at(2)), (13, None, at(2))])
    words = distinct.session_words(s, o)
    assert counted(distinct.volume_trend(words.where("day IS NOT NULL"), "month")) == [(2024, 1, 2, 2), (2024, 2, 1, 2)]
    days = distinct.volume_trend(words, "day", F.col("day") < "2024-02-01")
    assert counted(days) == [(dt.date(2024, 1, 2), 2, 2), (dt.date(2024, 1, 3), 1, 2), (dt.date(2024, 1, 4), 0, 0)]
    bought = distinct.volume_trend(words, "year", F.col("day").isNotNull(), orders_as="sessions_with_order")
    assert counted(bought) == [(2024, 2, 1)]
    assert [tuple(r) for r in distinct.volume_trend(words, "year", F.col("day").isNull()).collect()] == [(None, 1, 0)]
    mobile = distinct.channel_characteristics(words).first()
    assert (mobile["sessions"], mobile["mobile_sessions"]) == (3, 2)


def test_empty_tables_and_unknown_counts(spark):
    words = distinct.session_words(sessions_of(spark, []), orders_of(spark, []))
    assert distinct.conversion_trend(words).collect() == []
    assert distinct.top_pages(distinct.page_words(spark.createDataFrame([], SCHEMAS["website_pageviews"]))).collect() == []
    with pytest.raises(ValueError):
        distinct.volume_trend(words, "month", orders_as="other")


def test_many_repeats_on_both_sides_do_not_multiply(spark):
    s = sessions_of(spark, [session(1, at(2))]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(30_000)))).drop("n")
    o = orders_of(spark, [(10, 1, at(2))]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(30_000)))).drop("n")
    assert counted(distinct.volume_trend(distinct.session_words(s, o), "month")) == [(2024, 1, 1, 1)]


def test_counts_need_no_expand(spark, sf0001):
    from shopflow.sources.testdata import ShopData
    words = ShopData(spark, sf0001).daily_words.read()
    plan = distinct.segment_trend(words, "device_type", ["mobile", "desktop"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Join" not in plan and "SortAggregate" not in plan
    assert plan.count("Exchange") == 2


def test_refresh_rebuilds_the_days_that_rows_were_added_to(spark):
    root = tempfile.mkdtemp(prefix="shopflow-test-words-")
    days = [session(i, at(2 + i % 3)) for i in range(1, 200)]
    land(sessions_of(spark, days), f"{root}/sessions")
    land(orders_of(spark, [(i, i, at(2 + i % 3)) for i in range(1, 200, 5)])
         .select(*[F.col(f.name) if f.name in ("order_id", "website_session_id", "created_at")
                   else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS["orders"]]), f"{root}/orders")
    kept = DailyWords(spark, f"{root}/sessions", f"{root}/orders", f"words-{root[-8:]}")
    assert kept.refresh() == ["2024-01-02", "2024-01-03", "2024-01-04"]
    clean = counted(distinct.volume_trend(kept.read(), "month"))
    assert clean == [(2024, 1, 199, 40)]
    land(sessions_of(spark, days[:40]).where("website_session_id % 3 = 0"), f"{root}/sessions")  # rows of one day again
    assert kept.refresh() == ["2024-01-02"]
    assert counted(distinct.volume_trend(kept.read(), "month")) == clean
    land(sessions_of(spark, [session(6, at(9))]), f"{root}/sessions")  # a session of the 2nd again, on the 9th
    assert kept.refresh() == ["2024-01-09"]
    assert counted(distinct.volume_trend(kept.read(), "month")) == clean
    assert counted(distinct.volume_trend(kept.read("2024-01-09"), "day")) == [(dt.date(2024, 1, 9), 1, 1)]  # with its order
    assert kept.refresh() == []


def test_tables_with_repeated_rows_need_no_check(spark, sf0001):
    from shopflow.sources.testdata import ShopData
    d = ShopData(spark, sf0001)
    root = tempfile.mkdtemp(prefix="shopflow-test-repeats-")
    for name, df in (("sessions", d.sessions), ("pageviews", d.pageviews), ("orders", d.web_orders)):
        df.unionAll(df).write.parquet(f"{root}/{name}")
    t = ShopTables.from_paths(spark, **{n: f"{root}/{n}" for n in ("sessions", "pageviews", "orders")})
    with pytest.raises(ValueError):
        t.facts
    once = distinct.session_words(d.sessions, d.web_orders)
    assert counted(distinct.volume_trend(t.session_words, "week")) == counted(distinct.volume_trend(once, "week"))
    want = d.pageviews.groupBy("pageview_url").count()
    assert counted(distinct.top_pages(t.page_words)) == counted(want)
