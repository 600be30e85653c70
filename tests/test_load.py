"""The keyed load: careless deliveries give the clean tables and a list of what was left out."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from shopflow.operators import pages, traffic
from shopflow.sources.load import load, split
from shopflow.sources.schema import SCHEMAS
from shopflow.sources.tables import ShopTables
from shopflow.sources.testdata import ShopData
from tests.rows import pageviews


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_careless_delivery_gives_the_clean_tables(spark, sf0001):
    d = ShopData(spark, sf0001)
    t = d.delivery()
    for got, clean in ((t.sessions, d.sessions), (t.pageviews, d.pageviews), (t.orders, d.web_orders)):
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in clean.schema]
        assert same(got, clean)
    assert same(traffic.conversion_trend(t.facts, "week"), traffic.conversion_trend(d.facts, "week"))
    assert t.rejects().count() > 0


def test_rows_are_rejected_with_a_reason(spark):
    schema = "website_session_id string, created_at timestamp, user_id int, is_repeat_session double, utm_source string, " \
             "utm_campaign string, device_type string, http_referer string, more string"
    at, later = "TIMESTAMP '2024-01-02 03:04:05'", "TIMESTAMP '2024-01-02 04:00:00'"
    values = [f"('1', {at}, 5, 0D, 'a', null, null, null, 'x')", f"('1', {at}, 5, 0D, 'a', null, null, null, 'y')",
              f"('1', {at}, 5, 0D, 'a', null, null, null, 'z')", f"('1', {later}, 5, 0D, 'a', null, null, null, 'x')",
              f"('2', null, 5, 0D, 'a', null, null, null, 'x')", f"('two', {at}, 5, 0D, 'a', null, null, null, 'x')",
              f"('3', {at}, null, 0.5D, 'a', null, null, null, 'x')", f"(null, {at}, 5, 0D, 'a', null, null, null, 'x')",
              f"('4', {at}, null, null, null, null, null, null, null)"]
    df = spark.sql(f"SELECT * FROM VALUES {', '.join(values)}").toDF(*[c.split()[0] for c in schema.split(", ")])
    got = split(df, "website_sessions")
    assert [f.dataType for f in got.accepted.schema] == [f.dataType for f in SCHEMAS["website_sessions"]]
    assert sorted((r.website_session_id, str(r.created_at), r.user_id) for r in got.accepted.collect()) == [
        (1, "2024-01-02 03:04:05", 5), (4, "2024-01-02 03:04:05", None)]
    rejects = got.rejected.collect()
    assert sorted((r.key or "", r.reason, r.copies) for r in rejects) == [
        ("", "website_session_id is missing", 1), ("1", "other row of the key", 1),
        ("1", "repeated row", 2), ("2", "created_at is missing", 1),
        ("3", "is_repeat_session is not int", 1), ("two", "website_session_id is not bigint", 1)]
    assert all(json.loads(r.row).get("utm_source") == "a" for r in rejects)


@pytest.mark.parametrize("value, kept", [("19.99D", True), ("19.999D", False), ("CAST(3 AS INT)", True), ("'7.5'", True),
                                         ("'7.555'", False), ("'much'", False), ("CAST(1e20 AS DOUBLE)", False),
                                         ("CAST('NaN' AS DOUBLE)", False), ("1.2300BD", True), ("NULL", True)])
def test_money_is_cast_only_where_nothing_is_lost(spark, value, kept):
    df = spark.sql(f"SELECT 1L order_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' created_at, 2L website_session_id, "
                   f"3 primary_product_id, 4L items_purchased, {value} price_usd, 1BD cogs_usd")
    got = split(df, "orders")
    assert (got.accepted.count(), got.rejected.count()) == ((1, 0) if kept else (0, 1))


def test_repeated_views_count_once(spark):
    rows = [(k, f"2024-01-01 00:{k:02}:00", 1, "/a" if k % 2 else "/b") for k in range(1, 11)]
    out = tempfile.mkdtemp(prefix="shopflow-load-")
    pageviews(spark, rows + rows[:4] * 50).write.parquet(f"{out}/views")
    t = ShopTables.from_paths(spark, sessions=f"{out}/none", pageviews=f"{out}/views", orders=f"{out}/none",
                              keyed_load=True)
    views = load(spark, f"{out}/views", "website_pageviews").accepted
    assert same(views, pageviews(spark, rows))
    assert {r.pageview_url: r.sessions for r in pages.top_pages(views, F.lit(True)).collect()} == {"/a": 5, "/b": 5}
    assert load(spark, f"{out}/views", "website_pageviews").rejected.agg(F.sum("copies")).first()[0] == 200
    assert t.keyed_load


def test_empty_table_and_missing_column(spark):
    empty = spark.createDataFrame([], SCHEMAS["order_item_refunds"])
    got = split(empty, "order_item_refunds")
    assert got.accepted.count() == 0 and got.rejected.count() == 0
    with pytest.raises(ValueError, match="order_id"):
        split(empty.drop("order_id"), "order_item_refunds")
