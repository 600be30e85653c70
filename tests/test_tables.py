"""Analyses over the five tables opened from paths, as a deployment does."""

import tempfile

import pytest

from shopflow.operators import traffic
from shopflow.sources.tables import ShopTables
from shopflow.sources.testdata import ShopData


def test_tables_from_paths_give_the_same_results(spark, sf0001):
    d = ShopData(spark, sf0001, materialize=False)
    out = tempfile.mkdtemp(prefix="shopflow-tables-")
    for name, df in [("sessions", d.sessions), ("pageviews", d.pageviews), ("orders", d.web_orders),
                     ("items", d.order_items), ("refunds", d.refunds)]:
        df.write.parquet(f"{out}/{name}")
    t = ShopTables.from_paths(spark, sessions=f"{out}/sessions", pageviews=f"{out}/pageviews",
                              orders=f"{out}/orders", order_items=f"{out}/items", refunds=f"{out}/refunds")
    def names_types(df):
        return [(f.name, f.dataType) for f in df.schema.fields]     # file reads are always nullable
    assert names_types(t.sessions) == names_types(d.sessions)
    a = traffic.conversion_trend(t.facts, "week")
    b = traffic.conversion_trend(d.facts, "week")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert t.refunds.count() == d.refunds.count()


def test_absent_and_mistyped_columns_raise(spark, sf0001):
    from shopflow.sources.schema import read_table
    d = ShopData(spark, sf0001, materialize=False)
    out = tempfile.mkdtemp(prefix="shopflow-tables-")
    d.sessions.withColumnRenamed("utm_source", "source").write.parquet(f"{out}/renamed")
    with pytest.raises(ValueError, match="utm_source"):
        read_table(spark, f"{out}/renamed", "website_sessions")
    d.order_items.withColumn("price_usd", d.order_items["price_usd"].cast("double")).write.parquet(f"{out}/mistyped")
    with pytest.raises(TypeError, match="price_usd"):
        read_table(spark, f"{out}/mistyped", "order_items")
    d.refunds.drop("order_id").write.parquet(f"{out}/short")
    with pytest.raises(ValueError, match="order_id"):
        read_table(spark, f"{out}/short", "order_item_refunds")


def test_repeated_rows_raise(spark, sf0001):
    """A row delivered twice would be counted twice, so it is an error when the facts are built."""
    d = ShopData(spark, sf0001, materialize=False)
    out = tempfile.mkdtemp(prefix="shopflow-tables-")
    d.sessions.unionByName(d.sessions.limit(1)).write.parquet(f"{out}/sessions")
    d.pageviews.write.parquet(f"{out}/pageviews")
    d.web_orders.unionByName(d.web_orders.limit(1)).write.parquet(f"{out}/orders")
    d.sessions.write.parquet(f"{out}/sessions_once")
    with pytest.raises(ValueError, match="website_session_id repeats"):
        ShopTables.from_paths(spark, sessions=f"{out}/sessions", pageviews=f"{out}/pageviews",
                              orders=f"{out}/orders").facts
    t = ShopTables.from_paths(spark, sessions=f"{out}/sessions_once", pageviews=f"{out}/pageviews",
                              orders=f"{out}/orders")
    with pytest.raises(ValueError, match="order_id repeats"):
        t.facts
    with pytest.raises(ValueError, match="order_id repeats"):
        t.check_keys()
