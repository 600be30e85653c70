"""What the written shop tables cost: only tables that are read get written, in buckets that bound a task's memory."""

import os
import shutil
import tempfile

import pytest

from shopflow.plans import checks
from shopflow.plans.registry import QUERIES
from shopflow.session import checkpoint_dir
from shopflow.sources import fixtures, store
from shopflow.sources.testdata import ShopData


@pytest.fixture
def fresh(spark, sf0001):
    """A copy of the smallest tables of which nothing is written yet."""
    folder = tempfile.mkdtemp(prefix="shopflow-layout-")
    for t in ("events", "orders", "lineitem", "part"):
        shutil.copyfile(f"{sf0001}/{t}.parquet", f"{folder}/{t}.parquet")
    return folder


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def written(spark) -> set[str]:
    """Folders of derived tables, such as ``sessions-<signature>``."""
    return set(os.listdir(f"{checkpoint_dir(spark).removeprefix('file:').rstrip('/')}/shopflow"))


@pytest.mark.parametrize("name,tables", [
    ("tables_distinct_values_rows", {"tagged", "sessions"}), ("tables_top_pages", {"tagged", "pageviews"})])
def test_a_deployment_writes_the_tables_that_are_read(spark, fresh, sf0001, name, tables):
    QUERIES["volume_trend"](spark, sf0001)   # the shared folder exists
    before = written(spark)
    got = QUERIES[name](spark, fresh)
    assert {n.split("-")[0] for n in written(spark) - before} == tables
    want = QUERIES[name.removeprefix("tables_")](spark, fresh)
    assert got.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_commerce_analyses_write_no_other_table(spark, fresh, sf0001):
    QUERIES["volume_trend"](spark, sf0001)
    before = written(spark)
    QUERIES["tables_product_revenue_trend"](spark, fresh)
    assert {n.split("-")[0] for n in written(spark) - before} == {"shop_items"}
    QUERIES["sales_trend"](spark, fresh)
    assert {n.split("-")[0] for n in written(spark) - before} == {"shop_items", "shop_orders"}


@pytest.mark.parametrize("name", ["cross_sell_matrix", "buckets_cross_sell_matrix"])
def test_orders_and_items_are_written_by_order(spark, sf0001, no_broadcast, name):
    assert not [k for k in checks.shuffle_keys(QUERIES[name](spark, sf0001)) if "order_id" in k]


@pytest.mark.parametrize("shuffles", ["3", "8", "12"])
def test_line_items_are_dealt_twice(spark, sf0001, no_broadcast, shuffles):
    """By part and by order, whatever shuffles have by default; orders once and parts once."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        d = ShopData(spark, sf0001)
        n = store.dealt_count(spark, 8)
        assert n % 8 == 0 and n >= int(shuffles)
        items = fixtures.commerce_items(d.raw("orders"), d.raw("lineitem"), d.raw("part"), n)
        assert len(checks.shuffle_keys(items)) == 4
        plain = fixtures.commerce_items(d.raw("orders"), d.raw("lineitem"), d.raw("part"))
        assert items.exceptAll(plain).count() == 0 and plain.exceptAll(items).count() == 0
        # the orders are dealt to the buckets of the items
        orders = fixtures.commerce_from_items(d.raw("orders"), d._flagged_items, 8)["orders"]
        assert [k for k in checks.shuffle_keys(orders) if "order" in k] == ["o_orderkey"]
        lazy = ShopData(spark, sf0001, materialize=False).shop_orders
        assert d.shop_orders.exceptAll(lazy).count() == 0 and lazy.exceptAll(d.shop_orders).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_bucket_of_dealt_rows_is_whole(spark):
    """Two partitions a bucket: the rows of a key are in one bucket, and a join by key sees all of them."""
    sig = "test-" + os.urandom(4).hex()
    rows = spark.range(1000).selectExpr("id % 100 AS k", "id AS v")
    a = store.materialize_bucketed(spark, lambda: rows.repartition(16, "k"), "probe_dealt", sig, "k", 8, dealt=True)
    assert {(r.k, r["count"]) for r in a.groupBy("k").count().collect()} == {(k, 10) for k in range(100)}
    assert checks.shuffle_keys(a.groupBy("k").count()) == []


def test_the_memory_of_a_bucket_does_not_grow_with_the_input():
    """Line items of sf 0.6, 6 and 36 (about 0.1, 1 and 6 GB of tables): at most 16 MB of files for each bucket."""
    for mb in (65, 645, 3872):
        assert (mb << 20) / store.bucket_count(mb << 20) <= 16 << 20
    assert store.bucket_count(0) == 8 and store.bucket_count(1 << 50) <= 100_000  # Spark's most
