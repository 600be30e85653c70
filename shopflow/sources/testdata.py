"""The web-shop tables built from a folder of test Parquet tables.

``ShopData(spark, folder)`` exposes the clickstream tables (sessions, page
views, web orders, session facts) and the commerce tables (orders, items,
refunds). With ``materialize=True`` each derived table is written once to
the shared checkpoint folder (see :mod:`shopflow.sources.store`) and read
back, so many analyses share one sessionisation; with ``False`` every
table is a lazy plan over the raw files.
"""

from __future__ import annotations

import warnings
from functools import cached_property

from pyspark.errors import PySparkAttributeError, PySparkNotImplementedError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.operators import distinct
from shopflow.operators.grain import session_facts
from shopflow.sources import fixtures, store
from shopflow.sources.daily import DailyFacts, DailyWords, land, read_days
from shopflow.sources.paths import SessionPaths, build_paths, nest_views
from shopflow.sources.tables import ShopTables, partitioned_pair

RAW_TABLES = ("events", "orders", "lineitem", "part")


class ShopData:
    def __init__(self, spark: SparkSession, folder: str, materialize: bool = True,
                 gap: str = "12 hours", split_hours: int = 24):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.materialize = materialize
        self.gap = gap
        self.split_hours = split_hours

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _sig(self, *names: str) -> str:
        paths = [f"{self.folder}/{n}.parquet" for n in names]
        return store.input_signature(self.spark, paths) + f"-{self.gap.replace(' ', '')}"

    def _size(self, name: str) -> int:
        return store.input_size(self.spark, f"{self.folder}/{name}.parquet")

    # clickstream -----------------------------------------------------------
    @cached_property
    def _lazy_click(self) -> dict[str, DataFrame]:
        return fixtures.clickstream(self.raw("events"), self.gap, self.split_hours)

    def _click(self, table: str, short: str, make) -> DataFrame:
        """One clickstream table: the first one asked for writes the sessionised events that feed them all."""
        if not self.materialize:
            return self._lazy_click[table]
        sig = self._sig("events")

        def tagged() -> DataFrame:
            return store.materialize(self.spark, lambda: fixtures.tag_sessions(self.raw("events"), self.gap,
                                                                               self.split_hours), "tagged", sig)
        return store.materialize(self.spark, lambda: make(tagged()), short, sig, cluster_by="created_at",
                                 input_bytes=self._size("events"))

    @cached_property
    def sessions(self) -> DataFrame:
        return self._click("website_sessions", "sessions", fixtures.sessions_from_tagged)

    @cached_property
    def pageviews(self) -> DataFrame:
        return self._click("website_pageviews", "pageviews", fixtures.pageviews_from_tagged)

    @cached_property
    def web_orders(self) -> DataFrame:
        return self._click("orders", "web_orders", fixtures.web_orders_from_tagged)

    @cached_property
    def facts(self) -> DataFrame:
        if not self.materialize:
            return session_facts(self.sessions, self.web_orders)
        return store.materialize(self.spark, lambda: session_facts(self.sessions, self.web_orders),
                                 "session_facts", self._sig("events"), cluster_by="created_at",
                                 input_bytes=self._size("events"))

    @cached_property
    def paths(self) -> SessionPaths:
        """Page views nested by session, next to the session facts in the same buckets."""
        if not self.materialize:
            return SessionPaths(nest_views(self.pageviews), self.facts)
        return build_paths(self.spark, self.facts, self.pageviews, self._sig("events"), self._size("events"))

    @cached_property
    def landed(self) -> dict[str, str]:
        """Sessions, page views and web orders in day folders, written once."""
        root = store.table_path(self.spark, "landed", self._sig("events"))

        def write(folder: str) -> None:
            for name, df in (("website_sessions", self.sessions), ("website_pageviews", self.pageviews),
                             ("orders", self.web_orders)):
                land(df, f"{folder}/{name}")
        found = store._attempt(self.spark, root, write)
        return {name: f"{found}/{name}" for name in ("website_sessions", "website_pageviews", "orders")}

    def landed_pageviews(self) -> DataFrame:
        return read_days(self.spark, self.landed["website_pageviews"], "website_pageviews")

    @cached_property
    def daily(self) -> DailyFacts:
        """Session facts by day over the landed tables."""
        facts = DailyFacts(self.spark, self.landed["website_sessions"], self.landed["orders"],
                           f"daily_facts-{self._sig('events')}")
        facts.refresh()
        return facts

    @cached_property
    def repeated(self) -> dict[str, str]:
        """Sessions, page views and web orders in day folders, many rows landed two or three times."""
        root = store.table_path(self.spark, "repeated", self._sig("events"))

        def write(folder: str) -> None:
            for name, df, key in (("website_sessions", self.sessions, "website_session_id"),
                                  ("website_pageviews", self.pageviews, "website_pageview_id"),
                                  ("orders", self.web_orders, "order_id")):
                land(df, f"{folder}/{name}")
                land(df.where(F.col(key) % 3 == 0).unionAll(df.where(F.col(key) % 6 == 0)), f"{folder}/{name}")
        found = store._attempt(self.spark, root, write)
        return {name: f"{found}/{name}" for name in ("website_sessions", "website_pageviews", "orders")}

    @cached_property
    def daily_words(self) -> DailyWords:
        """Session words by day over the tables with repeated rows."""
        words = DailyWords(self.spark, self.repeated["website_sessions"], self.repeated["orders"],
                           f"daily_words-{self._sig('events')}")
        words.refresh()
        return words

    @cached_property
    def page_words(self) -> DataFrame:
        """Page-view words by url and day over the page views with repeated rows."""
        return store.materialize(
            self.spark, lambda: distinct.page_words(read_days(self.spark, self.repeated["website_pageviews"],
                                                              "website_pageviews")),
            "page_words", self._sig("events"), cluster_by="day", input_bytes=self._size("events"))

    # commerce --------------------------------------------------------------
    @cached_property
    def _lazy_commerce(self) -> dict[str, DataFrame]:
        return fixtures.commerce(self.raw("orders"), self.raw("lineitem"), self.raw("part"))

    @property
    def _shop(self) -> tuple[str, int]:
        """Signature and number of buckets of the commerce tables."""
        return self._sig("orders", "lineitem", "part"), store.bucket_count(self._size("lineitem"))

    @cached_property
    def _flagged_items(self) -> DataFrame:
        """Order items with their return flag, written in buckets of the order: the other tables are derived from it."""
        sig, n = self._shop
        return store.materialize_bucketed(self.spark, lambda: fixtures.commerce_items(
            self.raw("orders"), self.raw("lineitem"), self.raw("part"), store.dealt_count(self.spark, n)),
            "shop_items", sig, "order_id", n, dealt=True)

    @cached_property
    def shop_orders(self) -> DataFrame:
        if not self.materialize:
            return self._lazy_commerce["orders"]
        sig, n = self._shop
        return store.materialize_bucketed(self.spark, lambda: fixtures.commerce_from_items(
            self.raw("orders"), self._flagged_items, n)["orders"], "shop_orders", sig, "order_id", n)

    @cached_property
    def order_items(self) -> DataFrame:
        return self._flagged_items.drop("l_returnflag") if self.materialize else self._lazy_commerce["order_items"]

    @cached_property
    def refunds(self) -> DataFrame:
        if not self.materialize:
            return self._lazy_commerce["order_item_refunds"]
        return fixtures.commerce_from_items(self.raw("orders"), self._flagged_items)["order_item_refunds"]

    @cached_property
    def items_and_refunds(self) -> tuple[DataFrame, DataFrame]:
        """Order items and refunds in the same buckets of the item id."""
        return self._pair("order_item_id", shop_items=self.order_items, shop_refunds=self.refunds)

    @property
    def orders_and_items(self) -> tuple[DataFrame, DataFrame]:
        """Orders and order items in the same buckets of the order id, as they are written."""
        return self.shop_orders, self.order_items

    def _pair(self, key: str, **tables: DataFrame) -> tuple[DataFrame, DataFrame]:
        if not self.materialize:
            return tuple(tables.values())
        return partitioned_pair(self.spark, key, self._sig("orders", "lineitem", "part"), self._size("lineitem"), **tables)

    def deployment(self, *tables: str) -> ShopTables:
        """The written tables (or those named), opened from their paths as a deployment opens its own."""
        (shop, n), click = self._shop, self._sig("events")

        def path(name: str, sig: str) -> str:
            return store.current(self.spark, store.table_path(self.spark, name, sig))

        def items() -> str:
            self._flagged_items  # written by now
            return store.current(self.spark, store.bucketed_path(self.spark, "shop_items", shop, n))

        def refunds() -> str:
            store.materialize(self.spark, lambda: self.refunds, "shop_order_item_refunds", shop)
            return path("shop_order_item_refunds", shop)
        paths = {"sessions": lambda: (self.sessions, path("sessions", click))[1],
                 "pageviews": lambda: (self.pageviews, path("pageviews", click))[1],
                 "orders": lambda: (self.web_orders, path("web_orders", click))[1],
                 "order_items": items, "refunds": refunds}
        return ShopTables.from_paths(self.spark, **{name: paths[name]() for name in tables or paths})

    def delivery(self) -> ShopTables:
        """The clickstream tables as a careless delivery, opened by the keyed load: see :func:`fixtures.careless`."""
        tables = {"sessions": self.sessions, "pageviews": self.pageviews, "orders": self.web_orders}
        keys = {"sessions": "website_session_id", "pageviews": "website_pageview_id", "orders": "order_id"}
        sig = self._sig("events")
        for name, df in tables.items():
            store.materialize(self.spark, lambda d=df, n=name: fixtures.careless(d, keys[n]), f"careless_{name}", sig)
        return ShopTables.from_paths(self.spark, keyed_load=True, **{
            name: store.current(self.spark, store.table_path(self.spark, f"careless_{name}", sig)) for name in tables})


_CACHE: dict = {}


def shop_data(spark: SparkSession, folder: str, materialize: bool = True) -> ShopData:
    """One :class:`ShopData` per (application, folder, state of the input files, mode).

    The input files are looked at on each call, so a table that grew within
    the session gives new derived tables. A remote session has no access to
    the shared folder; there the tables stay lazy plans, with a warning.
    """
    folder = folder.rstrip("/")
    if materialize:
        try:
            app = spark.sparkContext.applicationId
        except (PySparkAttributeError, PySparkNotImplementedError):
            warnings.warn("remote session: derived tables are not materialised", stacklevel=2)
            materialize = False
    if not materialize:
        return ShopData(spark, folder, False)
    key = (app, folder, store.input_signature(spark, [f"{folder}/{t}.parquet" for t in RAW_TABLES]))
    if key not in _CACHE:
        _CACHE[key] = ShopData(spark, folder)
    return _CACHE[key]
