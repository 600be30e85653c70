"""The five web-shop tables of a real deployment, opened from their paths.

``ShopTables.from_paths(spark, ...)`` reads each table with its declared
schema (no inference) and offers the session fact table that most analyses
read, materialised once in the shared checkpoint folder (see
:mod:`shopflow.sources.store`) and clustered by time, keyed by the size
and modification time of the input files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession

from shopflow.operators import distinct
from shopflow.operators.grain import session_facts
from shopflow.sources import store
from shopflow.sources.load import Delivery, load
from shopflow.sources.paths import SessionPaths, build_paths, nest_views
from shopflow.sources.schema import check_unique, read_table


def partitioned_pair(spark: SparkSession, key: str, signature: str, input_bytes: int,
                     **tables: DataFrame) -> tuple[DataFrame, ...]:
    """The named tables in the same buckets of ``key``: they join on it without a shuffle."""
    n = store.bucket_count(input_bytes)
    return tuple(store.materialize_bucketed(spark, lambda t=table: t, f"{name}_by_{key}", signature, key, n)
                 for name, table in tables.items())


@dataclass
class ShopTables:
    spark: SparkSession
    paths: dict[str, str]
    materialize: bool = True
    keyed_load: bool = False

    @classmethod
    def from_paths(cls, spark: SparkSession, *, sessions: str | None = None, pageviews: str | None = None,
                   orders: str | None = None, order_items: str | None = None, refunds: str | None = None,
                   materialize: bool = True, keyed_load: bool = False) -> ShopTables:
        """The tables at these paths; analyses need only those that they read.

        With ``keyed_load`` they are deliveries: columns in other types are cast,
        rows that cannot be used or repeat a key go to :meth:`rejects` (see
        :mod:`shopflow.sources.load`). Without it such tables raise.
        """
        paths = {"website_sessions": sessions, "website_pageviews": pageviews, "orders": orders,
                 "order_items": order_items, "order_item_refunds": refunds}
        return cls(spark, {name: path for name, path in paths.items() if path}, materialize, keyed_load)

    @cached_property
    def _deliveries(self) -> dict[str, Delivery]:
        return {name: load(self.spark, path, name, self.materialize) for name, path in self.paths.items()}

    def rejects(self) -> DataFrame:
        """The rows of all deliveries that were left out: table_name, reason, key, copies, row."""
        return reduce(DataFrame.unionByName, [d.rejected for d in self._deliveries.values()])

    def table(self, name: str) -> DataFrame:
        if self.keyed_load:
            return self._deliveries[name].accepted
        return read_table(self.spark, self.paths[name], name)

    @property
    def sessions(self) -> DataFrame:
        return self.table("website_sessions")

    @property
    def pageviews(self) -> DataFrame:
        return self.table("website_pageviews")

    @property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @property
    def order_items(self) -> DataFrame:
        return self.table("order_items")

    @property
    def refunds(self) -> DataFrame:
        return self.table("order_item_refunds")

    def check_keys(self) -> None:
        """Raise when a key of any opened table repeats; one aggregate over each table."""
        for name in self.paths:
            check_unique(self.table(name), name)

    def _facts(self) -> DataFrame:
        if self.keyed_load:
            return session_facts(self.sessions, self.orders)
        return session_facts(check_unique(self.sessions, "website_sessions"), check_unique(self.orders, "orders"))

    @cached_property
    def facts(self) -> DataFrame:
        """Sessions with their order count, revenue and items (one row per session).

        Building them checks that session and order ids are unique.
        """
        if not self.materialize:
            return self._facts()
        return store.materialize(self.spark, self._facts, "session_facts_tables",
                                 self._signature("website_sessions", "orders"), cluster_by="created_at",
                                 input_bytes=self._size("website_sessions"))

    def _signature(self, *names: str) -> str:
        found = store.input_signature(self.spark, [self.paths[n] for n in names])
        return f"{found}-loaded" if self.keyed_load else found

    def _size(self, *names: str) -> int:
        return sum(store.input_size(self.spark, self.paths[n]) for n in names)

    @cached_property
    def session_paths(self) -> SessionPaths:
        """Page views nested by session, next to the session facts in the same buckets."""
        if not self.materialize:
            return SessionPaths(nest_views(self.pageviews), self.facts)
        names = ("website_sessions", "website_pageviews", "orders")
        return build_paths(self.spark, self.facts, self.pageviews, self._signature(*names),
                           self._size("website_pageviews"), name="table_paths")

    @cached_property
    def session_words(self) -> DataFrame:
        """Sets of session and order ids by day and channel, right where rows repeat (no key check)."""
        return self._words("session_words", lambda: distinct.session_words(self.sessions, self.orders),
                           "website_sessions", "orders")

    @cached_property
    def page_words(self) -> DataFrame:
        """Sets of page-view ids by url and day, right where rows repeat (no key check)."""
        return self._words("page_words", lambda: distinct.page_words(self.pageviews), "website_pageviews")

    def _words(self, name: str, build, *tables: str) -> DataFrame:
        if not self.materialize:
            return build()
        return store.materialize(self.spark, build, f"{name}_tables", self._signature(*tables), cluster_by="day",
                                 input_bytes=self._size(*tables))

    @cached_property
    def items_and_refunds(self) -> tuple[DataFrame, DataFrame]:
        """Order items and refunds in the same buckets of the item id."""
        return self._pair("order_item_id", order_items=self.order_items, order_item_refunds=self.refunds)

    @cached_property
    def orders_and_items(self) -> tuple[DataFrame, DataFrame]:
        """Orders and order items in the same buckets of the order id."""
        return self._pair("order_id", orders=self.orders, order_items=self.order_items)

    def _pair(self, key: str, **tables: DataFrame) -> tuple[DataFrame, ...]:
        if not self.materialize:
            return tuple(tables.values())
        return partitioned_pair(self.spark, key, self._signature(*tables), self._size(*tables), **tables)
