"""Session paths: the page views of a session as one ordered array, next to the session's facts.

``build_paths`` nests the page views by session: a row holds the views of a
session with ids of one range of ``chunk_ids``, in id order, so a row has at
most ``chunk_ids`` views however long the session is. The rows are bucketed by
session, and so are the session facts: page analyses read both without moving
a page view. Sessions of more than ``long_views`` views would make their bucket
large; their rows are kept apart, in files that any task can read, and only
what an analysis needs of each row is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.operators.pages import PVID, SID
from shopflow.sources import store

CHUNK_IDS = 1 << 16
LONG_VIEWS = 1 << 16


def nest_views(pageviews: DataFrame, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """``website_session_id, chunk, views``: page views in id order, one row per session and range of ids."""
    view = F.struct(F.col(PVID).alias("id"), F.col("created_at").alias("at"), F.col("pageview_url").alias("url"))
    return (pageviews.groupBy(SID, F.floor(F.col(PVID) / chunk_ids).alias("chunk"))
            .agg(F.array_sort(F.collect_list(view)).alias("views")))


@dataclass
class SessionPaths:
    """``short`` (bucketed by session), ``long`` (None without long sessions) and the ``sessions`` with
    their orders and ``is_long``."""

    short: DataFrame
    sessions: DataFrame
    long: DataFrame | None = None

    def each(self, fn: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """``fn(paths, sessions)`` over short sessions, and over long ones if there are any."""
        if self.long is None:
            return fn(self.short, self.sessions)
        return fn(self.short, self.sessions.where("NOT is_long")).unionByName(
            fn(self.long, self.sessions.where("is_long")))


def build_paths(spark: SparkSession, facts: DataFrame, pageviews: DataFrame, signature: str, input_bytes: int,
                chunk_ids: int = CHUNK_IDS, long_views: int = LONG_VIEWS, name: str = "paths") -> SessionPaths:
    """Write (once per ``signature``) and open the path tables of ``pageviews`` and the sessions in ``facts``."""
    signature = f"{signature}-{chunk_ids}-{long_views}"
    buckets = store.bucket_count(input_bytes)
    nested = store.materialize(spark, lambda: nest_views(pageviews, chunk_ids), f"{name}_nested", signature)
    busy = store.materialize(spark, lambda: nested.groupBy(SID).agg(F.sum(F.size("views")).alias("n"))
                             .where(F.col("n") > long_views).select(SID), f"{name}_busy", signature)
    short = store.materialize_bucketed(spark, lambda: nested.join(busy, SID, "left_anti"), f"{name}_short", signature,
                                       SID, buckets, [SID, "chunk"])
    sessions = store.materialize_bucketed(
        spark, lambda: facts.join(busy.select(SID, F.lit(True).alias("is_long")), SID, "left")
        .withColumn("is_long", F.coalesce("is_long", F.lit(False))), f"{name}_sessions", signature, SID, buckets)
    if busy.isEmpty():
        return SessionPaths(short, sessions)
    long = store.materialize(spark, lambda: nested.join(busy, SID, "left_semi"), f"{name}_long", signature)
    return SessionPaths(short, sessions, long)
