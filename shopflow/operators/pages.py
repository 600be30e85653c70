"""Page analyses: first and last sightings, landing pages, bounce.

Per-session page facts (first page view under a condition, number of page
views) come from one aggregation of the page views by session, which Spark
pre-aggregates on the map side; a session with a huge number of views
therefore never lands in one task as raw rows. Markers such as "first page
view of the new lander" are one-value DataFrames used as scalar subqueries
(``DataFrame.scalar()``): no value travels through the driver and no join
is needed to attach them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.functions.buckets import sunday_week
from shopflow.functions.filters import where as apply_where, url_is
from shopflow.functions.ratio import ratio

SID = "website_session_id"
PVID = "website_pageview_id"


def first_seen(pageviews: DataFrame, url: str, where: Column | None = None,
               mode: str = "independent") -> DataFrame:
    """When a page was first seen: one row.

    ``mode="independent"``: earliest date and smallest page-view id, each on
    its own (``first_date``, ``first_pv_id``); ``mode="row"``: the first page
    view by time, then id (``first_created_at``, ``first_pv_id``).
    """
    pv = apply_where(pageviews, where).filter(url_is(url))
    if mode == "independent":
        return pv.agg(F.min(F.to_date("created_at")).alias("first_date"),
                      F.min(PVID).alias("first_pv_id"))
    first = pv.agg(F.min(F.struct("created_at", PVID)).alias("f"))
    return first.select(F.col("f.created_at").alias("first_created_at"),
                        F.col(f"f.{PVID}").alias("first_pv_id"))


def first_pv_id(pageviews: DataFrame, url: str, where: Column | None = None) -> Column:
    """Smallest page-view id of ``url`` as a scalar subquery column."""
    return apply_where(pageviews, where).filter(url_is(url)).agg(F.min(PVID)).scalar()


def qualifying_pageviews(sessions: DataFrame, pageviews: DataFrame,
                         where: Column | None = None) -> DataFrame:
    """Page views of the sessions meeting ``where`` (a semi join)."""
    return pageviews.join(apply_where(sessions, where).select(SID), SID, "left_semi")


def last_seen(sessions: DataFrame, pageviews: DataFrame, url: str,
              where: Column | None = None) -> DataFrame:
    """Largest session id among sessions meeting ``where`` that saw ``url``."""
    pv = pageviews.filter(url_is(url)).select(SID)
    return (pv.join(apply_where(sessions, where).select(SID), SID, "left_semi")
            .agg(F.max(SID).alias("last_session_id")))


def sessions_since(sessions: DataFrame, marker: Column, where: Column | None = None) -> DataFrame:
    """Number of sessions meeting ``where`` with an id above ``marker``."""
    return (apply_where(sessions, where).filter(F.col(SID) > marker)
            .agg(F.count(SID).alias("sessions_since_test")))


def top_pages(pageviews: DataFrame, where: Column | None = None) -> DataFrame:
    """Page views per url, most viewed first (the column is named ``sessions``).

    Page-view ids are unique, so rows are counted.
    """
    return (apply_where(pageviews, where).groupBy("pageview_url")
            .agg(F.count(PVID).alias("sessions"))
            .orderBy(F.col("sessions").desc()))


def first_pageview(pageviews: DataFrame, where: Column | None = None) -> DataFrame:
    """First page-view id of each session among the page views meeting ``where``."""
    return apply_where(pageviews, where).groupBy(SID).agg(F.min(PVID).alias("min_pageview_id"))


def landing_page(pageviews: DataFrame, where: Column | None = None) -> DataFrame:
    """Url of each session's first page view among those meeting ``where``."""
    first = apply_where(pageviews, where).groupBy(SID).agg(F.min(F.struct(PVID, "pageview_url")).alias("f"))
    return first.select(SID, F.col("f.pageview_url").alias("landing_page"))


def top_entry_pages(pageviews: DataFrame, where: Column | None = None) -> DataFrame:
    """Sessions per landing page."""
    return (landing_page(pageviews, where).groupBy(F.col("landing_page"))
            .agg(F.count(SID).alias("sessions_hitting_this_landing_page")))


def session_pages(pageviews: DataFrame, first_if: Column | None = None,
                  fields=("pageview_url",)) -> DataFrame:
    """Per session: ``pgv`` (all its page views) and ``first``, the first page
    view (struct of id and ``fields``) among those meeting ``first_if``."""
    first = F.struct(PVID, *fields)
    if first_if is not None:
        first = F.when(first_if, first)
    return pageviews.groupBy(SID).agg(F.min(first).alias("first"), F.count(PVID).alias("pgv"))


def bounced_sessions(pageviews: DataFrame, where: Column | None = None) -> DataFrame:
    """Sessions whose landing page (first view meeting ``where``) was their
    only page view; the count covers all the session's page views."""
    per = session_pages(pageviews, where)
    return (per.filter(F.col("first").isNotNull() & (F.col("pgv") == 1))
            .select(SID, F.col("first.pageview_url").alias("land"), "pgv"))


def bounce_rate(pageviews: DataFrame, where: Column | None = None) -> DataFrame:
    """Sessions, bounced sessions and their share (one row)."""
    per = session_pages(pageviews, where).filter(F.col("first").isNotNull())
    agg = per.agg(F.count(SID).alias("sessions"),
                  F.count_if(F.col("pgv") == 1).alias("bounced_sessions"))
    return agg.withColumn("bounce_rate", ratio("bounced_sessions", "sessions"))


def bounce_rate_by_landing(sessions: DataFrame, pageviews: DataFrame, landers: list[str],
                           marker_url: str | None = None, session_where: Column | None = None,
                           inclusive: bool = True) -> DataFrame:
    """Bounce per landing page for a split test between ``landers``.

    Sessions meeting ``session_where`` land on their first page view among
    ``landers`` at or after (``inclusive``) the first view of ``marker_url``
    by such sessions; bounce counts all the session's page views.
    """
    views = qualifying_pageviews(sessions, pageviews, session_where)
    cond = url_is(landers)
    if marker_url is not None:
        marker = first_pv_id(views, marker_url)
        cond = cond & ((F.col(PVID) >= marker) if inclusive else (F.col(PVID) > marker))
    per = session_pages(views, cond).filter(F.col("first").isNotNull())
    agg = per.groupBy(F.col("first.pageview_url").alias("land")).agg(
        F.count(SID).alias("sessions"), F.count_if(F.col("pgv") == 1).alias("bounced_sessions"))
    return agg.withColumn("bounce_rate", ratio("bounced_sessions", "sessions"))


def weekly_bounce_trend(sessions: DataFrame, pageviews: DataFrame, landers: list[str],
                        labels=("home", "lander"), session_where: Column | None = None,
                        legacy: bool = False) -> DataFrame:
    """Per Sunday-week: bounce rate and volumes of two landing pages.

    Default: one row per session, landing on its first view among
    ``landers``, in the week of that view; returns sessions and bounced
    sessions per lander. ``legacy=True`` reproduces the original: every
    lander view is a landing row (distinct per session and time), the rate
    divides bounced rows by landing rows, and the per-lander columns count
    bounced sessions only.
    """
    views = qualifying_pageviews(sessions, pageviews, session_where)
    lab0, lab1 = labels
    if not legacy:
        rows = (session_pages(views, url_is(landers), ("created_at", "pageview_url"))
                .filter(F.col("first").isNotNull())
                .select(SID, F.col("first.created_at").alias("created_at"),
                        F.col("first.pageview_url").alias("land"),
                        (F.col("pgv") == 1).alias("bounced")))
        agg = rows.groupBy(sunday_week("created_at").alias("wk")).agg(
            F.min(F.to_date("created_at")).alias("week_start_date"),
            F.count(SID).alias("sessions"),
            F.count_if("bounced").alias("bounced_sessions"),
            F.count_if(F.col("land") == landers[0]).alias(f"{lab0}_sessions"),
            F.count_if(F.col("bounced") & (F.col("land") == landers[0])).alias(f"{lab0}_bounced"),
            F.count_if(F.col("land") == landers[1]).alias(f"{lab1}_sessions"),
            F.count_if(F.col("bounced") & (F.col("land") == landers[1])).alias(f"{lab1}_bounced"))
        return agg.select("week_start_date", "sessions", "bounced_sessions",
                          ratio("bounced_sessions", "sessions").alias("bounce_rate"),
                          f"{lab0}_sessions", f"{lab0}_bounced", f"{lab1}_sessions", f"{lab1}_bounced")
    per = session_pages(views).select(SID, "pgv")
    # legacy: landing rows are lander views grouped by (session, view time)
    land_rows = (pageviews.filter(url_is(landers))
                 .groupBy(SID, "created_at").agg(F.min(F.struct(PVID, "pageview_url")).alias("f"))
                 .select(SID, "created_at", F.col("f.pageview_url").alias("land")))
    rows = land_rows.join(per, SID).withColumn("bounced", F.col("pgv") == 1)
    agg = rows.groupBy(sunday_week("created_at").alias("wk")).agg(
        F.min(F.to_date("created_at")).alias("week_start_date"),
        F.count_if("bounced").alias("b"), F.count(SID).alias("n"),
        F.count_if(F.col("bounced") & (F.col("land") == landers[0])).alias(f"{lab0}_sessions"),
        F.count_if(F.col("bounced") & (F.col("land") == landers[1])).alias(f"{lab1}_sessions"))
    return agg.select("week_start_date", ratio("b", "n").alias("bounce_rate"),
                      f"{lab0}_sessions", f"{lab1}_sessions")
