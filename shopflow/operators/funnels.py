"""Page tests and conversion funnels.

Funnel flags are computed by pre-aggregating page views per session (one
``max`` per step, combined on the map side) and left-joining them to the
chosen sessions, so sessions without page views keep zeros and a busy
session never reaches one task as raw rows. Counts and rates are then
narrow aggregates at session grain; orders enter as per-session counts and
revenue, never as order rows that would multiply page-view rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.functions.buckets import at
from shopflow.functions.filters import where as apply_where, url_is
from shopflow.functions.ratio import ratio
from shopflow.operators.grain import orders_per_session
from shopflow.operators.pages import PVID, SID, first_pv_id, first_seen, session_pages


def conversion_by_landing(facts: DataFrame, pageviews: DataFrame, landers: list[str],
                          marker: Column | None = None,
                          session_where: Column | None = None) -> DataFrame:
    """Landing page to order conversion for a split test.

    A session's landing page is its first page view with id >= ``marker``
    (default: the first view of ``landers[1]``); only sessions landing on
    one of ``landers`` count.
    """
    if marker is None:
        marker = first_pv_id(pageviews, landers[1])
    # a row filter (not a condition inside the aggregate): page views before
    # the marker are never read past the scan
    per = (session_pages(pageviews.filter(F.col(PVID) >= marker))
           .select(SID, F.col("first.pageview_url").alias("landing_page")))
    rows = (per.join(apply_where(facts, session_where).select(SID, "n_orders"), SID)
            .filter(F.col("landing_page").isin(list(landers))))
    agg = rows.groupBy("landing_page").agg(F.count(SID).alias("sessions"),
                                           F.sum("n_orders").alias("orders"))
    return agg.withColumn("conv_rate", ratio("orders", "sessions"))


def landing_test_lift(facts: DataFrame, pageviews: DataFrame, landers: list[str], test_where: Column | None = None,
                      since_where: Column | None = None, id_range: int = 1 << 16) -> DataFrame:
    """Value of a lander test in one row.

    Conversion of control (``landers[0]``) and test (``landers[1]``) pages
    over ``test_where`` sessions, the last session sent to the control page
    (among ``since_where`` sessions), the sessions since then and the extra
    orders they brought: ``lift * sessions_since_test``.

    One summary per session (landing page since the marker, whether it saw the
    control page) serves all figures. The sessions after the last control one
    are counted without a second pass: each range of ``id_range`` session ids
    keeps its last control session, the sessions after it in the range and how
    many the range has; the ranges after the last one count whole.
    """
    marker = first_pv_id(pageviews, landers[1])
    seen = pageviews.groupBy(SID).agg(
        F.min(F.when(F.col(PVID) >= marker, F.struct(PVID, "pageview_url"))).getField("pageview_url").alias("land"),
        F.max(url_is(landers[0])).alias("saw_control"))
    flags = {name: F.lit(True) if cond is None else F.coalesce(cond, F.lit(False))
             for name, cond in (("tested", test_where), ("since", since_where))}
    rows = facts.withColumns(flags).filter("tested OR since").select(SID, "n_orders", "tested", "since").join(seen, SID, "left")
    here = [F.col("tested") & (F.col("land") == lander) for lander in landers[:2]]
    ranges = rows.groupBy(F.floor(F.col(SID) / id_range).alias("r")).agg(
        *[F.count_if(c).alias(f"s{k}") for k, c in enumerate(here)],
        *[F.sum(F.when(c, F.col("n_orders"))).alias(f"o{k}") for k, c in enumerate(here)],
        F.max(F.when(F.col("since") & F.col("saw_control"), F.col(SID))).alias("last"),
        F.collect_list(F.when(F.col("since"), F.col(SID))).alias("ids"))
    one = ranges.agg(
        *[F.sum(f"{x}{k}").alias(f"{x}{k}") for k in (0, 1) for x in "so"],
        F.max(F.struct("last", "r", F.size(F.filter("ids", lambda i: i > F.col("last"))).alias("after"))).alias("top"),
        F.collect_list(F.struct("r", F.size("ids").alias("n"))).alias("held"))
    beyond = F.aggregate(F.filter("held", lambda h: h["r"] > F.col("top.r")), F.lit(0).cast("long"), lambda a, h: a + h["n"])
    last = F.col("top.last")
    return (one.select(ratio("o0", "s0").alias("control_conv_rate"), ratio("o1", "s1").alias("test_conv_rate"),
                       last.alias("last_control_session_id"),
                       F.when(last.isNull(), F.lit(0).cast("long")).otherwise(F.col("top.after") + beyond).alias("sessions_since_test"))
            .withColumn("lift", F.col("test_conv_rate") - F.col("control_conv_rate"))
            .withColumn("extra_orders", F.col("lift") * F.col("sessions_since_test"))
            .select("control_conv_rate", "test_conv_rate", "lift", "last_control_session_id", "sessions_since_test",
                    "extra_orders"))


def funnel_flags(sessions: DataFrame, pageviews: DataFrame, flags: dict[str, str],
                 session_where: Column | None = None, zero=0) -> DataFrame:
    """One row per session meeting ``session_where``, a 0/1 column per
    ``{column: url}`` in ``flags`` (1 if the session viewed the url).

    The order of the steps is not enforced. ``zero=None`` gives NULL for
    "not reached" instead of 0.
    """
    per = pageviews.groupBy(SID).agg(
        *[F.max((F.col("pageview_url") == F.lit(u)).cast("int")).alias(c) for c, u in flags.items()])
    out = apply_where(sessions, session_where).select(SID).join(per, SID, "left")
    if zero is None:
        return out.select(SID, *[F.when(F.col(c) == 1, F.lit(1)).alias(c) for c in flags])
    return out.select(SID, *[F.coalesce(F.col(c), F.lit(zero)).cast("int").alias(c) for c in flags])


def _segment(segments: list[tuple[str, str]] | None, other: str) -> Column:
    expr = None
    for col, label in segments or []:
        expr = (F.when(F.col(col) == 1, F.lit(label)) if expr is None
                else expr.when(F.col(col) == 1, F.lit(label)))
    return expr.otherwise(F.lit(other))


def funnel_counts(flags: DataFrame, steps: list[str], segments: list[tuple[str, str]] | None = None,
                  other: str = "other") -> DataFrame:
    """Sessions reaching each step (``to_{step}``), in total or per segment.

    ``steps`` names flag columns ``{step}_made_it``; ``segments`` is a list of
    (flag column, label): a session takes the first label whose flag is 1.
    """
    aggs = [F.count(SID).alias("sessions")] + [
        F.count_if(F.col(f"{s}_made_it") == 1).alias(f"to_{s}") for s in steps]
    if not segments:
        return flags.agg(*aggs)
    return flags.groupBy(_segment(segments, other).alias("segment")).agg(*aggs)


def funnel_rates(flags: DataFrame, steps: list[str], segments: list[tuple[str, str]] | None = None,
                 entry: str = "lander", other: str = "other") -> DataFrame:
    """Click rates between consecutive steps: ``{entry}_click_rt`` is the first
    step over sessions, ``{step}_click_rt`` the next step over ``step``."""
    counts = funnel_counts(flags, steps, segments, other)
    prev = ["sessions"] + [f"to_{s}" for s in steps]
    names = [entry] + list(steps[:-1])
    rates = [ratio(f"to_{s}", p).alias(f"{n}_click_rt") for s, p, n in zip(steps, prev, names)]
    keys = ["segment"] if segments else []
    return counts.select(*keys, *rates)


def page_version_conversion(pageviews: DataFrame, orders: DataFrame, versions: list[str],
                            until=None, marker: Column | None = None) -> DataFrame:
    """Sessions, orders and order rate per version of a page.

    Page views of ``versions`` before ``until`` with id >= ``marker``
    (default: the first view of ``versions[1]`` by time).
    """
    if marker is None:
        marker = first_seen(pageviews, versions[1], mode="row").select("first_pv_id").scalar()
    pv = pageviews.filter(url_is(versions) & (F.col(PVID) >= marker))
    if until is not None:
        pv = pv.filter(F.col("created_at") < at(until))
    seen = pv.select("pageview_url", SID).distinct()
    rows = seen.join(orders_per_session(orders).select(SID, "n_orders"), SID, "left")
    agg = rows.groupBy("pageview_url").agg(F.count(SID).alias("sessions"),
                                           F.coalesce(F.sum("n_orders"), F.lit(0)).alias("orders"))
    return agg.withColumn("billing_to_order_rt", ratio("orders", "sessions"))


def page_version_conversion_by_day(pageviews: DataFrame, facts: DataFrame, versions: list[str],
                                   until=None) -> DataFrame:
    """:func:`page_version_conversion` over page views in day folders (with their ``day``).

    The marker, the first view of ``versions[1]`` by time, is found in the plan; views of earlier
    days cannot have a later time, so its day is a partition filter that prunes folders at run
    time. Page-view ids follow time. Orders are those of the sessions in ``facts``.
    """
    first = first_seen(pageviews, versions[1], mode="row").select(F.struct(
        F.to_date("first_created_at").alias("day"), "first_pv_id").alias("m")).scalar()
    pv = pageviews.filter((F.col("day") >= first.getField("day")) & url_is(versions) & (F.col(PVID) >= first.getField("first_pv_id")))
    if until is not None:
        pv = pv.filter((F.col("day") <= F.to_date(at(until))) & (F.col("created_at") < at(until)))
    seen = pv.select("pageview_url", SID).distinct()
    rows = seen.join(facts.select(SID, "n_orders"), SID, "left")
    agg = rows.groupBy("pageview_url").agg(F.count(SID).alias("sessions"),
                                           F.coalesce(F.sum("n_orders"), F.lit(0)).alias("orders"))
    return agg.withColumn("billing_to_order_rt", ratio("orders", "sessions"))


def page_version_revenue(pageviews: DataFrame, orders: DataFrame, versions: list[str],
                         start, end) -> DataFrame:
    """Revenue per session that saw each version, views strictly inside (start, end).

    As in the original analysis, each view of the page carries its
    session's order revenue, so a session viewing it twice counts twice in
    the revenue (not in the sessions).
    """
    pv = pageviews.filter(url_is(versions) & (F.col("created_at") > at(start))
                          & (F.col("created_at") < at(end)))
    seen = pv.groupBy(F.col("pageview_url").alias("billing_version_seen"), SID).agg(
        F.count(PVID).alias("views"))
    rows = seen.join(orders_per_session(orders).select(SID, "revenue"), SID, "left")
    agg = rows.groupBy("billing_version_seen").agg(
        F.count(SID).alias("sessions"),
        F.sum(F.col("revenue") * F.col("views")).cast("double").alias("rev"))
    return agg.select("billing_version_seen", "sessions",
                      ratio("rev", "sessions").alias("revenue_per_billing_page_seen"))


def page_test_value(pageviews: DataFrame, orders: DataFrame, versions: list[str],
                    test_start, test_end, volume_start, volume_end) -> DataFrame:
    """Monthly value of a page test, one row: revenue per session of old and
    new version over the test, their difference (``lift``), page views and
    distinct sessions of the page in the closed volume period, and
    ``test_value = lift * billing_pageviews``. One row per session, with its
    views of each version in both periods, serves all figures."""
    tested = (F.col("created_at") > at(test_start)) & (F.col("created_at") < at(test_end))
    counted = F.col("created_at").between(at(volume_start), at(volume_end))
    per = (pageviews.filter(url_is(versions) & (tested | counted)).groupBy(SID).agg(
        F.count_if(counted).alias("volume"),
        *[F.count_if(tested & (F.col("pageview_url") == v)).alias(f"v{k}") for k, v in enumerate(versions[:2])]))
    rows = per.join(orders_per_session(orders).select(SID, "revenue"), SID, "left")
    one = rows.agg(
        *[F.count_if(F.col(f"v{k}") > 0).alias(f"s{k}") for k in (0, 1)],
        *[F.sum(F.when(F.col(f"v{k}") > 0, F.col("revenue") * F.col(f"v{k}"))).cast("double").alias(f"r{k}") for k in (0, 1)],
        F.coalesce(F.sum("volume"), F.lit(0)).alias("billing_pageviews"), F.count_if(F.col("volume") > 0).alias("billing_sessions"))
    return (one.select(ratio("r0", "s0").alias("old_rev_per_session"), ratio("r1", "s1").alias("new_rev_per_session"),
                       "billing_pageviews", "billing_sessions")
            .withColumn("lift", F.col("new_rev_per_session") - F.col("old_rev_per_session"))
            .withColumn("test_value", F.col("lift") * F.col("billing_pageviews"))
            .select("old_rev_per_session", "new_rev_per_session", "lift", "billing_pageviews", "billing_sessions", "test_value"))


def sessions_detail(df: DataFrame, where: Column | None = None) -> DataFrame:
    """All columns of the rows meeting ``where`` (for looking at staged data)."""
    return apply_where(df, where).select("*")
