"""Page, funnel and pathing analyses over session paths.

The same results as :mod:`shopflow.operators.pages`, ``funnels`` and
``products`` give from page views, read from the nested table of
:mod:`shopflow.sources.paths`: conditions and "first view after" are
higher-order functions on a session's ordered views, and what remains is
combined per session where the rows already lie. No page view is shuffled;
sessions are joined bucket by bucket.

Conditions on a view are functions of the view, a struct ``id, at, url``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.functions.buckets import at, bucket_columns, bucket_names, period_label, sunday_week
from shopflow.functions.filters import where as apply_where
from shopflow.functions.ratio import ratio
from shopflow.operators.pages import PVID, SID
from shopflow.operators.products import summarise_carts
from shopflow.sources.paths import SessionPaths

ViewCond = Callable[[Column], Column]


def seen_before(t) -> ViewCond:
    return lambda v: v["at"] < at(t)


def seen_between(lo, hi) -> ViewCond:
    """Closed range, as ``BETWEEN``."""
    return lambda v: v["at"].between(at(lo), at(hi))


def of_url(urls) -> ViewCond:
    urls = [urls] if isinstance(urls, str) else list(urls)
    return lambda v: v["url"].isin(urls)


def both(a: ViewCond, b: ViewCond) -> ViewCond:
    return lambda v: a(v) & b(v)


def _first(cond: ViewCond | None = None) -> Column:
    """The first view of the row meeting ``cond``, NULL when none does."""
    return F.get("views" if cond is None else F.filter("views", cond), F.lit(0))


def _chosen(sessions: DataFrame, where: Column | None) -> DataFrame:
    return apply_where(sessions, where).select(SID)


def session_pages(paths: SessionPaths, cond: ViewCond | None = None, where: Column | None = None,
                  chosen: bool = False) -> DataFrame:
    """Per session with a view meeting ``cond``: ``first`` (that view) and ``pgv``, all its views.

    ``chosen`` keeps the sessions meeting ``where`` only (page views of unknown sessions drop out).
    """
    def per(views, sessions):
        views = views.join(_chosen(sessions, where), SID, "left_semi") if chosen else views
        return (views.select(SID, _first(cond).alias("f"), F.size("views").alias("n")).groupBy(SID)
                .agg(F.min("f").alias("first"), F.sum("n").alias("pgv")).filter(F.col("first").isNotNull()))
    return paths.each(per)


def first_pageview(paths: SessionPaths, cond: ViewCond | None = None) -> DataFrame:
    """As :func:`shopflow.operators.pages.first_pageview`."""
    return session_pages(paths, cond).select(SID, F.col("first.id").alias("min_pageview_id"))


def landing_page(paths: SessionPaths, cond: ViewCond | None = None) -> DataFrame:
    """As :func:`shopflow.operators.pages.landing_page`."""
    return session_pages(paths, cond).select(SID, F.col("first.url").alias("landing_page"))


def top_entry_pages(paths: SessionPaths, cond: ViewCond | None = None) -> DataFrame:
    """As :func:`shopflow.operators.pages.top_entry_pages`."""
    return landing_page(paths, cond).groupBy("landing_page").agg(
        F.count(SID).alias("sessions_hitting_this_landing_page"))


def bounced_sessions(paths: SessionPaths, cond: ViewCond | None = None) -> DataFrame:
    """As :func:`shopflow.operators.pages.bounced_sessions`."""
    return session_pages(paths, cond).filter("pgv = 1").select(SID, F.col("first.url").alias("land"), "pgv")


def bounce_rate(paths: SessionPaths, cond: ViewCond | None = None) -> DataFrame:
    """As :func:`shopflow.operators.pages.bounce_rate`."""
    agg = session_pages(paths, cond).agg(F.count(SID).alias("sessions"),
                                         F.count_if(F.col("pgv") == 1).alias("bounced_sessions"))
    return agg.withColumn("bounce_rate", ratio("bounced_sessions", "sessions"))


def bounce_rate_by_landing(paths: SessionPaths, landers: list[str], marker_url: str,
                           where: Column | None = None, inclusive: bool = True) -> DataFrame:
    """As :func:`shopflow.operators.pages.bounce_rate_by_landing`."""
    marker = session_pages(paths, of_url(marker_url), where, chosen=True).agg(F.min("first.id")).scalar()

    def landed(v):
        return v["url"].isin(list(landers)) & ((v["id"] >= F.col("marker")) if inclusive else (v["id"] > F.col("marker")))

    marked = SessionPaths(*[None if t is None else t.withColumn("marker", marker) if "views" in t.columns else t
                            for t in (paths.short, paths.sessions, paths.long)])
    per = session_pages(marked, landed, where, chosen=True)
    agg = per.groupBy(F.col("first.url").alias("land")).agg(
        F.count(SID).alias("sessions"), F.count_if(F.col("pgv") == 1).alias("bounced_sessions"))
    return agg.withColumn("bounce_rate", ratio("bounced_sessions", "sessions"))


def weekly_bounce_trend(paths: SessionPaths, landers: list[str], labels=("home", "lander"),
                        where: Column | None = None) -> DataFrame:
    """As :func:`shopflow.operators.pages.weekly_bounce_trend` (its default form)."""
    rows = session_pages(paths, of_url(landers), where, chosen=True).select(
        F.col("first.at").alias("created_at"), F.col("first.url").alias("land"), (F.col("pgv") == 1).alias("bounced"))
    aggs = []
    for lander, label in zip(landers, labels):
        aggs += [F.count_if(F.col("land") == lander).alias(f"{label}_sessions"),
                 F.count_if(F.col("bounced") & (F.col("land") == lander)).alias(f"{label}_bounced")]
    agg = rows.groupBy(sunday_week("created_at").alias("wk")).agg(
        F.min(F.to_date("created_at")).alias("week_start_date"), F.count(F.lit(1)).alias("sessions"),
        F.count_if("bounced").alias("bounced_sessions"), *aggs)
    return agg.select("week_start_date", "sessions", "bounced_sessions",
                      ratio("bounced_sessions", "sessions").alias("bounce_rate"),
                      *[f"{label}_{what}" for label in labels for what in ("sessions", "bounced")])


def qualifying_pageviews(paths: SessionPaths, where: Column | None = None) -> DataFrame:
    """As :func:`shopflow.operators.pages.qualifying_pageviews`: the views unnested after the join."""
    def per(views, sessions):
        return views.join(_chosen(sessions, where), SID, "left_semi").select(SID, F.inline("views"))
    return paths.each(per).select(SID, F.col("id").alias(PVID), F.col("at").alias("created_at"),
                                  F.col("url").alias("pageview_url"))


def funnel_flags(paths: SessionPaths, flags: dict[str, str], where: Column | None = None) -> DataFrame:
    """As :func:`shopflow.operators.funnels.funnel_flags`."""
    def per(views, sessions):
        seen = views.select(SID, *[F.exists("views", of_url(u)).alias(c) for c, u in flags.items()])
        seen = seen.groupBy(SID).agg(*[F.max(c).alias(c) for c in flags])
        return _chosen(sessions, where).join(seen, SID, "left").select(
            SID, *[F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c) for c in flags])
    return paths.each(per)


def page_version_conversion(paths: SessionPaths, versions: list[str], until=None) -> DataFrame:
    """As :func:`shopflow.operators.funnels.page_version_conversion`, with the orders of known sessions."""
    def earliest(views, _):
        times = F.transform(F.filter("views", of_url(versions[1])), lambda v: F.struct(v["at"].alias("at"), v["id"].alias("id")))
        return views.select(F.array_min(times).alias("m"))
    marker = paths.each(earliest).agg(F.min("m").alias("m")).select("m.id").scalar()

    def per(views, sessions):
        def counted(v):
            on = v["url"].isin(list(versions)) & (v["id"] >= F.col("marker"))
            return on if until is None else on & (v["at"] < at(until))
        seen = (views.withColumn("marker", marker)
                .select(SID, F.explode(F.array_distinct(F.transform(F.filter("views", counted), lambda v: v["url"])))
                        .alias("pageview_url")).distinct())
        return seen.join(sessions.select(SID, "n_orders"), SID, "left")
    agg = paths.each(per).groupBy("pageview_url").agg(F.count(SID).alias("sessions"),
                                                      F.coalesce(F.sum("n_orders"), F.lit(0)).alias("orders"))
    return agg.withColumn("billing_to_order_rt", ratio("orders", "sessions"))


def after_anchor(views: DataFrame, url: str, lo, hi, cut, labels, other: str = "other",
                 after_inclusive: bool = True) -> DataFrame:
    """Per (period, session): number of anchor views ``c`` and the first view after the earliest (``next``).

    Anchors are views of ``url`` in the closed range [lo, hi], labelled by
    ``cut``. A row's last views are followed by the first view of the session's
    next row.
    """
    following = F.lead(_first()).over(Window.partitionBy(SID).orderBy("chunk"))
    tagged = F.transform(F.filter("views", both(of_url(url), seen_between(lo, hi))), lambda v: F.struct(
        period_label(v["at"], cut, labels[0], labels[1], other, after_inclusive).alias("p"), v["id"].alias("id")))
    rows = (views.withColumn("following", following).withColumn("anchors", tagged).filter(F.size("anchors") > 0)
            .select(SID, "views", "following", "anchors",
                    F.explode(F.array_distinct(F.transform("anchors", lambda a: a["p"]))).alias("time_period")))
    own = F.transform(F.filter("anchors", lambda a: a["p"] == F.col("time_period")), lambda a: a["id"])
    rows = rows.withColumn("own", own).withColumn("a", F.array_min("own"))
    nxt = F.coalesce(_first(lambda v: v["id"] > F.col("a")), F.col("following"))
    return (rows.select("time_period", SID, F.size("own").alias("c"), F.struct("a", nxt.alias("n")).alias("s"))
            .groupBy("time_period", SID).agg(F.min("s").alias("s"), F.sum("c").alias("c"))
            .select("time_period", SID, "c", F.col("s.n").alias("next")))


def next_pageview(paths: SessionPaths, **anchors) -> DataFrame:
    """As :func:`shopflow.operators.products.next_pageview`; ``anchors`` as for :func:`after_anchor`."""
    return paths.each(lambda views, _: after_anchor(views, **anchors)).select(
        "time_period", SID, F.col("next.id").alias("min_next_pageview_id"), F.col("next.url").alias("pageview_url"))


def clickthrough_after(paths: SessionPaths, **anchors) -> DataFrame:
    """As :func:`shopflow.operators.products.clickthrough_after`."""
    return next_pageview(paths, **anchors).filter(F.col("min_next_pageview_id").isNotNull()).select(
        "time_period", SID, F.col("min_next_pageview_id").alias("after_cart_pageview_id"))


def cross_sell_period_summary(paths: SessionPaths, legacy: bool = False, **anchors) -> DataFrame:
    """As :func:`shopflow.operators.products.cross_sell_period_summary`, with the orders of known sessions."""
    carts = paths.each(lambda views, _: after_anchor(views, **anchors)).select(
        "time_period", SID, "c", F.col("next").isNotNull().alias("clicked"))
    return summarise_carts(carts, paths.sessions.filter("n_orders > 0").select(SID, "n_orders", "items", "revenue"), legacy)


def pages_after(paths: SessionPaths, anchor: ViewCond) -> DataFrame:
    """As :func:`shopflow.operators.products.pages_after`, anchors being the views meeting ``anchor``."""
    whole = Window.partitionBy(SID)

    def per(views, _):
        ids = F.transform(F.filter("views", anchor), lambda v: v["id"])
        last = F.get("views", F.size("views") - 1)["id"]
        rows = views.select("views", last.alias("last"), F.min(F.array_min(ids)).over(whole).alias("a_min"),
                            F.max(F.array_max(ids)).over(whole).alias("a_max"), F.max(last).over(whole).alias("s_max"))
        later = F.array_distinct(F.transform(F.filter("views", lambda v: v["id"] > F.col("a_min")), lambda v: v["url"]))
        dead_end = F.when((F.col("a_max") >= F.col("s_max")) & (F.col("last") == F.col("s_max")),
                          F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
        return rows.filter(F.col("a_min").isNotNull()).select(F.explode(F.concat(later, dead_end)).alias("pageview_url"))
    return paths.each(per).distinct()


def product_funnel_counts(paths: SessionPaths, products: dict[str, str], steps: list[str], lo, hi) -> DataFrame:
    """As :func:`shopflow.operators.products.product_funnel_counts`."""
    inside = seen_between(lo, hi)

    def per(views, _):
        rows = views.select(
            SID, F.exists("views", inside).alias("any"),
            *[F.exists("views", both(inside, of_url(s))).alias(f"f_{s}") for s in steps],
            *[F.size(F.filter("views", of_url(u))).alias(f"n_{p}") for p, u in products.items()])
        return rows.groupBy(SID).agg(F.max("any").alias("any"), *[F.max(f"f_{s}").alias(f"f_{s}") for s in steps],
                                     *[F.sum(f"n_{p}").alias(f"n_{p}") for p in products])
    rows = paths.each(per).filter("any").select(SID, *[f"f_{s}" for s in steps], F.inline(F.array(*[
        F.struct(F.lit(p).alias("product_seen"), F.col(f"n_{p}").alias("views")) for p in products]))).filter("views > 0")
    return rows.groupBy("product_seen").agg(
        F.count(SID).alias("sessions"),
        *[F.coalesce(F.sum(F.when(F.col(f"f_{s}"), F.col("views"))), F.lit(0)).alias(f"to_{s}") for s in steps])


def product_funnel_rates(paths: SessionPaths, products: dict[str, str], steps: list[str], lo, hi) -> DataFrame:
    """As :func:`shopflow.operators.products.product_funnel_rates`."""
    counts = product_funnel_counts(paths, products, steps, lo, hi)
    prev = ["sessions"] + [f"to_{s}" for s in steps]
    names = ["product_page"] + list(steps[:-1])
    return counts.select("product_seen", "sessions",
                         *[ratio(f"to_{s}", p).alias(f"{n}_click_rt") for s, p, n in zip(steps, prev, names)])


def listing_page_trend(paths: SessionPaths, listing_url: str, grain: str = "quarter") -> DataFrame:
    """As :func:`shopflow.operators.products.listing_page_trend`, with the orders of known sessions."""
    keys = bucket_names(grain)
    last = F.get("views", F.size("views") - 1)["id"]

    def per(views, sessions):
        rows = (views.select(SID, F.max(last).over(Window.partitionBy(SID)).alias("s_max"),
                             F.filter("views", of_url(listing_url)).alias("listed"))
                .select(SID, "s_max", F.inline("listed"))
                .select(SID, "s_max", "id", *bucket_columns("at", grain))
                .groupBy(SID, *keys).agg(F.min("id").alias("a"), F.max("s_max").alias("s_max")))
        return rows.join(sessions.select(SID, "n_orders"), SID, "left")
    agg = paths.each(per).groupBy(*keys).agg(F.count(SID).alias("sessions_to_product"),
                                             F.count_if(F.col("s_max") > F.col("a")).alias("clicked"),
                                             F.coalesce(F.sum("n_orders"), F.lit(0)).alias("orders"))
    return agg.select(*keys, "sessions_to_product", ratio("clicked", "sessions_to_product").alias("click_thro_rate"),
                      ratio("orders", "sessions_to_product").alias("conversion_rate"))
