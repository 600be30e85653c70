"""Traffic and channel analyses (trends, conversion, channel mix).

All take the session fact table of :func:`shopflow.operators.grain.session_facts`
and an optional ``where`` condition on it, and group by a calendar bucket
(``grain``: day, week, month, quarter or year) of the session's start time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.functions.buckets import bucket_columns, bucket_names, sunday_week
from shopflow.functions.channels import SEARCH_REFERERS, campaign, is_direct, is_organic, src
from shopflow.functions.filters import where as apply_where
from shopflow.functions.ratio import ratio, round_avg_half_up
from shopflow.operators.grain import count_orders, count_sessions, has_order, sum_revenue



def volume_trend(facts: DataFrame, grain: str = "month", where: Column | None = None,
                 orders_as: str = "orders") -> DataFrame:
    """Sessions and orders per bucket of session time.

    ``orders_as="orders"`` counts distinct orders (``sessions``, ``orders``);
    ``"sessions_with_order"`` counts sessions that placed an order
    (``sessions_volume``, ``order_volume``).
    """
    if orders_as == "orders":
        aggs = [count_sessions().alias("sessions"), count_orders().alias("orders")]
    elif orders_as == "sessions_with_order":
        aggs = [count_sessions().alias("sessions_volume"),
                count_sessions(has_order()).alias("order_volume")]
    else:
        raise ValueError(orders_as)
    return apply_where(facts, where).groupBy(*bucket_columns("created_at", grain)).agg(*aggs)


def segment_trend(facts: DataFrame, column: str, values: list[str], grain: str = "month",
                  where: Column | None = None) -> DataFrame:
    """Sessions and orders per bucket, one column pair per value of ``column``
    (a fixed list, so no data-driven pivot): ``{v}_sessions``, ``{v}_orders``."""
    aggs = []
    for v in values:
        cond = F.col(column) == F.lit(v)
        aggs += [count_sessions(cond).alias(f"{v}_sessions"), count_orders(cond).alias(f"{v}_orders")]
    return apply_where(facts, where).groupBy(*bucket_columns("created_at", grain)).agg(*aggs)


def distinct_values(df: DataFrame, columns: list[str] | None = None,
                    where: Column | None = None) -> DataFrame:
    """Distinct values of some columns (or whole rows); NULLs are values."""
    out = apply_where(df, where)
    return (out.select(*columns) if columns else out).distinct()


def channel_mix_trend(facts: DataFrame, grain: str = "month", where: Column | None = None,
                      organic="any_referer") -> DataFrame:
    """Paid gsearch, paid bsearch, organic and direct sessions per bucket."""
    return apply_where(facts, where).groupBy(*bucket_columns("created_at", grain)).agg(
        count_sessions(src("gsearch")).alias("gsearch_paid_sessions"),
        count_sessions(src("bsearch")).alias("bsearch_paid_sessions"),
        count_sessions(is_organic(organic)).alias("organic_search_sessions"),
        count_sessions(is_direct()).alias("direct_type_in_sessions"))


def direct_brand_vs_nonbrand(facts: DataFrame, grain: str = "month", where: Column | None = None,
                             organic=SEARCH_REFERERS) -> DataFrame:
    """Brand, direct and organic sessions, each also as a share of nonbrand."""
    keys = bucket_names(grain)
    counts = apply_where(facts, where).groupBy(*bucket_columns("created_at", grain)).agg(
        count_sessions(campaign("nonbrand")).alias("nonbrand"),
        count_sessions(campaign("brand")).alias("brand"),
        count_sessions(is_direct()).alias("direct"),
        count_sessions(is_organic(organic)).alias("organic"))
    return counts.select(
        *keys, "nonbrand", "brand",
        ratio("brand", "nonbrand").alias("brand_pct_of_nonbrand"),
        "direct", ratio("direct", "nonbrand").alias("direct_pct_of_nonbrand"),
        "organic", ratio("organic", "nonbrand").alias("organic_pct_of_nonbrand"))


def conversion_trend(facts: DataFrame, grain: str = "month", where: Column | None = None) -> DataFrame:
    """Sessions, orders and orders per session per bucket."""
    keys = bucket_names(grain)
    return (volume_trend(facts, grain, where)
            .select(*keys, "sessions", "orders", ratio("orders", "sessions").alias("conversion_rate")))


def efficiency_trend(facts: DataFrame, grain: str = "quarter", where: Column | None = None) -> DataFrame:
    """Session-to-order conversion, revenue per order, revenue per session.

    "Orders" are sessions with an order, as in the per-quarter board report.
    """
    keys = bucket_names(grain)
    agg = apply_where(facts, where).groupBy(*bucket_columns("created_at", grain)).agg(
        count_sessions().alias("s"), count_sessions(has_order()).alias("o"),
        sum_revenue().alias("rev"))
    return agg.select(*keys,
                      ratio("o", "s").alias("sessions_to_order_conv_rate"),
                      ratio("rev", "o").alias("rev_per_order"),
                      ratio("rev", "s").alias("rev_per_session"))


def _five_channels() -> list[tuple[str, Column]]:
    return [("gsearch_nonbrand", src("gsearch") & campaign("nonbrand")),
            ("bsearch_nonbrand", src("bsearch") & campaign("nonbrand")),
            ("brand", campaign("brand")),
            ("organic_search", is_organic("any_referer")),
            ("direct_type_in", is_direct())]


def orders_by_channel(facts: DataFrame, grain: str = "quarter", where: Column | None = None) -> DataFrame:
    """Orders per bucket from five channels (brand is any source)."""
    names = {"brand": "brandsearch_overall"}
    return apply_where(facts, where).groupBy(*bucket_columns("created_at", grain)).agg(
        *[count_orders(c).alias(names.get(n, n)) for n, c in _five_channels()])


def conversion_by_channel(facts: DataFrame, grain: str = "quarter", where: Column | None = None) -> DataFrame:
    """Orders per session for the five channels of :func:`orders_by_channel`, sorted by bucket."""
    keys = bucket_names(grain)
    names = {"brand": "brand_search"}
    chans = _five_channels()
    aggs = []
    for n, c in chans:
        aggs += [count_orders(c).alias(f"o_{n}"), count_sessions(c).alias(f"s_{n}")]
    agg = apply_where(facts, where).groupBy(*bucket_columns("created_at", grain)).agg(*aggs)
    return (agg.select(*keys, *[ratio(f"o_{n}", f"s_{n}").alias(f"{names.get(n, n)}_conv_rt")
                               for n, _ in chans])
            .orderBy(*keys))


def channel_characteristics(facts: DataFrame, where: Column | None = None) -> DataFrame:
    """Per source: sessions, mobile sessions and the mobile share."""
    agg = apply_where(facts, where).groupBy("utm_source").agg(
        count_sessions().alias("sessions"),
        count_sessions(F.col("device_type") == "mobile").alias("mobile_sessions"))
    return agg.withColumn("pct_mobile", ratio("mobile_sessions", "sessions"))


def conversion_by(facts: DataFrame, keys=("device_type", "utm_source"),
                  where: Column | None = None) -> DataFrame:
    """Sessions, orders and conversion per combination of ``keys`` (bid inputs)."""
    agg = apply_where(facts, where).groupBy(*keys).agg(
        count_sessions().alias("sessions"), count_orders().alias("orders"))
    return agg.withColumn("conv_rate", ratio("orders", "sessions"))


def weekly_portfolio(facts: DataFrame, where: Column | None = None) -> DataFrame:
    """Per Sunday-week: gsearch and bsearch sessions on desktop and mobile,
    and bsearch as a share of gsearch. ``week_start`` is the first date
    present in the week."""
    def c(source, device):
        return count_sessions(src(source) & (F.col("device_type") == device))
    agg = apply_where(facts, where).groupBy(sunday_week("created_at").alias("wk")).agg(
        F.min(F.to_date("created_at")).alias("week_start"),
        c("gsearch", "desktop").alias("g_dtop_session"),
        c("bsearch", "desktop").alias("b_dtop_session"),
        c("gsearch", "mobile").alias("g_mob_session"),
        c("bsearch", "mobile").alias("b_mob_session"))
    return agg.select(
        "week_start", "g_dtop_session", "b_dtop_session",
        ratio("b_dtop_session", "g_dtop_session").alias("b_pct_of_g_dtop"),
        "g_mob_session", "b_mob_session",
        ratio("b_mob_session", "g_mob_session").alias("b_pct_of_g_mob"))


WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def hour_by_weekday(sessions: DataFrame, where: Column | None = None) -> DataFrame:
    """Average sessions per hour of day, one column per weekday.

    The average runs over the (date, hour) cells that hold a session; empty
    hours are absent, not zero. Rounded half up to one decimal, exactly.
    """
    cells = apply_where(sessions, where).groupBy(
        F.to_date("created_at").alias("da"), F.hour("created_at").alias("hr"),
        F.weekday("created_at").alias("wk")).agg(count_sessions().alias("sessions"))
    aggs = []
    for i, name in enumerate(WEEKDAYS):
        aggs += [F.sum(F.when(F.col("wk") == i, F.col("sessions"))).alias(f"t{i}"),
                 F.count_if(F.col("wk") == i).alias(f"n{i}")]
    per_hour = cells.groupBy("hr").agg(*aggs)
    return per_hour.select("hr", *[round_avg_half_up(f"t{i}", f"n{i}").alias(n)
                                   for i, n in enumerate(WEEKDAYS)])
