"""Distinct counts that merge: sets of ids as 64-bit words, OR-combined from days into longer periods.

An id of a set is one bit of the word ``id >> 6``. Words of parts of the data (days,
channels) are combined by ``bit_or``, so an id counts once however often its rows
repeat, in one day or in many, and a day's words serve every week, month and
quarter that holds it. The count is the sum of ``bit_count``. All of it is hash
aggregation on longs with map-side combine: no ``COUNT(DISTINCT)``, hence no
``Expand`` that copies a row once per counted key, and no need of unique keys.

Close ids (as a shop's counters give them) share words; ids far apart take one
row of 16 bytes each, so the words are never larger than the list of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.functions.buckets import bucket_columns, bucket_names
from shopflow.functions.channels import is_direct, is_organic, src
from shopflow.functions.filters import where as apply_where
from shopflow.functions.ratio import ratio

DIMENSIONS = ["utm_source", "utm_campaign", "device_type", "http_referer", "is_repeat_session"]
SESSIONS, ORDERS, BUYING = "sessions", "orders", "sessions_with_order"


def id_words(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``by``..., ``word``, ``bits``: the set of ``key`` (an integer column) for each combination of ``by``.

    Null ids are in no set; a combination that has only such rows keeps one row
    with a null word and no bits, so that it is listed with a count of 0.
    Negative ids have negative words. An empty table has no rows.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).cast("long").bitwiseAND(F.lit(63)).cast("int"))
    return (rows.withColumn("word", F.shiftright(F.col(key).cast("long"), 6)).groupBy(*by, "word")
            .agg(F.bit_or(F.coalesce(bit, F.lit(0).cast("long"))).alias("bits")))


def count_words(words: DataFrame, by: list[str], counts: dict[str, Column | None],
                sets: list[str] | None = None) -> DataFrame:
    """``by``... and for each name of ``counts`` the distinct ids of the rows meeting its condition.

    ``sets`` names the columns that tell different kinds of ids apart (words of two
    kinds are never combined); conditions may read these and all other columns.
    """
    bits = [F.bit_or(F.col("bits") if cond is None else F.when(cond, F.col("bits"))).alias(name)
            for name, cond in counts.items()]
    merged = words.groupBy(*by, *(sets or []), "word").agg(*bits)
    return merged.groupBy(*by).agg(*[
        F.coalesce(F.sum(F.bit_count(F.col(name))), F.lit(0)).cast("long").alias(name) for name in counts])


def session_words(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """The words of each day of session time and combination of :data:`DIMENSIONS`.

    ``ids`` tells the sets apart: ``sessions``, their ``orders`` and the
    ``sessions_with_order``. Rows may repeat, and a session may be delivered with
    several times or channels: it is then in the set of each. Orders of unknown
    sessions and orders without an id are in none.
    """
    seen = sessions.select(*DIMENSIONS, "website_session_id", F.to_date("created_at").alias("day"))
    placed = orders.where("order_id IS NOT NULL").select("website_session_id", "order_id").distinct()
    # both sides without repeats, so that a session and an order delivered often do not multiply
    of_orders = seen.distinct().join(placed, "website_session_id").select(*DIMENSIONS, "day", F.explode(F.array(
        F.struct(F.lit(ORDERS).alias("ids"), F.col("order_id").cast("long").alias("id")),
        F.struct(F.lit(BUYING).alias("ids"), F.col("website_session_id").cast("long").alias("id")))).alias("i"))
    of_sessions = seen.select(*DIMENSIONS, "day", F.lit(SESSIONS).alias("ids"),
                              F.col("website_session_id").cast("long").alias("id"))
    everything = of_sessions.unionByName(of_orders.select(*DIMENSIONS, "day", "i.ids", "i.id"))
    words = id_words(everything, "id", [*DIMENSIONS, "ids", "day"])
    return words.select(*DIMENSIONS, "ids", "word", "bits", "day")


def page_words(pageviews: DataFrame) -> DataFrame:
    """The words of page views by url and day."""
    views = pageviews.select("pageview_url", "website_pageview_id", F.to_date("created_at").alias("day"))
    return id_words(views, "website_pageview_id", ["pageview_url", "day"])


def _is(ids: str, cond: Column | None = None) -> Column:
    of = F.col("ids") == F.lit(ids)
    return of if cond is None else of & cond


def _by_time(words: DataFrame, grain: str, where: Column | None, counts: dict[str, Column]) -> DataFrame:
    names = bucket_names(grain)
    timed = apply_where(words, where).select("*", *bucket_columns("day", grain))
    return count_words(timed, names, counts, ["ids"])


# The analyses of :mod:`shopflow.operators.traffic` over session words. ``where`` may use ``day``
# and the dimensions; a bound inside a day needs words built from the rows it leaves.

def volume_trend(words: DataFrame, grain: str = "month", where: Column | None = None,
                 orders_as: str = "orders") -> DataFrame:
    """Distinct sessions and orders (or sessions with an order) per bucket of session time."""
    if orders_as == "orders":
        counts = {"sessions": _is(SESSIONS), "orders": _is(ORDERS)}
    elif orders_as == "sessions_with_order":
        counts = {"sessions_volume": _is(SESSIONS), "order_volume": _is(BUYING)}
    else:
        raise ValueError(orders_as)
    return _by_time(words, grain, where, counts)


def segment_trend(words: DataFrame, column: str, values: list[str], grain: str = "month",
                  where: Column | None = None) -> DataFrame:
    """Distinct sessions and orders per bucket, one column pair per value of ``column``."""
    counts = {}
    for v in values:
        counts[f"{v}_sessions"] = _is(SESSIONS, F.col(column) == F.lit(v))
        counts[f"{v}_orders"] = _is(ORDERS, F.col(column) == F.lit(v))
    return _by_time(words, grain, where, counts)


def channel_mix_trend(words: DataFrame, grain: str = "month", where: Column | None = None,
                      organic="any_referer") -> DataFrame:
    """Distinct paid gsearch, paid bsearch, organic and direct sessions per bucket."""
    return _by_time(words, grain, where, {
        "gsearch_paid_sessions": _is(SESSIONS, src("gsearch")),
        "bsearch_paid_sessions": _is(SESSIONS, src("bsearch")),
        "organic_search_sessions": _is(SESSIONS, is_organic(organic)),
        "direct_type_in_sessions": _is(SESSIONS, is_direct())})


def conversion_trend(words: DataFrame, grain: str = "month", where: Column | None = None) -> DataFrame:
    """Distinct sessions and orders, and orders per session, per bucket."""
    return volume_trend(words, grain, where).withColumn("conversion_rate", ratio("orders", "sessions"))


def conversion_by(words: DataFrame, keys=("device_type", "utm_source"), where: Column | None = None) -> DataFrame:
    """Distinct sessions, orders and conversion per combination of ``keys``."""
    counts = count_words(apply_where(words, where), list(keys),
                         {"sessions": _is(SESSIONS), "orders": _is(ORDERS)}, ["ids"])
    return counts.withColumn("conv_rate", ratio("orders", "sessions"))


def channel_characteristics(words: DataFrame, where: Column | None = None) -> DataFrame:
    """Per source: distinct sessions, mobile sessions and the mobile share."""
    counts = count_words(apply_where(words, where), ["utm_source"], {
        "sessions": _is(SESSIONS), "mobile_sessions": _is(SESSIONS, F.col("device_type") == "mobile")}, ["ids"])
    return counts.withColumn("pct_mobile", ratio("mobile_sessions", "sessions"))


def top_pages(words: DataFrame, where: Column | None = None) -> DataFrame:
    """Distinct page views per url, most viewed first (the column is named ``sessions``)."""
    return (count_words(apply_where(words, where), ["pageview_url"], {"sessions": None})
            .orderBy(F.col("sessions").desc()))
