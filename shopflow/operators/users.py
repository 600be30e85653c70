"""User analyses: repeat visits, time to repeat, channels and value of new
and repeat sessions.

"Repeat sessions of the same user after this new session" is answered
without pairing sessions: session ids are cut into ranges (``id_bucket``
ids each); inside a (user, range) a running window in descending id order
counts the later repeats, and a one-row-per-(user, range) summary scanned
in range order adds everything in later ranges. A user with a huge number
of sessions is thus spread over many ranges and tasks, and the ordered
scan across ranges runs on the small summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.functions.buckets import at
from shopflow.functions.channels import SEARCH_REFERERS, channel_group
from shopflow.functions.ratio import ratio

SID = "website_session_id"


def _period(df: DataFrame, lo, hi) -> DataFrame:
    """``lo <= created_at < hi``."""
    return df.filter((F.col("created_at") >= at(lo)) & (F.col("created_at") < at(hi)))


def new_and_repeat(sessions: DataFrame, lo, hi) -> tuple[DataFrame, DataFrame]:
    s = _period(sessions, lo, hi)
    new = s.filter(F.col("is_repeat_session") == 0).select("user_id", F.col(SID).alias("new_id"),
                                                            F.col("created_at").alias("first_time"))
    rep = s.filter(F.col("is_repeat_session") == 1).select("user_id", F.col(SID).alias("rid"),
                                                            F.col("created_at").alias("rtime"))
    return new, rep


def repeat_sessions(sessions: DataFrame, lo, hi) -> DataFrame:
    """Each new session in [lo, hi) with each later repeat session of its user
    in the same period (NULL when none): ``user_id, new_id, repeated_id``.

    The result is a list of pairs by definition; a user has one new session,
    so its size is the number of repeat sessions. The pairs come from an
    inner join, whose skewed side (a user with very many sessions) adaptive
    execution can split. New sessions without a later repeat are those above
    their user's largest repeat id, a one-row-per-user aggregate. Sessions
    without a user have no repeats.
    """
    new, rep = new_and_repeat(sessions, lo, hi)
    rep = rep.withColumnRenamed("user_id", "r_user").filter(F.col("r_user").isNotNull())
    pairs = (new.join(rep, (F.col("user_id") == F.col("r_user")) & (F.col("rid") > F.col("new_id")))
             .select("user_id", "new_id", F.col("rid").alias("repeated_id")))
    last = rep.groupBy("r_user").agg(F.max("rid").alias("last_rid"))
    alone = (new.join(last, F.col("user_id") == F.col("r_user"), "left")
             .filter(F.col("last_rid").isNull() | (F.col("last_rid") <= F.col("new_id")))
             .select("user_id", "new_id", F.lit(None).cast("long").alias("repeated_id")))
    return pairs.unionByName(alone)


def later_repeats(sessions: DataFrame, lo, hi, id_bucket: int = 1 << 20) -> DataFrame:
    """Per new session in [lo, hi): ``repeats`` (later repeat sessions of the
    user in the period), ``second_id`` (smallest such id) and
    ``second_time`` (earliest such start, taken on its own), plus
    ``user_id, new_id, first_time``.

    No pairs are formed: inside each (user, id range) a running window in
    descending id order gives the repeats after each session in the same
    range; a one-row-per-(user, range) summary scanned in range order adds
    the repeats of all later ranges. Sessions without a user are nobody's
    repeats: they are counted with 0 and stay out of the windows.
    """
    chosen = _period(sessions, lo, hi).filter(F.col("is_repeat_session").isin(0, 1))
    s = (chosen.filter(F.col("user_id").isNotNull())
         .select("user_id", F.col(SID).alias("sid"), "created_at",
                 (F.col("is_repeat_session") == 1).alias("is_rep"),
                 F.floor(F.col(SID) / id_bucket).alias("b")))
    rep_id = F.when(F.col("is_rep"), F.col("sid"))
    rep_t = F.when(F.col("is_rep"), F.col("created_at"))

    later_here = (Window.partitionBy("user_id", "b").orderBy(F.col("sid").desc())
                  .rowsBetween(Window.unboundedPreceding, -1))
    rows = s.select("user_id", "b", "sid", "created_at", "is_rep",
                    F.count(rep_id).over(later_here).alias("n_in"),
                    F.min(rep_id).over(later_here).alias("id_in"),
                    F.min(rep_t).over(later_here).alias("t_in"))

    later_ranges = (Window.partitionBy("user_id").orderBy(F.col("b").desc())
                    .rowsBetween(Window.unboundedPreceding, -1))
    suffix = (s.groupBy("user_id", "b").agg(F.count(rep_id).alias("c"), F.min(rep_id).alias("mi"),
                                            F.min(rep_t).alias("mt"))
              .select("user_id", "b", F.sum("c").over(later_ranges).alias("n_after"),
                      F.min("mi").over(later_ranges).alias("id_after"),
                      F.min("mt").over(later_ranges).alias("t_after")))
    new = rows.filter(~F.col("is_rep")).join(suffix, ["user_id", "b"], "left")
    known = new.select(
        "user_id", F.col("sid").alias("new_id"), F.col("created_at").alias("first_time"),
        (F.col("n_in") + F.coalesce("n_after", F.lit(0))).alias("repeats"),
        F.least("id_in", "id_after").alias("second_id"),
        F.least("t_in", "t_after").alias("second_time"))
    nobody = chosen.filter(F.col("user_id").isNull() & (F.col("is_repeat_session") == 0)).select(
        "user_id", F.col(SID).alias("new_id"), F.col("created_at").alias("first_time"),
        F.lit(0).cast("long").alias("repeats"), F.lit(None).cast("long").alias("second_id"),
        F.lit(None).cast("timestamp_ntz").alias("second_time"))
    return known.unionByName(nobody)


def repeat_histogram(sessions: DataFrame, lo, hi, id_bucket: int = 1 << 20) -> DataFrame:
    """Users (new sessions) by number of later repeat sessions; zero is a bucket."""
    return (later_repeats(sessions, lo, hi, id_bucket)
            .groupBy(F.col("repeats").alias("repeated_sessions"))
            .agg(F.count("new_id").alias("users")))


def first_to_second(sessions: DataFrame, lo, hi, id_bucket: int = 1 << 20) -> DataFrame:
    """Each new session with its user's next repeat session: ``user_id,
    first_id, second_id, second_time, first_time`` (NULLs when none)."""
    return later_repeats(sessions, lo, hi, id_bucket).select(
        "user_id", F.col("new_id").alias("first_id"), "second_id", "second_time", "first_time")


def time_to_repeat(sessions: DataFrame, lo, hi, id_bucket: int = 1 << 20) -> DataFrame:
    """Min, max and average calendar days from first to second session."""
    days = F.datediff(F.to_date("second_time"), F.to_date("first_time"))
    return (first_to_second(sessions, lo, hi, id_bucket).filter(F.col("second_id").isNotNull())
            .agg(F.min(days).alias("min_days_first_to_second"),
                 F.max(days).alias("max_days_first_to_second"),
                 F.avg(days).alias("avg_days_first_to_second")))


def channel_new_vs_repeat(sessions: DataFrame, lo, hi, organic=SEARCH_REFERERS) -> DataFrame:
    """New and repeat sessions per channel group (first match wins; sessions
    matching no group form a NULL group)."""
    return (_period(sessions, lo, hi).groupBy(channel_group(organic).alias("channel_group"))
            .agg(F.count_if(F.col("is_repeat_session") == 0).alias("new_sessions"),
                 F.count_if(F.col("is_repeat_session") == 1).alias("repeat_sessions")))


def new_vs_repeat_value(facts: DataFrame, lo, hi) -> DataFrame:
    """Sessions, conversion and revenue per session for new and repeat sessions."""
    agg = _period(facts, lo, hi).groupBy("is_repeat_session").agg(
        F.count(SID).alias("sessions"), F.sum("n_orders").alias("o"),
        F.sum("revenue").cast("double").alias("rev"))
    return agg.select("is_repeat_session", "sessions", ratio("o", "sessions").alias("conv_rate"),
                      ratio("rev", "sessions").alias("rev_per_session"))


def customer_value(facts: DataFrame, where: Column | None = None, organic=SEARCH_REFERERS,
                   n: int | None = None) -> DataFrame:
    """Per user: channel group of the first session, sessions, orders and
    revenue, most valuable first.

    With ``n`` the first ``n`` users only: each task keeps its best ``n`` and
    the heaps are merged, so the users are not sorted as a whole.
    """
    ranked = (_per_user(facts, where, organic)
              .select("user_id", "first_channel", "sessions", "orders", F.col("revenue").cast("double"))
              .orderBy(F.col("revenue").desc(), "user_id"))
    return ranked if n is None else ranked.limit(n)


def _per_user(facts: DataFrame, where: Column | None, organic) -> DataFrame:
    """Per known user, revenue kept as an exact decimal (sums of it do not depend on order)."""
    f = (facts if where is None else facts.filter(where)).filter(F.col("user_id").isNotNull())
    per = f.groupBy("user_id").agg(
        F.min(F.struct(SID, channel_group(organic).alias("ch"))).alias("first"),
        F.count(SID).alias("sessions"), F.sum("n_orders").alias("orders"),
        F.coalesce(F.sum("revenue"), F.lit(0)).alias("revenue"))
    return per.select("user_id", F.col("first.ch").alias("first_channel"), "sessions", "orders", "revenue")


def customer_value_by_channel(facts: DataFrame, where: Column | None = None,
                              organic=SEARCH_REFERERS) -> DataFrame:
    """Users, buying users, revenue and revenue per user by the channel group
    of the user's first session."""
    agg = _per_user(facts, where, organic).groupBy("first_channel").agg(
        F.count("user_id").alias("users"), F.count_if(F.col("orders") > 0).alias("buyers"),
        F.sum("revenue").cast("double").alias("revenue"))
    return agg.withColumn("rev_per_user", ratio("revenue", "users"))
