"""Base tables in day folders, and session facts kept up to date day by day.

``land`` writes a base table as ``day=YYYY-MM-DD`` folders of its event time, so
a period is a partition filter and a marker known only while the query runs
prunes days at run time. ``DailyFacts`` derives the session facts from such
folders. Each day of facts has a signature of the files it is made from: its own
sessions, and every day of orders that holds an order of one of them (a session
open at midnight may order on the next day or later; which days those are is
looked up when a day of orders is new or changed). ``refresh`` rebuilds the days
whose signature changed, in one job, and publishes a new list of days by one
small file: readers see the old list or the new one, never a mixture.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.operators import distinct
from shopflow.operators.grain import session_facts
from shopflow.session import checkpoint_dir
from shopflow.sources import store
from shopflow.sources.schema import SCHEMAS

TIME = "created_at"
FILES_A_DAY = 4


def land(df: DataFrame, path: str) -> None:
    """Add the rows of ``df`` to the day folders of their event time (rows without one to no day's folder)."""
    days = df.withColumn("day", F.to_date(TIME))
    days.repartition("day", F.pmod(F.xxhash64(*df.columns[:1]), F.lit(FILES_A_DAY))).write.mode("append").partitionBy("day").parquet(path)


def day_signatures(spark: SparkSession, path: str) -> dict[str, str]:
    """Number, length and newest time of the files in each day folder, as one listing per day."""
    p, fs = store._fs(spark, path)
    found = {}
    for folder in fs.listStatus(p) if fs.exists(p) else []:
        name = folder.getPath().getName()
        if name.startswith("day=") and "__HIVE" not in name:
            files = [f for f in fs.listStatus(folder.getPath()) if not f.getPath().getName().startswith(("_", "."))]
            found[name[4:]] = f"{len(files)}:{sum(f.getLen() for f in files)}:{max((f.getModificationTime() for f in files), default=0)}"
    return found


def read_days(spark: SparkSession, path: str, table: str, days: list[str] | None = None) -> DataFrame:
    """A landed table with its ``day``; with ``days`` only those folders are listed."""
    schema = T.StructType([*SCHEMAS[table].fields, T.StructField("day", T.DateType())])
    if days is None:
        return spark.read.schema(schema).parquet(path)
    present = set(day_signatures(spark, path))
    folders = [f"{path}/day={d}" for d in days if d in present]
    return spark.read.schema(schema).option("basePath", path).parquet(*folders) if folders else spark.createDataFrame([], schema)


@dataclass
class DailyFacts:
    """Session facts by day, derived from landed sessions and orders, under the shared folder."""

    spark: SparkSession
    sessions: str
    orders: str
    name: str = "daily_facts"

    @property
    def root(self) -> str:
        return f"{checkpoint_dir(self.spark).rstrip('/')}/shopflow/{self.name}"

    def _listed(self) -> tuple[int, dict]:
        """Newest published version and its list: ``days`` (day -> own signature, whole signature, folder) and
        ``orders`` (day of orders -> signature, days of their sessions, number of their unknown sessions)."""
        p, fs = store._fs(self.spark, f"{self.root}/_days")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        versions = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
        if not versions:
            return 0, {"days": {}, "orders": {}}
        text = self.spark.read.text(f"{self.root}/_days/v{max(versions)}", wholetext=True).first()[0]
        return max(versions), json.loads(text)

    def _session_days(self, order_days: list[str]) -> dict[str, tuple[list[str], int]]:
        """For each day of orders: the days of their sessions, and how many of their sessions are unknown."""
        orders = (read_days(self.spark, self.orders, "orders", order_days).where("website_session_id IS NOT NULL")
                  .select("website_session_id", "day").distinct())
        ids = orders.agg(F.min("website_session_id").alias("lo"), F.max("website_session_id").alias("hi")).first()
        sessions = (read_days(self.spark, self.sessions, "website_sessions")  # ids in range only, by the files' statistics
                    .where(F.col("website_session_id").between(F.lit(ids["lo"]), F.lit(ids["hi"])))
                    .select("website_session_id", F.col("day").cast("string").alias("s_day")))
        pairs = (orders.select("website_session_id", F.col("day").cast("string").alias("day")).join(sessions, "website_session_id", "left")
                 .groupBy("day", "s_day").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per pair of days
        return {d: (sorted(r["s_day"] for r in pairs if r["day"] == d and r["s_day"]),
                    sum(r["n"] for r in pairs if r["day"] == d and not r["s_day"])) for d in order_days}

    def _add_sessions_of(self, orders: dict[str, list], session_days: list[str]) -> None:
        """Add new or changed days of sessions to the days of orders that have an order of theirs.

        With unique sessions there is nothing to add: only orders of unknown sessions can be, and these are looked up.
        """

    def refresh(self) -> list[str]:
        """Bring the facts up to date; returns the days that were rebuilt."""
        version, listed = self._listed()
        own, ordered = day_signatures(self.spark, self.sessions), day_signatures(self.spark, self.orders)
        sessions_changed = {d: s for d, s in own.items()} != {d: v[0] for d, v in listed["days"].items()}
        stale = [d for d, sig in ordered.items() if listed["orders"].get(d, [None])[0] != sig
                 or (sessions_changed and listed["orders"][d][2])]
        looked_up = self._session_days(stale) if stale else {}
        orders = {d: [sig, *(looked_up[d] if d in looked_up else listed["orders"][d][1:])] for d, sig in ordered.items()}
        self._add_sessions_of(orders, [d for d, sig in own.items() if listed["days"].get(d, [None])[0] != sig])
        want = {day: "|".join([sig, *[f"{d}={v[0]}" for d, v in sorted(orders.items()) if day in v[1]]]) for day, sig in own.items()}
        changed = sorted(d for d, sig in want.items() if listed["days"].get(d, [None, None])[1] != sig)
        if not changed and listed["days"].keys() == want.keys() and orders == listed["orders"]:
            return []
        attempt = uuid.uuid4().hex[:12]
        if changed:
            order_days = [d for d, v in orders.items() if set(changed) & set(v[1])]
            self._build(changed, order_days).write.partitionBy("day").parquet(f"{self.root}/attempt={attempt}")
        days = {d: [own[d], sig, attempt if d in changed else listed["days"][d][2]] for d, sig in want.items()}
        self._publish(version + 1, {"days": days, "orders": orders}, attempt)
        return changed

    def _build(self, days: list[str], order_days: list[str]) -> DataFrame:
        facts = session_facts(read_days(self.spark, self.sessions, "website_sessions", days),
                              read_days(self.spark, self.orders, "orders", order_days))
        return (facts.withColumn("day", F.to_date(TIME)).repartition("day", F.pmod("website_session_id", F.lit(FILES_A_DAY)))
                .sortWithinPartitions("day", TIME))

    def _publish(self, version: int, days: dict, attempt: str) -> None:
        made, fs = store._fs(self.spark, f"{self.root}/_days/new-{attempt}")
        target, _ = store._fs(self.spark, f"{self.root}/_days/v{version}")
        stream = fs.create(made, True)
        stream.write(bytearray(json.dumps(days).encode()))
        stream.close()
        if fs.exists(target) or not fs.rename(made, target):  # a rename onto an existing file fails
            fs.delete(made, False)
            raise RuntimeError(f"{self.root}: another refresh published version {version}; refresh again")

    def read(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """The facts with their ``day``; of ``since`` to ``until`` (days, both included) only those folders are listed."""
        _, listed = self._listed()
        days = {d: v[2] for d, v in listed["days"].items() if (since is None or d >= since) and (until is None or d <= until)}
        schema = self._schema()
        folders = [f"{self.root}/attempt={f}/day={d}" for d, f in sorted(days.items())]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*folders).drop("attempt")

    def _schema(self):
        empty = [self.spark.createDataFrame([], SCHEMAS[t]) for t in ("website_sessions", "orders")]
        return session_facts(*empty).withColumn("day", F.to_date(TIME)).schema


@dataclass
class DailyWords(DailyFacts):
    """Session words by day (see :mod:`shopflow.operators.distinct`), kept up to date as the facts are.

    Rows may repeat, within a day or on several days: the words of a period hold an id once.
    """

    name: str = "daily_words"

    def _add_sessions_of(self, orders: dict[str, list], session_days: list[str]) -> None:
        """A session may be delivered again on another day, where its orders then count too."""
        if not session_days or not orders:
            return
        sessions = (read_days(self.spark, self.sessions, "website_sessions", session_days)
                    .select("website_session_id", F.col("day").cast("string").alias("s_day")).distinct())
        ids = sessions.agg(F.min("website_session_id").alias("lo"), F.max("website_session_id").alias("hi")).first()
        placed = (read_days(self.spark, self.orders, "orders")
                  .where(F.col("website_session_id").between(F.lit(ids["lo"]), F.lit(ids["hi"])))
                  .select("website_session_id", F.col("day").cast("string").alias("day")).distinct())
        for r in sessions.join(placed, "website_session_id").select("day", "s_day").distinct().collect():  # pairs of days
            if r["day"] in orders:
                orders[r["day"]][1] = sorted({*orders[r["day"]][1], r["s_day"]})

    def _build(self, days: list[str], order_days: list[str]) -> DataFrame:
        words = distinct.session_words(read_days(self.spark, self.sessions, "website_sessions", days),
                                       read_days(self.spark, self.orders, "orders", order_days))
        return (words.repartition("day", F.pmod("word", F.lit(FILES_A_DAY))).sortWithinPartitions("day", "ids", "word"))

    def _schema(self):
        return distinct.session_words(*[self.spark.createDataFrame([], SCHEMAS[t])
                                        for t in ("website_sessions", "orders")]).schema
