"""Session facts kept up to date by day: only touched days are rebuilt, and the result equals a full build."""

import tempfile

import pytest
from pyspark.sql import functions as F

from shopflow.operators.grain import session_facts
from shopflow.plans import checks
from shopflow.plans.registry import QUERIES
from shopflow.sources.daily import DailyFacts, land
from shopflow.sources.testdata import shop_data
from tests import rows as R


def session(i, when):
    return (i, when, i % 5, 0, "gsearch", "nonbrand", "mobile", None)


def order(i, when, s):
    return (i, when, s, 1, 1, 10.0 + i)


class Shop:
    def __init__(self, spark):
        self.spark, root = spark, tempfile.mkdtemp(prefix="daily-")
        self.paths = {t: f"{root}/{t}" for t in ("sessions", "orders")}
        self.rows = {"sessions": [], "orders": []}
        self.facts = DailyFacts(spark, self.paths["sessions"], self.paths["orders"], f"daily-{root[-8:]}")

    def add(self, **new):
        for name, rows in new.items():
            land(getattr(R, name)(self.spark, rows), self.paths[name])
            self.rows[name] += rows
        return self.facts.refresh()

    def check(self):
        want = session_facts(R.sessions(self.spark, self.rows["sessions"]), R.orders(self.spark, self.rows["orders"]))
        got = self.facts.read().drop("day")
        assert got.columns == want.columns and got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.fixture
def shop(spark):
    s = Shop(spark)
    days = s.add(sessions=[session(10 * d + k, f"2024-01-{d:02d} {h}:00:00") for d in range(1, 6) for k, h in enumerate(("08", "23"))],
                 orders=[order(d, f"2024-01-{d:02d} 09:00:00", 10 * d) for d in range(1, 6)])
    assert days == [f"2024-01-0{d}" for d in range(1, 6)]
    s.check()
    return s


def test_a_new_day_rewrites_two_days_at_most(shop):
    """The session open at midnight orders on the new day: its day and the new one are built, no other."""
    rebuilt = shop.add(sessions=[session(60, "2024-01-06 08:00:00")],
                       orders=[order(6, "2024-01-06 00:30:00", 51), order(7, "2024-01-06 09:00:00", 60)])
    assert rebuilt == ["2024-01-05", "2024-01-06"]
    shop.check()


def test_nothing_new_rebuilds_nothing(shop):
    before = shop.facts._listed()[0]
    assert shop.facts.refresh() == [] and shop.facts._listed()[0] == before


def test_a_session_open_for_days(shop):
    """An order three days after its session's start reaches the session's day; the days between stay."""
    assert shop.add(orders=[order(8, "2024-01-06 10:00:00", 20)]) == ["2024-01-02"]
    shop.check()


def test_late_sessions_find_their_orders(shop):
    """The order came first and had no session; when the session is delivered it is counted."""
    assert shop.add(orders=[order(9, "2024-01-07 10:00:00", 70)]) == []
    shop.check()
    assert shop.add(sessions=[session(70, "2024-01-07 09:00:00")]) == ["2024-01-07"]
    shop.check()


def test_changed_orders_of_one_day(shop):
    assert shop.add(orders=[order(11, "2024-01-03 12:00:00", 31), order(12, "2024-01-03 13:00:00", None)]) == ["2024-01-03"]
    shop.check()


def test_empty_folders(spark):
    s = Shop(spark)
    assert s.facts.refresh() == [] and s.facts.read().count() == 0


def test_two_refreshes_of_one_version(shop):
    """The second to publish a version is refused; the published list stays whole."""
    version, listed = shop.facts._listed()
    with pytest.raises(RuntimeError):
        shop.facts._publish(version, listed, "other")
    shop.check()


def test_a_week_lists_a_week_of_files(shop, spark, sf0001):
    files = shop.facts.read("2024-01-02", "2024-01-03").inputFiles()
    assert files and all("day=2024-01-02" in f or "day=2024-01-03" in f for f in files)
    week = shop_data(spark, sf0001).daily.read("2024-01-08", "2024-01-14")
    days = {f.split("day=")[1][:10] for f in week.inputFiles()}
    assert days <= {f"2024-01-{d:02d}" for d in range(8, 15)}
    assert week.count() == shop_data(spark, sf0001).facts.filter(
        "created_at >= timestamp_ntz'2024-01-08' AND created_at < timestamp_ntz'2024-01-15'").count()


def test_markers_prune_days(spark, sf0001):
    """The marker's day is known only while the query runs, and still is a filter on partitions."""
    filters = checks.partition_filters(QUERIES["daily_page_version_conversion"](spark, sf0001))
    assert any("day" in f and "ubquery" in f for f in filters)
    static = shop_data(spark, sf0001).landed_pageviews().filter(F.col("day") == F.lit("2024-01-09").cast("date"))
    assert any("2024-01-09" in f for f in checks.partition_filters(static))
