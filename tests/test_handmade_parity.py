"""Every query against its oracle on a hand-made event table that holds the
edge cases the generated tables may miss: cart views before, exactly at
and after a period cut, several orders in one session, click-throughs in
two periods of one session, a view exactly on a closed upper bound, a gap
of exactly the session limit, sessions without a later page, and every
traffic channel."""

import datetime as dt
import shutil
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from oracle.sql import SQL
from tests.parity import TABLES, compare, duck

T = dt.datetime.fromisoformat

# (user, time, type, value, k); k picks the channel: 1 gsearch nonbrand, 0 gsearch brand,
# 51 bsearch nonbrand, 71 socialbook, 80 organic (gsearch referer), 95 direct
EVENTS = [
    # user 1: one long session across the cut of 2024-01-16 with carts in three periods
    (1, "2024-01-15 22:00:00", "view", 1.0, 1),
    (1, "2024-01-15 23:00:00", "click", 2.0, 1),
    (1, "2024-01-15 23:30:00", "click", 3.0, 1),
    (1, "2024-01-16 00:00:00", "click", 4.0, 1),          # exactly the cut
    (1, "2024-01-16 01:00:00", "signup", 5.0, 1),
    (1, "2024-01-16 02:00:00", "purchase", 19.99, 2),
    (1, "2024-01-16 03:00:00", "purchase", 5.01, 3),
    (1, "2024-01-16 04:00:00", "click", 6.0, 1),          # last view of the session is a cart
    # user 2: a view exactly on the closed bound 2024-01-27 00:00, then a bounce
    (2, "2024-01-27 00:00:00", "view", 1.0, 51),
    (2, "2024-01-28 12:00:00", "signup", 1.0, 0),
    # user 3: gap of exactly 12 hours stays in the session, 12h + 1s starts a new one
    (3, "2024-01-05 08:00:00", "view", 1.0, 71),
    (3, "2024-01-05 20:00:00", "click", 1.0, 71),
    (3, "2024-01-06 08:00:01", "view", 1.0, 80),
    (3, "2024-01-06 08:10:00", "purchase", 42.5, 80),
    (3, "2024-01-20 10:00:00", "signup", 1.0, 95),
    (3, "2024-01-20 10:05:00", "purchase", 7.25, 95),
    # user 4: new session on a Sunday, repeat a week later, several landers
    (4, "2024-01-07 00:00:00", "signup", 1.0, 1),
    (4, "2024-01-07 00:01:00", "view", 1.0, 1),
    (4, "2024-01-14 23:59:59", "view", 1.0, 5),
    (4, "2024-01-15 00:00:00", "click", 1.0, 5),
    (4, "2024-01-25 09:00:00", "error", 1.0, 88),
    # user 5: a single purchase (order in a one-view session)
    (5, "2024-01-10 10:00:00", "purchase", 100.0, 1),
    # user 6: many sessions for the repeat histogram
    *[(6, f"2024-01-{d:02d} 06:00:00", t, 1.0, 1) for d in range(2, 29, 3) for t in ("view",)],
    *[(6, f"2024-01-{d:02d} 06:30:00", "click", 1.0, 1) for d in range(2, 29, 6)],
    # nobody: each event is a session of its own and nobody's repeat
    (None, "2024-01-08 10:00:00", "view", 1.0, 1),
    (None, "2024-01-08 10:01:00", "click", 1.0, 51),
    (None, "2024-01-08 10:01:00", "purchase", 9.0, 1),
    (None, "2024-01-12 10:00:00", "view", 1.0, 95),
]


@pytest.fixture(scope="module")
def folder():
    out = tempfile.mkdtemp(prefix="shopflow-handmade-")
    for t in TABLES:
        if t != "events":
            shutil.copyfile(f"/root/testdata/sf0.001/{t}.parquet", f"{out}/{t}.parquet")
    rows = sorted(EVENTS, key=lambda e: (T(e[1]), e[0] or 0))
    table = pa.table({
        "event_id": pa.array(range(len(rows)), pa.int64()),
        "ts": pa.array([T(r[1]) for r in rows], pa.timestamp("us")),
        "user_id": pa.array([r[0] for r in rows], pa.int64()),
        "event_type": pa.array([r[2] for r in rows], pa.string()),
        "value": pa.array([r[3] for r in rows], pa.float64()),
        "props": pa.array([f'{{"k": {r[4]}}}' for r in rows], pa.string()),
    })
    pq.write_table(table, f"{out}/events.parquet")
    return out


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_handmade_parity(spark, folder, con, name):
    r = compare(spark, name, folder, con)
    assert r.get("ok"), r.get("error")
