"""Sessionisation against a brute-force reference on random event sequences."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shopflow.sources import fixtures

GAP = dt.timedelta(hours=12)
T0 = dt.datetime(2024, 1, 1)


def brute_force(events):
    """(event_id, session id, is_start, is_first) by walking each user's events in order."""
    out = {}
    by_user = {}
    for e in events:
        by_user.setdefault(e[2], []).append(e)
    for evs in by_user.values():
        evs.sort(key=lambda e: (e[1], e[0]))
        prev, sid = None, None
        for i, (eid, ts, _u) in enumerate(evs):
            start = prev is None or ts - prev > GAP
            if start:
                sid = eid
            out[eid] = (sid, start, i == 0)
            prev = ts
    return out


event_lists = st.lists(
    st.tuples(st.integers(0, 3),                                  # user
              st.integers(0, 6 * 24 * 60)),                       # minute within six days
    min_size=1, max_size=40)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=event_lists, split_hours=st.sampled_from([1, 5, 24, 1000]),
       exact_gap=st.booleans())
def test_tag_sessions_matches_brute_force(spark, rows, split_hours, exact_gap):
    events = []
    for i, (user, minute) in enumerate(rows):
        ts = T0 + dt.timedelta(minutes=minute)
        events.append((i, ts, user))
    if exact_gap:                                   # a gap of exactly the limit stays in the session
        events.append((len(events), events[0][1] + GAP, events[0][2]))
    df = spark.createDataFrame([(e[0], e[1], e[2], "view", 1.0, '{"k": 1}') for e in events],
                               "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                               "value double, props string")
    got = {r["event_id"]: (r["website_session_id"], r["is_start"], r["is_first"])
           for r in fixtures.tag_sessions(df, split_hours=split_hours).collect()}
    assert got == brute_force(events)
