"""The prefix trie against one built in plain Python, for several block sizes."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shopflow.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, n long, parent string"


def shared(c):
    return F.crc32(c.cast("string")) % 9


def base(c):
    return c - c % 5


def brute_force(rows):
    """Nodes of the rebuilt conversations, by their whole sequences."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        b = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(own.get(b, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for node, cs in members.items():
        below = [v for v in members if v[:len(node)] == node]
        kids = [v for v in below if len(v) == len(node) + 1]
        leaves = [v for v in below if not any(w[:-1] == v and w for w in members)]
        saved = sum((len(members[v]) - 1) * (len(v[-1][1].encode()) if v else 0) for v in below)
        ends = ",".join(str(c) for c in sorted(cs) if rebuilt[c] == node)
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), len(leaves),
                    saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, block_turns):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    found = conversation_trie.rebuilt_trie(df, shared, base, 8, block_turns)
    return sorted((tuple(r) for r in found.collect()), key=str)


#: Long and short, shared openings, null and repeated turns, ties, empty texts, a negative id, no id.
ODD = ([(c, t, "user", f"turn {t}") for c in range(12) for t in range(6 + c)]
       + [(20, None, None, None), (20, None, "user", None), (20, 0, "", ""), (20, 0, "", ""), (20, 0, "a", "b")]
       + [(21, 5, "user", "late"), (22, 1, "user", "été 😀"), (-7, 0, "user", "x"), (-5, 0, "user", "x")]
       + [(None, 0, "user", "nobody")]
       + [(30 + c, t, "user", "same" if t < 9 else f"tail {c % 3}") for c in range(6) for t in range(12)])


@pytest.mark.parametrize("block_turns", [1, 3, 4])
def test_equals_brute_force(spark, block_turns):
    assert trie(spark, ODD, block_turns) == brute_force(ODD)


def test_ranges_segments_and_lists(spark, monkeypatch):
    """Segments of two blocks and lists of three ids give the same trie."""
    monkeypatch.setattr(conversation_trie, "SEGMENT_BLOCKS", 2)
    monkeypatch.setattr(conversation_trie, "LISTED_IDS", 3)
    rows = ODD + [(100 + c, t, "user", f"t{t}") for c in range(20) for t in range(10)]
    assert trie(spark, rows, 2) == brute_force(rows)


def test_empty_table_and_only_turnless(spark):
    assert trie(spark, [], 4) == []
    turnless = [(c, 0, "user", "x") for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9 > 0]
    assert trie(spark, turnless, 4) == brute_force(turnless)
