"""Hard negatives against all pairs; cover trees against their own bounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopflow.llm import hard_negatives

SCHEMA = "vec_id long, label long, vec array<float>, score long, g long"


def brute_force(rows):
    live = {(i, l, tuple(math.floor(256 * np.float32(x).astype(float)) for x in v)) for i, l, v in rows
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in live:
        if a[0] % 50:
            continue

        def ranked(others):
            scored = [(sum(x * y for x, y in zip(a[2], r[2])), r) for r in others]
            return sorted(scored, key=lambda s: (-s[0], s[1][0]))

        for p, row in ranked(r for r in live if r[1] == a[1] and r != a)[:5]:
            fits = [(n, r) for n, r in ranked(r for r in live if r[1] != a[1]) if 50 * p <= 100 * n <= 95 * p]
            out += [(a[0], row[0], k + 1, r[0], p, n) for k, (n, r) in enumerate(fits[:3])]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect())


def vectors(n, width, clusters, spread, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, width))
    out = centers[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, width))
    return [(i, int(rng.integers(0, 3)), [float(x) for x in v]) for i, v in enumerate(out.astype(np.float32))]


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_equals_brute_force(spark, monkeypatch, spread):
    """Several trees with and without cluster structure, several chunks."""
    monkeypatch.setattr(hard_negatives, "TREE_ROWS", 150)
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "ROWS_A_CENTER", 2)
    monkeypatch.setattr(hard_negatives, "CHUNK_QUERIES", 4)
    rows = vectors(600, 12, 15, spread, 3)
    want = brute_force(rows)
    assert want and mined(spark, rows) == want


def test_odd_rows(spark):
    """Nulls, non-finite and empty vectors, ties, repeated rows, several rows of one id, other lengths."""
    rows = vectors(120, 4, 3, 0.3, 5)
    rows += [(200, None, [1.0] * 4), (250, 1, None), (201, 1, [1.0, None, 0.0, 0.0]), (202, 1, [float("nan")] * 4),
             (203, 1, [float("inf")] * 4), (None, 1, [1.0] * 4), (300, 1, []), (301, 1, [2.0]), (302, 2, [1.0] * 6)]
    rows += [(400, 1, [1.0, 0.5, 0.0, 0.0])] * 3 + [(i, 1, [1.0, 0.5, 0.0, 0.0]) for i in range(401, 410)]
    rows += [(i, 2, [0.7, 0.2, 0.0, 0.0]) for i in range(420, 430)] + [(420, 2, [0.9, 0.2, 0.1, 0.0])]
    assert mined(spark, rows) == brute_force(rows)


def test_empty_table_and_huge_components(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [3e38, 0.0]), (1, 1, [3e38, 1.0]), (2, 2, [-3e38, 0.0])]) == []


def test_tree_bounds_hold():
    rng = np.random.default_rng(1)
    points = np.round(256 * (rng.normal(size=(8, 6))[rng.integers(0, 8, 3000)] + 0.05 * rng.normal(size=(3000, 6)))).astype(np.int32)
    tree = hard_negatives.CoverTree(points, np.zeros(3000, np.int64), np.arange(3000), np.arange(3000))
    assert sorted(tree.ids.tolist()) == list(range(3000)) and len(tree.nodes) > 20
    lifted = np.concatenate([tree.points, np.sqrt(np.maximum(tree.top_square - (tree.points.astype(float) ** 2).sum(1), 0))[:, None]], axis=1)
    for (center, lo, hi, child, end, _, _), radius in zip(tree.nodes.tolist(), tree.radii):
        assert (np.linalg.norm(lifted[lo:hi] - lifted[center], axis=1) <= radius + 1e-6).all()
        if child < end:
            spans = sorted(tree.nodes[child:end, 1:3].tolist())
            assert spans[0][0] == lo and spans[-1][1] == hi and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_search_skips_nodes(monkeypatch):
    """With clusters far apart most leaves are never scored."""
    rng = np.random.default_rng(2)
    points = np.round(256 * (rng.normal(size=(40, 16))[np.repeat(np.arange(40), 100)] + 0.01 * rng.normal(size=(4000, 16)))).astype(np.int32)
    tree = hard_negatives.CoverTree(points, np.zeros(4000, np.int64), np.arange(4000), np.arange(4000))
    scored = []
    real = hard_negatives.Search._verify
    monkeypatch.setattr(hard_negatives.Search, "_verify", lambda self, t, q, lo, hi, s: (scored.append(s.size), real(self, t, q, lo, hi, s)))
    run = hard_negatives.Search(points[:5], np.zeros(5, np.int64), np.full((5, 2), -1), np.full(5, -np.inf), np.full(5, np.inf), True, 3)
    run.over(tree)
    want = -np.sort(-(points[:5].astype(np.int64) @ points.T.astype(np.int64)), axis=1)[:, :3]
    assert (run.score == want).all() and sum(scored) < 5 * 4000 / 4


def test_chunks_of_equal_vectors(spark, monkeypatch):
    """Queries of one vector and label fill several chunks; none is taken for another."""
    monkeypatch.setattr(hard_negatives, "CHUNK_QUERIES", 4)
    monkeypatch.setattr(hard_negatives, "TREE_ROWS", 40)
    rows = [(50 * i, 1, [1.0, 0.5]) for i in range(30)] + [(50 * i + 1, 2, [0.75, 0.25]) for i in range(90)]
    want = brute_force(rows)
    assert len(want) == 30 * 5 * 3 and mined(spark, rows) == want


def test_empty_vectors_only(spark):
    rows = [(0, 1, []), (50, 1, []), (51, 2, [])]
    want = brute_force(rows)
    assert len(want) == 2 and mined(spark, rows) == want


def test_chunks_and_trees_are_not_copied_through_a_shuffle(spark):
    """Chunks once went to each group of trees: 45 GB of shuffle files on 3.4 GB of vectors."""
    df = spark.createDataFrame([(*r, 1, 1) for r in vectors(600, 12, 15, 1.0, 3)], SCHEMA)
    plan = hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("CartesianProduct") == 1
    assert "negatives-trees" not in plan


@pytest.mark.parametrize("same", [True, False])
def test_windows_of_one_row(same, monkeypatch):
    """Rows with several windows, few and many hits, ties at the last rank: as each window by itself."""
    monkeypatch.setattr(hard_negatives, "SCORED_POINTS", 100)
    monkeypatch.setattr(hard_negatives, "SCORED_ROWS", 7)
    rng = np.random.default_rng(4)
    points, labels = rng.integers(-3, 4, (900, 3)).astype(np.int32), rng.integers(0, 3, 900)
    ids, marks = rng.integers(0, 600, 900), np.arange(900)
    of = np.sort(np.concatenate([np.arange(40), rng.integers(0, 40, 60)]))
    lo = np.where(rng.random(100) < 0.3, -np.inf, rng.integers(-20, 20, 100))
    hi = np.where(rng.random(100) < 0.3, np.inf, lo + rng.integers(0, 25, 100))
    run = hard_negatives.Search(points[:40], labels[:40], np.stack([ids[:40], marks[:40]], axis=1), lo, hi, same, 4, of)
    for a in range(0, 900, 300):
        run.over(hard_negatives.CoverTree(*(x[a:a + 300] for x in (points, labels, ids, marks))))
    for w, q in enumerate(of):
        score = points @ points[q]
        fits = ((labels == labels[q]) == same) & (score >= lo[w]) & (score <= hi[w]) & (marks != q)
        want = sorted((-score[i], ids[i], marks[i]) for i in np.flatnonzero(fits))[:4]
        n = np.isfinite(run.score[w]).sum()
        assert [(-s, *f) for s, f in zip(run.score[w, :n], run.found[w, :n].tolist())] == want
