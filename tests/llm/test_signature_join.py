import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shopflow.llm import signature_join as S
from shopflow.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in where[s])
        for s in sets[i]:
            where[s].append(i)
        for j, o in shared.items():
            if den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(rng, n_docs, n_words, edits, start, vocabulary=4000):
    base = [f"w{rng.integers(vocabulary)}" for _ in range(n_words)]
    out = []
    for k in range(n_docs):
        words = list(base)
        for at in rng.integers(0, n_words, edits):
            words[at] = f"e{rng.integers(10**6)}"
        out.append((start + k, " ".join(words)))
    return out


def check(spark, rows, n, num, den):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.similar_components(docs, n, num, den).collect()}
    assert got == brute(rows, n, num, den)
    kept = {r.doc_id for r in S.keep_one_of_each(docs, n, num, den).collect()}
    assert kept == {i for i, (size, root) in brute(rows, n, num, den).items() if not size or root == i}


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 8, 10)])
def test_documents_equal_brute_force(spark, documents, n, num, den):
    check(spark, [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()], n, num, den)


@pytest.mark.parametrize("small", [False, True])
def test_families_around_the_threshold(spark, monkeypatch, small):
    """Chains and near misses; with small blocks also the ways across blocks of large clusters."""
    if small:
        monkeypatch.setattr(S, "BLOCK_TOKENS", 2500)
        monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(11)
    rows, passage = [], " ".join(f"p{k}" for k in range(60))
    for f in range(25):
        rows += family(rng, int(rng.integers(1, 9)), int(rng.integers(8, 250)), int(rng.integers(0, 4)), len(rows))
    rows += family(rng, 80, 150, 1, len(rows))  # one large family
    rows += family(rng, 60, 100, 4, len(rows))  # mostly too far apart
    rows += [(i, f"{t} {passage}") for i, (_, t) in enumerate(family(rng, 40, 50, 25, 0), len(rows))]
    check(spark, rows, 3, 9, 10)


def copied_families(seed):
    """Families of near copies, common words in them; about half of the members stand twice."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(300):
        members = [t for _, t in family(rng, 4, int(rng.integers(25, 120)), 1, 0, vocabulary=300)]
        texts += members + [t for t in members if rng.random() < 0.5]
    return list(enumerate(texts))


def test_copies_in_several_partitions_equal_brute_force(spark):
    rows = copied_families(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.similar_components(docs).collect()}
    assert got == brute(rows, 3, 9, 10)


@pytest.mark.parametrize("parts", [1, 7])
def test_copies_leave_the_groups_alone(spark, parts):
    """A node emitted twice, from one slice or from two partitions, counts once."""
    rows = copied_families(3)
    once = list({t: (i, t) for i, t in reversed(rows)}.values())
    order = spark.sparkContext.broadcast(S.counted_hashes(
        spark.createDataFrame(once, "doc_id long, text string").coalesce(1), 3, 0, 100_000))

    def groups(texts):
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
        return sorted(map(tuple, S.prefix_groups(docs, 3, 0, order, 9, 10).collect()))

    assert groups(rows) == groups(once)


def test_tree_finds_all_links():
    rng = np.random.default_rng(2)
    for _ in range(30):
        base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(20, 60), replace=False),
                                          rng.integers(0, 1 << 60, rng.integers(0, 4)).astype(np.uint64)]))
                for _ in range(int(rng.integers(2, 70)))]
        tree, at = S.SignatureTree.of_sets(sets, np.arange(len(sets)), 8, 10)
        list(tree.stars())
        group = dict(zip(at.tolist(), tree.labels.tolist()))
        want = {i: (0, i) for i in range(len(sets))}
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 10 * o >= 8 * (len(sets[i]) + len(sets[j]) - o):
                    old, new = label[i], label[j]
                    label = [new if x == old else x for x in label]
        assert want and all((group[i] == group[j]) == (label[i] == label[j])
                            for i in range(len(sets)) for j in range(i))


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(0, 300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in components(chain.repartition(5), "chain").collect()}
    assert got == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000}


def test_odd_rows(odd_docs, no_docs):
    rows = S.similar_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.n_shingles, r.component_id))
    assert found[1] + found[2] + found[3] == [(9, 1)] * 4
    assert found[4] == [(0, 4)] and found[5] == [(0, 5)] and found[6] == [(0, 6)]
    assert found[None] == [(3, None)] * 2
    assert found[7] == [(1, 7)] and found[10] == [(1, 10)]
    kept = S.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 10, 11]
    assert S.similar_components(no_docs).count() == 0
    assert S.keep_one_of_each(no_docs).count() == 0
