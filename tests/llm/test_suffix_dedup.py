import hashlib
from collections import Counter

import numpy as np
import pytest

from shopflow.llm import suffix_dedup as S


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s:s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        covered = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                covered[s:s + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        out.append((i or 0, len(b), int(covered.sum()), len(S.runs_of(covered)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_suffix_arrays_equal_sorting():
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = np.append(rng.integers(1, rng.integers(2, 5), rng.integers(0, 60)), 0).astype(np.uint8)
        raw = text.tobytes()
        assert [raw[p:] for p in S.suffix_array(text, 1000)] == sorted(raw[p:] for p in range(len(raw)))


def test_common_prefixes():
    text = np.frombuffer(b"abcabcabcabcabcabcab" * 30, np.uint8)
    at = np.array([0, 3, 20, 1])
    assert S.common_prefixes(text, at, 16, block=8).tolist() == [16, 16, 0]


def test_documents_equal_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = rows_of(S.remove_repeats(documents))
    assert got == brute(rows, 400)
    assert sum(r[2] > 0 for r in got) > 10


@pytest.mark.parametrize("block", [4000, 3])
def test_short_strings_runs_and_blocks(spark, monkeypatch, block):
    """Overlaps, repeats inside one text, runs of one byte; small blocks also go through the count across blocks."""
    monkeypatch.setattr(S, "FRAGMENTS_PER_BLOCK", block)
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0 if block == 3 else 250_000)  # and the join without a broadcast
    rng = np.random.default_rng(4)

    def noise(n):
        return "".join(map(chr, rng.integers(97, 123, n)))

    passage = noise(60)
    rows = [(k, noise(int(rng.integers(0, 80))) + passage[int(rng.integers(0, 20)):] + noise(int(rng.integers(0, 80))))
            for k in range(60)]
    rows += [(100, "a" * 200), (101, "é" * 90), (102, noise(50) * 3), (103, noise(19)), (104, passage), (105, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(S.remove_repeats(docs, length=32, gram=8)) == brute(rows, 32)


def test_chunks_of_long_texts(spark):
    """Chunks give the same starts under the same grams, texts over many chunks the same result."""
    rng = np.random.default_rng(9)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 700, 700, 712, 5000])

    def starts(chunk):
        row, grams, _, s1, s2 = S.fragments_of(data, offsets, 32, 8, chunk)
        return sorted((int(r), k, int(g)) for r, g, a, b in zip(row, grams, s1, s2) for k in range(a, b + 1))

    whole = starts(1 << 20)
    assert whole and starts(100) == starts(33) == starts(1) == whole
    assert len(starts(5000)) == 700 - 31 + 4288 - 31


def test_hashes_that_clash_across_blocks_remove_nothing(spark, documents, monkeypatch):
    """Every string under one hash and a block per fragment: only equal bytes are removed."""
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").limit(40).collect()]
    shared = "It was the same sentence in each of them, word by word. "
    rows = [(k, (t or "")[:300] + (shared if k % 2 else "") + (t or "")[300:500]) for k, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    starts = S._same_strings(
        spark.createDataFrame([(1, 10, 0, 7), (1, 11, 0, 7), (1, 12, 0, 7), (1, 13, 2, 7), (2, 14, 0, 7)],
                              "gram long, content long, a int, seen long"),
        spark.createDataFrame([(1, 10, b"abcdX"), (1, 11, b"abcdY"), (1, 12, b"zzzzz"), (1, 13, b"__abcd"), (2, 14, b"abcd")],
                              "gram long, content long, piece binary"), 4)
    assert sorted((r.content, r.a, r.b) for r in starts.collect()) == [(10, 0, 1), (11, 0, 1), (13, 2, 3)]
    monkeypatch.setattr(S, "FRAGMENTS_PER_BLOCK", 1)
    assert rows_of(S.remove_repeats(docs, length=40, gram=8)) == brute(rows, 40)


def test_planted_passages_are_removed_and_clean_documents_kept(spark):
    """Recall on passages of 400 bytes and more, read from n_removed, and no byte of a clean document."""
    rng = np.random.default_rng(11)

    def words(n):
        return " ".join("".join(map(chr, rng.integers(97, 123, int(rng.integers(2, 9))))) for _ in range(n))

    passages = [words(90) for _ in range(8)]
    planted = {k: f"{words(60)} {passages[k % 8]} {words(40)}" for k in range(64)}
    clean = {k: words(200) for k in range(100, 140)}
    docs = spark.createDataFrame([*planted.items(), *clean.items()], "doc_id long, text string").repartition(4)
    removed = {r.doc_id: r.n_removed for r in S.remove_repeats(docs).collect()}
    assert all(removed[k] >= len(passages[k % 8]) for k in planted)  # recall 1
    assert all(removed[k] == 0 for k in clean)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(S.remove_repeats(odd_docs)) == brute(rows, 400)
    assert rows_of(S.remove_repeats(odd_docs, length=16, gram=4)) == brute(rows, 16)
    assert S.remove_repeats(no_docs).count() == 0
