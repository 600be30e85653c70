import re
from collections import defaultdict

import pytest

from shopflow.llm import decontaminate as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k:k + n])].add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (items_ := windows.get(tuple(w[k:k + n]))):
                    hit.update(range(k, k + n))
                    found |= items_
        out[doc] = (len(w), sorted(hit), sorted(found))
    return out


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_equals_brute_force(spark, documents, sf0001, block):
    """In one broadcast and in blocks of the test set."""
    benchmark = spark.read.parquet(f"{sf0001}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    got = {r.doc_id: (r.found.n_words, r.found.hit_words, sorted(r.found["items"]))
           for r in D.find_contamination(documents, benchmark, block_windows=block).collect()}
    assert got == want
    assert sum(bool(v[1]) for v in want.values()) > 0
    clean = D.drop_contaminated(documents, benchmark, block_windows=block)
    assert clean.columns == documents.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, v in want.items() if not v[1]}


def test_a_window_of_every_item_is_dealt_over_the_blocks(spark):
    shared = " ".join(f"w{k}" for k in range(10))
    items = spark.createDataFrame([(k, f"{shared} own{k}") for k in range(200)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {shared} b"), (2, "w0 w1"), (3, f"{shared} own5")], "doc_id long, text string")
    blocks = [b.value for b in D.window_blocks(items, 10, 50)]
    sizes = [sum(map(len, b.items.values())) for b in blocks]
    assert sum(sizes) == 400 and len(sizes) == 8 and max(sizes) < 100
    assert sum(len(b.value.items) for b in D.window_blocks(items, 10, 50, with_items=False)) == 201
    found = {r.doc_id: r.found for r in D.find_contamination(docs, items, block_windows=50).collect()}
    assert found[1].hit_words == list(range(1, 11)) and len(found[1]["items"]) == 200
    assert found[2].hit_words == [] and found[3].hit_words == list(range(11))
    assert [r.doc_id for r in D.drop_contaminated(docs, items, block_windows=50).collect()] == [2]


def test_short_items_spans_and_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "TWO three"), (2, "über ñandú"), (3, None), (4, ""), (None, "Short")],
                                  "item_id long, text string")
    found = {(r.doc_id, r.text): r.found for r in D.find_contamination(odd_docs, items).collect()}
    text = "one  two\tthree four\nfive six seven eight nine ten eleven"
    (span,) = found[3, text].spans
    assert text[span.start:span.end] == "two\tthree"
    assert D.remove_spans(text, [(span.start, span.end)]).startswith("one   four")
    french = "été über ñandú 日本語 😀 " * 50
    assert len(found[8, french].spans) == 50
    assert french[found[8, french].spans[0].start:found[8, french].spans[0].end] == "über ñandú"
    assert found[10, "Short"]["items"] == [""]
    assert found[4, None].n_words == 0
    empty = items.where("item_id > 99")
    assert all(not r.found.hit_words for r in D.find_contamination(odd_docs, empty).collect())
    assert D.find_contamination(no_docs, items).count() == 0
