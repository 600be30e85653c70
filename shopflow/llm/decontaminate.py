"""Benchmark decontamination: broadcast hash sets of test n-grams, scanned over all documents.

Words are maximal runs of digits, letters a-z (A-Z lowered) and characters
beyond ASCII. A benchmark item gives every run of ``n`` consecutive words, or
its whole sequence when shorter. Document windows of the same lengths are
hashed by prefix sums over whole Arrow batches, looked up in the hash set, and
each hit is verified on the words themselves.

The test set is broadcast in blocks of about ``block_windows`` rows, one per
window and item that has it, however many items share a window; a larger one
takes one pass over the documents per block, the findings of the earlier passes
travelling with each row. Where only the documents are wanted that have none, a
block has a row per distinct window.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from shopflow.llm.bytewords import (LOWER, char_positions, sequence_hashes, span_hashes,
                                    text_slices, word_spans)
from shopflow.llm.staging import stage

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

WINDOW_SCHEMA = "item_id string, length int, hash long, words string"
FOUND_TYPE = ("struct<n_words: bigint, hit_words: array<int>, items: array<string>, "
              "spans: array<struct<start: bigint, end: bigint>>>")
_FOUND = pa.struct([("n_words", pa.int64()), ("hit_words", pa.list_(pa.int32())),
                    ("items", pa.list_(pa.string())),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The distinct windows of the items: item_id (as text), length, hash, words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                ids = rows.column(0).to_pylist()
                start, end, row = word_spans(data, offsets, WORD)
                low = LOWER[data]
                hashes, raw = span_hashes(low, start, end), low.tobytes()
                out = {"item_id": [], "length": [], "hash": [], "words": []}
                counts = np.bincount(row, minlength=len(ids))
                for length in sorted({min(n, int(c)) for c in counts if c}):
                    found, first = sequence_hashes(hashes, row, length)
                    mine = (counts[row[first]] == length) | (length == n)
                    for h, f in zip(found[mine].view(np.int64), first[mine]):
                        out["item_id"].append(ids[row[f]])
                        out["length"].append(length)
                        out["hash"].append(int(h))
                        out["words"].append(b" ".join(
                            raw[start[k]:end[k]] for k in range(f, f + length)).decode())
                yield pa.RecordBatch.from_pydict(out, pa.schema(
                    [("item_id", pa.string()), ("length", pa.int32()), ("hash", pa.int64()),
                     ("words", pa.string())]))

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return items.mapInArrow(cut, WINDOW_SCHEMA).distinct()


class WindowSet:
    """The broadcast form of a block of windows: a bit filter, sorted hashes, exact words."""

    FILTER_BITS = 20

    def __init__(self, rows):
        self.lengths = sorted({r.length for r in rows})
        self.known = {}
        self.filters = {}
        self.items: dict[tuple[int, bytes], list[str]] = defaultdict(list)
        for length in self.lengths:
            hashes = np.unique(np.array([r.hash for r in rows if r.length == length], np.int64).view(np.uint64))
            bits = np.zeros(1 << self.FILTER_BITS, bool)
            bits[hashes >> np.uint64(64 - self.FILTER_BITS)] = True
            self.known[length], self.filters[length] = hashes, bits
        for r in rows:
            self.items[r.length, r.words.encode()].append(r.item_id)

    def hits(self, data: np.ndarray, start: np.ndarray, end: np.ndarray,
             row: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, length, items) of every document window that is a test window."""
        low = LOWER[data]
        hashes, raw = span_hashes(low, start, end), None
        for length in self.lengths:
            found, first = sequence_hashes(hashes, row, length)
            near = np.flatnonzero(self.filters[length][found >> np.uint64(64 - self.FILTER_BITS)])
            known = self.known[length]
            at = np.minimum(np.searchsorted(known, found[near]), len(known) - 1)
            for f in first[near[known[at] == found[near]]]:
                raw = low.tobytes() if raw is None else raw
                words = b" ".join(raw[start[k]:end[k]] for k in range(f, f + length))
                items = self.items.get((length, words))
                if items:
                    yield int(f), length, items


def _scan(windows, has_found: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = windows.value
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                start, end, row = word_spans(data, offsets, WORD)
                counts = np.bincount(row, minlength=rows.num_rows)
                first_word = np.cumsum(counts) - counts
                before = rows.column(rows.num_columns - 1).to_pylist() if has_found else [None] * rows.num_rows
                hit: dict[int, set[int]] = defaultdict(set)
                items: dict[int, set[str]] = defaultdict(set)
                for f, length, ids in tests.hits(data, start, end, row):
                    r = int(row[f])
                    hit[r].update(range(f - first_word[r], f - first_word[r] + length))
                    items[r].update(ids)
                found = []
                for r in range(rows.num_rows):
                    seen = before[r] or {"hit_words": [], "items": []}
                    words = sorted(hit[r].union(seen["hit_words"])) if r in hit else list(seen["hit_words"])
                    found.append({"n_words": int(counts[r]), "hit_words": words,
                                  "items": sorted(items[r].union(seen["items"])) if r in items else seen["items"],
                                  "spans": _spans(words, data, offsets, start, end, int(first_word[r]), r)})
                kept = rows.columns[:-1] if has_found else rows.columns
                names = rows.schema.names[:-1] if has_found else rows.schema.names
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, _FOUND)], [*names, "found"])

    return scan


def _spans(words, data, offsets, start, end, base, r) -> list[dict]:
    """Runs of hit words as code-point ranges of the text."""
    if not words:
        return []
    chars = char_positions(data[offsets[r]:offsets[r + 1]])
    out = []
    for run in np.split(np.array(words), np.flatnonzero(np.diff(words) > 1) + 1):
        out.append({"start": int(chars[start[base + run[0]] - offsets[r]]),
                    "end": int(chars[end[base + run[-1]] - offsets[r]])})
    return out


def window_blocks(benchmark: DataFrame, n: int, block_windows: int, with_items: bool = True) -> Iterator[Broadcast]:
    """The test set as broadcast blocks of about ``block_windows`` rows, one block at least.

    Without items a window is one row, whichever items have it.
    """
    spark = benchmark.sparkSession
    windows = benchmark_windows(benchmark, n)
    if not with_items:
        windows = windows.select(F.lit("").alias("item_id"), "length", "hash", "words").distinct()
    windows = stage(windows, "test-windows")
    blocks = max(1, -(-windows.count() // block_windows))
    for block in range(blocks):
        # dealt by hash of window and item, so a block is close to its bound even if one window is in every item
        part = windows.where(F.pmod(F.xxhash64("hash", "item_id"), F.lit(blocks)) == block) if blocks > 1 else windows
        yield spark.sparkContext.broadcast(WindowSet(part.collect()))


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10,
                       block_windows: int = 1_000_000) -> DataFrame:
    """``doc_id, text, found`` for every document row.

    ``found`` has ``n_words``, the indexes of ``hit_words``, the ``items``
    (ids as text) with a window in the document, and the hit ``spans`` in code
    points, end exclusive. Null and empty texts have no words; so have items
    with null text, which match nothing. A null item_id is named by an empty
    string. An empty benchmark hits nothing; repeated rows are judged alike.
    """
    out = docs.select("doc_id", "text")
    schema = docs.select("doc_id", "text").schema.add("found", DataType.fromDDL(FOUND_TYPE))
    for block, tests in enumerate(window_blocks(benchmark, n, block_windows)):
        if block:
            out = stage(out, "contamination")
        out = out.mapInArrow(_scan(tests, block > 0), schema)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10,
                      block_windows: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` without a test window, columns unchanged; one filter per block of the test set."""

    def clean(tests):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, data, offsets in text_slices(batch, "text"):
                    start, end, row = word_spans(data, offsets, WORD)
                    keep = np.ones(rows.num_rows, bool)
                    keep[[row[f] for f, _, _ in tests.value.hits(data, start, end, row)]] = False
                    yield rows.filter(pa.array(keep))
        return run

    for tests in window_blocks(benchmark, n, block_windows, with_items=False):
        docs = docs.mapInArrow(clean(tests), docs.schema)
    return docs


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given code-point ranges (sorted, disjoint)."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])
