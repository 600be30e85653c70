"""Words and word-sequence hashes of many texts at once, on the Arrow buffers.

A batch of texts is one byte array with offsets. Words are maximal runs of
word bytes (a 256-entry table); all separators are ASCII, so cutting bytes
equals cutting characters. Word hashes come from one prefix sum over the
batch: a polynomial in an odd base modulo 2**64 over random byte values, made
position independent with the base's inverse powers, then mixed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (shift-multiply), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: str,
                limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``limit`` text bytes.

    Yields (rows, bytes, offsets); null texts are empty. One longer text is a
    slice of its own, whole.
    """
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield (batch.slice(lo, hi - lo), data[offsets[lo]:offsets[hi]],
               (offsets[lo:hi + 1] - offsets[lo]))
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray,
               word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of word bytes inside one text."""
    inside = word_byte[data]
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    begins[cuts] = inside[cuts]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    finishes[last] = inside[last]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(finishes) + 1, np.searchsorted(offsets, start, "right") - 1


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes hash equally wherever they stand."""
    power, inverse = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[values] * power[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def sequence_hashes(words: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of ``length`` words within one row."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(row[:n] == row[length - 1:])
    total = np.full(len(first), length, np.uint64)
    for j in range(length):
        total = total * np.uint64(_BASE) + words[first + j]
    return mix(total), first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray, length: int,
                 weigh: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """(row, hash) of the distinct shingles of each text, sorted by row and hash.

    A text of fewer words than ``length`` has its whole sequence as one
    shingle, a text without words none. With ``weigh``, a function of word
    hashes, the sum over each shingle's words is the third result.
    """
    start, end, row = word_spans(data, offsets, word_byte)
    words = span_hashes(LOWER[data], start, end)
    shingle, first = sequence_hashes(words, row, length)
    owner = row[first]
    counts = np.bincount(row, minlength=len(offsets) - 1)
    begin = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < length))
    if len(short):
        extra = np.array([sequence_hashes(words[begin[r]:begin[r] + counts[r]],
                                          row[begin[r]:begin[r] + counts[r]], int(counts[r]))[0][0]
                          for r in short], np.uint64)
        shingle, owner = np.concatenate([shingle, extra]), np.concatenate([owner, short])
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    keep = np.ones(len(shingle), bool)
    keep[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    if weigh is None:
        return owner[keep], shingle[keep]
    sums = np.concatenate([[0], np.cumsum(weigh(words))])
    weight = np.concatenate([sums[first + length] - sums[first], sums[begin[short] + counts[short]] - sums[begin[short]]])
    return owner[keep], shingle[keep], weight[order][keep]


def text_words(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word, lower-cased."""
    start, end, row = word_spans(data, offsets, word_byte)
    return row, span_hashes(LOWER[data], start, end)


def char_positions(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position of one text (length + 1 entries)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
