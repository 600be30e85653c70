"""Encoded forms of words seen before, bounded, kept by a Python worker between batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class WordCache:
    """Maps words to encoded bytes; emptied when it holds over ``limit`` words.

    Common words come back with the next batch, so emptying costs little.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = 300_000):
        self.encode_many, self.limit = encode_many, limit
        self.known: dict[str, bytes] = {}
        #: Marks that, closing a word of letters, are encoded apart from it, with their bytes.
        self.closing: dict[str, bytes] = {}

    def encode(self, words: list[str]) -> list[bytes]:
        """The bytes of each of these distinct words; the empty word has none."""
        if len(self.known) > self.limit:
            self.known = {}
        self.known[""] = b""
        known = self.known
        fresh = [w for w in words if w not in known]
        marks = tuple(self.closing)
        closed = [w for w in fresh if w.endswith(marks) and w[:-1].isalpha()] if marks else []
        if closed:
            fresh = list(set(fresh).difference(closed).union(w[:-1] for w in closed if w[:-1] not in known))
        known.update(zip(fresh, self.encode_many(fresh)))
        for w in closed:
            known[w] = known[w[:-1]] + self.closing[w[-1]]
        return list(map(known.__getitem__, words))


def laid_out(parts: list[bytes], codes: np.ndarray, offsets: np.ndarray, kind: str) -> list[bytes]:
    """Bytes of each text, given as a run (``offsets``) of ``codes`` of ``parts``; ``kind`` is the id type."""
    width = np.dtype(kind).itemsize
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // width
    start = np.cumsum(size) - size
    held = np.concatenate([[0], np.cumsum(size[codes])])
    at = np.repeat(start[codes] - held[:-1], size[codes]) + np.arange(held[-1])
    body, ends = np.frombuffer(b"".join(parts), kind)[at].tobytes(), (held[offsets] * width).tolist()
    return [body[a:b] for a, b in zip(ends, ends[1:])]
