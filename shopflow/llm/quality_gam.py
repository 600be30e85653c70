"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over the features, one feature at a time;
since each tree sees one feature, a feature's trees add up to one lookup table
over its bins. The strongest feature pairs then get tables of their own in the
same way. A text's score is the sigmoid of a sum of table entries, looked up
for whole batches at once.

Features are counts and shares computed from a text's bytes, words, word
sequences and lines; nothing but the text enters them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from shopflow.llm.bytewords import WHITE, sequence_hashes, span_hashes, text_slices, word_spans
from shopflow.llm.sampling import bounded_sample
from shopflow.llm.staging import stage

#: Bound of the training sample in labelled documents.
SAMPLE_DOCUMENTS = 20_000
BINS = 32
PAIR_BINS = 8

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[0x20, *range(9, 14)]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
_CLASS[ord("!")] = 6
_CLASS[128:] = 7
_CLASSES = 8  # class 0: all other bytes
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[0x0A] = False
FEATURES = ("log_bytes", "log_words", "upper", "digits", "white", "sentence_marks", "exclamations", "beyond_ascii",
            "other_marks", "word_length", "longest_word", "distinct_words", "commonest_word", "repeated_next",
            "distinct_triples", "odd_word_ends", "upper_words", "distinct_lines", "line_length", "short_words")


def _distinct_and_commonest(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many distinct values, and how often the commonest occurs."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    sizes = np.diff(np.append(at, len(values)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, row[at], sizes)
    return np.bincount(row[at], minlength=n), most


def features_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) of a slice; shares of nothing are 0."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    start, end, row = word_spans(data, offsets, WHITE ^ True)
    words = np.bincount(row, minlength=n)
    length = end - start
    hashes = span_hashes(data, start, end)
    distinct, commonest = _distinct_and_commonest(hashes, row, n)
    triple, first = sequence_hashes(hashes, row, 3)
    triples = np.bincount(row[first], minlength=n)
    distinct_triples, _ = _distinct_and_commonest(triple, row[first], n)
    again = np.bincount(row[1:][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])], minlength=n)
    last = _CLASS[data[end - 1]] if len(end) else np.zeros(0, np.int64)
    odd_ends = np.bincount(row[(last == 0) | (last == 6)], minlength=n)
    uppers = np.concatenate([[0], np.cumsum(_CLASS[data] == 1)])
    upper_words = np.bincount(row[2 * (uppers[end] - uppers[start]) > length], minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, length)
    total_length = np.bincount(row, weights=length, minlength=n)
    short = np.bincount(row[length <= 3], minlength=n)
    begin, stop, line_row = word_spans(data, offsets, _NOT_NEWLINE)
    lines = np.bincount(line_row, minlength=n)
    distinct_lines, _ = _distinct_and_commonest(span_hashes(data, begin, stop), line_row, n)

    def share(part, whole):
        return part / np.maximum(whole, 1)

    return np.stack([
        np.log1p(size), np.log1p(words), share(counts[:, 1], size), share(counts[:, 3], size),
        share(counts[:, 4], size), share(counts[:, 5], size), share(counts[:, 6], size), share(counts[:, 7], size),
        share(counts[:, 0], size), share(total_length, words), np.log1p(longest), share(distinct, words),
        share(commonest, words), share(again, words), share(distinct_triples, triples), share(odd_ends, words),
        share(upper_words, words), share(distinct_lines, lines), np.log1p(share(size, lines)), share(short, words),
    ], axis=1).astype(np.float64)


def text_features(docs: DataFrame) -> DataFrame:
    """``doc_id, features`` of every row of ``docs``, written once; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                x = features_of(data, offsets)
                at = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.ListArray.from_arrays(at, pa.array(x.reshape(-1)))], ["doc_id", "features"])

    schema = docs.select("doc_id").schema.add("features", ArrayType(DoubleType()))
    return stage(docs.select("doc_id", "text").mapInArrow(run, schema), "quality-features")


@dataclass
class AdditiveModel:
    """Intercept, bin edges and tables per feature, and tables per feature pair."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)  # bin -> pair bin
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[1], self.intercept)
        for table, b in zip(self.tables, bins):
            out += table[b]
        for (i, j), table in self.pairs.items():
            out += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


_SHRINK = 1.0


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + _SHRINK)


def _feature_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values, by bin, of a shallow regression tree over one feature's ordered bins."""
    out = np.full(len(g), g.sum() / (h.sum() + _SHRINK))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
        cut = int(gains.argmax()) + 1
        if gains[cut - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            out[:cut] = _feature_tree(g[:cut], h[:cut], depth - 1)
            out[cut:] = _feature_tree(g[cut:], h[cut:], depth - 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, leaf values) of the best tree with one cut in each of two features."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quarters(c):
        a, b, d, whole = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return a, b - a, d - a, whole - b - d + a

    qg, qh = quarters(cg), quarters(ch)
    gains = sum(_gain(a, b) for a, b in zip(qg, qh))
    if not gains.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.empty_like(g)
    for k, part in enumerate((np.s_[:i + 1, :j + 1], np.s_[:i + 1, j + 1:], np.s_[i + 1:, :j + 1],
                              np.s_[i + 1:, j + 1:])):
        out[part] = qg[k][i, j] / (qh[k][i, j] + _SHRINK)
    return float(gains[i, j]), out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8,
          rate: float = 0.1) -> AdditiveModel:
    """Boost one shallow tree per feature in turn, then one per chosen pair in turn."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model = AdditiveModel(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges])
    bins = model.bins(x)
    margin = model.margin(bins)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for table, b in zip(model.tables, bins):
            g, h = slopes()
            step = rate * _feature_tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
            table += step
            margin += step[b]

    model.coarse = [np.arange(len(t)) * PAIR_BINS // max(len(t), PAIR_BINS) for t in model.tables]
    coarse = [c[b] for c, b in zip(model.coarse, bins)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        cell = coarse[i] * PAIR_BINS + coarse[j]
        return (np.bincount(cell, g, PAIR_BINS ** 2).reshape(PAIR_BINS, PAIR_BINS),
                np.bincount(cell, h, PAIR_BINS ** 2).reshape(PAIR_BINS, PAIR_BINS))

    ranked = sorted(combinations(range(len(edges)), 2), key=lambda p: -_pair_tree(*sums(*p))[0])
    model.pairs = {p: np.zeros((PAIR_BINS, PAIR_BINS)) for p in ranked[:n_pairs]}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            step = rate * _pair_tree(*sums(i, j))[1]
            table += step
            margin += step[coarse[i], coarse[j]]
    return model


def fit(features: DataFrame, labels: DataFrame, learn: Column, documents: int = SAMPLE_DOCUMENTS) -> AdditiveModel:
    """Learn ``labels.quality`` from rows where ``learn`` holds, from a sample of at most ``documents`` rows.

    Rows without a label, or with a null one, are not used. Without any row
    the model scores 0.5 everywhere.
    """
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("y"))
    rows = bounded_sample(features.join(known, "doc_id").where(learn), documents).toArrow()
    if not rows.num_rows:
        return AdditiveModel(0.0, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES))
    x = np.array(rows["features"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = np.array(rows["y"])
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows arrive in
    return train(x[order], y[order])


def score(features: DataFrame, model: AdditiveModel) -> DataFrame:
    """``doc_id, score`` (0 to 1) of every row of ``features``."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return features.mapInArrow(run, features.select("doc_id").schema.add("score", DoubleType()))
