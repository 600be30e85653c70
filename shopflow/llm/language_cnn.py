"""Language identification by a byte convolutional network trained in numpy.

Texts are cut into fixed-length byte windows (all of them: whole texts are
read). A byte embedding feeds filters of several widths; each filter's largest
response in a window enters a softmax layer. Training is plain mini-batch
gradient descent with momentum on a bounded sample of labelled windows. For
scoring, embedding and filters are folded into tables over byte pairs, so a
filter's response is a sum of one or two table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from shopflow.llm.bytewords import text_slices
from shopflow.llm.sampling import bounded_sample

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
UNDETERMINED = "und"
#: Bound of the training sample: documents, and windows of each.
SAMPLE_DOCUMENTS = 4000
SAMPLE_WINDOWS = 2


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded with 0, row of each, bytes in each) of the texts of a slice."""
    lengths = np.diff(offsets)
    counts = -(-lengths // WINDOW)
    row = np.repeat(np.arange(len(lengths)), counts)
    start = offsets[row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))
    held = np.minimum(offsets[row + 1] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < held[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8), row, held


@dataclass
class ByteNet:
    """The trained network; ``labels`` are in the order of the softmax outputs."""

    labels: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width * embedding size, filters)
    weights: np.ndarray
    bias: np.ndarray

    def tables(self) -> ByteTables:
        pair, single = {}, {}
        for width, f in self.filters.items():
            taps = np.stack([self.embedding @ f[k * EMBEDDING:(k + 1) * EMBEDDING] for k in range(width)])
            pair[width] = [(taps[k][:, None, :] + taps[k + 1][None, :, :]).reshape(65536, -1).astype(np.float32)
                           for k in range(0, width - 1, 2)]
            single[width] = taps[width - 1].astype(np.float32) if width % 2 else None
        return ByteTables(self.labels, pair, single, self.weights.astype(np.float32), self.bias.astype(np.float32))


@dataclass
class ByteTables:
    labels: list[str]
    pair: dict[int, list[np.ndarray]]
    single: dict[int, np.ndarray | None]
    weights: np.ndarray
    bias: np.ndarray

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        n, size = windows.shape
        flat = windows.reshape(-1)
        pairs = flat.astype(np.int32) * 256
        pairs[:-1] += flat[1:]
        pooled = []
        for width, tables in self.pair.items():
            out = np.take(tables[0], pairs, axis=0).reshape(n, size, -1)[:, :size - width + 1]
            for k, t in enumerate(tables[1:], 1):
                out = out + np.take(t, pairs, axis=0).reshape(n, size, -1)[:, 2 * k:size - width + 1 + 2 * k]
            if self.single[width] is not None:
                out = out + np.take(self.single[width], flat, axis=0).reshape(n, size, -1)[:, width - 1:]
            pooled.append(out.max(axis=1))
        return _log_softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.weights + self.bias)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], passes: int = 4, batch: int = 64,
          rate: float = 0.1, seed: int = 7, least_steps: int = 300) -> ByteNet:
    """Fit the network to (windows, label indexes); classes weigh alike."""
    rng = np.random.default_rng(seed)
    net = ByteNet(labels, rng.normal(0, 0.5, (256, EMBEDDING)),
                  {w: rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)) for w in WIDTHS},
                  rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))), np.zeros(len(labels)))
    share = np.bincount(target, minlength=len(labels))
    weight = (len(target) / np.maximum(share, 1) / max(1, (share > 0).sum()))[target]
    params = [net.embedding, *net.filters.values(), net.weights, net.bias]
    speed = [np.zeros_like(p) for p in params]
    steps = max(least_steps, passes * len(target) // batch)  # small samples are gone over more often
    for step in range(steps):
        pick = rng.integers(0, len(target), min(batch, len(target)))
        grads = _gradients(net, windows[pick], target[pick], weight[pick])
        now = rate * (1 - step / steps)
        for p, v, g in zip(params, speed, grads):
            v *= 0.9
            v -= now * np.clip(g, -1, 1)
            p += v
    return net


def _gradients(net: ByteNet, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    n, size = x.shape
    embedded = net.embedding[x]
    pooled, best = [], {}
    for width, f in net.filters.items():
        taps = [embedded[:, k:size - width + 1 + k] @ f[k * EMBEDDING:(k + 1) * EMBEDDING] for k in range(width)]
        response = sum(taps)
        best[width] = response.argmax(axis=1)
        pooled.append(np.take_along_axis(response, best[width][:, None, :], axis=1)[:, 0])
    pooled = np.concatenate(pooled, axis=1)
    hidden = np.maximum(pooled, 0)
    delta = np.exp(_log_softmax(hidden @ net.weights + net.bias))
    delta[np.arange(n), y] -= 1
    delta *= weight[:, None] / n
    back = (delta @ net.weights.T) * (pooled > 0)
    d_embedding, d_filters = np.zeros_like(net.embedding), []
    for i, (width, f) in enumerate(net.filters.items()):
        g = back[:, i * FILTERS:(i + 1) * FILTERS]  # only the winning position of each filter learns
        at = best[width][:, None, :] + np.arange(width)[:, None]
        bytes_at = np.take_along_axis(x, at.reshape(n, -1), axis=1).reshape(n, width, FILTERS)
        seen = net.embedding[bytes_at]
        d_filters.append(np.einsum("nwfe,nf->wef", seen, g).reshape(width * EMBEDDING, FILTERS))
        cube = f.reshape(width, EMBEDDING, FILTERS)
        np.add.at(d_embedding, bytes_at, np.einsum("nf,wef->nwfe", g, cube))
    return [d_embedding, *d_filters, hidden.T @ delta, delta.sum(axis=0)]


def fit(docs: DataFrame, learn: Column, documents: int = SAMPLE_DOCUMENTS,
        windows: int = SAMPLE_WINDOWS) -> ByteNet | None:
    """Train on rows where ``learn`` holds and lang is not null; None without any.

    The sample is bounded by ``documents`` rows and ``windows`` windows of
    each, taken evenly over the text.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                if not len(data):
                    continue
                cut_windows, row, _ = windows_of(data, offsets)
                counts = np.bincount(row, minlength=rows.num_rows)
                place = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
                step = np.maximum(1, counts[row] // windows)
                keep = np.flatnonzero((place % step == step // 2) & (place // step < windows))
                langs = rows.column(1).to_pylist()
                yield pa.RecordBatch.from_pydict(
                    {"win": [cut_windows[k].tobytes() for k in keep], "lang": [langs[row[k]] for k in keep]},
                    pa.schema([("win", pa.binary()), ("lang", pa.string())]))

    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = bounded_sample(labelled.select("doc_id", "text", "lang"), documents).select("text", "lang")
    rows = chosen.mapInArrow(cut, "win binary, lang string").toArrow()
    if not rows.num_rows:
        return None
    order = np.argsort(np.array([w + (n or "").encode() for w, n in zip(
        rows["win"].to_pylist(), rows["lang"].to_pylist())], object), kind="stable")
    x = np.frombuffer(b"".join(rows["win"].to_pylist()), np.uint8).reshape(-1, WINDOW)[order]
    langs = np.array(rows["lang"].to_pylist())[order]
    labels = sorted(set(langs.tolist()))
    return train(x, np.searchsorted(labels, langs), labels)


def _lettered(rows: pa.RecordBatch) -> np.ndarray:
    """Whether each text of a slice has a letter."""
    texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
    return np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)


def _predict(tables: ByteTables | None, rows: pa.RecordBatch, data: np.ndarray,
             offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(label, score) of each text of a slice: window log-probabilities averaged by bytes."""
    n = rows.num_rows
    lettered = _lettered(rows)
    score = np.zeros(n)
    names = [UNDETERMINED] * n
    if tables is None or not lettered.any():
        return names, score
    x, row, held = windows_of(data, offsets)
    total = np.zeros((n, len(tables.labels)))
    for lo in range(0, len(x), 512):
        part = slice(lo, lo + 512)
        np.add.at(total, row[part], tables.log_probabilities(x[part]) * held[part, None])
    mean = _log_softmax(total / np.maximum(np.diff(offsets), 1)[:, None])
    best = mean.argmax(axis=1)
    score = np.where(lettered, np.exp(mean[np.arange(n), best]), 0.0)
    return [tables.labels[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)], score


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0; so is
    everything when no label could be learned. Repeated rows are judged
    alike; an empty table gives an empty result.
    """
    tables = docs.sparkSession.sparkContext.broadcast(net.tables() if net else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                names, score = _predict(tables.value, rows, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    schema = docs.select("doc_id").schema.add("lang_pred", StringType()).add("score", DoubleType())
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_identified(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """The rows of ``docs`` that are not ``und``, columns unchanged; without a model all texts with a letter stay."""
    tables = docs.sparkSession.sparkContext.broadcast(net.tables() if net else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                if tables.value is None:
                    keep = _lettered(rows).tolist()
                else:
                    keep = [n != UNDETERMINED for n in _predict(tables.value, rows, data, offsets)[0]]
                yield rows.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
