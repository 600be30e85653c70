"""Hard negatives by exact inner-product search in cover trees.

Candidates are augmented with one more component, sqrt(M**2 - |x|**2) with M the
largest norm of their tree, so that all have norm M and the inner product with a
query (augmented by 0) falls as the distance grows. Nodes of a cover tree hold a
center, a point of the tree, and the radius that covers everything below; radii
shrink by ``BASE`` from level to level. Distance to the center, plus or minus
the radius, bounds the inner product of all points below from both sides.

The search keeps a frontier of nodes per query and expands those of the highest
bound first. A node is skipped where its bounds lie outside the query's window,
cannot beat the matches held, or where its labels do not fit; leaves are scored
exactly, on integers. A set whose points are about equally far apart (as random
directions are) has no smaller cover: it stays one leaf and is scored whole.

Rows are dealt into trees of at most ``TREE_ROWS`` rows, ordered by label so that most
trees hold one label. The trees are written once in the shared folder; a task holds a
chunk of queries and reads the trees one at a time, so neither is copied through a shuffle.
Windows of one row are searched together: its scores are computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.llm.staging import file_system, scratch_path, stage

BASE = 1.5
LEAF_ROWS = 64
#: Rows that centers must cover on average; a set they hardly cover, seen after so many centers, stays one leaf.
ROWS_A_CENTER = 16
TRIED_CENTERS = 32
TREE_ROWS = 4096
#: Trees of a written file where there are more than a file for each partition of a shuffle.
FILE_TREES = 16
CHUNK_QUERIES = 16384
#: Rows of a chunk and points of a leaf that are scored at once.
SCORED_ROWS, SCORED_POINTS = 256, 1024
#: Nodes of a query that are expanded in one step.
BEAM = 8


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, vec`` of the rows with an id, a label and a vector of finite components."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("vec").cast("array<double>").alias("vec")).where(finite)


def quantised(rows: DataFrame, scale: int) -> tuple[DataFrame, int]:
    """Usable rows with components floor(scale * x) and a ``mark`` of the content, repeated rows once; and their number.

    Components are held within a bound at which inner products stay exact
    (2**23 and more for vectors of 64 components); a component beyond it counts as the bound.
    """
    rows = usable(rows)
    stats = rows.agg(F.max(F.size("vec")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    bound = float(2 ** ((52 - max(1, stats["width"] or 1).bit_length()) // 2))
    whole = F.transform("vec", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(bound)), F.lit(-bound))).cast("int"))
    whole = rows.withColumn("vec", whole).withColumn("mark", F.xxhash64("label", "vec")).dropDuplicates(["vec_id", "mark"])
    return whole, stats["n"]


class CoverTree:
    """Cover tree over the rows of ``points``; the points below a node stand side by side.

    ``nodes`` has a row per node: center, first and end of its points, first and end
    of its child nodes (equal at a leaf), least and greatest label.
    """

    def __init__(self, points: np.ndarray, labels: np.ndarray, ids: np.ndarray, marks: np.ndarray):
        squares = (points.astype(np.float64) ** 2).sum(axis=1)
        self.top_square = float(squares.max())
        lifted = np.concatenate([points, np.sqrt(np.maximum(self.top_square - squares, 0))[:, None]], axis=1)
        order = np.arange(len(points))
        first = self._nearest(lifted, lifted.mean(axis=0))
        reach = self._distances(lifted, order, first)
        todo = [(0, len(points), first, float(reach.max()), reach)]
        nodes, radii = [(first, 0, len(points), 0, 0)], [todo[0][3]]
        at = 0
        while at < len(todo):
            lo, hi, center, radius, reach = todo[at]
            parts = self._cover(lifted, order[lo:hi], center, radius / BASE, reach) if hi - lo > LEAF_ROWS and radius else None
            todo[at] = None
            if parts:
                nodes[at] = (*nodes[at][:3], len(nodes), len(nodes) + len(parts))
                for c, members, distance in parts:
                    order[lo:lo + len(members)] = members
                    todo.append((lo, lo + len(members), c, float(distance.max()), distance))
                    nodes.append((c, lo, lo + len(members), 0, 0))
                    radii.append(todo[-1][3])
                    lo += len(members)
            at += 1
        for _, lo, hi, child, end in nodes:
            if child == end:  # by id: the first of equal scores win
                order[lo:hi] = order[lo:hi][np.lexsort((marks[order[lo:hi]], ids[order[lo:hi]]))]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        table = np.array(nodes, np.int64)
        table[:, 0] = place[table[:, 0]]
        self.points, self.labels, self.ids, self.marks = points[order], labels[order], ids[order], marks[order]
        spans = [self.labels[lo:hi] for lo, hi in table[:, 1:3]]
        self.nodes = np.concatenate([table, [[s.min(), s.max()] for s in spans]], axis=1)
        self.radii = np.array(radii)

    @staticmethod
    def _nearest(lifted: np.ndarray, to: np.ndarray) -> int:
        return int(((lifted - to) ** 2).sum(axis=1).argmin())

    @staticmethod
    def _distances(lifted: np.ndarray, rows: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(((lifted[rows] - lifted[center]) ** 2).sum(axis=1))

    def _cover(self, lifted: np.ndarray, rows: np.ndarray, center: int, radius: float, reach: np.ndarray):
        """(center, rows, distances) of sets within ``radius`` of centers that lie further apart, None where few rows join one."""
        parts, left = [], rows
        while len(left):
            near = reach <= radius
            parts.append((center, left[near], reach[near]))
            left = left[~near]
            if len(parts) >= TRIED_CENTERS and len(rows) - len(left) < ROWS_A_CENTER * len(parts):
                return None
            if len(left):
                center = int(left[0])
                reach = self._distances(lifted, left, center)
        return parts if ROWS_A_CENTER * len(parts) <= len(rows) else None

    # as a row of a table ---------------------------------------------------------
    FIELDS = (("labels", np.int64), ("ids", np.int64), ("marks", np.int64), ("nodes", np.int64), ("radii", np.float64))
    SCHEMA = ("width long, top_square double, points binary, " + ", ".join(f"{name} binary" for name, _ in FIELDS))

    def packed(self) -> dict:
        return {"width": self.points.shape[1], "top_square": self.top_square, "points": whole_bytes(self.points)} | {
            name: getattr(self, name).astype(kind).tobytes() for name, kind in self.FIELDS}

    @classmethod
    def unpacked(cls, row: dict) -> CoverTree:
        tree = cls.__new__(cls)
        tree.top_square = row["top_square"]
        for name, kind in cls.FIELDS:
            setattr(tree, name, np.frombuffer(row[name], kind))
        tree.nodes = tree.nodes.reshape(-1, 7)
        tree.points = whole_matrix(row["points"], len(tree.ids), row["width"])
        return tree


class Search:
    """The best ``k`` matches of each window of a chunk, over one tree after another.

    A match of a window has a label equal to that of the window's row (``same``)
    or another one, a score from ``lo`` to ``hi`` (whole numbers or infinite) and
    is not the row itself; higher scores come first, then smaller ids. ``of`` has
    the row of each window, ascending, and no row without one; left out, each row
    has one window.
    """

    def __init__(self, vecs: np.ndarray, labels: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int,
                 of: np.ndarray | None = None):
        self.vecs, self.labels, self.own, self.lo, self.hi, self.same, self.k = vecs, labels, own, lo, hi, same, k
        self.of = np.arange(len(vecs)) if of is None else of
        self.first = np.searchsorted(self.of, np.arange(len(vecs) + 1))
        self.square = (vecs.astype(np.float64) ** 2).sum(axis=1)
        self.score = np.full((len(lo), k), -np.inf)
        self.found = np.zeros((len(lo), k, 2), np.int64)
        #: Of a row, over its windows: the least score that can still count, and the greatest.
        self.least = np.minimum.reduceat(lo, self.first[:-1]).astype(np.float64)
        self.most = np.maximum.reduceat(hi, self.first[:-1])

    def floor(self, w: np.ndarray) -> np.ndarray:
        """Least score that can still count in a window."""
        return np.maximum(self.lo[w], self.score[w, -1])

    def _windows(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of rows ``q``, each after the place of its row in ``q``."""
        n = self.first[q + 1] - self.first[q]
        at = np.repeat(np.arange(len(q)), n)
        return at, np.arange(len(at)) + (self.first[q] - np.cumsum(n) + n)[at]

    def over(self, tree: CoverTree) -> None:
        width = max(tree.points.shape[1], self.vecs.shape[1])
        exact = np.float32 if np.sqrt(self.square.max() * tree.top_square) < 2 ** 24 else np.float64
        points, vecs = (np.pad(m, ((0, 0), (0, width - m.shape[1]))).astype(exact) for m in (tree.points, self.vecs))
        q, node = np.arange(len(vecs)), np.zeros(len(vecs), np.int64)
        q, node, high = self._viable(tree, q, node, (vecs @ points[tree.nodes[0, 0]]).astype(np.float64))
        while len(q):
            order = np.lexsort((-high, q))
            q, node, high = q[order], node[order], high[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            now, held = rank < BEAM, rank >= BEAM
            parts = [(q[held], node[held], high[held])]
            order = np.argsort(node[now], kind="stable")
            which, cuts = np.unique(node[now][order], return_index=True)
            for n, who in zip(which.tolist(), np.split(q[now][order], cuts[1:])):
                _, lo, hi, child, end, _, _ = tree.nodes[n].tolist()
                if child == end:
                    for some in np.split(who, range(SCORED_ROWS, len(who), SCORED_ROWS)):
                        for a in range(lo, hi, SCORED_POINTS):
                            b = min(hi, a + SCORED_POINTS)
                            self._verify(tree, some, a, b, vecs[some] @ points[a:b].T)
                else:
                    score = vecs[who] @ points[tree.nodes[child:end, 0]].T
                    parts.append(self._viable(tree, np.repeat(who, end - child), np.tile(np.arange(child, end), len(who)),
                                              score.astype(np.float64).ravel()))
            q, node, high = (np.concatenate(x) for x in zip(*parts))
            open_ = high >= self.least[q]
            q, node, high = q[open_], node[open_], high[open_]

    def _viable(self, tree: CoverTree, q: np.ndarray, node: np.ndarray, score: np.ndarray):
        """Pairs whose node may hold a match, with the node's upper bound."""
        total = self.square[q] + tree.top_square
        slack = 1e-9 * total + 1e-6
        distance, radius = np.sqrt(np.maximum(total - 2 * score, 0)), tree.radii[node]
        high = (total - np.maximum(distance - radius, 0) ** 2) / 2 + slack
        low = (total - (distance + radius) ** 2) / 2 - slack
        least, most, label = tree.nodes[node, 5], tree.nodes[node, 6], self.labels[q]
        fits = ((least <= label) & (label <= most)) if self.same else ((least != label) | (most != label))
        fits &= (high >= self.least[q]) & (low <= self.most[q])
        return q[fits], node[fits], high[fits]

    def _verify(self, tree: CoverTree, q: np.ndarray, lo: int, hi: int, score: np.ndarray) -> None:
        some = np.flatnonzero(score.max(axis=1) >= self.least[q])
        if not len(some):
            return
        q, score = q[some], score[some]
        row, at = np.nonzero(score >= self.least[q].astype(score.dtype)[:, None])
        if 16 * len(row) > score.size:
            row, at, w = self._first(tree, q, lo, hi, score)
        else:
            pair, w = self._windows(q[row])
            row, at = row[pair], at[pair]
        self._merge(w, score[row, at].astype(np.float64), q[row], tree, lo + at)

    def _first(self, tree: CoverTree, q: np.ndarray, lo: int, hi: int, score: np.ndarray):
        """Row, place and window of the first ``k`` fitting scores of each window."""
        fits = (tree.labels[lo:hi] == self.labels[q][:, None]) == self.same
        mine = np.flatnonzero(np.isin(self.own[q, 0], tree.ids[lo:hi]))
        if len(mine):
            fits[mine] &= (tree.ids[lo:hi] != self.own[q[mine], :1]) | (tree.marks[lo:hi] != self.own[q[mine], 1:])
        score = np.where(fits, score, score.dtype.type(-np.inf))
        of, w = self._windows(q)
        score = score[of]
        score[(score < self.floor(w).astype(score.dtype)[:, None]) | (score > self.hi[w].astype(score.dtype)[:, None])] = -np.inf
        if score.shape[1] > self.k:
            cut = np.partition(score, -self.k, axis=1)[:, -self.k]
        else:
            cut = np.full(len(score), -np.inf)
        window, at = np.nonzero((score >= cut[:, None]) & (score > -np.inf))
        tied = score[window, at] == cut[window]
        n_tied = np.concatenate([[0], np.cumsum(tied)])
        few = ~tied | (n_tied[1:] - n_tied[np.searchsorted(window, window)] <= self.k)
        window, at = window[few], at[few]
        return of[window], at, w[window]

    def _merge(self, w: np.ndarray, value: np.ndarray, q: np.ndarray, tree: CoverTree, at: np.ndarray) -> None:
        """Take the points ``at`` that fit their windows ``w`` among the matches held."""
        what = np.stack([tree.ids[at], tree.marks[at]], axis=1)
        last, tied = self.found[w, -1], value == self.score[w, -1]
        fits = ((tree.labels[at] == self.labels[q]) == self.same) & (value >= self.floor(w)) & (value <= self.hi[w])
        fits &= (what != self.own[q]).any(axis=1)
        fits &= ~tied | (what[:, 0] < last[:, 0]) | ((what[:, 0] == last[:, 0]) & (what[:, 1] < last[:, 1]))
        if not fits.any():
            return
        w, value, what = w[fits], value[fits], what[fits]
        mine = np.unique(w)
        held, place = np.nonzero(np.isfinite(self.score[mine]))
        who = np.concatenate([w, mine[held]])
        value = np.concatenate([value, self.score[mine[held], place]])
        what = np.concatenate([what, self.found[mine[held], place]])
        order = np.lexsort((what[:, 1], what[:, 0], -value, who))
        who, value, what = who[order], value[order], what[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        top = rank < self.k
        self.score[mine] = -np.inf
        self.score[who[top], rank[top]] = value[top]
        self.found[who[top], rank[top]] = what[top]
        rows = np.unique(self.of[mine])
        of, w = self._windows(rows)
        self.least[rows] = np.minimum.reduceat(self.floor(w), np.searchsorted(of, np.arange(len(rows))))


def whole_bytes(m: np.ndarray) -> bytes:
    """Whole numbers in 2 bytes each where all fit, else in 4."""
    return m.astype(np.int16 if len(m) and np.abs(m).max(initial=0) < 2 ** 15 else np.int32).tobytes()


def whole_matrix(data, rows: int, width: int) -> np.ndarray:
    """The matrix that :func:`whole_bytes` wrote."""
    return np.frombuffer(data, np.int16 if len(data) == 2 * rows * width else np.int32).reshape(rows, width)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of integers as rows of a matrix, shorter ones filled up with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = np.asarray(column.flatten()), np.asarray(column.offsets)
    size = np.diff(ends)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of a partition in tables of at most ``most`` rows."""
    held, n = [], 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, most - n)
            held.append(part)
            n += len(part)
            batch = batch.slice(len(part))
            if n == most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def write_trees(rows: DataFrame, n_rows: int, tasks: int) -> str:
    """The folder, in the shared one, where the cover trees over all rows are written, a row each with ``least, most``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, TREE_ROWS):
            label, ids, marks = (np.asarray(run[c].combine_chunks()) for c in ("label", "vec_id", "mark"))
            tree = CoverTree(matrix(run["vec"]), label, ids, marks)
            yield pa.RecordBatch.from_pylist([{"least": int(label.min()), "most": int(label.max())} | tree.packed()])

    parts = max(tasks, -(-n_rows // (TREE_ROWS * FILE_TREES)))
    folder = scratch_path(rows.sparkSession, "negatives-trees")
    rows.repartitionByRange(parts, "label", F.xxhash64("mark", "vec_id")).select("vec_id", "label", "vec", "mark").mapInArrow(
        build, f"least long, most long, {CoverTree.SCHEMA}").write.parquet(folder)
    return folder


def read_trees(folder: str, g: int, groups: int, meets: Callable[[int, int], bool]) -> Iterator[CoverTree]:
    """The trees of every ``groups``-th file from ``g`` on whose labels meet, one at a time."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    files, base = file_system(folder)
    parts = sorted(f.path for f in files.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("part-"))
    for path in parts[g::groups]:
        with files.open_input_file(path) as data:
            file = pq.ParquetFile(data)
            if not any(meets(x["least"], x["most"]) for x in file.read(["least", "most"]).to_pylist()):
                continue
            for batch in file.iter_batches(batch_size=1):
                row = _row(batch, 0)
                if meets(row["least"], row["most"]):
                    yield CoverTree.unpacked(row)


def _row(batch: pa.RecordBatch, i: int) -> dict:
    """A row, bytes as buffers of the batch."""
    return {name: x.as_buffer() if pa.types.is_binary(x.type) else x.as_py()
            for name, x in zip(batch.schema.names, (c[i] for c in batch.columns))}


def best_matches(trees: str, queries: DataFrame, n_queries: int, keys: list[str], same: bool, k: int, tasks: int) -> DataFrame:
    """The first ``k`` matches of each query: ``keys``, ``rank`` (from 1), ``found_id, found_mark, score``.

    ``trees`` is the folder. ``queries`` has ``keys`` (long; the first two are the id and mark of the
    query's own row), ``label``, ``vec``, ``lo`` and ``hi``; no two have the same
    keys. Each chunk of queries meets the trees in one task, tree by tree, as they
    are read from the shared folder. Only where there are fewer chunks than
    ``tasks`` are the trees dealt to several tasks as well, so the search brings
    back no more than about ``k * CHUNK_QUERIES`` rows for each of ``tasks``, or ``k`` a query.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, CHUNK_QUERIES):
            lists = {c: np.asarray(run[c].combine_chunks()).astype(np.float64 if c in ("lo", "hi") else np.int64)
                     for c in [*keys, "label", "lo", "hi"]}
            own = np.stack([lists[keys[0]], lists[keys[1]]], axis=1)
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)]))
            vecs = matrix(run["vec"].combine_chunks().take(pa.array(new)))
            yield pa.RecordBatch.from_pylist([{
                "q_least": int(lists["label"].min()), "q_most": int(lists["label"].max()), "q_width": vecs.shape[1],
                "q_first": new.tobytes(), "q_vecs": whole_bytes(vecs), **{f"q_{c}": v.tobytes() for c, v in lists.items()}}])

    packed = ["q_first", "q_vecs", *[f"q_{c}" for c in [*keys, "label", "lo", "hi"]]]
    n_chunks = max(1, -(-n_queries // CHUNK_QUERIES))
    chunks = queries.repartitionByRange(n_chunks, "label", *keys[:2]).sortWithinPartitions("label", *keys).select(
        *keys, "label", "vec", "lo", "hi").coalesce(n_chunks).mapInArrow(
        pack, "q_least long, q_most long, q_width long, " + ", ".join(f"{c} binary" for c in packed))
    groups = -(-tasks // n_chunks)
    pairs = queries.sparkSession.range(0, groups, 1, groups).withColumnRenamed("id", "g").hint(
        "shuffle_replicate_nl").crossJoin(chunks)  # a task for each group and partition of chunks

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = _row(batch, i)
                first, last = row["q_least"], row["q_most"]
                run, lists = begun(row)
                for tree in read_trees(trees, row["g"], groups, lambda least, most: (
                        first <= most and least <= last if same else first < last or least < most or first != least)):
                    run.over(tree)
                yield found(run, lists)

    def begun(row: dict) -> tuple[Search, dict]:
        lists = {c: np.frombuffer(row[f"q_{c}"], np.float64 if c in ("lo", "hi") else np.int64).copy()
                 for c in [*keys, "label", "lo", "hi"]}
        new = np.frombuffer(row["q_first"], np.int64)
        vecs = whole_matrix(row["q_vecs"], len(new), row["q_width"]).astype(np.int32)
        own = np.stack([lists[keys[0]], lists[keys[1]]], axis=1)[new]
        of = np.searchsorted(new, np.arange(len(lists["lo"])), side="right") - 1
        return Search(vecs, lists["label"][new], own, lists["lo"], lists["hi"], same, k, of), lists

    def found(run: Search, lists: dict) -> pa.RecordBatch:
        q, place = np.nonzero(np.isfinite(run.score))
        return pa.RecordBatch.from_arrays(
            [*[pa.array(lists[c][q]) for c in keys], pa.array(run.found[q, place, 0]), pa.array(run.found[q, place, 1]),
             pa.array(run.score[q, place].astype(np.int64))], [*keys, "found_id", "found_mark", "score"])

    matches = pairs.mapInArrow(search, ", ".join(f"{c} long" for c in [*keys, "found_id", "found_mark", "score"]))
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "found_id", "found_mark")
    return matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, scale: int = 256, n_positives: int = 5, n_negatives: int = 3,
                   low: int = 50, high: int = 95) -> DataFrame:
    """Negatives whose score is ``low`` to ``high`` percent of the positive's, per anchor and positive.

    ``rows`` has ``vec_id``, ``label`` and ``vec``. A row's score is its inner
    product with the anchor on components floor(scale * x), shorter vectors
    filled up with 0; higher scores come first, ties by smaller vec_id. The
    positives of an anchor are its first ``n_positives`` other rows of the same
    label, its negatives the first ``n_negatives`` rows of other labels within
    the positive's window. Rows without an id, a label or a vector, or with a
    null or non-finite component take no part; repeated rows count once, and
    different rows of one vec_id are rows of their own. A positive score below
    0 has an empty window. Result: ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``.
    """
    whole, n = quantised(rows, scale)
    whole = stage(whole, "negatives-rows")
    tasks = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-n // TREE_ROWS)))
    trees = write_trees(whole, n, tasks)
    n_anchors = whole.where(is_anchor).count()
    anchors = whole.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), F.col("mark").alias("anchor_mark"), "label", "vec")
    keys = ["anchor_id", "anchor_mark"]
    open_ = anchors.select("*", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    positives = stage(best_matches(trees, open_, n_anchors, keys, True, n_positives, tasks).select(
        *keys, F.col("found_id").alias("positive_id"), F.col("found_mark").alias("positive_mark"),
        F.col("score").alias("positive_score")), "negatives-positives")
    windows = positives.join(anchors, keys).select(
        *keys, "positive_id", "positive_mark", "positive_score", "label", "vec",
        F.ceil(F.col("positive_score") * low / 100).cast("double").alias("lo"),
        F.floor(F.col("positive_score") * high / 100).cast("double").alias("hi")).where("lo <= hi")
    keys += ["positive_id", "positive_mark", "positive_score"]
    return best_matches(trees, windows, n_anchors * n_positives, keys, False, n_negatives, tasks).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
