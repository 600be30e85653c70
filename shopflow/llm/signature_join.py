"""Similarity self-join on word shingles with signature trees.

Two texts link when the Jaccard similarity of their sets of word shingles is
at least ``numerator / denominator``. The join loses no link:

1. Texts with equal sets form one class; from here on a class is one node.
2. Two linked sets share a shingle among their first ``n - ceil(t * n) + 1``
   in any common order. The order puts shingles of rare words first, by the
   words' counts, and frequent shingles last; so neither common words nor a
   passage in many texts brings unlike texts together.
3. The nodes that share such a shingle get a signature tree: leaves hold token
   bitmaps and sizes, inner nodes the OR of the bitmaps below and the range of
   sizes. The tree is traversed against itself, and a pair of tree nodes is
   pruned when the overlap that its bitmaps and sizes allow is too small, or
   when all below is connected already. What remains connects the nodes into
   clusters; a frequent shingle's nodes are all connected, without a tree.
   Each cluster gets a second tree whose leaves also hold the exact sets, and
   the pairs that its traversal leaves are checked on them.
4. A cluster too large for one task is cut into blocks by hash. Blocks are
   joined within, then one representative of each component found so far
   across blocks, and only nodes outside the cluster's largest component are
   still compared with the other blocks.

Shingles are 64-bit hashes of the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from shopflow.llm.bytewords import WHITE, shingle_sets, text_slices, text_words
from shopflow.llm.graph import components
from shopflow.llm.staging import fresh_name, stage

FANOUT = 8
BLOCK_TOKENS = 2_000_000  # in one tree
CHUNK_TOKENS = 2_000_000  # counted together when looking for common words and shingles
COMMON_WORDS = 400_000  # most words in the broadcast table
FREQUENT_SHINGLES = 1_500_000  # most shingles in the broadcast table
BROADCAST_ROWS = 250_000
SALTS = 64
_WORD = ~WHITE


def least_overlap(size, numerator: int, denominator: int):
    """ceil(t * size): shingles that a set shares at least with any set it links to."""
    return -(-size * numerator // denominator)


# --- sets and classes ------------------------------------------------------------------

def _set_rows(batch: pa.RecordBatch, words: int,
              salt: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[int]]]:
    """(rows, shingles, bounds of each row's shingles, node of each row) per slice."""
    key = salt.to_bytes(4, "little")
    for rows, data, offsets in text_slices(batch, "text"):
        owner, shingles = shingle_sets(data, offsets, _WORD, words)
        bounds = np.searchsorted(owner, np.arange(rows.num_rows + 1))
        raw, ends = shingles.tobytes(), (8 * bounds).tolist()
        nodes = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=16, key=key).digest()[:8], "little", signed=True)
                 for a, b in zip(ends, ends[1:])]
        yield rows, shingles, bounds, nodes


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits of the shingles' low ends; twice as many bits as shingles, rounded up to a power of two."""
    bits = 1 << max(6, (2 * len(shingles) - 1).bit_length())
    held = np.zeros(bits, bool)
    held[shingles & np.uint64(bits - 1)] = True
    return np.packbits(held).view(np.uint64)


def set_nodes(docs: DataFrame, words: int, salt: int) -> DataFrame:
    """``doc_id, n_shingles, node, digest, bitmap`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, shingles, bounds, nodes in _set_rows(batch, words, salt):
                raw = shingles.tobytes()
                digest = [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest()
                          for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                bitmaps = [bitmap(shingles[a:b]).tobytes() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.diff(bounds)), pa.array(nodes, pa.int64()),
                     pa.array(digest, pa.binary()), pa.array(bitmaps, pa.binary())],
                    ["doc_id", "n_shingles", "node", "digest", "bitmap"])

    schema = (docs.select("doc_id").schema.add("n_shingles", LongType()).add("node", LongType())
              .add("digest", BinaryType()).add("bitmap", BinaryType()))
    return stage(docs.mapInArrow(run, schema), "set-nodes")


def distinct_nodes(docs: DataFrame, words: int) -> tuple[DataFrame, int]:
    """Nodes of all rows under a salt that gives different sets different nodes."""
    for salt in range(16):
        nodes = set_nodes(docs, words, salt)
        clash = nodes.groupBy("node").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi")
        if clash.isEmpty():
            return nodes.drop("digest"), salt
    raise RuntimeError("set hashes collide under every salt")


# --- candidate clusters ----------------------------------------------------------------

def counted_hashes(docs: DataFrame, words: int, salt: int, total: int) -> tuple[HashWeights, HashWeights]:
    """(common words, frequent shingles) with their counts in different sets.

    Every occurrence is looked at; of each run of texts, words that occur less
    than 4 times and shingles that occur once are left out of the counts. The
    thresholds grow with ``total``, so at most COMMON_WORDS and
    FREQUENT_SHINGLES can pass them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        seen: set[int] = set()
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for kind, least in ((0, 4), (1, 2)):
                hashes, counts = np.unique(np.concatenate(held[kind]), return_counts=True)
                some = counts >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(some.sum(), kind, np.int32)), pa.array(hashes[some].view(np.int64)),
                     pa.array(counts[some])], ["kind", "hash", "n"])

        for batch in batches:
            for rows, shingles, bounds, nodes in _set_rows(batch, words, salt):
                _, data, offsets = next(text_slices(rows, "text", 1 << 62))
                row, text_word = text_words(data, offsets, _WORD)
                word_bounds = np.searchsorted(row, np.arange(len(nodes) + 1))
                for k, node in enumerate(nodes):
                    if node not in seen:
                        seen.add(node)
                        held[0].append(text_word[word_bounds[k]:word_bounds[k + 1]])
                        held[1].append(shingles[bounds[k]:bounds[k + 1]])
                        size += int(bounds[k + 1] - bounds[k])
                if size > CHUNK_TOKENS:
                    yield from counted()
                    held, size, seen = ([], []), 0, set()
        if size:
            yield from counted()

    least = F.when(F.col("kind") == 0, max(16, -(-total // COMMON_WORDS))).otherwise(
        max(8, -(-total // FREQUENT_SHINGLES)))
    rows = (docs.select("text").mapInArrow(run, "kind int, hash bigint, n bigint").groupBy("kind", "hash")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow())
    kind = np.array(rows["kind"])
    hashes, counts = np.array(rows["hash"], np.int64).view(np.uint64), np.array(rows["n"], np.int64)
    return tuple(HashWeights(hashes[kind == k], counts[kind == k]) for k in (0, 1))


class HashWeights:
    """Small weights of some hashes, growing with the logarithm of their counts; 0 for all others."""

    FILTER_BITS = 22

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.weights = (1 + 4 * np.log2(counts[order])).astype(np.uint16)
        self.filter = np.zeros(1 << self.FILTER_BITS, bool)
        self.filter[hashes >> np.uint64(64 - self.FILTER_BITS)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        if len(self.hashes):
            near = np.flatnonzero(self.filter[hashes >> np.uint64(64 - self.FILTER_BITS)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
            same = self.hashes[at] == hashes[near]
            out[near[same]] = self.weights[at[same]]
        return out


def prefixes(shingles: np.ndarray, bounds: np.ndarray, word_weight: np.ndarray, frequent: np.ndarray, numerator: int,
             denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the first shingles of every set in the common order.

    The order is by weight, the frequent ones' last, then by hash, by which
    each set is sorted already.
    """
    rank = np.where(frequent > 0, 32768 + frequent, np.minimum(word_weight, 32767)).astype(np.uint16)
    rows, picked = [], []
    for row, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        if b > a:
            wanted = b - a - int(least_overlap(b - a, numerator, denominator)) + 1
            picked.append(a + np.argsort(rank[a:b], kind="stable")[:wanted])
            rows.append(np.full(wanted, row))
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(picked)) if rows else (none, none)


def prefix_groups(docs: DataFrame, words: int, salt: int, order, numerator: int, denominator: int) -> DataFrame:
    """``shingle, salt, node, low``: the nodes that share a prefix shingle, with the group's least node.

    Salt is 0 for shingles that are not frequent. A frequent one's rows are
    dealt over SALTS groups. Of groups with the same nodes one is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        common, frequent_ = order.value
        for batch in batches:
            for rows, shingles, bounds, nodes in _set_rows(batch, words, salt):
                _, data, offsets = next(text_slices(rows, "text", 1 << 62))
                *_, weight = shingle_sets(data, offsets, _WORD, words, common)
                often = frequent_(shingles)
                row, at = prefixes(shingles, bounds, weight, often, numerator, denominator)
                prefix, frequent = shingles[at], often[at] > 0
                fresh = np.zeros(len(nodes), bool)
                fresh[np.unique(np.array(nodes, np.int64), return_index=True)[1]] = True
                fresh &= np.array([n not in seen for n in nodes], bool)
                if len(seen) < 1_000_000:  # copies in one task are emitted once; others meet in the group
                    seen.update(nodes)
                keep = fresh[row]
                node = np.array(nodes, np.int64)[row[keep]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix[keep].view(np.int64)), pa.array(node),
                     pa.array(np.where(frequent[keep], 1 + node % SALTS, 0).astype(np.int32))],
                    ["shingle", "node", "salt"])

    rows = docs.select("text").mapInArrow(run, "shingle bigint, node bigint, salt int")
    group = Window.partitionBy("shingle", "salt")
    # a node that two tasks emit would cancel out of x and y, so its rows become one first; the window's order serves both
    rows = rows.withColumn("before", F.lag("node").over(group.orderBy("node"))).where(
        "before IS NULL OR before <> node").drop("before")
    rows = rows.select("*", F.min("node").over(group).alias("low"), F.max("node").over(group).alias("high"),
                       F.bit_xor(F.xxhash64("node")).over(group).alias("x"),
                       F.bit_xor(F.xxhash64("node", F.lit(1))).over(group).alias("y"))
    rows = stage(rows.where("low <> high OR salt > 0"), "prefix-groups")
    chosen = (rows.where("salt = 0").groupBy("low", "high", "x", "y").agg(F.min("shingle").alias("shingle"))
              .select("shingle"))
    plain = rows.where("salt = 0").join(chosen, "shingle", "left_semi")
    return plain.union(rows.where("salt > 0").select(*plain.columns)).select("shingle", "salt", "node", "low")


def cluster_edges(groups: DataFrame, nodes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links (a, b) that connect all nodes of a group whose bitmaps and sizes allow a link."""
    frequent = groups.where("salt > 0")
    tops = frequent.select("shingle", "low").distinct()
    across = tops.withColumn("least", F.min("low").over(Window.partitionBy("shingle")))
    stars = (frequent.select(F.col("low").alias("a"), F.col("node").alias("b"))
             .union(across.select(F.col("least").alias("a"), F.col("low").alias("b"))).where("a <> b"))
    signatures = nodes.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bitmap").alias("bitmap"))
    members = groups.where("salt = 0").join(signatures, "node").select("shingle", "node", "n", "bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs_of(batches):
            pairs = [(rows[a][1], rows[b][1]) for a, b in _allowed_links(
                np.array([r[2] for r in rows]), [np.frombuffer(r[3], np.uint64) for r in rows],
                numerator, denominator)]
            yield _pairs(pairs)

    return stage(_grouped(members, "shingle").mapInArrow(run, "a bigint, b bigint").union(stars).distinct(),
                 "cluster-edges")


def _grouped(members: DataFrame, key: str) -> DataFrame:
    """Rows of a key one after the other, in as many tasks as shuffles have."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(n, key).sortWithinPartitions(key)


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows with one value in the first column, several at least, from rows sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                if len(held) > 1:
                    yield held
                held = []
            held.append(row)
    if len(held) > 1:
        yield held


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                       pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap over half as many bits, if it is longer."""
    return bitmap[:words] | bitmap[words:] if len(bitmap) > words else bitmap


def _allowed_links(size: np.ndarray, bitmaps: list[np.ndarray], numerator: int,
                   denominator: int) -> Iterator[tuple[int, int]]:
    """Pairs that connect all that bitmaps and sizes allow; t is over 1/2, so widths differ by 2 at most."""
    width = np.array([len(b) for b in bitmaps])
    for w in np.unique(width):
        at = np.flatnonzero((width == w) | (width == 2 * w))
        if (width[at] == w).any() and len(at) > 1:
            at = at[np.argsort(size[at], kind="stable")]
            tree = SignatureTree(np.stack([_folded(bitmaps[k], w) for k in at]), size[at], np.arange(len(at)),
                                 numerator, denominator)
            for a, b in tree.stars():
                yield int(at[a]), int(at[b])


# --- signature trees -------------------------------------------------------------------

class SignatureTree:
    """A tree over sets in a given order: bitmaps OR-combined and sizes ranged from the leaves up.

    ``labels`` tell which sets are known to be connected. With ``sets`` a pair
    is a link when its similarity reaches the threshold, without when bitmaps
    and sizes allow it.
    """

    def __init__(self, bitmaps: np.ndarray, size: np.ndarray, labels: np.ndarray, numerator: int, denominator: int,
                 sets: list[np.ndarray] | None = None):
        self.numerator, self.denominator, self.sets = numerator, denominator, sets
        self.labels = np.unique(labels, return_inverse=True)[1]
        excess = size - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        # per level: bitmap, least and greatest size, greatest count of shingles that share a bit
        self.levels = [(bitmaps, size, size, excess)]
        while len(self.levels[-1][1]) > 1:
            bitmap_, low, high, excess = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bitmap_, at), np.minimum.reduceat(low, at),
                                np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], labels: np.ndarray, numerator: int,
                denominator: int) -> tuple[SignatureTree, np.ndarray]:
        """(tree with exact sets, position of each leaf's set): like sizes, then like least shingles side by side."""
        size = np.array([len(s) for s in sets])
        first = np.array([s[0] for s in sets], np.uint64)
        order = np.lexsort((first, np.log(size) // np.log(denominator / numerator)))
        bits = min(max(1024, 1 << int(32 * np.median(size)).bit_length()), 65536)
        leaves = np.zeros((len(sets), bits // 8), np.uint8)
        for k, at in enumerate(order):
            held = np.zeros(bits, bool)
            held[sets[at] & np.uint64(bits - 1)] = True
            leaves[k] = np.packbits(held)
        return cls(leaves.view(np.uint64), size[order], labels[order], numerator, denominator,
                   [sets[k] for k in order]), order

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(len(a), len(b)) whether the pairs' bitmaps and sizes allow a link."""
        bitmap, low, high, excess = self.levels[level]
        overlap = np.bitwise_count(bitmap[a][:, None] & bitmap[b][None]).sum(axis=2, dtype=np.int64)
        overlap += np.minimum.outer(excess[a], excess[b])
        overlap = np.minimum(overlap, np.minimum.outer(high[a], high[b]))
        n, d = self.numerator, self.denominator
        return ((overlap * (n + d) >= n * np.add.outer(low[a], low[b]))
                & (d * high[a][:, None] >= n * low[b][None]) & (d * high[b][None] >= n * low[a][:, None]))

    def _one_component(self, level: int, a: int, b: int) -> bool:
        """Whether everything below both nodes is already connected."""
        step = FANOUT ** level
        first = self.labels[a * step]
        return bool((self.labels[a * step:(a + 1) * step] == first).all()
                    and (self.labels[b * step:(b + 1) * step] == first).all())

    def _linked(self, a: int, b: int) -> bool:
        if self.sets is None:
            return True  # bitmaps and sizes were compared on the way down
        x, y = self.sets[a], self.sets[b]
        shared = len(x) + len(y) - len(np.union1d(x, y))
        return shared * self.denominator >= self.numerator * (len(x) + len(y) - shared)

    def stars(self) -> Iterator[tuple[int, int]]:
        """Pairs of leaves, (first, other), that connect all that is linked or was known to be."""
        self._connect()
        first: dict[int, int] = {}
        for leaf, label in enumerate(self.labels.tolist()):
            lead = first.setdefault(label, leaf)
            if lead != leaf:
                yield lead, leaf

    def _connect(self) -> None:
        """Traverse the tree against itself and give linked leaves one label."""
        top = len(self.levels) - 1
        todo = [(top, 0, 0)]
        while todo:
            level, a, b = todo.pop()
            if self._one_component(level, a, b):
                continue
            if level == 0:
                if self._linked(a, b):
                    self.labels[self.labels == self.labels[b]] = self.labels[a]
                continue
            count = len(self.levels[level - 1][1])
            below_a = np.arange(a * FANOUT, min((a + 1) * FANOUT, count))
            below_b = np.arange(b * FANOUT, min((b + 1) * FANOUT, count))
            ok = self._possible(level - 1, below_a, below_b)
            if a == b:
                ok = np.triu(ok, 1 if level == 1 else 0)
            # nearest pairs last, so that they are taken first
            found = sorted(zip(*np.nonzero(ok)), key=lambda p: -abs(int(below_a[p[0]]) - int(below_b[p[1]])))
            todo += [(level - 1, int(below_a[i]), int(below_b[j])) for i, j in found]


def tree_links(members: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links (a, b) within each group of ``members`` (part, node, label, shingles).

    Nodes of a group with one label are known to be connected. A group fits
    one task; its rows come one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs_of(batches):
            rows = list({r[1]: r for r in rows}.values())
            if len(rows) > 1:
                sets = [np.frombuffer(r[3], np.uint64) for r in rows]
                tree, at = SignatureTree.of_sets(sets, np.array([r[2] for r in rows], np.int64), numerator,
                                                 denominator)
                yield _pairs([(rows[at[a]][1], rows[at[b]][1]) for a, b in tree.stars()])

    return _grouped(members.select("part", "node", "label", "shingles"), "part").mapInArrow(run, "a bigint, b bigint")


def shingles_of(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, words: int, salt: int) -> DataFrame:
    """``node, cluster, n, shingles`` of every clustered node, from one of its rows."""
    ids = (nodes.join(clusters.withColumnRenamed("component", "cluster"), "node")
           .groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
    wanted = stage(ids, "clustered-docs").select(F.col("doc_id").alias("wanted_id"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["wanted_id"]), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, shingles, bounds, found in _set_rows(batch, words, salt):
                raw = shingles.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.int64()), pa.array(np.diff(bounds)),
                     pa.array([raw[8 * a:8 * b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())], pa.binary())],
                    ["node", "n", "shingles"])

    sets = texts.mapInArrow(run, "node bigint, n bigint, shingles binary")
    return stage(sets.join(clusters.withColumnRenamed("component", "cluster"), "node"), "clustered-sets")


def similarity_links(docs: DataFrame, nodes: DataFrame, words: int, numerator: int, denominator: int,
                     salt: int = 0) -> DataFrame:
    """Links between nodes that connect exactly what is linked; ``docs`` has doc_id and text."""
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    order = docs.sparkSession.sparkContext.broadcast(counted_hashes(docs, words, salt, total))
    groups = prefix_groups(docs, words, salt, order, numerator, denominator)
    clusters = components(cluster_edges(groups, nodes, numerator, denominator), "clusters")
    sets = shingles_of(docs, nodes, clusters, words, salt)
    sizes = stage(sets.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks")),
                  "cluster-sizes")
    sets = sets.join(sizes, "cluster")

    def part(*columns):
        return F.struct(F.col("cluster").alias("c"), *[F.col(c).alias(f"p{k}") for k, c in enumerate(columns)])

    def keyed(df, *columns, label="node"):
        return df.select(F.to_json(part(*columns)).alias("part"), "node", F.col(label).alias("label"), "shingles")

    blocked = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    links = stage(tree_links(keyed(blocked, "block"), numerator, denominator), "tree-links")
    large = blocked.where("blocks > 1")
    if sizes.where("blocks > 1").isEmpty():
        return links
    # across the blocks of large clusters: representatives of the components found, then all but the largest
    for step in ("representatives", "remainder"):
        found = components(links, f"found-{step}")
        labelled = large.join(found, "node", "left").withColumn("label", F.coalesce("component", "node"))
        groups = labelled.groupBy("cluster", "label").agg(F.count("*").alias("members"), F.sum("n").alias("n_all"),
                                                          F.min("node").alias("lead"))
        if step == "representatives":
            leads = groups.select("cluster", F.col("lead").alias("node"))
            more = labelled.join(leads, ["cluster", "node"], "left_semi")
            more = more.withColumn("block", F.pmod(F.xxhash64("node", F.lit(step)), F.col("blocks")))
            links = stage(links.union(tree_links(keyed(more, "block", label="label"), numerator, denominator)),
                          "tree-links")
            continue
        largest = groups.groupBy("cluster").agg(F.max(F.struct("members", "label"))["label"].alias("largest"))
        rest = groups.join(largest, "cluster").where("label <> largest")
        rest_blocks = rest.groupBy("cluster").agg(F.ceil(F.sum("n_all") / BLOCK_TOKENS).cast("int").alias("rests"))
        sides = labelled.join(rest_blocks, "cluster").join(largest, "cluster")
        every = sides.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).withColumn("a", F.col("block"))
        outside = (sides.where("label <> largest")
                   .withColumn("s", F.pmod(F.xxhash64("node", F.lit(step)), F.col("rests")))
                   .withColumn("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
        both = every.select(*outside.columns).union(outside)
        links = stage(links.union(tree_links(keyed(both, "s", "a", label="label"), numerator, denominator)),
                      "tree-links")
    return links


def rooted_rows(docs: DataFrame, words: int, numerator: int, denominator: int) -> tuple[DataFrame, int]:
    """(``doc_id, n_shingles, node, root`` of every row, salt); root is null without shingles."""
    nodes, salt = distinct_nodes(docs, words)
    sets = nodes.where("n_shingles > 0")
    reached = components(similarity_links(docs, sets, words, numerator, denominator, salt), "similar")
    rows = nodes.join(reached, "node", "left").select(
        "doc_id", "n_shingles", "node",
        F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("root"))
    return stage(rows, "rooted-rows"), salt


def similar_components(docs: DataFrame, words: int = 3, numerator: int = 9, denominator: int = 10) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (doc_id and text).

    ``component_id`` is the least doc_id reachable by links, itself included.
    Null, empty and blank texts have no shingles and are linked with nothing.
    Texts with fewer words than ``words`` have their whole sequence as one
    shingle. Rows with equal sets are linked, repeated rows too. Null doc_ids
    are passed over for the least id, which is null only in a component
    without any id. An empty table gives an empty result.
    """
    rows, _ = rooted_rows(docs.select("doc_id", "text"), words, numerator, denominator)
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
        .alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = 5, numerator: int = 8, denominator: int = 10) -> DataFrame:
    """One row of ``docs`` per component, that with the least doc_id, columns unchanged.

    Rows without shingles all stay. Null doc_ids come last; of rows with one
    doc_id and one set a single one stays.
    """
    names = docs.columns
    rows, salt = rooted_rows(docs.select("doc_id", "text"), words, numerator, denominator)
    rows = rows.where("root IS NOT NULL").groupBy("root", "doc_id", "node").agg(F.count("*").alias("times"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    first = rows.groupBy("root").agg(F.min(rank).alias("first"))
    judged = stage(rows.join(first, "root").select("doc_id", "node", "times", (rank == F.col("first")).alias("stays")),
                   "similar-judged")
    judged = judged.select("doc_id", "node", "times", F.coalesce("stays", F.lit(False)).alias("stays"))
    gone_id, gone_node, held_node = (fresh_name(n, names) for n in ("gone_id", "gone_node", "held_node"))
    goes = judged.where("NOT stays").select(F.col("doc_id").alias(gone_id), F.col("node").alias(gone_node))
    if goes.count() <= BROADCAST_ROWS:
        goes = F.broadcast(goes)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_, _, bounds, found in _set_rows(batch, words, salt):
                node = [n if size else None for n, size in zip(found, np.diff(bounds).tolist())]
                yield pa.RecordBatch.from_arrays([*slice_.columns, pa.array(node, pa.int64())],
                                                 [*slice_.schema.names, held_node])

    marked = docs.mapInArrow(mark, docs.select("*").schema.add(held_node, LongType()))
    left = marked.join(goes, marked["doc_id"].eqNullSafe(goes[gone_id]) & (marked[held_node] == goes[gone_node]),
                       "left_anti")
    if not judged.where("stays AND times > 1").isEmpty():
        left = (left.where(F.col(held_node).isNull())
                .union(left.where(F.col(held_node).isNotNull()).dropDuplicates(["doc_id", held_node])))
    return left.select(*[F.col(f"`{c}`") for c in names])
