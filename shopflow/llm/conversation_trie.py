"""Prefix trie of conversations, found by digests of fixed-length blocks of turns.

Every conversation is cut into blocks of ``block_turns`` turns. A digest per
block and running sums of position-bound digests name each prefix that ends at
a block's edge, so conversations that begin alike fall into one group per block
whatever their number. Only where a prefix is followed by several different
blocks are the turn boundaries inside those blocks told apart, once per
different block and not once per conversation; elsewhere the turns of a block
form a chain with the same members.

Texts are read once and leave the scan as 32-byte digests. No step holds a
conversation, or the members of a node, in one group: turns are numbered in
ranges, running sums in segments, and members enter nodes as partial sums. The
sums over subtrees need no walk by depth: each node belongs to the path of its
smallest member, so they are sums over a node's members (see ``subtree_sums``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.llm.staging import stage

LANES = 4
#: Blocks of one conversation whose running sums one task adds up in order.
SEGMENT_BLOCKS = 4096
#: Width of the ranges of conv_id whose members are listed in one row.
LISTED_IDS = 4096


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", *parts), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, t, n``: place (from 0), digest of role and text, bytes of the text of each turn.

    Ordered by turn, null first; turns of the same number by digest, so the
    order never depends on the files. Null role or text is empty, repeated rows
    are turns of their own, rows without a conv_id belong to no conversation.
    A conversation of any length is numbered by ranges: each range by itself,
    then the counts of the ranges before it are added.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    facts = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("t"),
        F.octet_length(text).cast("long").alias("n"))
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(facts.repartitionByRange(parts, "conv_id", "turn", "t")
                   .withColumn("part", F.spark_partition_id()), "trie-ranges")
    here = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "t")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = (ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("held"))
            .select("conv_id", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before")))
    return (ranged.withColumn("place", F.row_number().over(here)).join(held, ["conv_id", "part"])
            .select("conv_id", (F.col("before") + F.col("place") - 1).alias("pos"), "t", "n"))


def shared_openings(turns: DataFrame, shared: Callable[[Column], Column],
                    base: Callable[[Column], Column], most: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first ``shared(conv_id)`` turns (at most ``most``) taken from another.

    Of conversation ``base(conv_id)`` all turns are taken if it has fewer, none
    if it is absent; the conversation's own turns after that number follow.
    Result: all ``conv_id``, those left without turns too, and the rows ``conv_id, pos, t, n``.
    """
    heads = (turns.where(F.col("pos") < most).groupBy(F.col("conv_id").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "t", "n"))).alias("head")))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select(
        "conv_id", shared(F.col("conv_id")).alias("h"), base(F.col("conv_id")).alias("base"))
    taken = convs.join(heads, "base", "left").select(
        "conv_id", "h", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1),
                                F.col("h").cast("int")).alias("head"))
    taken = stage(taken, "trie-openings")
    own = turns.join(taken.select("conv_id", "h", F.size("head").alias("m")), "conv_id").where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "t", "n")
    return taken.select("conv_id"), taken.select("conv_id", F.inline("head")).unionByName(own)


def prefix_id(blocks: Column, sums: list[Column]) -> Column:
    """Name of the node at a block's edge: the number of blocks before it and the sums of their digests."""
    return _digest(F.lit("edge"), blocks, *sums)


def digest_blocks(turns: DataFrame, block_turns: int) -> DataFrame:
    """A row per conversation and block: ``conv_id, k, up, end, ts, ns, before``.

    ``up`` and ``end`` name the nodes before and at the end of the block,
    ``ts`` and ``ns`` are its turns' digests and bytes, ``before`` the bytes of
    the blocks before it. The sums of a long conversation are taken in segments.
    """
    rows = (turns.groupBy("conv_id", F.floor(F.col("pos") / block_turns).alias("k"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", "t", "n"))).alias("x"))
            .select("conv_id", "k", F.col("x.t").alias("ts"), F.col("x.n").alias("ns"),
                    F.floor(F.col("k") / SEGMENT_BLOCKS).alias("segment"))
            .withColumn("own", block_digest(F.col("ts"))))
    bound = F.sha2(F.concat_ws(":", "k", F.hex("own")), 256)
    lanes = [F.conv(F.substring(bound, 8 * i + 1, 8), 16, 10).cast("long").alias(f"s{i}") for i in range(LANES)]
    size = F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x).alias("b")
    rows = stage(rows.select("*", *lanes, size), "trie-blocks")
    summed = [f"s{i}" for i in range(LANES)] + ["b"]
    here = Window.partitionBy("conv_id", "segment").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = (rows.groupBy("conv_id", "segment").agg(*[F.sum(c).alias(c) for c in summed])
               .select("conv_id", "segment", *[F.sum(c).over(earlier).alias(f"{c}_carried") for c in summed])
               .where("segment > 0"))
    prior = {c: F.coalesce(F.sum(c).over(here), F.lit(0)) for c in summed}
    found = (rows.withColumns({f"{c}_prior": p for c, p in prior.items()})
             .join(carried, ["conv_id", "segment"], "left")
             .withColumns({f"{c}_prior": F.col(f"{c}_prior") + F.coalesce(f"{c}_carried", F.lit(0)) for c in summed}))
    at = [F.col(f"s{i}_prior") for i in range(LANES)]
    up = prefix_id(F.col("k"), at)
    edge = prefix_id(F.col("k") + 1, [a + F.col(f"s{i}") for i, a in enumerate(at)])
    end = F.when(F.size("ts") == block_turns, edge).otherwise(inner_id(up, F.col("own")))
    return found.select("conv_id", "k", up.alias("up"), end.alias("end"), "ts", "ns", F.col("b_prior").alias("before"))


def block_digest(ts: Column) -> Column:
    return F.unhex(F.sha2(F.aggregate(ts, F.lit(b""), lambda a, t: F.concat(a, t)), 256))


def inner_id(up: Column, digest: Column) -> Column:
    """Name of a node inside a block: the node before the block and the digest of the turns since."""
    return _digest(F.lit("inner"), F.hex(up), F.hex(digest))


def boundaries(blocks: DataFrame, block_turns: int) -> DataFrame:
    """A row per different block and turn boundary in it: ``end, id, parent, depth, bytes, cum, low, n``.

    Blocks are grouped by content and prefix first. Inside a block without
    siblings the boundaries are a chain named after the block; where siblings
    diverge each boundary is named by the turns up to it, which siblings may share.
    """
    distinct = stage(blocks.groupBy("end").agg(
        F.min("conv_id").alias("low"), F.count(F.lit(1)).alias("n"),
        F.first(F.struct("up", "k", "ts", "ns", "before")).alias("f")).select("end", "low", "n", "f.*"), "trie-distinct")
    alone = distinct.groupBy("up").agg(F.count(F.lit(1)).alias("siblings"))
    marked = distinct.join(alone, "up")
    places = F.sequence(F.lit(1), F.size("ts"))

    def inside(j: Column) -> Column:
        chain = _digest(F.lit("chain"), F.hex("end"), j)
        shared = inner_id(F.col("up"), block_digest(F.slice("ts", F.lit(1), j)))
        return F.when(j == F.size("ts"), F.col("end")).when(F.col("siblings") == 1, chain).otherwise(shared)

    cut = marked.withColumn("ids", F.transform(places, inside)).select(
        "end", "low", "n", "up", "k", "ns", "before", "ids", F.posexplode("ids").alias("j", "id"))
    spent = F.aggregate(F.slice("ns", F.lit(1), F.col("j")), F.lit(0).cast("long"), lambda a, x: a + x)
    return cut.select("end", "id", F.when(F.col("j") == 0, F.col("up")).otherwise(F.get("ids", F.col("j") - 1)).alias("parent"),
                      (F.col("k") * block_turns + F.col("j") + 1).alias("depth"),
                      F.get("ns", F.col("j")).alias("bytes"), (F.col("before") + spent).alias("cum"), "low", "n")


def listed_ends(ends: DataFrame) -> DataFrame:
    """``id, ends_sha256``: hash of the ids of conversations that end at a node, ascending, comma-joined.

    Ids are listed by ranges of ``LISTED_IDS``; the lists of a node that has
    several are hashed one after the other as a stream, so no node's members
    are held at once.
    """
    pieces = (ends.groupBy("id", F.floor(F.col("conv_id") / LISTED_IDS).alias("piece"))
              .agg(F.array_sort(F.collect_list("conv_id")).alias("c"))
              .select("id", "piece", F.array_join(F.col("c").cast("array<string>"), ",").alias("listed")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            ids, out = [], []
            for row, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if row != node:
                    if node is not None:
                        ids.append(node)
                        out.append(state.hexdigest())
                    node, state = row, hashlib.sha256(listed.encode())
                else:
                    state.update(b"," + listed.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.string())], ["id", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["id", "ends_sha256"])

    return (pieces.repartition("id").sortWithinPartitions("id", "piece").select("id", "listed")
            .mapInArrow(hashed, "id binary, ends_sha256 string"))


def subtree_sums(nodes: DataFrame, cut: DataFrame, blocks: DataFrame, totals: DataFrame) -> DataFrame:
    """``id, n_leaves, saved_tokens`` of every node from sums over its members.

    A conversation owns the nodes whose smallest member it is, the last part of
    its path. With T the bytes of a conversation and W the bytes of the nodes it
    owns, the subtree of a node with ``cum`` bytes before it has
    sum(T) - n * cum bytes counted once per member, and
    sum(W) - W(low) + T(low) - cum counted once per node; their difference is
    what sharing saves. Leaves are counted at the conversations that own them.
    """
    owned = nodes.groupBy(F.col("low").alias("conv_id")).agg(
        F.sum("bytes").alias("w"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    weights = stage(totals.join(owned, "conv_id", "left").select(
        "conv_id", "total", F.coalesce("w", F.lit(0)).alias("w"), F.coalesce("leaves", F.lit(0)).alias("leaves")), "trie-weights")
    sums = [F.sum("total").alias("total"), F.sum("w").alias("w"), F.sum("leaves").alias("leaves")]
    by_block = blocks.select("conv_id", "end").join(weights, "conv_id").groupBy("end").agg(*sums)
    by_node = (cut.select("end", "id").join(by_block, "end").groupBy("id").agg(*sums)
               .unionByName(weights.agg(*sums).select(prefix_id(F.lit(0), [F.lit(0)] * LANES).alias("id"), "*")))
    low = weights.select(F.col("conv_id").alias("low"), F.col("total").alias("low_total"), F.col("w").alias("low_w"))
    return (nodes.select("id", "low", "n", "cum").join(by_node, "id").join(low, "low")
            .select("id", F.col("leaves").alias("n_leaves"),
                    (F.col("total") - F.col("n") * F.col("cum") - F.col("w") + F.col("low_w")
                     - F.col("low_total") + F.col("cum")).alias("saved_tokens")))


def prefix_trie(convs: DataFrame, turns: DataFrame, block_turns: int = 4) -> DataFrame:
    """The trie of ``turns`` (``conv_id, pos, t, n``, places from 0 without gaps) of all ``convs``.

    Per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``
    (null at the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. Conversations without turns are
    members of the root; without any conversation there is no node. Equal
    conversations share all nodes.
    """
    blocks = stage(digest_blocks(turns, block_turns), "trie-digests")
    cut = stage(boundaries(blocks, block_turns), "trie-boundaries")
    root = prefix_id(F.lit(0), [F.lit(0)] * LANES)
    zero = F.lit(0).cast("long")
    top = convs.agg(F.min("conv_id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 0").select(
        root.alias("id"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), zero.alias("bytes"),
        zero.alias("cum"), "low", "n")
    found = cut.groupBy("id").agg(*[F.first(c).alias(c) for c in ("parent", "depth", "bytes", "cum")],
                                  F.min("low").alias("low"), F.sum("n").alias("n")).unionByName(top)
    found = stage(found, "trie-found")
    children = found.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = stage(found.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-nodes")

    last = blocks.groupBy("conv_id").agg(F.max_by("end", "k").alias("id"), F.sum(
        F.aggregate("ns", zero, lambda a, x: a + x)).alias("total"))
    ends = stage(convs.join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("id", root).alias("id"), F.coalesce("total", zero).alias("total")), "trie-ends")
    sums = subtree_sums(nodes, cut, blocks, ends.select("conv_id", "total"))
    above = nodes.select(F.col("id").alias("parent"), F.col("low").alias("parent_conv_id"))
    return (nodes.join(sums, "id").join(listed_ends(ends.select("id", "conv_id")), "id", "left")
            .join(above, "parent", "left")
            .select(F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
                    "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def rebuilt_trie(conversations: DataFrame, shared: Callable[[Column], Column], base: Callable[[Column], Column],
                 most: int, block_turns: int = 4) -> DataFrame:
    """:func:`prefix_trie` of conversations whose openings are taken from others (see :func:`shared_openings`)."""
    turns = stage(ordered_turns(conversations), "trie-turns")
    convs, rebuilt = shared_openings(turns, shared, base, most)
    return prefix_trie(convs, rebuilt, block_turns)
