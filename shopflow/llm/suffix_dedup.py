"""Removal of repeated passages with suffix arrays.

Every byte covered by a ``length``-byte string that also starts elsewhere, in
any text, is removed. Equal strings must meet in one task without comparing
all suffixes with all:

1. Each start of a string is assigned to the position, inside the string, of
   the least-hashed short gram (leftmost on ties). Equal strings have equal
   grams at equal places, so only strings under one gram need comparing. The
   starts of one position form a fragment: the bytes that their strings cover.
2. Equal fragments are counted before anything is gathered; of each distinct
   fragment one copy goes on, or two where it stands at several positions.
   Grams with a single position are dropped.
3. The fragments of many grams are laid end to end and their suffixes sorted
   in two stages: suffixes smaller than their successor directly, the others
   induced by scanning the buckets of first bytes in order. Common prefixes of
   neighbours then tell which starts repeat.
4. A gram with too many distinct fragments for one task is cut into blocks.
   Strings whose hashes meet across the blocks are compared as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from shopflow.llm.bytewords import mix, span_hashes, text_slices
from shopflow.llm.staging import stage

LENGTH = 400
GRAM = 64
POSITION_BITS = 30
CHUNK_BYTES = 2 << 20  # of starts hashed at once
FRAGMENTS_PER_BLOCK = 4000
TASK_BYTES = 2 << 20
BROADCAST_ROWS = 250_000


# --- suffix array ----------------------------------------------------------------------

def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each position is smaller than the next one; the last one is not."""
    n = len(text)
    rises = np.zeros(n, bool)
    if n > 1:
        change = np.flatnonzero(text[1:] != text[:-1])
        up = np.append(text[change + 1] > text[change], False)
        rises[:-1] = up[np.searchsorted(change, np.arange(n - 1))]
    return rises


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a byte array in suffix order, right at least to ``depth`` bytes.

    Ends with a 0; suffixes that agree on ``depth`` bytes may be in any order.
    """
    direct = smaller_than_successor(text)
    raw = text.tobytes()
    starts = np.flatnonzero(direct)
    lead = text[starts].astype(np.int32) * 256 + text[starts + 1]
    order = np.argsort(lead, kind="stable")
    starts, lead = starts[order], lead[order]
    sorted_direct: list[list[np.ndarray]] = [[] for _ in range(256)]
    cuts = np.flatnonzero(np.diff(lead)) + 1
    for bucket in np.split(starts, cuts) if len(starts) else []:
        if len(bucket) > 1:
            bucket = np.array(sorted(bucket.tolist(), key=lambda p: raw[p:p + depth]))
        sorted_direct[text[bucket[0]]].append(bucket)

    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([len(text) - 1]))
    out = []

    def induce(scanned: np.ndarray, byte: int) -> np.ndarray:
        """Place the larger predecessors of scanned suffixes; returns those of the same bucket."""
        before = scanned[scanned > 0] - 1
        before = before[~direct[before]]
        lead = text[before]
        inside, beyond = before[lead == byte], before[lead != byte]
        if len(beyond):
            by = np.argsort(text[beyond], kind="stable")
            beyond = beyond[by]
            heads = text[beyond]
            for part in np.split(beyond, np.flatnonzero(heads[1:] != heads[:-1]) + 1):
                induced[text[part[0]]].append(part)
        return inside

    for byte in range(256):
        front = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, np.int64)
        while len(front):
            out.append(front)
            front = induce(front, byte)
        if sorted_direct[byte]:
            front = np.concatenate(sorted_direct[byte])
            out.append(front)
            induce(front, byte)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, most: int, block: int = 80) -> np.ndarray:
    """Bytes that each suffix shares with the next in order, up to ``most`` (8 at least), compared by blocks.

    A shorter prefix is given as the end of its last block that agrees.
    """
    block = min(block, most // 8 * 8)
    shared = np.zeros(max(0, len(suffixes) - 1), np.int64)
    padded = np.concatenate([text, np.zeros(most, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, block)
    live = np.arange(len(shared))
    for end in [*range(block, most, block), most]:
        if not len(live):
            break
        same = np.ones(len(live), bool)
        for lo in range(0, len(live), 1 << 16):
            part = live[lo:lo + (1 << 16)]
            a, b = rows[suffixes[part] + end - block], rows[suffixes[part + 1] + end - block]
            same[lo:lo + (1 << 16)] = (a.view(np.uint64) == b.view(np.uint64)).all(axis=1)
        live = live[same]
        shared[live] = end
    return shared


def repeated_starts(fragments: list[bytes], copies: list[int], length: int) -> list[np.ndarray]:
    """Per fragment, whether the string at each of its starts occurs at another place."""
    laid = b"\x00".join(f for f, c in zip(fragments, copies) for _ in range(c)) + b"\x00"
    raw = np.frombuffer(laid, np.uint8)
    sizes = np.repeat([len(f) for f in fragments], copies)
    ends = np.cumsum(sizes + 1) - 1
    text = raw + np.uint8(1)  # no byte of UTF-8 is 255, so 0 is left for the ends
    text[ends] = 0
    room = np.repeat(ends, sizes + 1) - np.arange(len(text))
    order = suffix_array(text, length)
    order = order[room[order] >= length]
    same = common_prefixes(text, order, length) >= length
    repeated = np.zeros(len(text), bool)
    repeated[order[:-1][same]] = True
    repeated[order[1:][same]] = True
    begin = ends - sizes
    first = np.cumsum(copies) - copies
    return [repeated[begin[k]:begin[k] + sizes[k] - length + 1] for k in first]


def runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of True as (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


# --- fragments -------------------------------------------------------------------------

def text_node(raw: bytes, salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=salt.to_bytes(4, "little")).digest(),
                          "little", signed=True)


def fragments_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, chunk: int = CHUNK_BYTES):
    """(row, gram hash, fragment hash, first start, last start) of the fragments of a slice's texts.

    Starts are relative to their text. A long slice is read ``chunk`` starts at a
    time; a fragment across two chunks becomes two, whose strings meet again by
    their gram.
    """
    parts = [_chunk_fragments(data[at:at + chunk + length - 1], offsets - at, length, gram)
             for at in range(0, max(len(data), 1), chunk)]
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(p) for p in zip(*parts))


def _chunk_fragments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = len(data)
    if n < length:
        return none
    at = np.arange(n - gram + 1)
    grams = span_hashes(data, at, at + gram)
    shift = np.uint64(POSITION_BITS)
    least = ((grams >> shift) << shift) | at.astype(np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    anchor = (least & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.searchsorted(offsets, start, "right") - 1
    inside = start + length <= offsets[row + 1]
    start, row, anchor = start[inside], row[inside], anchor[inside]
    if not len(start):
        return none
    opens = np.ones(len(start), bool)
    opens[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(start)) - 1
    s1, s2, row, anchor = start[first], start[last], row[first], anchor[first]
    content = span_hashes(data, s1, s2 + length)
    content = mix(content + (anchor - s1).astype(np.uint64))  # the gram's place belongs to it
    return row, grams[anchor], content, s1 - offsets[row], s2 - offsets[row]


def text_table(docs: DataFrame, length: int, gram: int, salt: int) -> DataFrame:
    """``doc_id, node, digest, n_bytes, fragments`` of every row, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kind = pa.struct([("gram", pa.int64()), ("content", pa.int64()), ("s1", pa.int32()), ("s2", pa.int32())])
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                row, grams, content, s1, s2 = fragments_of(data, offsets, length, gram)
                raw, ends = data.tobytes(), offsets.tolist()
                digest = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(ends, ends[1:])]
                nodes = [text_node(d, salt) for d in digest]
                fresh = np.array([n not in seen for n in nodes], bool)
                if len(seen) < 1_000_000:  # copies in one task give their fragments once; others meet later
                    seen.update(nodes)
                keep = fresh[row] if len(row) else np.zeros(0, bool)
                bounds = np.searchsorted(row[keep], np.arange(rows.num_rows + 1)).astype(np.int32)
                flat = pa.StructArray.from_arrays(
                    [pa.array(grams[keep].view(np.int64)), pa.array(content[keep].view(np.int64)),
                     pa.array(s1[keep].astype(np.int32)), pa.array(s2[keep].astype(np.int32))], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(nodes, pa.int64()), pa.array(digest, pa.binary()),
                     pa.array(np.diff(offsets)), pa.ListArray.from_arrays(bounds, flat)],
                    ["doc_id", "node", "digest", "n_bytes", "fragments"])

    schema = docs.select("doc_id").schema
    for name, kind in (("node", "bigint"), ("digest", "binary"), ("n_bytes", "bigint"),
                       ("fragments", "array<struct<gram: bigint, content: bigint, s1: int, s2: int>>")):
        schema = schema.add(name, DataType.fromDDL(kind))
    return stage(docs.mapInArrow(run, schema), "text-fragments")


def _texts(docs: DataFrame, table: DataFrame, nodes: DataFrame, salt: int, name: str) -> DataFrame:
    """``node, text`` (bytes) of the given nodes, from one row of each."""
    ids = stage(table.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
                .select(F.col("doc_id").alias("wanted_id")).distinct(), name)
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                raw, ends = data.tobytes(), offsets.tolist()
                texts = [raw[a:b] for a, b in zip(ends, ends[1:])]
                nodes = [text_node(hashlib.sha256(t).digest(), salt) for t in texts]
                fresh = [k for k, n in enumerate(nodes) if n not in seen and not seen.add(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[k] for k in fresh], pa.int64()),
                     pa.array([texts[k] for k in fresh], pa.binary())], ["node", "text"])

    chosen = docs.join(ids, docs["doc_id"].eqNullSafe(ids["wanted_id"]), "left_semi").select("text")
    return chosen.mapInArrow(run, "node bigint, text binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame, int]:
    """(text table, covers, salt): ``covers`` has, per node, the byte ranges of repeated strings.

    Ranges may overlap; texts whose exact copies exist are not singled out.
    """
    for salt in range(16):
        table = text_table(docs, length, gram, salt)
        if (table.groupBy("node").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
                .where("a <> b").isEmpty()):
            break
    else:
        raise RuntimeError("text hashes collide under every salt")
    rows = table.select("node", F.explode("fragments").alias("f")).select("node", "f.*")
    place = F.xxhash64("node", "s1")
    distinct = stage(rows.groupBy("gram", "content").agg(F.min(place).alias("lo"), F.max(place).alias("hi")),
                     "distinct-fragments")
    # counts and a join, not a window: a gram in very many texts is then split like any skewed key
    shared = (distinct.groupBy("gram").agg(F.count("*").alias("kinds"), F.max(F.col("lo") != F.col("hi")).alias("twice"))
              .where("kinds > 1 OR twice").select("gram", "kinds"))
    several = stage(distinct.join(shared, "gram").select(
        "gram", "content", "lo", F.when(F.col("lo") == F.col("hi"), 1).otherwise(2).alias("copies"), "kinds"),
        "several-fragments")
    members = stage(rows.join(several, ["gram", "content"]).select(
        "gram", "content", "node", "s1", "s2", "copies", "kinds", (place == F.col("lo")).alias("leads")),
        "fragment-members")

    leads = members.where("leads").dropDuplicates(["gram", "content"])
    wanted = leads.groupBy("node").agg(F.collect_list(F.struct("gram", "content", "s1", "s2", "copies", "kinds"))
                                       .alias("cuts"))  # as many as the text is long, at most
    texts = _texts(docs, table, leads.select("node").distinct(), salt, "fragment-docs")
    pieces = (texts.dropDuplicates(["node"]).join(wanted, "node")
              .select("text", F.explode("cuts").alias("c"))
              .select("c.gram", "c.content", "c.copies", "c.kinds",
                      F.expr(f"substring(text, c.s1 + 1, c.s2 - c.s1 + {length})").alias("piece")))
    found = stage(_sorted_fragments(pieces, length), "repeated-starts")

    starts = found.select("gram", "content", F.explode("runs").alias("r")).select("gram", "content", "r.*")
    opened = found.where("open IS NOT NULL").select("gram", "content", F.posexplode("open").alias("a", "seen"))
    opened = opened.where("seen IS NOT NULL")
    across = _same_strings(opened, pieces, length)
    covers = (members.join(starts.union(across), ["gram", "content"])
              .select("node", F.struct((F.col("s1") + F.col("a")).alias("start"),
                                       (F.col("s1") + F.col("b") - 1 + length).alias("end")).alias("range"))
              .groupBy("node").agg(F.collect_set("range").alias("ranges")))
    return table, stage(covers, "repeat-covers"), salt


def _same_strings(opened: DataFrame, pieces: DataFrame, length: int) -> DataFrame:
    """``gram, content, a, b``: the starts of ``opened`` whose string also starts in another block of their gram.

    Hashes only choose which strings to look at; these are cut out of their
    fragments and compared as bytes.
    """
    twice = opened.groupBy("gram", "seen").agg(F.count("*").alias("n")).where("n > 1").select("gram", "seen")
    likely = stage(opened.join(twice, ["gram", "seen"]), "strings-of-several-blocks")
    if likely.isEmpty():  # no gram has blocks, or their strings differ: no fragment is read again
        return likely.select("gram", "content", "a", (F.col("a") + 1).alias("b"))
    strings = likely.join(pieces.select("gram", "content", "piece"), ["gram", "content"]).select(
        "gram", "seen", "content", "a", F.expr(f"substring(piece, a + 1, {length})").alias("string"))
    strings = stage(strings, "strings-compared")
    same = (strings.groupBy("gram", "seen", "string").agg(F.count("*").alias("n")).where("n > 1")
            .select("gram", "seen", "string"))
    return strings.join(same, ["gram", "seen", "string"]).select("gram", "content", "a", (F.col("a") + 1).alias("b"))


def _sorted_fragments(pieces: DataFrame, length: int) -> DataFrame:
    """``gram, content, runs, open``: repeated starts of each distinct fragment.

    ``open`` has, for grams cut into blocks, a hash of the string at each
    start, but for strings that repeat within their block only once.
    """
    blocks = F.ceil(F.col("kinds") / FRAGMENTS_PER_BLOCK)
    keyed = pieces.select("gram", F.pmod(F.xxhash64("content"), blocks).cast("int").alias("block"), "content",
                          "copies", (blocks > 1).alias("cut"), "piece")
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "gram", "block").sortWithinPartitions("gram", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def sort() -> pa.RecordBatch:
            masks = repeated_starts([h[5] for h in held], [h[3] for h in held], length)
            opens = []
            told: set[tuple[int, int, int]] = set()
            for (gram, block, *_, cut, piece), mask in zip(held, masks):
                if not cut:
                    opens.append(None)
                    continue
                at = np.arange(len(mask))
                hashes = span_hashes(np.frombuffer(piece, np.uint8), at, at + length).view(np.int64)
                # a string that repeats in its block speaks once for the block
                opens.append([None if m and ((gram, block, h) in told or told.add((gram, block, h))) else h
                              for m, h in zip(mask.tolist(), hashes.tolist())])
            return pa.RecordBatch.from_pydict(
                {"gram": [h[0] for h in held], "content": [h[2] for h in held],
                 "runs": [[{"a": a, "b": b} for a, b in runs_of(m)] for m in masks], "open": opens},
                pa.schema([("gram", pa.int64()), ("content", pa.int64()),
                           ("runs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                           ("open", pa.list_(pa.int64()))]))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > TASK_BYTES and held[-1][:2] != row[:2]:
                    yield sort()
                    held, size = [], 0
                held.append(row)
                size += row[3] * len(row[5])
        if held:
            yield sort()

    return dealt.mapInArrow(run, "gram bigint, content bigint, runs array<struct<a: int, b: int>>, open array<bigint>")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256`` for every row of ``docs``.

    ``spans`` are the maximal removed byte ranges, end exclusive. Null and
    empty texts have no bytes. Repeated rows and exact copies of ``length``
    bytes or more are removed whole, each by the other. Shorter texts keep
    all. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    table, covers, salt = repeated_spans(docs, length, gram)
    table = table.drop("fragments")
    counts = table.groupBy("node").agg(F.count("*").alias("copies"))
    copied = counts.where("copies > 1").select("node", F.lit(True).alias("copied"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"node": batch.column(0).to_pylist(), "spans": [], "kept": []}
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = _merged([(r["start"], r["end"]) for r in ranges])
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
                out["kept"].append(hashlib.sha256(kept_bytes(text, spans)).digest())
            yield pa.RecordBatch.from_pydict(out, pa.schema([
                ("node", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ("kept", pa.binary())]))

    partly = covers.join(copied, "node", "left_anti")
    texts = _texts(docs, table, partly.select("node"), salt, "covered-docs")
    pieces = texts.dropDuplicates(["node"]).join(partly, "node").select("node", "text", "ranges")
    trimmed = pieces.mapInArrow(cut, "node bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
    trimmed = stage(trimmed, "trimmed")
    whole = F.col("copied") & (F.col("n_bytes") >= length)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    spans = F.when(whole, everything).otherwise(
        F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    kept = F.when(whole, F.unhex(F.sha2(F.lit(""), 256))).otherwise(F.coalesce("kept", "digest"))
    return (table.join(copied, "node", "left").join(trimmed, "node", "left")
            .select("doc_id", "n_bytes", spans.alias("spans"), F.lower(F.hex(kept)).alias("kept_sha256"))
            .select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                    "spans", "kept_sha256"))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the given byte ranges (sorted, disjoint)."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])
