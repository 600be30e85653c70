"""Token-id output: length-delimited binary records with masked checksums and an offset index.

A record is ``length (u64) | masked CRC-32 of the length (u32) | payload |
masked CRC-32 of the payload (u32)``, all little-endian; the mask rotates the
checksum by 15 bits and adds a constant, so that a checksum stored inside
checksummed data stays useful. The payload is ``has_id (u8) | doc_id (i64) |
id width in bytes (u8) | ids``. Beside each data file stands an index file
with, per record, its byte offset and the ids before it (u64 each): readers
take any record range of any file, so shuffled reads need no scan.

Files are named by attempt; the manifest of finished files is written by
Spark's committer, so files of failed or repeated attempts are never read.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopflow.llm.bytewords import text_slices
from shopflow.llm.word_cache import WordCache, laid_out
from shopflow.llm.staging import file_system, scratch_path, stage

SPACE_BYTE = "\u0120"  # how byte-level vocabularies write the space
_MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
_META = struct.Struct("<BqB")
_ENTRY = struct.Struct("<QQ")
RECORDS_PER_READ = 1024
CACHED_WORDS = 800_000  # about 160 MB in a worker
SLICE_BYTES = 8 << 20  # of text encoded at once
READ_BYTES = 16 << 20  # of records per reading task
FILE_BYTES = 256 << 20  # of records in a file
RANGE_BYTES = 256 << 20  # of texts in a writing task
MANIFEST = "file string, index_file string, part int, seq int, n_records bigint, n_ids bigint, n_bytes bigint"
_MANIFEST = pa.schema([("file", pa.string()), ("index_file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()),
                       ("n_records", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _TAIL.pack(masked_crc(length)), payload, _TAIL.pack(masked_crc(payload))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """(payload, next offset) of the record at ``at``; raises when a checksum fails."""
    length, check = _HEAD.unpack_from(data, at)
    if masked_crc(data[at:at + 8]) != check:
        raise ValueError(f"record length at {at} fails its checksum")
    begin = at + _HEAD.size
    payload = data[begin:begin + length]
    if len(payload) != length or masked_crc(payload) != _TAIL.unpack_from(data, begin + length)[0]:
        raise ValueError(f"record at {at} fails its checksum")
    return payload, begin + length + _TAIL.size


def pack(doc_id: int | None, width: int, body: bytes) -> bytes:
    return frame(_META.pack(doc_id is not None, doc_id or 0, width) + body)


def unpack(data: bytes, at: int) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of the record at ``at``."""
    payload, _ = unframe(data, at)
    has_id, doc_id, width = _META.unpack_from(payload)
    return (doc_id if has_id else None), np.frombuffer(payload, f"<u{width}", offset=_META.size).astype("<u4")


class Encoder:
    """A byte-level tokenizers file applied word by word, equal to encoding whole texts.

    Its pre-tokenizer never joins across a space that follows a non-space or
    ends a run of white space. So texts are cut at such spaces and each
    distinct word is encoded once, many words in one call; a word's ids begin
    at the one that holds its space. Texts with a space inside a
    run of white space, or with an added token, are encoded whole.
    """

    # first bytes of white space other than space and line feed, in UTF-8
    _OTHER_WHITE = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3])
    _INSIDE_RUN = re.compile(r"\s (?=\s|\Z)| (?=\s)")
    WORDS_PER_CALL = 1000

    def __init__(self, path: str, width: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.width = width or (2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4)
        self.kind = f"<u{self.width}"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens_word = np.zeros(max(vocab.values()) + 1, bool)
        self.opens_word[[k for token, k in vocab.items() if token.startswith(SPACE_BYTE)]] = True
        self.tokenizer.model._resize_cache(0)  # words are kept here, whole
        self.cache = WordCache(self._encode_words, CACHED_WORDS)
        # after letters a mark is a unit of its own, without a space before it
        self.cache.closing = {m: ids.astype(self.kind).tobytes() for m, ids in zip(".,;:!?", self._ids(list(".,;:!?")))}

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Each word with a space before it."""
        step = self.WORDS_PER_CALL
        groups = [words[lo:lo + step] for lo in range(0, len(words), step)]
        out: list[bytes] = []
        for group, e in zip(groups, self._ids([" " + " ".join(g) for g in groups])):
            begins = (np.flatnonzero(self.opens_word[e]) * self.width).tolist()
            if len(begins) != len(group):
                raise ValueError("words and space marks do not agree")
            body = e.astype(self.kind).tobytes()
            out += [body[a:b] for a, b in zip(begins, [*begins[1:], len(body)])]
        return out

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64)
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _uneven(self, texts: pa.Array) -> np.ndarray:
        """Whether spaces stand beside other white space, or an added token occurs."""
        found = np.zeros(len(texts), bool)
        ends = np.array(pc.binary_length(texts)).cumsum()
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        data = data[self._begin(texts):][:ends[-1] if len(ends) else 0]
        # a space with a space or line feed behind it, or at the end; across texts this finds too many, never too few
        space = data == 0x20
        pairs = np.flatnonzero(space[:-1] & (space[1:] | (data[1:] == 0x0A)))
        last = np.flatnonzero(space[ends[ends > 0] - 1])
        found[np.searchsorted(ends, pairs, "right")] = True
        found[np.flatnonzero(ends > 0)[last]] = True
        near = np.unique(np.searchsorted(ends, np.flatnonzero(self._OTHER_WHITE[data]), "right"))
        for k in near[~found[near]]:
            found[k] = bool(self._INSIDE_RUN.search(texts[int(k)].as_py()))
        raw = data.tobytes()
        for token in self.added:
            if token.encode() in raw:
                found |= np.array(pc.match_substring(texts, token))
        return found

    @staticmethod
    def _begin(texts: pa.Array) -> int:
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        return int(np.frombuffer(texts.buffers()[1], kind)[texts.offset]) if len(texts) else 0

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The id bytes of each text (strings without nulls)."""
        uneven = self._uneven(texts)
        whole = texts.filter(pa.array(uneven)).to_pylist()
        bodies = [ids.astype(self.kind).tobytes() for ids in self._ids(whole)]
        split = pc.split_pattern(texts.filter(pa.array(~uneven)) if uneven.any() else texts, " ")
        offsets = np.array(split.offsets)
        words = split.flatten()
        firsts = self._ids(words.take(pa.array(offsets[:-1])).to_pylist())
        coded = words.dictionary_encode()
        parts = self.cache.encode(coded.dictionary.to_pylist()) + [f.astype(self.kind).tobytes() for f in firsts]
        codes = np.array(coded.indices)
        codes[offsets[:-1]] = len(parts) - len(firsts) + np.arange(len(firsts))
        even = laid_out(parts, codes, offsets, self.kind)
        out, whole_at, even_at = [], iter(bodies), iter(even)
        for odd in uneven.tolist():
            out.append(next(whole_at) if odd else next(even_at))
        return out


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


class _Files:
    """The data and index files that one task writes, a new pair every ``file_bytes``."""

    def __init__(self, folder: str, file_bytes: int):
        self.folder = folder
        self.file_bytes = file_bytes
        self.part = TaskContext.get().partitionId()
        self.seq = 0
        self.out = None

    def _open(self) -> None:
        fs, base = file_system(self.folder)
        fs.create_dir(base, recursive=True)
        self.name = f"part-{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(f"{base}/{self.name}.rec")
        self.index = fs.open_output_stream(f"{base}/{self.name}.idx")
        self.at = self.ids = self.records = 0

    def add(self, record: bytes, n_ids: int) -> None:
        if self.out is None:
            self._open()
        self.index.write(_ENTRY.pack(self.at, self.ids))
        self.out.write(record)
        self.at += len(record)
        self.ids += n_ids
        self.records += 1

    @property
    def full(self) -> bool:
        return self.out is not None and self.at >= self.file_bytes

    def close(self) -> Iterator[pa.RecordBatch]:
        """The manifest row of the open file, when one is open."""
        if self.out is None:
            return
        self.out.close()
        self.index.close()
        row = {"file": f"{self.folder}/{self.name}.rec", "index_file": f"{self.folder}/{self.name}.idx",
               "part": self.part, "seq": self.seq, "n_records": self.records, "n_ids": self.ids, "n_bytes": self.at}
        self.out = None
        self.seq += 1
        yield pa.RecordBatch.from_pylist([row], _MANIFEST)


def _ordered(rows: DataFrame) -> DataFrame:
    """``rows`` in ascending (doc_id, text) over their partitions.

    Rows of one id are told apart by how their text begins, so an id of very many rows is
    several ranges. There are as many ranges as shuffles have partitions, more where their texts
    would have over ``RANGE_BYTES`` each.
    """
    by = ["doc_id", F.substring("text", 1, 64)]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = -(-size // RANGE_BYTES)
    if ranges > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        ranged = rows.repartitionByRange(ranges, *by)
    else:
        ranged = rows.repartitionByRange(*by)
    return ranged.sortWithinPartitions("doc_id", "text")


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None,
                  file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every text, append ``end_id``, write records in ascending doc_id order.

    Returns the manifest: one row per finished file, in MANIFEST's columns; the
    files follow each other by ``part`` and ``seq``. A task starts a new file when
    one has ``file_bytes``, and writes its index as it goes.
    Null texts are empty (their record holds the end id alone). Null doc_ids
    come first; repeated doc_ids are all written, ordered by text. Of an empty
    table nothing is written.
    """
    folder = folder or scratch_path(docs.sparkSession, "token-records")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        end = np.array([end_id], f"<u{encode.width}").tobytes()
        files = _Files(folder, file_bytes)
        for batch in batches:
            for rows, _, _ in text_slices(batch, "text", SLICE_BYTES):
                texts = rows.column(1).fill_null("")
                for doc_id, body in zip(rows.column(0).to_pylist(), encode(texts)):
                    files.add(pack(doc_id, encode.width, body + end), len(body) // encode.width + 1)
                    if files.full:
                        yield from files.close()
        yield from files.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(_ordered(rows).mapInArrow(write, MANIFEST), "token-manifest")


def read_records(manifest: DataFrame, records_per_read: int = RECORDS_PER_READ) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all records, from the files.

    ``start`` counts the ids of all records before; ``ids`` are little-endian
    unsigned 32-bit integers. The work is dealt out by record ranges, which
    may be read in any order.
    """
    in_order = Window.orderBy("part", "seq")  # a row per file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(
        in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranges = files.select("file", "index_file", "base", "n_records", F.explode(
        F.sequence(F.lit(0), F.col("n_records") - 1, F.lit(records_per_read).cast("long"))).alias("lo"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                            ("ids", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = file_system(r["index_file"])
                n = min(records_per_read, r["n_records"] - r["lo"])
                with fs.open_input_file(path) as f:
                    f.seek(16 * r["lo"])
                    index = np.frombuffer(f.read(16 * (n + 1)), "<u8").reshape(-1, 2)
                fs, path = file_system(r["file"])
                with fs.open_input_file(path) as f:
                    begin = int(index[0, 0])
                    f.seek(begin)
                    data = f.read(int(index[n, 0]) - begin) if len(index) > n else f.read()
                out = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                held = 0
                for offset, before in index[:n].tolist():
                    doc_id, ids = unpack(data, offset - begin)
                    out["doc_id"].append(doc_id)
                    out["start"].append(r["base"] + before)
                    out["n_tokens"].append(len(ids))
                    out["ids"].append(ids.tobytes())
                    held += ids.nbytes
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pydict(out, schema)
                        out, held = {k: [] for k in out}, 0
                yield pa.RecordBatch.from_pydict(out, schema)

    total = manifest.agg(F.sum("n_bytes")).first()[0] or 0
    spread = ranges.repartition(1 + total // READ_BYTES, F.xxhash64("file", "lo"))
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
