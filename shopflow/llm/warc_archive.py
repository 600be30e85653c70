"""WARC archives: writing with revisit records, reading with boundary-chain verification.

Writing: of records with equal payloads of at least ``least_revisit`` bytes,
the one with the smallest page_id is stored as a response, the others as
revisits that refer to it. Files are named by attempt and listed in a manifest
that Spark's committer writes, so files of failed attempts are never read.

Reading: a payload may itself contain the magic of a record. Tasks over byte
ranges emit every candidate record start with the end of its record; within a
range they follow these links to where the chain leaves the range. Pointer
jumping over the ranges from the start of the file then keeps only the range
entries that are reachable, and records are parsed from those.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.staging import file_system, scratch_path, stage

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
RANGE_BYTES = 4 << 20
FILE_BYTES = 256 << 20
TASK_BYTES = 16 << 20  # of archives per reading task
AHEAD_BYTES = 1 << 20  # read beyond a range at once, for headers that cross its end
DATE = "1970-01-01T00:00:00Z"  # the pages carry no capture time
_LENGTH = re.compile(rb"\r\nContent-Length: *([0-9]+)(?=\r\n)", re.IGNORECASE)
_HEAD_END = re.compile(rb"\r\n(?=\r\n)")  # overlapping: three line breaks hold two header ends
MANIFEST = "file string, n_records bigint, n_bytes bigint"
_MANIFEST = pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
RECORDS = ("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
           "payload_digest string, payload binary")
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                      ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("payload", pa.binary())])


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def _header_value(text: str) -> str:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", text)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                  revisit: bool) -> bytes:
    """One record: a response holds the payload, a revisit only its HTTP header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        lines.append(f"WARC-Page-Id: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(lines).encode() + END + block + END


def decode_record(record: bytes) -> dict:
    """The row of one whole record (without the closing line breaks)."""
    head, _, block = record.partition(END)
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    page_id, refers_to = fields.get(b"WARC-Page-Id"), fields.get(b"WARC-Refers-To-Page-Id")
    http, _, payload = block.partition(END)
    revisit = fields[b"WARC-Type"] == b"revisit"
    said = fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
    digest = said if revisit else hashlib.sha256(payload).hexdigest()
    if digest != said:
        raise ValueError(f"payload of page {page_id!r} fails its digest")
    url = fields.get(b"WARC-Target-URI")
    return {"page_id": None if page_id is None else int(page_id), "url": None if url is None else url.decode(),
            "record_type": "revisit" if revisit else "response",
            "refers_to": None if refers_to is None else int(refers_to),
            "payload_bytes": int(_LENGTH.search(http + b"\r\n")[1]) if revisit else len(payload),
            "payload_digest": digest, "payload": None if revisit else payload}


def write_archives(pages: DataFrame, folder: str | None = None, least_revisit: int = 100,
                   broadcast_rows: int = 250_000) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the manifest of finished files.

    Null html is an empty payload. Null page_ids never lead a group that has
    another id; in a group without ids all are responses. Repeated rows with
    the group's smallest page_id are all responses. Of an empty table nothing
    is written. The groups with several rows are broadcast when there are at
    most ``broadcast_rows`` of them, else joined by digest.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    large = rows.where(F.octet_length("html") >= least_revisit)
    groups = stage(large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
                   .where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"), "warc-groups")
    small = groups.count() <= broadcast_rows
    joined = rows.join(F.broadcast(groups) if small else groups, "digest", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        done, out, name, n, at = [], None, "", 0, 0
        for batch in batches:
            for page_id, url, html, digest, first_id in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name, n, at = f"pages-{uuid.uuid4().hex}.warc", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}")
                record = encode_record(page_id, url, html.encode(), digest, first_id,
                                       first_id is not None and page_id != first_id)
                out.write(record)
                n, at = n + 1, at + len(record)
                if at >= FILE_BYTES:
                    out.close()
                    done.append({"file": f"{folder}/{name}", "n_records": n, "n_bytes": at})
                    out = None
        if out is not None:
            out.close()
            done.append({"file": f"{folder}/{name}", "n_records": n, "n_bytes": at})
        if done:
            yield pa.RecordBatch.from_pylist(done, _MANIFEST)

    columns = joined.select("page_id", "url", "html", "digest", "first_id")
    return stage(columns.mapInArrow(write, MANIFEST), "warc-manifest")


def record_end(data: bytes, at: int) -> int | None:
    """Offset behind the record that would begin at ``at``; None if its header is not whole or has no length in int64."""
    head = data.find(END, at)
    length = _LENGTH.search(data, at, head + 2) if head >= 0 else None
    digits = length[1].lstrip(b"0") if length else b""
    return head + len(END) + int(digits or b"0") + len(END) if length and len(digits) <= 18 else None


def candidates(data: bytes, size: int) -> tuple[list[tuple[int, int]], bool]:
    """(offset, end) of everything that looks like a record starting in the first ``size`` bytes.

    The second result tells whether a header runs over the end of ``data``.
    Header ends and lengths are found once and walked beside the magics, so
    a payload full of magics takes time linear in its length.
    """
    heads = [m.start() for m in _HEAD_END.finditer(data)]
    lengths = [(m.start(), m.end(), m[1].lstrip(b"0")) for m in _LENGTH.finditer(data)]
    out, h, k, at = [], 0, 0, data.find(MAGIC)
    while 0 <= at < size:
        while h < len(heads) and heads[h] < at:
            h += 1
        if h == len(heads):
            return out, True
        while k < len(lengths) and lengths[k][0] < at:
            k += 1
        if k < len(lengths) and lengths[k][1] <= heads[h] and len(lengths[k][2]) <= 18:
            out.append((at, heads[h] + len(END) + int(lengths[k][2] or b"0") + len(END)))
        at = data.find(MAGIC, at + 1)
    return out, False


def _ranges(manifest: DataFrame, range_bytes: int) -> DataFrame:
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(range_bytes).cast("long"))
    ranges = manifest.select("file", "n_bytes", F.explode(starts).alias("lo"))
    return ranges.repartition(_tasks(manifest), F.xxhash64("file", "lo"))


def _tasks(manifest: DataFrame) -> int:
    """Reading tasks for all files together."""
    return 1 + (manifest.agg(F.sum("n_bytes")).first()[0] or 0) // TASK_BYTES


def range_entries(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, n_bytes, offset``: of each byte range in which a record begins, the first true record.

    Raises when a file's chain of records does not end with the file.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = file_system(r["file"])
                with fs.open_input_file(path) as f:
                    f.seek(r["lo"])
                    data = f.read(range_bytes + AHEAD_BYTES)
                    found, cut = candidates(data, range_bytes)
                    while cut and (more := f.read(max(AHEAD_BYTES, len(data)))):
                        data += more
                        found, cut = candidates(data, range_bytes)
                leaves: dict[int, int] = {}
                found = [(at, end) for at, end in found if r["lo"] + end <= r["n_bytes"]]  # no record runs over its file
                for at, end in reversed(found):
                    if end >= range_bytes or end in leaves or r["lo"] + end >= r["n_bytes"]:
                        leaves[at] = leaves.get(end, r["lo"] + end)
                yield pa.RecordBatch.from_pydict(
                    {"file": [r["file"]] * len(leaves), "n_bytes": [r["n_bytes"]] * len(leaves),
                     "offset": [r["lo"] + a for a in leaves], "leaves": list(leaves.values())},
                    pa.schema([("file", pa.string()), ("n_bytes", pa.int64()), ("offset", pa.int64()),
                               ("leaves", pa.int64())]))

    links = stage(_ranges(manifest, range_bytes).mapInArrow(
        link, "file string, n_bytes bigint, offset bigint, leaves bigint"), "warc-links")
    most = manifest.agg(F.max("n_bytes")).first()[0] or 0
    reached = links.where("offset = 0").select("file", "n_bytes", "offset")
    jumps = links.select("file", "offset", "leaves")
    hops = 1
    while hops * range_bytes < most:
        ahead = (reached.join(jumps, ["file", "offset"]).where("leaves < n_bytes")
                 .select("file", "n_bytes", F.col("leaves").alias("offset")))
        reached = stage(reached.union(ahead), "warc-reached")
        second = jumps.select("file", F.col("offset").alias("leaves"), F.col("leaves").alias("further"))
        jumps = stage(jumps.join(second, ["file", "leaves"]).select(
            "file", "offset", F.col("further").alias("leaves")), "warc-jumps")
        hops *= 2
    ended = reached.join(links.where("leaves = n_bytes").select("file", "offset"), ["file", "offset"])
    broken = manifest.where("n_bytes > 0").join(ended, "file", "left_anti").select("file").take(1)
    if broken:
        raise ValueError(f"{broken[0].file}: the records do not end with the file")
    return reached


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of all files, in RECORDS' columns; payloads inside payloads are not taken for records.

    Raises where a chain of records does not end with its file.
    """
    entries = range_entries(manifest, range_bytes).repartition(_tasks(manifest), F.xxhash64("file", "offset"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = file_system(r["file"])
                stop = min((r["offset"] // range_bytes + 1) * range_bytes, r["n_bytes"])
                out, held = [], 0
                with fs.open_input_file(path) as f:
                    f.seek(r["offset"])
                    data, at, base = f.read(stop - r["offset"]), 0, r["offset"]
                    while base + at < stop:
                        end = record_end(data, at)
                        if end is None or end > len(data):
                            more = f.read(max(AHEAD_BYTES, (end or 0) - len(data)))
                            if not more:
                                raise ValueError(f"{r['file']}: the record at {base + at} is not whole")
                            data += more
                            continue
                        if not data.startswith(MAGIC, at):
                            raise ValueError(f"{r['file']}: no record at {base + at}")
                        out.append(decode_record(data[at:end - len(END)]))
                        held += end - at
                        at = end
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_pylist(out, _RECORDS)
                            out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, _RECORDS)

    return entries.mapInArrow(read, RECORDS)
