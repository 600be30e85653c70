import hashlib
import random
import time

import pytest

from shopflow.llm import warc_archive as W

INNER = W.encode_record(99, "http://x", b"<p>inner</p>", "0" * 64, None, False).decode()
BIG = "z" * 150
ROWS = ([(1, "http://a\r\nb", "x" * 99), (2, None, "x" * 99), (3, "u", BIG), (4, "u", BIG), (None, "u", BIG),
         (5, "u", INNER + BIG + INNER), (6, "u", None), (7, "u", INNER * 40), (8, "u", "é" * 60), (9, "u", ""),
         (3, "u", BIG), (10, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc"), (11, "u", "WARC/1.1\r\n")]
        + [(100 + i, "u", INNER * (i % 5) + "q" * i) for i in range(60)])


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)


@pytest.mark.parametrize("range_bytes", [200, 1000, 4096, 4 << 20])
@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_magic_inside_payloads_is_no_record(pages, range_bytes, broadcast_rows):
    manifest = W.write_archives(pages, broadcast_rows=broadcast_rows)
    rows = W.read_archives(manifest, range_bytes).collect()
    want = sorted((i or 0, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest())
                  for i, _, h in ROWS)
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest) for r in rows) == want
    assert sorted((r.page_id or 0, r.refers_to) for r in rows if r.record_type == "revisit") == [(0, 3), (4, 3)]
    html = {i: (h or "").encode() for i, _, h in ROWS}
    assert all(bytes(r.payload) == html[r.page_id] for r in rows if r.record_type == "response" and r.page_id)


def test_without_verification_false_records_would_appear(pages):
    manifest = W.write_archives(pages.where("page_id = 7"))
    data = open(manifest.first().file.removeprefix("file:"), "rb").read()
    assert len(W.candidates(data, len(data))[0]) > 1
    assert W.read_archives(manifest, 300).count() == 1


def test_candidates_equal_a_search_from_each_magic():
    rng = random.Random(5)
    parts = [W.MAGIC, W.END, b"\r\n", b"\r\nContent-Length: 12", b"\r\ncontent-length:0007", b"x", b"9" * 20, b"\r"]
    for _ in range(3000):
        data = b"".join(rng.choices(parts, k=rng.randrange(14)))
        size = rng.randrange(len(data) + 2)
        at = [k for k in range(min(size, len(data))) if data.startswith(W.MAGIC, k)]
        want = [(k, W.record_end(data, k)) for k in at if W.record_end(data, k) is not None]
        assert W.candidates(data, size) == (want, any(data.find(W.END, k) < 0 for k in at))


def test_a_payload_full_of_magics_takes_linear_time(spark):
    data = W.MAGIC * (4_000_000 // len(W.MAGIC))
    started = time.perf_counter()
    assert W.candidates(data + W.END, len(data))[0] == []
    assert len(W.candidates(data + b"W: 1\r\nContent-Length: 5" + W.END, len(data))[0]) == len(data) // len(W.MAGIC)
    assert time.perf_counter() - started < 5
    html = data.decode() + "W: 1\r\nContent-Length: 5\r\n\r\n"
    pages = spark.createDataFrame([(1, "u", html), (2, "u", "b")], "page_id long, url string, html string")
    got = W.read_archives(W.write_archives(pages), 1 << 20).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(1, len(html)), (2, 1)]


@pytest.mark.parametrize("range_bytes", [100, 4 << 20])
def test_lengths_beyond_the_file_in_payloads(spark, range_bytes):
    lengths = ["9" * 20, "9" * 18, "9" * 5000, str(2**63 - 1), str(2**63), "0" * 30 + "5", "70000"]
    rows = [(k, "u", f"a WARC/1.1\r\nContent-Length: {n}\r\n\r\nb" + "c" * 50) for k, n in enumerate(lengths)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = W.read_archives(W.write_archives(pages), range_bytes).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == [(k, h) for k, _, h in rows]


def test_a_cut_file_is_found(spark, pages, tmp_path):
    row = W.write_archives(pages.coalesce(1)).first()
    data = open(row.file.removeprefix("file:"), "rb").read()
    short = tmp_path / "short.warc"
    short.write_bytes(data[:-20])
    cut = spark.createDataFrame([(str(short), row.n_records, row.n_bytes - 20)], W.MANIFEST)
    with pytest.raises(Exception, match="do not end"):
        W.read_archives(cut).collect()


def test_long_addresses(spark):
    """A header longer than what is read ahead."""
    url = "http://x/" + "u" * (3 << 20)
    rows = [(k, url, f"page {k}") for k in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = W.read_archives(W.write_archives(pages), 1 << 16).collect()
    assert sorted((r.page_id, len(r.url), bytes(r.payload).decode()) for r in got) == [(k, len(url), h) for k, _, h in rows]


def test_empty_table(pages):
    assert W.read_archives(W.write_archives(pages.where("page_id > 9999"))).count() == 0
