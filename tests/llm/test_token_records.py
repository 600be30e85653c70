import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopflow.llm import token_records as T

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(VOCABULARY)


def library(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "  ", "\n", "\t", " ", "　", "a", "The", "don't", "été", "日本", "😀", "!!",
                                          ".", "12", "<|endoftext|>", "\x1c", ""]), max_size=12).map("".join), max_size=6))
def test_word_wise_encoding_equals_whole_texts(encoder, texts):
    got = [np.frombuffer(b, "<u2").tolist() for b in encoder(pa.array(texts, pa.string()))]
    assert got == [library(encoder, t) for t in texts]


def check(rows, docs, encoder):
    start = 0
    for row, (doc_id, text) in zip(rows, docs):
        ids = library(encoder, text or "") + [0]
        want = np.array(ids, "<u4").tobytes()
        assert (row.doc_id, row.start, row.n_tokens, bytes(row.ids)) == (doc_id, start, len(ids), want)
        start += len(ids)
    assert len(rows) == len(docs)


def test_round_trip_in_id_order(documents, encoder):
    docs = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    rows = T.read_records(T.write_records(documents, VOCABULARY), records_per_read=7).collect()
    check(sorted(rows, key=lambda r: r.start), docs, encoder)


def test_odd_rows(odd_docs, no_docs, encoder):
    docs = sorted(((r.doc_id, r.text) for r in odd_docs.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    rows = T.read_records(T.write_records(odd_docs, VOCABULARY)).collect()
    check(sorted(rows, key=lambda r: r.start), docs, encoder)
    assert T.read_records(T.write_records(no_docs, VOCABULARY)).count() == 0


def test_rolled_files_and_ids_of_many_rows(spark, encoder, monkeypatch):
    """Small files and ranges; one id and null hold most rows, over several tasks."""
    monkeypatch.setattr(T, "RANGE_BYTES", 2000)
    rows = [(7 if k % 3 else None, f"{(k * 37) % 101} word {k}" + " more" * (k % 9)) for k in range(900)] + [(7, None), (8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = T.write_records(docs, VOCABULARY, file_bytes=1500)
    files = manifest.collect()
    assert sum(r.n_records for r in files) == len(rows)
    assert max(r.seq for r in files) > 0 and len({r.part for r in files}) > 3
    assert all(r.n_bytes < 1500 + 500 for r in files)
    assert all(os.path.getsize(r.index_file.removeprefix("file:")) == 16 * r.n_records for r in files)
    got = T.read_records(manifest, records_per_read=7).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    check(sorted(got, key=lambda r: r.start), want, encoder)


def test_damage_is_found(spark, documents):
    manifest = T.write_records(documents, VOCABULARY)
    path = manifest.first().file.removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    payload, after = T.unframe(bytes(data), 0)
    assert T.frame(payload) == bytes(data[:after])
    data[20] ^= 1
    with pytest.raises(ValueError):
        T.unframe(bytes(data), 0)
    data[20] ^= 1
    data[3] ^= 1
    with pytest.raises(ValueError):
        T.unframe(bytes(data), 0)
    assert os.path.getsize(path) == manifest.first().n_bytes


def test_masked_checksum_differs_from_the_plain_one():
    assert T.masked_crc(b"abc") != zlib.crc32(b"abc")
