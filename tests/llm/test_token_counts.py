"""Counts of the transducer against the sentencepiece library."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopflow.llm import token_counts
from shopflow.llm.registry import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def machine():
    return token_counts.Transducer(PATH)


def counts(machine, texts):
    raw = [t.encode() for t in texts]
    return machine.count(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)).tolist()


ODD = ["", " ", "  a", "a ", "été über ñandú 日本語 😀 " * 50, "x" * 5000, "▁▁ a▁b", "\x00\x01", "a\n\nb\t\tc", " " * 3000,
       "<s></s><unk>", "aaaaaaaaab" * 300, "ererororinananan" * 200, "Thtionoues erreoror whed", "𝔘𝔫𝔦" * 30, "0" * 777]


def test_odd_texts(machine, library):
    assert counts(machine, ODD) == [len(x) for x in library.encode(ODD)]


def test_chunks_and_windows(machine, library, monkeypatch):
    """Chunks of three characters and windows of 50 bytes, so that maps must be run from many states and composed."""
    monkeypatch.setattr(token_counts, "CHUNK", 3)
    monkeypatch.setattr(token_counts, "WINDOW_BYTES", 50)
    assert counts(machine, ODD) == [len(x) for x in library.encode(ODD)]
    for text in ODD:
        assert counts(machine, [text]) == [len(library.encode(text))]


def test_tables_that_start_anew(library):
    small = token_counts.Transducer(PATH, most=500)
    small.bits = 18
    small.reset()
    for text in ODD:
        assert counts(small, [text]) == [len(library.encode(text))]
        small.reset()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aeinrstoh ▁\n.0"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_any_text(texts):
    import sentencepiece
    lib = _shared.setdefault("lib", sentencepiece.SentencePieceProcessor(model_file=PATH))
    machine = _shared.setdefault("machine", token_counts.Transducer(PATH))
    assert counts(machine, texts) == [len(lib.encode(t)) for t in texts]


_shared: dict = {}


def test_all_documents(spark, documents, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(documents, PATH).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert got == {r.doc_id: (len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in rows}


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs, library):
    got = sorted(map(tuple, token_counts.count_tokens(odd_docs, PATH).collect()), key=str)
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in odd_docs.collect()]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(no_docs, PATH).collect() == []
