import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopflow.llm import piece_codec as C

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return C.PieceModel(MODEL)


PARTS = [" ", "  ", "   ", "\n", "\t", "▁", "▁▁", "a", "the", "ing", "thering", "été", "日本", "😀", "\x00", "<s>", "<0x0A>",
         "1234", "x" * 70, "ab" * 40, "\xa0"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=10).map("".join), max_size=5))
def test_equals_the_library(model, texts):
    bodies = model.encode(pa.array(texts, pa.string()))
    want = [model.library.encode(t) for t in texts]
    assert [np.frombuffer(b, "<i4").tolist() for b in bodies] == want
    ids = np.frombuffer(b"".join(bodies), "<i4")
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in want])]).astype(np.int32)
    assert model.decode(ids, offsets) == [model.library.decode(w) for w in want]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdeinorst▁é", min_size=1, max_size=40))
def test_heap_and_matrix_agendas_agree(model, word):
    symbols = model.symbol_of_char[np.frombuffer(word.encode("utf-32-le"), np.uint32)]
    row = model._agenda_matrix(symbols[None].astype(np.int32))[0]
    assert row[row >= 0].tolist() == model._agenda_heap(symbols.tolist())


def test_a_difference_from_the_library_is_raised(model):
    other = C.PieceModel(MODEL)
    other.pair_keys = other.pair_keys - 1
    with pytest.raises(ValueError):
        other.encode(pa.array(["something thering"]))


def test_documents_and_odd_rows(documents, odd_docs, no_docs, model):
    for docs in (documents, odd_docs):
        want = sorted((r.doc_id or 0, tuple(model.library.encode(r.text or ""))) for r in docs.collect())
        rows = C.encode_decode(docs, MODEL).collect()
        assert sorted((r.doc_id or 0, tuple(r.ids)) for r in rows) == want
        assert all(r.decoded == model.library.decode(r.ids) for r in rows)
    assert C.encode_decode(no_docs, MODEL).count() == 0
