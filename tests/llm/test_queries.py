"""The registered queries and the pipeline on the smallest tables: DuckDB where SQL can say it, else brute force."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from shopflow.llm import language_cnn
from shopflow.llm.registry import QUERIES, SQL
from shopflow.llm.sampling import not_held_out
from tests.llm import test_decontaminate, test_exact_dedup, test_secret_scan, test_signature_join, test_suffix_dedup
from tests.parity import compare, duck

P = pytest.importorskip("public_tokenizers")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(documents):
    return sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())


def rows(spark, folder, name):
    return sorted(QUERIES[name](spark, folder).collect(), key=lambda r: r.doc_id)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf0001, name):
    r = compare(spark, name, sf0001, duck(sf0001))
    assert r.get("ok"), r.get("error")


def test_op1(spark, sf0001, texts):
    for r, (doc_id, text) in zip(rows(spark, sf0001, "op1_secret_scan"), texts):
        base = [":".join(map(str, f)) for f in test_secret_scan.base_spans(text or "")]
        assert r.doc_id == doc_id and r.base_sha256 == sha(",".join(base))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s and not s.startswith("lexed")] == base


def test_op2(spark, sf0001, texts):
    got = rows(spark, sf0001, "op2_quality_gam")
    assert [r.doc_id for r in got] == [i for i, _ in texts]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op3(spark, sf0001, texts):
    want = test_signature_join.brute(texts, 3, 9, 10)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, sf0001, "op3_signature_join")} == want


def test_op4(spark, sf0001, texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start = 0
    for r, (doc_id, text) in zip(rows(spark, sf0001, "op4_token_records"), texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_op5(spark, sf0001, texts):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r, (doc_id, text) in zip(rows(spark, sf0001, "op5_piece_codec"), texts):
        ids = library.encode(text or "")
        assert (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_op6(spark, sf0001, texts):
    got = rows(spark, sf0001, "op6_suffix_dedup")
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == \
        test_suffix_dedup.brute(texts, 400)


def test_op7(spark, sf0001, documents):
    langs = {r.doc_id: r.lang for r in documents.collect()}
    got = rows(spark, sf0001, "op7_language_cnn")
    assert [r.doc_id for r in got] == sorted(langs)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in langs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) > 0.9 * len(held)


def test_op13(spark, sf0001, texts):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r, (doc_id, text) in zip(rows(spark, sf0001, "op13_token_counts"), texts):
        n = len(library.encode(text or ""))
        assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (doc_id, len((text or "").encode()), n, n > 4096)


def test_pipeline(spark, sf0001, documents, texts):
    """The rows that each rule keeps, in the order of the stages, encoded as the library does."""
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    net = language_cnn.fit(documents, not_held_out())
    told = {r.doc_id for r in language_cnn.predict(documents, net).collect() if r.lang_pred != "und"}
    first = {}
    for i, t in texts:
        if i in told:
            first.setdefault(test_exact_dedup.norm(t), (i, t))
    left = sorted(first.values())
    roots = test_signature_join.brute(left, 5, 8, 10)
    left = [(i, t) for i, t in left if not roots[i][0] or roots[i][1] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf0001}/benchmark.parquet").collect()]
    leaks = test_decontaminate.brute(left, items)
    want = {i: library.encode(t) for i, t in left if not leaks[i][1]}
    got = {r.doc_id: (r.n_tokens, list(r.ids), r.decoded) for r in corpus_pipeline.run(spark, sf0001).collect()}
    assert got == {i: (len(ids), ids, library.decode(ids)) for i, ids in want.items()}
    assert 0 < len(got) < len(first) < len(texts)


def test_pipeline_stages_keep_the_columns(spark, sf0001, odd_docs, no_docs):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for docs in (odd_docs, no_docs):
        for _, step in corpus_pipeline.STAGES[:-1]:
            assert step(spark, docs, sf0001).columns == docs.columns
            assert step(spark, docs, sf0001).schema.simpleString() == docs.schema.simpleString()
    assert corpus_pipeline.STAGES[-1][1](spark, odd_docs, sf0001).count() == odd_docs.count()
