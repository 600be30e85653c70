import numpy as np
import pytest
from pyspark.sql import functions as F

from shopflow.llm import language_cnn as L
from shopflow.llm.sampling import not_held_out


@pytest.fixture(scope="module")
def net(spark, sf001):
    return L.fit(spark.read.parquet(f"{sf001}/documents.parquet"), not_held_out(), documents=800)


def test_held_out_accuracy(spark, sf001, net):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    got = L.predict(docs, net).join(docs, "doc_id").where(~not_held_out()).toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_tables_equal_the_network(net):
    """Scoring by byte-pair tables gives what the embedding and the filters give."""
    x = np.random.default_rng(3).integers(0, 256, (5, L.WINDOW)).astype(np.uint8)
    e, pooled = net.embedding[x], []
    for width, f in net.filters.items():
        wide = np.concatenate([e[:, k:L.WINDOW - width + 1 + k] for k in range(width)], axis=2)
        pooled.append((wide @ f).max(axis=1))
    want = L._log_softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ net.weights + net.bias)
    assert np.allclose(net.tables().log_probabilities(x), want, atol=1e-3)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 256, (4, L.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])
    net = L.train(x, y, ["a", "b"], batch=4, rate=0.0, least_steps=1)

    def loss():
        return -net_log(net, x)[np.arange(4), y].mean()

    def net_log(n, x):
        pooled = []
        for width, f in n.filters.items():
            wide = np.concatenate([n.embedding[x][:, k:L.WINDOW - width + 1 + k] for k in range(width)], axis=2)
            pooled.append((wide @ f).max(axis=1))
        return L._log_softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ n.weights + n.bias)

    grads = L._gradients(net, x, y, np.ones(4))
    for p, g in zip([net.embedding, *net.filters.values(), net.weights, net.bias], grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 1e-6
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=1e-3, abs=1e-6)


def test_windows_cover_whole_texts():
    texts = [b"", b"a" * 256, b"b" * 257, b"c"]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    windows, row, held = L.windows_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert row.tolist() == [1, 2, 2, 3] and held.tolist() == [256, 256, 1, 1]
    assert b"".join(w[:h].tobytes() for w, h in zip(windows, held)) == b"".join(texts)


def test_odd_rows(odd_docs, no_docs, net):
    got = {(r.doc_id, r.lang_pred) for r in L.predict(odd_docs, net).collect() if r.doc_id in (4, 5, 6, 11)}
    assert got == {(4, "und"), (5, "und"), (6, "und"), (11, "und")}
    kept = L.keep_identified(odd_docs, net)
    assert kept.columns == odd_docs.columns
    assert not {4, 5, 6, 11} & {r.doc_id for r in kept.collect()}
    assert kept.where("doc_id IN (1, 2, 3)").count() == 4
    assert L.predict(no_docs, net).count() == 0
    nothing = L.fit(odd_docs, F.lit(False))
    assert nothing is None
    assert {r.lang_pred for r in L.predict(odd_docs, nothing).collect()} == {"und"}


def test_unsure_texts_stay(odd_docs):
    """With many labels the best one of a clean text scores little; without a model nothing can be scored."""
    rng = np.random.default_rng(1)
    labels = [f"l{k:02}" for k in range(40)]
    unsure = L.train(rng.integers(0, 256, (40, L.WINDOW)).astype(np.uint8), np.arange(40), labels, rate=0.0)
    unsure.weights[:] = 0
    lettered = odd_docs.where("doc_id IS NULL OR doc_id NOT IN (4, 5, 6, 11)")
    for net in (unsure, None):
        kept = L.keep_identified(odd_docs, net)
        assert kept.columns == odd_docs.columns
        assert sorted(map(str, kept.collect())) == sorted(map(str, lettered.collect()))
