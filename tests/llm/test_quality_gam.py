import numpy as np
from pyspark.sql import functions as F

from shopflow.llm import quality_gam as Q
from shopflow.llm.sampling import bounded_sample, not_held_out


def test_held_out_accuracy(spark, sf001):
    docs, labels = (spark.read.parquet(f"{sf001}/{n}.parquet") for n in ("documents", "labels"))
    features = Q.text_features(docs)
    model = Q.fit(features, labels, not_held_out())
    scored = Q.score(features, model).join(labels, "doc_id").where(~not_held_out()).toPandas()
    assert scored.score.between(0, 1).all()
    assert ((scored.score >= 0.3) == (scored.quality == 1)).mean() > 0.95
    again = Q.fit(features.repartition(7), labels, not_held_out())
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables))


def test_tables_learn_single_and_paired_effects():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(Q.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.train(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.85
    alone = Q.train(x, (x[:, 3] > 0.3).astype(float), pair_rounds=0)
    assert ((alone.score(x) > 0.5) == (x[:, 3] > 0.3)).mean() > 0.98


def test_features_of_known_texts():
    texts = [b"", b"AB ab ab\nAB ab ab", "é!".encode()]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    rows = [dict(zip(Q.FEATURES, r)) for r in Q.features_of(np.frombuffer(b"".join(texts), np.uint8), offsets)]
    assert all(v == 0 for v in rows[0].values())
    assert rows[1]["distinct_words"] == 2 / 6 and rows[1]["commonest_word"] == 4 / 6
    assert rows[1]["distinct_lines"] == 1 / 2 and rows[1]["repeated_next"] == 2 / 6
    assert rows[1]["upper_words"] == 2 / 6
    assert rows[2]["exclamations"] == 1 / 3 and rows[2]["odd_word_ends"] == 1


def test_labels_are_the_only_teacher(spark, odd_docs, no_docs):
    """Other columns change nothing; odd rows get a score; without labels it is one half."""
    features = Q.text_features(odd_docs)
    assert Q.text_features(odd_docs.withColumn("lang", F.lit("zz"))).select("features").distinct().count() == \
        features.select("features").distinct().count()
    labels = spark.createDataFrame([(1, 1), (9, 0), (5, None)], "doc_id long, quality int")
    scored = Q.score(features, Q.fit(features, labels, F.lit(True))).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r.score <= 1 for r in scored)
    none = Q.fit(features, labels.where("quality > 5"), F.lit(True))
    assert {r.score for r in Q.score(features, none).collect()} == {0.5}
    empty = Q.text_features(no_docs)
    assert Q.score(empty, none).count() == 0


def test_samples_are_bounded_and_do_not_depend_on_order(spark):
    rows = spark.range(1000).withColumnRenamed("id", "doc_id")
    a = {r.doc_id for r in bounded_sample(rows, 100).collect()}
    b = {r.doc_id for r in bounded_sample(rows.repartition(13), 100).collect()}
    assert a == b and len(a) == 100
    assert bounded_sample(rows, 5000).count() == 1000
