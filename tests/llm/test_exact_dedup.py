import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shopflow.llm import exact_dedup as X
from shopflow.llm.staging import scratch_path


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("broadcast_rows", [0, 250_000])
def test_groups_equal_brute_force(documents, monkeypatch, broadcast_rows):
    monkeypatch.setattr(X, "BROADCAST_ROWS", broadcast_rows)
    groups = defaultdict(list)
    for r in documents.collect():
        groups[norm(r.text)].append(r.doc_id)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in X.exact_duplicates(documents).collect()}
    assert got == {i: (min(g), len(g), i == min(g)) for g in groups.values() for i in g}


def test_odd_rows(odd_docs):
    rows = X.exact_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert [(r.keep_id, r.group_size, r.kept) for r in by_id[1]] == [(1, 4, True)]
    assert sorted((r.keep_id, r.kept) for r in by_id[2] + by_id[3]) == [(1, False)] * 3
    assert [(r.keep_id, r.group_size) for r in by_id[4] + by_id[5]] == [(4, 2), (4, 2)]
    assert by_id[6][0].kept  # blank texts are one space, not empty
    assert sorted(r.kept for r in by_id[None]) == [False, True]
    assert {r.keep_id for r in by_id[None]} == {None}


@pytest.mark.parametrize("broadcast_rows", [0, 250_000])
def test_dropping_keeps_columns_and_one_row_of_each(odd_docs, no_docs, monkeypatch, broadcast_rows):
    monkeypatch.setattr(X, "BROADCAST_ROWS", broadcast_rows)
    left = X.drop_exact_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    ids = sorted(r.doc_id or 0 for r in left.collect())
    assert ids == [0, 1, 4, 6, 7, 8, 9, 10, 11]
    assert X.drop_exact_duplicates(no_docs).count() == 0
    assert X.exact_duplicates(no_docs).count() == 0


def test_rows_of_a_join(spark, odd_docs, documents):
    both = odd_docs.select("doc_id", "text").union(documents.select("doc_id", "text")).join(
        spark.range(5).withColumnRenamed("id", "doc_id"), "doc_id")
    assert X.exact_duplicates(both).count() == both.count()


def test_state_outlives_the_run(spark):
    """A second stream over the same state matches new arrivals against earlier ones."""
    folder, state = scratch_path(spark, "arrivals"), scratch_path(spark, "state")

    def arrive(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string").select(
            "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.lit("f").alias("locator"),
            F.monotonically_increasing_id().alias("seq"))
        df.write.mode("append").parquet(folder)
        return X.fold_into_state(spark, folder, df.schema, state)

    arrive([(5, "a"), (6, "b")])
    found = {(r["first"].doc_id, r.group_size) for r in arrive([(7, "a"), (2, "b")]).collect()}
    assert found == {(5, 2), (2, 2)}


def test_texts_that_share_a_digest_are_told_apart(spark):
    texts = spark.createDataFrame([(1, "a", b"d"), (2, "b", b"d"), (3, "b", b"d")],
                                  "doc_id long, norm string, digest binary")
    found = texts.select("doc_id", "digest", F.lit(0).cast("long").alias("seq"), F.lit(3).cast("long").alias("group_size"),
                         F.lit(1).cast("long").alias("keep_id"), F.lit(False).alias("kept"))
    rows = X._settle_by_text(found, texts, texts.select("digest").distinct()).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows) == [
        (1, 1, 1, True), (2, 2, 2, True), (3, 2, 2, False)]


def test_later_calls_over_one_state(spark):
    """Earlier calls' texts stay the kept ones, their bytes are read from the files; the same rows again are all copies."""
    state, folder = scratch_path(spark, "kept-state"), scratch_path(spark, "kept-docs")

    def call(name, rows):
        spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{folder}/{name}")
        found = X.exact_duplicates(spark.read.parquet(f"{folder}/{name}"), state)
        return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect())

    assert call("a", [(5, "x y"), (6, "z"), (7, "x  y")]) == [(5, 5, 2, True), (6, 6, 1, True), (7, 5, 2, False)]
    assert call("b", [(5, "x y"), (6, "z"), (7, "x  y")]) == [(5, 5, 4, False), (6, 6, 2, False), (7, 5, 4, False)]
    assert call("c", [(1, "z"), (2, "new"), (3, "new")]) == [(1, 6, 3, False), (2, 2, 2, True), (3, 2, 2, False)]


def test_no_python_in_later_calls(spark):
    state = scratch_path(spark, "plain-state")
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    X.exact_duplicates(docs, state).collect()
    plan = X.exact_duplicates(docs, state)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_columns_named_like_helpers(spark, odd_docs):
    """Columns called as the stages' own helpers keep their values."""
    from shopflow.llm import signature_join
    names = ["digest", "_digest", "gone_id", "_gone_id", "_gone_digest", "_node", "held_node", "_gone_node", "GONE_NODE"]
    docs = odd_docs
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    for left in (X.drop_exact_duplicates(docs), signature_join.keep_one_of_each(docs)):
        assert left.columns == docs.columns
        rows = left.collect()
        assert rows and all([r[n] for n in names] == list(range(len(names))) for r in rows)
