"""Materialised tables: written once under the session's checkpoint folder,
reused by later readers, rewritten when the inputs change."""

import os
import shutil
import tempfile

import pytest

from shopflow.session import checkpoint_dir
from shopflow.sources import store


def test_checkpoint_dir_comes_from_the_session(spark):
    conf_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert checkpoint_dir(spark).startswith("file:" + conf_dir) or checkpoint_dir(spark).startswith(conf_dir)


def test_written_once_then_read(spark):
    calls = []

    def factory():
        calls.append(1)
        return spark.range(5).withColumnRenamed("id", "created_at")

    sig = "test-" + os.urandom(4).hex()
    a = store.materialize(spark, factory, "probe", sig)
    b = store.materialize(spark, factory, "probe", sig)
    assert len(calls) == 1
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect()) == [0, 1, 2, 3, 4]
    assert store.current(spark, store.table_path(spark, "probe", sig)) is not None


def test_signature_follows_the_inputs(spark, sf0001):
    src = tempfile.mkdtemp(prefix="shopflow-sig-")
    shutil.copyfile(f"{sf0001}/part.parquet", f"{src}/part.parquet")
    before = store.input_signature(spark, [f"{src}/part.parquet"])
    assert before == store.input_signature(spark, [f"{src}/part.parquet"])
    shutil.copyfile(f"{sf0001}/region.parquet", f"{src}/part.parquet")     # different content, same name
    assert store.input_signature(spark, [f"{src}/part.parquet"]) != before


def test_clustered_write_is_sorted_within_files(spark):
    sig = "test-" + os.urandom(4).hex()
    df = store.materialize(spark, lambda: spark.range(1000).selectExpr("(id * 7919) % 1000 AS created_at"),
                           "probe_sorted", sig, cluster_by="created_at")
    from pyspark.sql import functions as F
    per_file = (df.withColumn("f", F.input_file_name())
                .groupBy("f").agg(F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))
                .orderBy("lo").collect())
    # range partitioned: the files hold disjoint ranges of the clustering column
    assert all(a["hi"] < b["lo"] for a, b in zip(per_file, per_file[1:]))


def test_an_interrupted_write_is_built_again(spark):
    """Part files without a pointer, whole or not, are never read."""
    sig = "test-" + os.urandom(4).hex()
    path = store.table_path(spark, "probe_cut", sig)
    spark.range(3).write.parquet(f"{path}/attempt-000000000000")
    got = store.materialize(spark, lambda: spark.range(7), "probe_cut", sig)
    assert got.count() == 7
    assert store.materialize(spark, lambda: spark.range(9), "probe_cut", sig).count() == 7


def test_the_first_of_two_writers_wins(spark):
    sig = "test-" + os.urandom(4).hex()

    def slow():
        store.materialize(spark, lambda: spark.range(4), "probe_race", sig)
        return spark.range(5)

    assert store.materialize(spark, slow, "probe_race", sig).count() == 4
    path = store.table_path(spark, "probe_race", sig).removeprefix("file:")
    assert len([d for d in os.listdir(path) if d.startswith("attempt-")]) == 1


def test_a_failed_writer_leaves_no_table(spark):
    sig = "test-" + os.urandom(4).hex()
    with pytest.raises(Exception, match="no such"):
        store.materialize(spark, lambda: spark.range(3).selectExpr("raise_error('no such')"), "probe_fail", sig)
    assert store.current(spark, store.table_path(spark, "probe_fail", sig)) is None


def test_inputs_that_grow_within_a_session_give_new_tables(spark, sf0001):
    from shopflow.sources.testdata import shop_data
    folder = tempfile.mkdtemp(prefix="shopflow-grow-")
    for t in ("orders", "lineitem", "part"):
        shutil.copyfile(f"{sf0001}/{t}.parquet", f"{folder}/{t}.parquet")
    events = spark.read.parquet(f"{sf0001}/events.parquet")
    events.limit(100).write.parquet(f"{folder}/events.parquet")
    assert shop_data(spark, folder).pageviews.count() == 100
    events.orderBy("event_id", ascending=False).limit(50).write.mode("append").parquet(f"{folder}/events.parquet")
    assert shop_data(spark, folder).pageviews.count() == 150
