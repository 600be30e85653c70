"""Exact deduplication with keyed streaming state (built-in functions only).

Texts are equal when identical after each run of white space becomes one
space. A structured stream over the arriving rows keeps, per digest and
without expiry, the smallest stable identifier with its content locator and
the number of rows, in the disk-backed RocksDB state store; the state is read
back as a table. Where the state reports a hit, the full normalised texts are
compared; a digest shared by different texts is settled by the texts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shopflow.llm.staging import fresh_name, scratch_path, stage

FIRST_RUN = "000000"

#: Groups of several rows up to this number are broadcast (about 20 MB), so texts outside them never move.
BROADCAST_ROWS = 250_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # each state partition holds little; without this each reserves megabytes ahead of its files
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # one bound for all state partitions of an executor, small buffers for each, and a prompt end
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    # a partition's store is closed as soon as its task has committed, not when the query is long over
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: str | Column) -> Column:
    """Each run of space, tab or line-break characters becomes one space; null is empty."""
    text = F.col(text) if isinstance(text, str) else text
    # a lone space is already right, so it is not matched
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def fold_into_state(spark: SparkSession, arrivals_path: str, schema, state_path: str) -> DataFrame:
    """Run the arrivals not yet seen into the keyed state and return the state.

    ``state_path`` may be one of an earlier run over the same ``arrivals_path``:
    new arrivals are then matched against all earlier ones. Where folders
    ``run=...`` tell the runs apart, a row of an earlier run stays a group's first.
    Columns: digest, first (struct), group_size.
    """
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        rows = spark.readStream.schema(schema).parquet(arrivals_path)
        if "run" not in schema.names:
            rows = rows.withColumn("run", F.lit(FIRST_RUN))
        first = F.min(F.struct("run", F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator", "seq"))
        keyed = rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size"))
        (keyed.writeStream.format("noop").outputMode("update")
         .option("checkpointLocation", state_path).trigger(availableNow=True)
         .start().awaitTermination())
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    state = spark.read.format("statestore").load(state_path)
    first, size = [f.name for f in state.schema["value"].dataType.fields]
    return state.select("key.digest", F.col("value")[first].alias("first"),
                        F.col("value")[size].alias("group_size"))


def _locator(docs: DataFrame) -> Column:
    """The file that holds a row's content; empty where rows come from several sources, as after a join."""
    try:
        docs.select(F.input_file_name())
    except AnalysisException:
        return F.lit("")
    return F.input_file_name()


def exact_duplicates(docs: DataFrame, state_path: str | None = None) -> DataFrame:
    """Group rows of equal text; the row with the smallest doc_id of a group stays.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns
    a row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.
    Null texts count as empty. Null doc_ids come after all others: such a row
    stays only in a group without ids, whose ``keep_id`` is null. Of repeated
    rows with the smallest doc_id exactly one is ``kept``. An empty table
    gives an empty result.

    With the ``state_path`` of earlier calls (a folder all executors reach) rows
    are matched against all that came before: a text that an earlier call kept
    stays its group's kept one, whatever the doc_ids of later rows, and its bytes
    are read again from the Parquet file that the state names.
    """
    spark = docs.sparkSession
    digest = F.unhex(F.sha2(normalised("text"), 256))
    state_path = state_path or scratch_path(spark, "dedup-state")
    path = f"{state_path.rstrip('/')}-arrivals"
    run = f"{_runs_before(spark, path):06d}"
    arrivals = docs.select("doc_id", digest.alias("digest"), _locator(docs).alias("locator"),
                           F.monotonically_increasing_id().alias("seq"))
    arrivals.write.parquet(f"{path}/run={run}")
    schema = arrivals.schema
    arrivals = spark.read.schema(schema).parquet(f"{path}/run={run}")

    state = fold_into_state(spark, path, StructType([*schema.fields, StructField("run", StringType())]), state_path)
    groups = state.where("group_size > 1").select(
        "digest", F.col("first.doc_id").alias("first_id"), F.col("first.seq").alias("first_seq"),
        F.col("first.run").alias("first_run"), F.col("first.locator").alias("first_locator"), "group_size")
    if run != FIRST_RUN:
        groups = groups.join(arrivals.select("digest"), "digest", "left_semi")  # others have no row in this call
    groups = stage(groups, "dedup-groups")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)

    # full bytes on hits: the least and the greatest text of a digest are the same bytes
    texts = docs.select(normalised("text").alias("norm"), "doc_id").withColumn(
        "digest", F.unhex(F.sha2("norm", 256)))
    hits = texts.join(groups.select("digest"), "digest", "left_semi").select("digest", "norm")
    if run != FIRST_RUN:
        hits = hits.unionByName(_earlier_texts(spark, groups.where(F.col("first_run") < run)))
    compared = stage(hits.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
                     .select("digest", (F.col("lo") == F.col("hi")).alias("same")), "dedup-compared")
    found = (arrivals.join(groups, "digest", "left")
             .select("doc_id", "digest", "seq", F.coalesce("group_size", F.lit(1)).alias("group_size"),
                     F.when(F.col("group_size").isNull(), F.col("doc_id"))
                     .otherwise(F.col("first_id")).alias("keep_id"),
                     F.coalesce((F.col("first_seq") == F.col("seq")) & (F.col("first_run") == run), F.lit(True))
                     .alias("kept")))
    clashes = compared.where("NOT same").select("digest")
    if not clashes.isEmpty():
        found = _settle_by_text(found, texts.join(clashes, "digest", "left_semi"), clashes)
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long"), "kept",
                        F.lower(F.hex("digest")).alias("text_sha256"))


def _runs_before(spark: SparkSession, path: str) -> int:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len(fs.listStatus(folder)) if fs.exists(folder) else 0


def _earlier_texts(spark: SparkSession, groups: DataFrame) -> DataFrame:
    """``digest, norm`` of the rows that earlier calls kept, read from the files that the state names."""
    files = [r[0] for r in groups.where("first_locator <> ''").select("first_locator").distinct().collect()]
    if not files:
        return spark.createDataFrame([], "digest binary, norm string")
    rows = spark.read.parquet(*files).select("doc_id", normalised("text").alias("norm"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("norm", 256)))
    kept = groups.select("digest", F.col("first_id").alias("kept_id"))
    return rows.join(kept, "digest").where(F.col("doc_id").eqNullSafe(F.col("kept_id"))).select("digest", "norm")


def _settle_by_text(found: DataFrame, texts: DataFrame, clashes: DataFrame) -> DataFrame:
    """Rows of digests with several texts, grouped by the text itself (by doc_id within)."""
    by_text = texts.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"),
                                                  F.count("*").alias("group_size"))
    rows = texts.groupBy("digest", "norm", "doc_id").agg(F.count("*").alias("copies")).alias("r").join(
        by_text, ["digest", "norm"])
    each = rows.select("doc_id", "digest", "group_size", "keep_id",
                       F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    settled = each.select("doc_id", "digest", F.lit(None).cast("long").alias("seq"), "group_size", "keep_id",
                          ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"))
    return found.join(clashes, "digest", "left_anti").unionByName(settled)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged.

    Repeated rows (same doc_id, equal text) leave one row.
    """
    names = docs.columns
    digest = fresh_name("digest", names)
    found = stage(exact_duplicates(docs).select("doc_id", F.unhex("text_sha256").alias("digest"), "kept",
                                                F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("as_first")),
                  "dedup-found").where("NOT kept")
    gone_id, gone_digest = fresh_name("gone_id", names), fresh_name("gone_digest", names)
    gone = found.where("NOT as_first").select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    keyed = docs.withColumn(digest, F.unhex(F.sha2(normalised("text"), 256)))
    same = (keyed[digest] == gone[gone_digest]) & keyed["doc_id"].eqNullSafe(gone[gone_id])
    left = keyed.join(gone, same, "left_anti")
    if not found.where("as_first").isEmpty():  # rows repeated with the id that stays
        left = left.dropDuplicates(["doc_id", digest])
    return left.select(*[F.col(f"`{c}`") for c in names])
