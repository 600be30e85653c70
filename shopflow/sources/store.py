"""Materialise derived tables as Parquet in the shared checkpoint folder.

A derived table (the session-tagged clickstream, the commerce tables, the
session fact table) is written once under ``spark.checkpoint.dir`` and read
back by every later analysis. Reading the written table cuts the lineage,
survives lost executors (the files live on shared storage, unlike cached
blocks) and lets the Parquet reader push filters and prune columns.

A table is keyed by its name, a version and the size and modification time
of its input files, so changed inputs give a new folder. Each writer fills
an attempt folder of its own; when its job has ended, one small pointer file
naming that folder is created. Readers follow the pointer, so a table that
was cut off while it was written or moved is never read, and the next call
builds it again.
"""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from shopflow.session import checkpoint_dir

FORMAT_VERSION = "5"
POINTER = "_current"
ABANDONED_AFTER = 24 * 3600  # seconds without change after which an attempt without pointer is removed
FILE_BYTES = 128 << 20
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 20_000


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def input_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``, 0 when there is none."""
    p, fs = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def input_signature(spark: SparkSession, paths: list[str]) -> str:
    """Hash of each path's modification time and its files' number and total length.

    Three calls a path, however many files it has. A folder's modification
    time changes when a file is added, removed or replaced in it; files are
    not rewritten in place.
    """
    h = hashlib.sha1(FORMAT_VERSION.encode())
    for path in sorted(paths):
        p, fs = _fs(spark, path)
        h.update(path.encode())
        if fs.exists(p):
            held = fs.getContentSummary(p)
            h.update(f"{fs.getFileStatus(p).getModificationTime()}:{held.getFileCount()}:{held.getLength()}".encode())
    return h.hexdigest()[:16]


def table_path(spark: SparkSession, name: str, signature: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/shopflow/{name}-{signature}"


def current(spark: SparkSession, path: str) -> str | None:
    """The folder that the table's pointer names, None without a finished attempt."""
    p, fs = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return f"{path}/{stream.readUTF()}"
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, attempt: str) -> None:
    """Create the pointer unless another writer was first."""
    p, fs = _fs(spark, f"{path}/{POINTER}")
    made, _ = _fs(spark, f"{path}/{POINTER}-{attempt}")
    stream = fs.create(made, True)
    stream.writeUTF(attempt)
    stream.close()
    # a rename keeps an existing file; where it replaces one, either names a whole table
    if not fs.exists(p):
        fs.rename(made, p)
    if fs.exists(made):
        fs.delete(made, False)


def _clean(spark: SparkSession, path: str, kept: str) -> None:
    """Remove this table's attempts that were left behind long ago."""
    p, fs = _fs(spark, path)
    for status in fs.listStatus(p):
        left = status.getPath().getName() != kept and status.isDirectory()
        if left and time.time() - status.getModificationTime() / 1000 > ABANDONED_AFTER:
            fs.delete(status.getPath(), True)


def bucket_count(input_bytes: int) -> int:
    """Buckets of a co-partitioned table made from ``input_bytes``: about ``BUCKET_BYTES`` each, 8 at least.

    One task sorts, joins and aggregates a bucket, and compressed input grows about tenfold in memory, so a
    bucket's size sets the memory of a task. Beyond ``MOST_BUCKETS`` buckets grow instead.
    """
    return max(8, min(-(-input_bytes // BUCKET_BYTES), MOST_BUCKETS))


def _attempt(spark: SparkSession, path: str, write) -> str:
    """The folder of the table at ``path``; ``write(folder)`` fills it first where there is none."""
    found = current(spark, path)
    if found is None:
        attempt = f"attempt-{uuid.uuid4().hex[:12]}"
        write(f"{path}/{attempt}")
        _publish(spark, path, attempt)
        found = current(spark, path)
        if not found.endswith(attempt):
            p, fs = _fs(spark, f"{path}/{attempt}")
            fs.delete(p, True)
        _clean(spark, path, found.rsplit("/", 1)[1])
    return found


def dealt_count(spark: SparkSession, buckets: int) -> int:
    """Partitions for a join that fills ``buckets`` buckets without another shuffle: a multiple of them, so that a
    partition holds rows of one bucket, and no fewer than shuffles have (a join deals fewer ones anew)."""
    return buckets * -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)


def bucketed_path(spark: SparkSession, name: str, signature: str, buckets: int) -> str:
    return table_path(spark, name, f"{signature}-{buckets}")


def materialize_bucketed(spark: SparkSession, df_factory, name: str, signature: str, by: str, buckets: int,
                         sort: list[str] | None = None, dealt: bool = False) -> DataFrame:
    """Table ``name`` for ``signature`` in ``buckets`` files by the hash of ``by``, written first if absent.

    Tables bucketed by the same key into the same number of buckets join, and
    aggregate by that key, without a shuffle. Each bucket is one file sorted by
    ``sort`` (default: the key), or one for each partition with rows of it where
    ``df_factory`` has ``dealt`` the rows (see :func:`dealt_count`). The catalog
    entry that tells Spark of the buckets belongs to the session; it is made
    again wherever the files are opened.
    """
    sort = sort or [by]
    path = bucketed_path(spark, name, signature, buckets)

    def table(folder: str) -> str:
        return "shopflow_" + hashlib.sha1(folder.encode()).hexdigest()[:20]

    def write(folder: str) -> None:
        df = df_factory()
        ((df if dealt else df.repartition(buckets, by)).write.bucketBy(buckets, by).sortBy(*sort)
         .option("path", folder).option("compression", "zstd").format("parquet").saveAsTable(table(folder)))

    found = _attempt(spark, path, write)
    if not spark.catalog.tableExists(table(found)):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(found).schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table(found)} ({columns}) USING parquet CLUSTERED BY (`{by}`) "
                  f"SORTED BY ({', '.join(f'`{c}`' for c in sort)}) INTO {buckets} BUCKETS LOCATION '{found}'")
    return spark.table(table(found))


def materialize(spark: SparkSession, df_factory, name: str, signature: str,
                cluster_by: str | None = None, input_bytes: int = 0) -> DataFrame:
    """Read table ``name`` for ``signature``, writing it first if absent.

    ``df_factory`` is only called (and the job only run) when the table is
    missing. ``cluster_by`` range-partitions the rows on that column and
    sorts each file by it, so the Parquet min/max statistics of files and
    row groups let a filter on the column skip most of the table;
    ``input_bytes`` sets how many files that gives (by default as many as
    shuffles have partitions). Of several writers the first to finish wins
    and the others remove what they wrote.
    """
    def write(folder: str) -> None:
        df = df_factory()
        if cluster_by:
            files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // FILE_BYTES))
            df = df.repartitionByRange(files, cluster_by).sortWithinPartitions(cluster_by)
        df.write.parquet(folder)

    return spark.read.parquet(_attempt(spark, table_path(spark, name, signature), write))
