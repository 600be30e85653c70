"""Written intermediate tables and the file system behind the shared folder.

Every intermediate table goes to the folder named by ``spark.checkpoint.dir``,
which all executors reach, so a lost executor costs a re-read and never a
re-run of the lineage. Each call takes a new folder: an interrupted run leaves
files that nobody reads, never a part table that looks whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shopflow.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` is called so, in any case."""
    used = {c.lower() for c in taken}
    while name in used:
        name = f"_{name}"
    return name


def file_system(uri: str):
    """(pyarrow file system, path in it) of a folder on shared storage; works in tasks."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
