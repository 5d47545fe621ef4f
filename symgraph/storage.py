"""Shared storage for cutting lineage and for intermediate tables.

A cluster names the folder that the driver and every executor can reach in
``spark.checkpoint.dir``.  Only on a single machine may it be unset; then a
folder of our own is used.  Nothing here keeps a copy on one executor alone, so
a lost executor costs a re-read and not the job.

Tables of a process lie in one folder below it, which goes when the process
ends; what a ``scratch`` block stores goes when the block ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Folders of tables, by application; the last of each takes what is stored now.
_folders: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; also made the checkpoint folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif context.master.split("[")[0] == "local":
            named = tempfile.mkdtemp(prefix="symgraph-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(named)
    return named


def _delete(context: SparkContext, path: str) -> None:
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _open(spark: SparkSession) -> list[str]:
    own = _folders.setdefault(spark.sparkContext.applicationId, [])
    own.append(f"{shared_dir(spark).rstrip('/')}/symgraph-{uuid.uuid4().hex}")
    return own


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored within the block are deleted when it ends."""
    own = _open(spark)
    try:
        yield
    finally:
        _delete(spark.sparkContext, own.pop())


@atexit.register
def _clear() -> None:
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        for folder in _folders.pop(context.applicationId, []):
            _delete(context, folder)


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    folder = (_folders.get(spark.sparkContext.applicationId) or _open(spark))[-1]
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as a Parquet table (with these options) in the shared folder and read back.

    The files give later passes column pruning and a row order that does not
    change when a task is repeated.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_lines(lines: DataFrame, name: str) -> str:
    """The path of text files in the shared folder that hold the lines of a table's one column."""
    path = new_path(lines.sparkSession, name)
    lines.write.text(path)
    return path
