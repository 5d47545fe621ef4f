"""Bounded Arrow batches between the JVM and Python tasks, and names for columns of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a batch; documents are a few kilobytes, and a task holds a batch or two on either side.
ROWS = 2000


def bound_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """Let no Arrow batch of this session have more rows; a smaller bound that is set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def fresh(table: DataFrame, name: str) -> str:
    """A column name that ``table`` has not, whatever its columns are called."""
    taken, name = {c.lower() for c in table.columns}, f"__{name}"
    while name in taken:
        name += "_"
    return name
