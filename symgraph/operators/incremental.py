"""Change detection by content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.scalars import utc_now
from symgraph.operators.ingest import last_writer


def content_hashes(files: DataFrame) -> DataFrame:
    """(filepath, sha256) of binary file rows (path, content); '' where the content cannot be read."""
    return files.select(F.col("path").alias("filepath"), F.coalesce(F.sha2("content", 256), F.lit("")).alias("sha256"))


def changed(current: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of ``current`` that the cache lacks or has otherwise; unreadable files count as changed."""
    known = cache.select("filepath", F.col("sha256").alias("__known"))
    joined = current.join(known, "filepath", "left")
    return joined.where((F.col("sha256") == "") | ~F.col("sha256").eqNullSafe(F.col("__known"))).drop("__known")


def removed(current: DataFrame, cache: DataFrame) -> DataFrame:
    """(filepath) that the cache has and the tree has no more."""
    return cache.select("filepath").join(current.select("filepath"), "filepath", "left_anti")


def update(cache: DataFrame, parsed: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The cache after a run: parsed files replace their rows, files that are gone leave."""
    new = parsed.select("filepath", "sha256", utc_now().alias("last_parsed")).where("sha256 <> ''")
    rows = cache.select("filepath", "sha256", "last_parsed", F.lit(0).alias("__new")).unionByName(new.withColumn("__new", F.lit(1)))
    kept = last_writer(rows, ["filepath"], ["__new", "sha256"]).drop("__new")
    return kept if gone is None else kept.join(gone, "filepath", "left_anti")
