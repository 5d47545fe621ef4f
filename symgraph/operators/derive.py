"""Edges derived by joins: overrides across files and virtual dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.scalars import signatures_agree


def overrides(inheritance: DataFrame, methods: DataFrame) -> DataFrame:
    """(src, dst): methods that override one of a parent class by simple name and agreeing signature.

    ``inheritance``: child, parent (qualified names); ``methods``: class, name,
    signature, usr, seq.  Of a parent's methods of one name the last counts.
    """
    parents = methods.groupBy("class", "name").agg(F.max_by(F.struct("usr", "signature"), F.struct("seq", "usr")).alias("base"))
    child = methods.select(F.col("class").alias("child"), "name", F.col("signature").alias("own"), F.col("usr").alias("src"))
    pairs = inheritance.distinct().join(child, "child").join(parents.withColumnRenamed("class", "parent"), ["parent", "name"])
    return pairs.where(signatures_agree("own", "base.signature") & (F.col("src") != F.col("base.usr"))).select("src", F.col("base.usr").alias("dst")).distinct()


def virtual_dispatch(calls: DataFrame, override_edges: DataFrame, static: DataFrame) -> DataFrame:
    """(src, dst, file, line): for a call of a base method that is not static, calls of its overriders; one for each pair, at the first call site."""
    base = override_edges.select(F.col("src").alias("derived"), F.col("dst").alias("base")).distinct()
    live = calls.join(static.select(F.col("usr").alias("dst")), "dst", "left_anti")
    # the first call site is chosen before the fan-out, so frequent pairs do not multiply
    sites = live.groupBy("src", "dst").agg(F.min(F.struct("file", "line")).alias("site"))
    pairs = sites.join(base, sites["dst"] == base["base"])
    first = pairs.groupBy("src", F.col("derived").alias("to")).agg(F.min("site").alias("site"))
    return first.select("src", F.col("to").alias("dst"), "site.file", "site.line")


def virtual_targets(override_edges: DataFrame) -> DataFrame:
    """(dst, overriders): base methods, and how many override each."""
    return override_edges.groupBy("dst").agg(F.countDistinct("src").alias("overriders"))
