"""Keyed merges of triples into node and edge tables.

A merge is a union with what exists and one aggregation per key: last writer
wins, by the order columns.  Partial aggregation keeps frequent keys from one
task.  Tables are written as new versions; readers see a version when its
pointer file names it, so a failed write changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.schema import CORE_RELATIONSHIPS, valid_edge, valid_node

EDGE_KEY = ("src", "rel", "dst", "file", "line")


def last_writer(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key the row that comes last in ``order``; its nulls win too."""
    rest = [c for c in rows.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return rows.groupBy(*keys).agg(latest).select(*keys, *(F.col(f"__row.`{c}`").alias(c) for c in rest))


def edge_key_text() -> Column:
    return F.concat_ws("|", F.col("src"), F.col("rel"), F.col("dst"), F.col("file"), F.col("line").cast("string"))


def merged_edges(raw: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """One edge for each key, of those whose ends exist, with its id."""
    kept = raw.join(sources.select(F.col("usr").alias("src")), "src", "left_semi").join(targets.select(F.col("usr").alias("dst")), "dst", "left_semi")
    return kept.select(*EDGE_KEY).dropDuplicates().withColumn("edge_id", edge_key_text())


def dangling_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that does not exist; they stay out of the graph, but are reported."""
    known = nodes.select("usr")
    no_source = raw.join(known, raw["src"] == known["usr"], "left_anti")
    no_target = raw.join(known, raw["src"] == known["usr"], "left_semi").join(known, raw["dst"] == known["usr"], "left_anti")
    return no_source.unionByName(no_target)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that stand more than once: rows for quarantine under a uniqueness rule."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def graph_of(triples: DataFrame, compat: bool = False, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> dict[str, DataFrame]:
    """nodes, edges, dangling and quarantine of triples (with shard and seq), merged into what exists.

    ``compat`` drops what a plain property graph loader would: relationships
    beyond the core ones, and the flags of functions and classes.
    """
    node_rows = triples.where("triple_type = 'node'").select(F.col("node_label").alias("label"), "node_data.*", "shard", "seq")
    good = node_rows.where(valid_node())
    if nodes is not None:
        good = nodes.withColumns({"shard": F.lit(""), "seq": F.lit(-1).cast("long")}).unionByName(good)
    merged = last_writer(good, ["label", "usr"], ["shard", "seq"]).drop("shard", "seq")
    if compat:
        merged = merged.drop("is_virtual", "is_pure_virtual", "is_static", "is_const", "is_abstract")
    edge_rows = triples.where("triple_type = 'edge'").select("edge_data.*")
    kept = edge_rows.where(valid_edge())
    if compat:
        kept = kept.where(F.col("relationship").isin(*CORE_RELATIONSHIPS))
    raw = kept.select(F.col("source_usr").alias("src"), F.col("relationship").alias("rel"), F.col("target_usr").alias("dst"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"))
    if edges is not None:
        raw = edges.select(*EDGE_KEY).unionByName(raw)
    known = merged.select("usr").distinct()
    bad = node_rows.where(~valid_node()).select(F.lit("node").alias("what"), F.to_json(F.struct("*")).alias("row"))
    bad = bad.unionByName(edge_rows.where(~valid_edge()).select(F.lit("edge").alias("what"), F.to_json(F.struct("*")).alias("row")))
    return {"nodes": merged, "edges": merged_edges(raw, known, known), "dangling": dangling_edges(raw, known).dropDuplicates(), "quarantine": bad}


def ingest_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): rows by label and by relationship."""
    return nodes.groupBy(F.col("label").alias("what")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("rel").alias("what")).agg(F.count("*").alias("n")))


def diagnostics_histogram(diagnostics: DataFrame) -> DataFrame:
    """(severity, n) of what readers passed over."""
    return diagnostics.groupBy("severity").agg(F.count("*").alias("n"))


class GraphStore:
    """Versioned node and edge tables in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int | None:
        """The version that the pointer names, or None for an empty store."""
        system, folder = self._fs("versions")
        if not system.exists(folder):
            return None
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=None)

    def read(self, what: str) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.path}/{what}/v={v}")

    def write(self, tables: dict[str, DataFrame]) -> int:
        v = (self.version() or 0) + 1
        for what, rows in tables.items():
            writer = rows.write.mode("overwrite")
            (writer.partitionBy("rel") if what == "edges" else writer).parquet(f"{self.path}/{what}/v={v}")
        system, pointer = self._fs(f"versions/{v}")
        system.create(pointer, True).close()
        return v

    def ingest(self, triples: DataFrame, compat: bool = False) -> int:
        """Merge triples into the store; the same triples twice change nothing."""
        return self.write(graph_of(triples, compat, self.read("nodes"), self.read("edges")))

    def wipe(self) -> None:
        system, root = self._fs("")
        system.delete(root, True)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
