"""Triples as JSON lines: one object for each node or edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.schema import TRIPLE


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Triples with shard (file name) and seq (order in it), and the bad lines. Blank lines are none."""
    rows = spark.read.schema(TRIPLE + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    rows = rows.select("*", F.element_at(F.split("_metadata.file_name", "/"), -1).alias("shard"), F.monotonically_increasing_id().alias("seq"))
    known = F.col("_corrupt_record").isNull() & F.coalesce(F.col("triple_type").isin("node", "edge"), F.lit(False))
    bad = rows.where(~known).select("shard", F.coalesce("_corrupt_record", F.to_json(F.struct("triple_type", "node_label", "node_data", "edge_data"))).alias("line"))
    return rows.where(known).drop("_corrupt_record"), bad


def edges_of(triples: DataFrame, *relationships: str) -> DataFrame:
    """The edges of some relationships, as a node table does not need them."""
    return triples.where((F.col("triple_type") == "edge") & F.col("edge_data.relationship").isin(*relationships)).select("edge_data.*", "shard", "seq")


def write(triples: DataFrame, path: str, mode: str = "append") -> None:
    triples.select("triple_type", "node_label", "node_data", "edge_data").write.mode(mode).json(path)


def of_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes (label and the node columns) as triples."""
    fields = [c for c in nodes.columns if c not in ("label", "shard", "seq")]
    empty = F.lit(None).cast("struct<source_usr:string,target_usr:string,relationship:string,file:string,line:int>")
    return nodes.select(F.lit("node").alias("triple_type"), F.col("label").alias("node_label"), F.struct(*fields).alias("node_data"), empty.alias("edge_data"))


def of_edges(edges: DataFrame, template: DataFrame) -> DataFrame:
    """Edges as triples, with the node type of ``template``."""
    kind = template.schema["node_data"].dataType
    return edges.select(F.lit("edge").alias("triple_type"), F.lit(None).cast("string").alias("node_label"), F.lit(None).cast(kind).alias("node_data"), F.struct("source_usr", "target_usr", "relationship", "file", "line").alias("edge_data"))
