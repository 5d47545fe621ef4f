"""Continuous indexing: new JSON-line shards are merged as they arrive.

An extension: each micro-batch goes through the same keyed merge as a batch
run, so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symgraph.operators.ingest import GraphStore
from symgraph.schema import TRIPLE


def watch(spark: SparkSession, shards: str, store: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Merge every shard that appears in a folder; with ``once`` those that are there, and end."""
    graph = GraphStore(spark, store)

    def merge(batch: DataFrame, number: int) -> None:
        graph.ingest(batch.where("triple_type IN ('node', 'edge')").withColumns({"shard": F.lit(f"{number:020d}"), "seq": F.monotonically_increasing_id()}))

    rows = spark.readStream.schema(TRIPLE).json(shards)
    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
