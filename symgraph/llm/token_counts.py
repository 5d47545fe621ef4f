"""Token counts of documents in flat token files by a separator scan (operator 2).

A flat token file is nothing but token ids, documents one after the other, each
closed by an end-of-document id; there is no index.  It is read in blocks of a
fixed number of ids, and a block starts where its number says.  Each block is
searched for the separator in one vectorised comparison.  A document's length
is the distance to the separator before, which may be many blocks back: a
prefix scan over the blocks' last separators stitches the boundaries.  The scan
has two levels, blocks in groups and then groups, so a single file of any size
is never one task's work.

Defined results: an empty document (two separators in turn) has 0 tokens;
tokens after the last separator are a last, open document (closed = false); an
empty stream has no documents; repeated documents are each counted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symgraph.llm.tokens import token_ids

#: Token ids in a block, and blocks in a group of the prefix scan.
BLOCK_TOKENS = 1 << 19
GROUP_BLOCKS = 1024


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def write_flat_files(docs: DataFrame, tokenizer: str, separator: int, folder: str, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2") -> DataFrame:
    """(stream, ordinal, id): the order of the documents in the flat token files that this writes to ``folder``, one for each task that has rows.

    The files hold ids alone.  A file that a failed attempt has left is in no
    row of a stored result.  Ids that do not fit ``dtype`` are an error.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    most = np.iinfo(dtype).max

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at, out = uuid.uuid4().hex, 0, None
        try:
            for batch in batches:
                if out is None:
                    system, inner = _file_system(folder)
                    system.create_dir(inner)
                    out = system.open_output_stream(f"{inner}/{name}")
                for tokens in token_ids(batch.column(1), tokenizer, separator):
                    if tokens.max() > most:
                        raise ValueError(f"token id {tokens.max()} does not fit {dtype}")
                    out.write(tokens.astype(dtype).tobytes())
                ordinals = pa.array(np.arange(at, at + batch.num_rows))
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows, pa.string()), ordinals, batch.column(0)], ["stream", "ordinal", id_col])
        finally:
            if out is not None:
                out.close()

    return docs.select(id_col, docs[text_col].cast("string").alias("__text")).mapInArrow(write, f"stream string, ordinal long, `{id_col}` {kind}")


def flat_files(spark: SparkSession, path: str) -> DataFrame:
    """(stream, path, length) of the flat token files below a folder; the file name, which must be unique there, is the stream."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("stream"), "path", "length")


def read_flat_files(files: DataFrame, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(stream, block, tokens) of ``flat_files``; blocks are read by position, so one large file is many tasks' work."""
    width = np.dtype(dtype).itemsize
    ranges = files.select("path", "stream", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / (width * block_tokens)))).alias("block"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, stream, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inner = _file_system(name)
                with system.open_input_file(inner) as f:
                    f.seek(block * width * block_tokens)
                    data = f.read(width * block_tokens)
                yield pa.RecordBatch.from_arrays([pa.array([stream]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["stream", "block", "tokens"])

    return ranges.repartition("stream", "block").mapInArrow(read, "stream string, block long, tokens binary")


def count_tokens(blocks: DataFrame, separator: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(stream, ordinal, block, nth, n_tokens, closed): a row for each document of each stream, in the order of the stream from 0.

    ``blocks``: stream, block (numbered from 0) and tokens; all but the last of
    a stream hold ``block_tokens`` ids.  block and nth tell which separator of
    which block closes the document.
    """

    kind = blocks.schema["stream"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, block, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                tokens = np.frombuffer(data.as_buffer(), dtype)
                at = np.flatnonzero(tokens == separator) + block.as_py() * block_tokens
                columns = [pa.array([stream.as_py()]), pa.array([block.as_py()], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([at], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["stream", "block", "n", "at"])

    found = blocks.select("stream", "block", "tokens").mapInArrow(search, f"stream {kind}, block long, n long, at array<long>")
    found = found.withColumns({"group": F.floor(F.col("block") / GROUP_BLOCKS), "last": F.element_at(F.when(F.size("at") > 0, F.col("at")), -1), "seps": F.size("at").cast("long"), "stop": F.col("block") * block_tokens + F.col("n")})

    def before(window, last: str, seps: str) -> dict:
        window = window.rowsBetween(Window.unboundedPreceding, -1)
        return {"last_before": F.max(last).over(window), "seps_before": F.coalesce(F.sum(seps).over(window), F.lit(0))}

    groups = found.groupBy("stream", "group").agg(F.max("last").alias("g_last"), F.sum("seps").alias("g_seps"), F.max("stop").alias("g_stop"))
    groups = groups.withColumns(before(Window.partitionBy("stream").orderBy("group"), "g_last", "g_seps"))
    carried = groups.select("stream", "group", F.col("last_before").alias("g_last_before"), F.col("seps_before").alias("g_seps_before"))
    stitched = found.withColumns(before(Window.partitionBy("stream", "group").orderBy("block"), "last", "seps")).join(carried, ["stream", "group"])
    previous = F.coalesce(F.greatest("last_before", "g_last_before"), F.lit(-1))
    closed = stitched.select("stream", "block", (F.col("seps_before") + F.col("g_seps_before")).alias("first"), previous.alias("previous"), "at", F.posexplode("at").alias("nth", "here")).select(
        "stream", (F.col("first") + F.col("nth")).alias("ordinal"), "block", "nth",
        (F.col("here") - F.when(F.col("nth") == 0, F.col("previous")).otherwise(F.get("at", F.col("nth") - 1)) - 1).alias("n_tokens"), F.lit(True).alias("closed"),
    )
    ends = groups.groupBy("stream").agg(F.max("g_last").alias("last"), F.sum("g_seps").alias("ordinal"), F.max("g_stop").alias("stop"))
    rest = F.col("stop") - 1 - F.coalesce("last", F.lit(-1))
    still_open = ends.where(rest > 0).select("stream", "ordinal", F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("nth"), rest.alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(still_open)


def document_token_counts(order: DataFrame, blocks: DataFrame, separator: int, dtype: str = "<u2") -> DataFrame:
    """``order`` (stream, ordinal, ...) with n_tokens in place of stream and ordinal, by the separator scan of the files' blocks."""
    counts = count_tokens(blocks, separator, dtype).select("stream", "ordinal", "n_tokens")
    return order.join(counts, ["stream", "ordinal"]).drop("stream", "ordinal")
