"""Best-fit packing of documents into sequences by large-item matching (operator 4).

Only lengths decide a packing, and there are at most ``capacity`` of them.  So
the tasks count pieces by length, and the plan is made on that histogram: a
bounded table, however many documents there are.  Pieces above a third of the
capacity go at most two to a sequence: from the longest on, each is matched
with the longest other that fits.  Shorter pieces then go, from the longest on,
to the smallest gap that takes them, and to new sequences when none does.  The
plan says for each length which ranks go where; a piece's rank is the number of
pieces of its length in earlier tasks and before it in its own.  Nothing is
sorted and no length, however frequent, meets in one task.

Defined results: a null or empty text is its end token alone; only documents
longer than a sequence are cut, with the short piece first; repeated rows and
null ids are packed like others; other columns are ignored; an empty table
gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.llm.tokens import token_ids
from symgraph.storage import stored


def match_and_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Kinds of sequences as (how many, lengths in them) that take ``counts`` pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens")
        left[length] = n
    least = capacity // 3 + 1
    plan: list[tuple[int, list[int]]] = []
    by_gap: dict[int, list[tuple[int, list[int]]]] = {}

    def put(n: int, lengths: list[int]) -> None:
        by_gap.setdefault(capacity - sum(lengths), []).append((n, lengths))

    for a in range(capacity, least - 1, -1):
        b = min(a, capacity - a)
        while left[a]:
            while b >= least and left[b] < 1 + (a == b):
                b -= 1
            if b < least:
                put(int(left[a]), [a])
                left[a] = 0
                break
            n = int(left[a] // 2 if a == b else min(left[a], left[b]))
            put(n, [a, b])
            left[a] -= n
            left[b] -= n
    for s in range(least - 1, 0, -1):
        while left[s]:
            gap = next((g for g in range(s, capacity) if by_gap.get(g)), None)
            if gap is None:
                each = capacity // s
                if n := int(left[s] // each):
                    put(n, [s] * each)
                if n := int(left[s] % each):
                    put(1, [s] * n)
                left[s] = 0
                break
            n, lengths = by_gap[gap].pop()
            take = int(min(n, left[s]))
            put(take, [*lengths, s])
            if take < n:
                by_gap[gap].append((n - take, lengths))
            left[s] -= take
    for kinds in by_gap.values():
        plan += kinds
    return plan


class _Places:
    """Where the pieces of each length go, by rank."""

    def __init__(self, plan: list[tuple[int, list[int]]], capacity: int):
        rank = np.zeros(capacity + 1, np.int64)
        rows, sequence = [], 0
        for n, lengths in plan:
            offset = 0
            for length in lengths:
                rows.append(((length << 44) + rank[length], sequence, offset))
                rank[length] += n
                offset += length
            sequence += n
        rows.sort()
        self.sequences = sequence
        self.key, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 3).T

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (length << 44) + rank
        k = np.searchsorted(self.key, at, side="right") - 1
        return self.sequence[k] + at - self.key[k], self.offset[k]


def cut_into_pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: id, piece, start, length, ids_crc32 (and ids, if they are kept), and its task and rank of its length there."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            row, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []

            def out():
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32", "task", "task_rank"]
                if keep_ids:
                    columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
                return pa.RecordBatch.from_arrays(columns, names)

            for i, tokens in enumerate(token_ids(batch.column(1), tokenizer, end)):
                at, k = 0, 0
                while at < len(tokens):
                    n = (len(tokens) - at) % capacity or capacity
                    own = tokens[at : at + n].tobytes()
                    for column, value in ((row, i), (piece, k), (start, at), (length, n), (crc, zlib.crc32(own)), (rank, seen[n])):
                        column.append(value)
                    if keep_ids:
                        ids.append(own)
                    seen[n] += 1
                    at, k = at + n, k + 1
                if len(row) >= 4096:
                    yield out()
                    for column in (row, piece, start, length, crc, rank, ids):
                        column.clear()
            if row:
                yield out()

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, task int, task_rank long" + ", ids binary" * keep_ids
    return docs.select(id_col, docs[text_col].cast("string").alias("__text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with the sequence and the offset where each stands."""
    pieces = stored(cut_into_pieces(docs, tokenizer, capacity, end, id_col, text_col, keep_ids), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # as many rows as the capacity at most
    places = docs.sparkSession.sparkContext.broadcast(_Places(match_and_fit(counts, capacity), capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("task_rank"))
    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = places.value.of(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    types = dict(pieces.dtypes)
    return ranked.select(*names, "rank").mapInArrow(place, ", ".join(f"`{c}` {types[c]}" for c in names) + ", sequence_id long, offset long")
