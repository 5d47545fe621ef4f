"""Benchmark decontamination over a positional inverted index (operator 1).

The training texts become a stored index, sharded by document: a segment is one
megabyte of neighbouring documents, and holds for every term (a 64-bit
hash and its length stand for a word) the list of its positions.  Positions run
through the segment with gaps between documents, so a phrase never crosses
one.  Building it needs no shuffle, and a lost executor costs one segment.

A benchmark is a set of windows, each a sequence of terms.  They are searched
segment by segment: windows with a term the segment lacks go at once; for the
others the list of the rarest term, shifted by its offset, is intersected with
the shifted lists of the next rarest, until exact phrase starts are left.  With
a slop the same lists give proximity matches, where every term is within that
many words of its place.  The benchmark is read in blocks of bounded size; only
one block's windows are ever sent to the tasks.

Defined results: a null or empty text has no words and no hits; an item without
words has no window; an item with a null id counts as a hit but is not listed;
two items with one text are both listed; repeated rows are each reported; other
columns are ignored; an empty index or benchmark gives rows without hits.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm.bytescan import Texts, byte_set, hashes, lowered, prefix_sums, ragged, slices
from symgraph.storage import stored

#: Word bytes once A-Z are lowered: digits, a-z and everything beyond ASCII.
_WORD = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

#: Positions left free between two documents; more than any window with its slop.
GAP = 64

#: Bytes of text in a segment, and bytes of benchmark text searched at a time.
SEGMENT_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20

_SEGMENT = "n_words array<int>, terms binary, counts binary, postings binary"


def terms_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and where each text's words begin (n + 1 entries)."""
    data = lowered(texts.data)
    starts, stops, at = texts.runs(_WORD[data])
    return hashes(prefix_sums(data), starts, stops), at


def _packed(positions: np.ndarray) -> bytes:
    """Positions as differences (modulo 2**32), each byte of them in a plane of its own, compressed."""
    steps = np.diff(positions.astype(np.uint32), prepend=np.uint32(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    if not len(planes):
        return np.zeros(0, np.int64)
    steps = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32).astype(np.int64)


def _segment(texts: Texts) -> tuple[list[int], bytes, bytes, bytes]:
    terms, at = terms_of(texts)
    n_words = np.diff(at)
    position = np.arange(len(terms)) + GAP * np.repeat(np.arange(len(n_words)), n_words)
    order = np.argsort(terms, kind="stable")
    ranked = terms[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([first, [len(ranked)]])).astype(np.uint32)
    return n_words.tolist(), ranked[first].tobytes(), counts.tobytes(), _packed(position[order])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of ``docs``: a row for each segment, with its documents' ids in order."""
    kind = docs.schema[id_col].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(texts, SEGMENT_BYTES):
                n_words, terms, counts, postings = _segment(Texts.of(texts.slice(lo, hi - lo)))
                own = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids.slice(lo, hi - lo))
                columns = [own, pa.array([n_words], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in (terms, counts, postings))]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "n_words", "terms", "counts", "postings"])

    return docs.select(id_col, docs[text_col].cast("string").alias("__text")).mapInArrow(index, f"ids array<{kind}>, {_SEGMENT}")


class Windows:
    """The distinct windows of some items: rows of term numbers (-1: no term), and the items of each; arrays throughout, some 60 bytes a window."""

    def __init__(self, items: list[tuple[object, str | None]], size: int):
        terms, at = terms_of(Texts.of_list([text for _, text in items]))
        self.vocabulary, numbers = np.unique(terms, return_inverse=True)
        numbers = np.append(numbers, -1).astype(np.int32)
        n = np.diff(at)
        counts = np.where(n > 0, np.maximum(1, n - size + 1), 0)
        owner = np.repeat(np.arange(len(n), dtype=np.int32), counts)
        begins = ragged(at[:-1], counts)
        lengths = np.minimum(n, size)[owner]
        rows = np.empty((len(begins), size), np.int32)
        for k in range(size):
            rows[:, k] = numbers[np.where(k < lengths, np.minimum(begins + k, len(numbers) - 1), -1)]
        _, first, of = np.unique(np.ascontiguousarray(rows).view(f"V{4 * size}").ravel(), return_index=True, return_inverse=True)
        self.rows, self.lengths = rows[first], lengths[first]
        pairs = np.unique(of.astype(np.int64) * max(len(n), 1) + owner)
        self.item_of = (pairs % max(len(n), 1)).astype(np.int32)
        self.items_at = np.searchsorted(pairs // max(len(n), 1), np.arange(len(first) + 1))
        self.names = [None if item is None else str(item) for item, _ in items]
        self.rarest_first = np.argsort(self.rows, axis=1).astype(np.int8)

    def items(self, k: int) -> list[str]:
        """The ids of the items that have a window."""
        own = (self.names[i] for i in self.item_of[self.items_at[k] : self.items_at[k + 1]].tolist())
        return [x for x in own if x is not None]

    def order_by(self, frequency: np.ndarray) -> None:
        """From now on a window's terms are taken from the rarest in the whole corpus on."""
        if len(self.rows):
            known = np.where(self.rows >= 0, frequency[self.rows], np.iinfo(np.int64).max)
            self.rarest_first = np.argsort(known, axis=1, kind="stable").astype(np.int8)


def _lookup(vocabulary: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the vocabulary, its list's begin and length in a segment."""
    if not len(terms):
        return np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    k = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
    begin = np.cumsum(counts) - counts
    return begin[k], np.where(terms[k] == vocabulary, counts[k], 0)


def _search(windows: Windows, terms: np.ndarray, counts: np.ndarray, postings: bytes, slop: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window, starts of exact phrases, starts of proximity matches) of the windows that a segment has."""
    begin, length = _lookup(windows.vocabulary, terms, counts)
    if not len(windows.rows):
        return
    present = np.append(length > 0, True)[windows.rows].all(axis=1)
    if not present.any():
        return
    positions = _unpacked(postings)
    for k in np.flatnonzero(present).tolist():
        row, order = windows.rows[k], windows.rarest_first[k][: windows.lengths[k]]
        near = None
        for offset in order.tolist():
            term = row[offset]
            shifted = positions[begin[term] : begin[term] + length[term]] - offset
            if near is None:
                near, exact = shifted, np.ones(len(shifted), bool)
                continue
            at = np.searchsorted(shifted, near)
            after = shifted[np.minimum(at, len(shifted) - 1)] - near
            before = near - shifted[np.maximum(at - 1, 0)]
            after, before = np.where(after >= 0, after, slop + 1), np.where(before >= 0, before, slop + 1)
            exact &= after == 0
            keep = np.minimum(after, before) <= slop
            near, exact = near[keep], exact[keep]
            if not len(near):
                break
        if len(near):
            yield k, near[exact], near


def _frequencies(spark: SparkSession, index: DataFrame, windows: Windows) -> np.ndarray:
    """How often each of the windows' terms occurs in the whole corpus. As many rows as the block has terms reach the driver."""
    vocabulary = spark.sparkContext.broadcast(windows.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.value), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                total += _lookup(vocabulary.value, np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64))[1]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["term", "n"])

    out = np.zeros(len(windows.vocabulary), np.int64)
    for term, n in index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).toLocalIterator():
        out[term] = n
    return out


_MATCHES = "n_words long, hits array<struct<start:int,stop:int>>, items array<string>, near_items array<string>"


def _block_matches(index: DataFrame, windows: Windows, slop: int) -> DataFrame:
    """A row for each document of the index: its place there, words, disjoint runs of hit words, items with an exact window, and with a near one."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(windows)
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n_words, terms, counts, postings = (batch.column(k)[i] for k in range(1, 6))
                n = np.array(n_words.as_py(), np.int64)
                begins = np.cumsum(n) - n + GAP * np.arange(len(n))
                cover = np.zeros(int(n.sum() + GAP * len(n)) + 1, np.int32)
                items: dict[int, set[str]] = defaultdict(set)
                near_items: dict[int, set[str]] = defaultdict(set)
                w = sent.value
                found = _search(w, np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64), postings.as_py(), slop)
                for k, exact, near in found:
                    np.add.at(cover, exact, 1)
                    np.add.at(cover, exact + w.lengths[k], -1)
                    # a near match may be placed up to the slop before its document
                    for to, starts in ((items, exact), (near_items, near + slop)):
                        for doc in np.unique(np.searchsorted(begins, starts, side="right") - 1).tolist():
                            to[doc].update(w.items(k))
                hit = np.cumsum(cover) > 0
                edge = np.diff(hit.astype(np.int8), prepend=0)
                starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                hits: dict[int, list] = defaultdict(list)
                for s, e, doc in zip(starts.tolist(), stops.tolist(), (np.searchsorted(begins, starts, side="right") - 1).tolist(), strict=True):
                    hits[doc].append({"start": s - int(begins[doc]), "stop": e - int(begins[doc])})
                rows = range(len(n))
                columns = [
                    pa.array([batch.column(0)[i].as_py()] * len(n), pa.int64()), pa.array(rows, pa.int64()), ids.values, pa.array(n),
                    pa.array([hits.get(d, []) for d in rows], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                    pa.array([sorted(items.get(d, ())) for d in rows], pa.list_(pa.string())),
                    pa.array([sorted(near_items.get(d, ())) for d in rows], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "row", "doc", "n_words", "hits", "items", "near_items"])

    return index.select("segment", "ids", "n_words", "terms", "counts", "postings").mapInArrow(match, f"segment long, row long, doc {kind}, {_MATCHES}")


def _merged(spans) -> Column:
    """Disjoint runs of the words that sorted spans cover."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def add(done, span):
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))))
        return F.when((F.size(done) > 0) & (span["start"] <= F.get(done, F.size(done) - 1)["stop"]), longer).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), empty, add)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, slop: int = 2
) -> DataFrame:
    """(id, n_words, hits, items, near_items) for each row of ``docs``.

    hits: disjoint runs [start, stop) of words inside exact windows; items: ids,
    as sorted strings, with an exact window; near_items: with one whose terms
    are each within ``slop`` words of their place.
    """
    if window + slop >= GAP:
        raise ValueError(f"window and slop must be under {GAP} together")
    spark = docs.sparkSession
    index = stored(build_index(docs, id_col, text_col), "postings").withColumn("segment", F.monotonically_increasing_id())
    test = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))
    size = test.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    parts = []
    for b in range(blocks):
        own = test if blocks == 1 else test.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        windows = Windows([(r.item, r.text) for r in own.toLocalIterator()], window)
        windows.order_by(_frequencies(spark, index, windows))
        parts.append(_block_matches(index, windows, slop))
    if blocks == 1:
        found = parts[0]
    else:
        # each block has found some of a document's matches; a document's own rows are as many as the blocks
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        found = every.groupBy("segment", "row").agg(
            F.first("doc").alias("doc"), F.first("n_words").alias("n_words"), _merged(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
        )
    return found.select(F.col("doc").alias(id_col), "n_words", "hits", "items", "near_items")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and digests of what ``find_contamination`` found."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, h: total + h["stop"] - h["start"])
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


#: DuckDB SQL for ``digest(find_contamination(...))`` with windows of ten words.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM docs) CROSS JOIN (SELECT DISTINCT size FROM windows)
  WHERE i + size - 1 <= len(w)
), found AS (
  SELECT rid, i, p.size AS size, item_id FROM places p JOIN windows w ON p.phrase = w.phrase AND p.size = w.size
), hit AS (
  SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + size)) AS at FROM (SELECT DISTINCT rid, i, size FROM found)) GROUP BY rid
), listed AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT rid, CAST(item_id AS varchar) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, CAST(coalesce(n_hit, 0) AS bigint) AS n_hit, CAST(coalesce(n_items, 0) AS bigint) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN listed USING (rid)
"""
