"""Near copies by the Jaccard similarity of their shingle sets (near-copy stage of the pipeline).

A text's set holds the XXH64 of its shingles of words (as in ``simhash``), each
once.  Texts of equal sets are one class from the start, known by a 64-bit sum
over the set.  Every candidate pair is verified on the sets themselves, so no
link is below the threshold.

The first candidates are the links of the SimHash operator: equal fingerprints,
and those its bit-sliced comparison finds within a few bits.  A fingerprint
within so few bits is sure only of very close texts, so the rest comes from
MinHash signatures: ``BANDS`` bands of ``ROWS`` minima each; two sets of
similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS, which is
0.9995 at 0.8 and grows above.  Each class is compared with the smallest of each
of its bands, if no link joins them yet, which joins a dense group with one pair
a member.  Then, only in bands that still hold more than one group, all pairs
across groups are compared, so that no candidate is passed over.  Texts are read
again only for the classes in candidate pairs.

Defined results: a null or empty text, or one of separators alone, has the empty
set, and all of them are one class; texts of fewer words than a shingle are one
shingle; null ids are kept and never become a component id unless their group
has no other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.bytescan import Texts, _mix, slices
from symgraph.llm.components import components
from symgraph.llm.simhash import _majority, fingerprint_links, shingle_hashes
from symgraph.storage import stored

_U = np.uint64

#: Bands of a signature, and minima in a band.
BANDS, ROWS = 25, 6

_rng = np.random.default_rng(5)
_FLIPS = _rng.integers(0, 1 << 63, BANDS * ROWS).astype(_U)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS).astype(_U) | _U(1)


def sets_of(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and where each text's begin (n + 1 entries)."""
    return distinct_of(*shingle_hashes(texts, words))


def distinct_of(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sets_of`` for the hashes of all shingles and the number of them in each text."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(counts) + 1))


def prints_of(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each set, the same for equal sets; zero for the empty one."""
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(h.copy()), dtype=_U)])
    return _mix(sums[at[1:]] - sums[at[:-1]])


def bands_of(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the sets that are not empty: their numbers, and a key for each of their bands."""
    full = np.flatnonzero(np.diff(at))
    keys = np.empty((len(full), BANDS), _U)
    if len(full):
        begins = at[:-1][full]
        for band in range(BANDS):
            key = np.full(len(full), band + 1, _U)
            for k in range(band * ROWS, band * ROWS + ROWS):
                key = _mix(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat((h ^ _FLIPS[k]) * _FACTORS[k], begins))
            keys[:, band] = key
    return full, keys


def prints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, own, print, fp, bands): a row for each row of ``docs``: text hash, set, fingerprint; bands is empty for the empty set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in slices(texts):
                shingles = shingle_hashes(Texts.of(texts.slice(lo, hi - lo)), words)
                h, at = distinct_of(*shingles)
                full, keys = bands_of(h, at)
                ends = np.zeros(hi - lo + 1, np.int32)
                ends[full + 1] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
                print_, fp = (pa.array(x.view(np.int64)) for x in (prints_of(h, at), _majority(*shingles)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), print_, fp, bands], ["id", "own", "print", "fp", "bands"])

    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].alias("id"), text_hash(text).alias("own"), text.alias("text")).mapInArrow(scan, f"id {kind}, own string, print long, fp long, bands array<long>")


def text_hash(text) -> Column:
    """What a text is known by; a null is an empty text."""
    return F.md5(F.coalesce(text, F.lit("")))


def _sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, text_col: str, words: int) -> DataFrame:
    """(print, members): the sets of the classes that stand in ``pairs``, one row each."""
    wanted = pairs.select(F.col("a").alias("print")).unionByName(pairs.select(F.col("b").alias("print"))).distinct()
    texts = classes.join(wanted, "print").select("own")  # one text stands for its class
    source = docs.select(docs[text_col].cast("string").alias("text")).withColumn("own", text_hash(F.col("text"))).join(texts, "own", "left_semi").select("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in slices(texts):
                h, at = sets_of(Texts.of(texts.slice(lo, hi - lo)), words)
                members = [h[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(prints_of(h, at).view(np.int64)), pa.array(members, pa.binary())], ["print", "members"])

    return source.mapInArrow(scan, "print long, members binary").dropDuplicates(["print"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sets have the similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), _U) for c in (left, right))
                if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = both / (len(x) + len(y) - both) >= similarity
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], ["a", "b"])

    joined = pairs.join(sets.select(F.col("print").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("print").alias("b"), F.col("members").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """(id, own, group, component_id): a row for each row of ``docs``; own is the text's MD5, rows of one group are linked, component_id is the smallest id in it."""
    scanned = stored(prints(docs, id_col, text_col, words), "shingle-prints")
    classes = stored(scanned.groupBy("print").agg(F.min("id").alias("least"), F.min("own").alias("own"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "shingle-classes")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stored(pairs.distinct(), f"shingle-pairs-{name}")
        return stored(_verified(pairs, _sets(docs, classes, pairs, text_col, words), similarity), f"shingle-links-{name}")

    def rooted(members: DataFrame, joined: DataFrame) -> DataFrame:
        return members.join(components(joined).withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))

    of_fp = stored(classes.groupBy("fp").agg(F.min("print").alias("least_print")), "shingle-fingerprints")
    close = fingerprint_links(of_fp.select("fp"), radius)
    first, second = (of_fp.select(F.col("fp").alias(side), F.col("least_print").alias(f"print_{side}")) for side in "ab")
    same = classes.join(of_fp, "fp").where("print <> least_print").select(F.col("print").alias("a"), F.col("least_print").alias("b"))
    found = links(same.unionByName(close.join(first, "a").join(second, "b").select(F.col("print_a").alias("a"), F.col("print_b").alias("b"))), "simhash")

    by_print = stored(rooted(classes.select("print", "bands"), found).select("print", "root", F.explode("bands").alias("key")), "shingle-keys")
    shared = by_print.groupBy("key").agg(F.min(F.struct("print", "root")).alias("low"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key", "low")
    members = stored(by_print.join(shared, "key").select("key", "print", "root", F.col("low.print").alias("low"), F.col("low.root").alias("low_root")), "shingle-bands")
    found = stored(found.unionByName(links(members.where("root <> low_root").select(F.col("print").alias("a"), F.col("low").alias("b")), "first")), "shingle-links")

    again = rooted(members.select("key", "print", "low"), found)
    mixed = again.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    # the smallest of a band has been compared with all of it that was not linked with it
    rest = stored(again.join(mixed, "key").select("key", "print", "root"), "shingle-rest")
    across = rest.alias("l").join(rest.alias("r"), "key").where("l.root <> r.root and l.print > r.print").select(F.col("l.print").alias("a"), F.col("r.print").alias("b"))
    grouped = rooted(classes.select("print", "least"), found.unionByName(links(across, "rest"))).select("print", "least", F.col("root").alias("group"))
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    of_print = grouped.join(least, "group").select("print", "group", "component_id")
    return scanned.select("id", "own", "print").join(of_print, "print").select(F.col("id").alias(id_col), "own", "group", "component_id")
