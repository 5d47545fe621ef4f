"""SimHash near-duplicates with a bit-sliced comparison (operator 5).

Fingerprints: the words of a whole text, shingles of them, XXH64 of every
shingle, and for each of 64 bits whether more than half of the hashes have it.
XXH64 and the bit counts are vectorised over all shingles of a slice of texts.

Links: equal fingerprints are one class from the start, so copies are never
paired.  The 64 bits are cut in blocks; two fingerprints within ``radius`` bits
agree on all but ``radius`` blocks, so every close pair meets under some choice
of the other blocks (exact: no pair is missed).  More fingerprints take more
blocks, which only changes the cost.  A crowded key is cut into chunks and the
chunks are paired, so no task ever holds a whole hot key.  Within a group the
bits stand in vertical planes, 64 fingerprints to a word: a plane is compared
by one exclusive or, 64 distances are counted at once in carry-save counters,
and a word is given up as soon as all its lanes are beyond the radius.  Groups
report spanning links only; components of them give the classes.

Defined results: a null or empty text, or one of separators alone, has the
fingerprint zero and links like any other; texts of fewer words than a shingle
are one shingle; repeated rows are each reported; null ids are kept and never
become a component id unless their class has no other; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgraph.llm.bytescan import Texts, byte_set, lowered, slices
from symgraph.llm.components import components
from symgraph.storage import stored

_U = np.uint64
_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_SEPARATOR = byte_set((0x20, 0x20), (0x09, 0x0D))

#: Rows of a chunk of a crowded key; a task's group has two chunks at most.
CHUNK = 512


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of spans of bytes, vectorised over the spans of equal length."""
    padded = np.concatenate([data, np.zeros(40, np.uint8)])
    eights = np.ndarray(len(padded) - 7, "<u8", padded.data, 0, (1,))
    fours = np.ndarray(len(padded) - 3, "<u4", padded.data, 0, (1,))
    out = np.empty(len(starts), _U)
    lengths = stops - starts
    if not len(lengths):
        return out
    short = lengths.astype(np.uint16) if lengths.max() < 1 << 16 else lengths
    order = np.argsort(short, kind="stable")
    ranked = lengths[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(ranked)) + 1, [len(ranked)]])
    seed = _U(seed)

    def lane(acc, k):
        acc = acc + k * _P2
        return _rotl(acc, 31) * _P1

    with np.errstate(over="ignore"):
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows, n = order[lo:hi], int(ranked[lo])
            at = starts[rows]
            left = n
            if n >= 32:
                acc = [np.full(len(at), seed + x, _U) for x in (_P1 + _P2, _P2, _U(0), _U(0) - _P1)]
                for _ in range(n // 32):
                    acc = [lane(a, eights[at + 8 * i]) for i, a in enumerate(acc)]
                    at = at + 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for a in acc:
                    h = (h ^ lane(_U(0), a)) * _P1 + _P4
                left = n % 32
            else:
                h = np.full(len(at), seed + _P5, _U)
            h = h + _U(n)
            while left >= 8:
                h = _rotl(h ^ lane(_U(0), eights[at]), 27) * _P1 + _P4
                at, left = at + 8, left - 8
            if left >= 4:
                h = _rotl(h ^ (fours[at].astype(_U) * _P1), 23) * _P2 + _P3
                at, left = at + 4, left - 4
            for _ in range(left):
                h = _rotl(h ^ (padded[at].astype(_U) * _P5), 11) * _P1
                at = at + 1
            h ^= h >> _U(33)
            h *= _P2
            h ^= h >> _U(29)
            h *= _P3
            h ^= h >> _U(32)
            out[rows] = h
    return out


#: A byte's bits, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(_U)


def _majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, with ``counts`` of the hashes ``h`` in turn, the bits that over half of them have."""
    out = np.zeros(len(counts), _U)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    counts = counts[full]
    # byte counters hold 255, so a text is added up in pieces of as many hashes
    pieces = -(-counts // 255)
    first = np.cumsum(pieces) - pieces
    begins = np.repeat(np.cumsum(counts) - counts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    octets = h.view(np.uint8).reshape(-1, 8)
    bits = np.zeros((len(full), 64), bool)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[octets[:, k]], begins).view(np.uint8).reshape(-1, 8)
        totals = np.add.reduceat(sums.astype(np.int64), first, axis=0)
        bits[:, 8 * k : 8 * k + 8] = 2 * totals > counts[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_hashes(texts: Texts, words: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of ``words`` words, text by text, and the number of them in each text."""
    data = lowered(texts.data)
    separators = _SEPARATOR[data]
    starts, stops, at = texts.runs(~separators)
    # one space for each run of separators
    keep = ~separators
    keep[1:] |= ~separators[:-1]
    place = np.cumsum(keep) - 1
    joined = np.where(separators, np.uint8(32), data)[keep]
    if len(starts):
        starts, stops = place[starts], place[stops - 1] + 1
    n = np.diff(at)
    counts = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    begins = np.repeat(at[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    ends = np.minimum(begins + words, np.repeat(at[1:], counts)) - 1
    return xxh64(joined, starts[begins], stops[ends]), counts


def fingerprints_of(texts: Texts, words: int = 4) -> np.ndarray:
    """The SimHash of each text over shingles of ``words`` words."""
    return _majority(*shingle_hashes(texts, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp long): a row for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in slices(texts):
                fp = fingerprints_of(Texts.of(texts.slice(lo, hi - lo)), words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fp.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, docs[text_col].cast("string").alias("__text")).mapInArrow(scan, f"`{id_col}` {kind}, fp long")


def with_fingerprints(docs: DataFrame, text_col: str = "text", words: int = 4, out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each row's text as 16 hexadecimal digits."""
    position = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(position)
            fp = [f"{x:016x}" for lo, hi in slices(texts) for x in fingerprints_of(Texts.of(texts.slice(lo, hi - lo)), words).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp, pa.string())], [*batch.schema.names, out])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def _blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, width) of n blocks of the 64 bits."""
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def choose_blocks(distinct: int, radius: int) -> int:
    """The number of blocks with the least estimated cost: rows sent, and pairs compared, 1/600 of a row's cost each."""

    def cost(n: int) -> float:
        keys = list(combinations(_blocks(n), n - radius))
        return len(keys) * distinct + sum(distinct**2 / 2 / 2.0 ** sum(w for _, w in k) for k in keys) / 600

    return min(range(radius + 1, radius + 6), key=cost)


_ALL = ~_U(0)


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int, lanes: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) within ``radius`` bits in the same group; rows of a group stand together."""
    n = len(fps)
    first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    sizes = np.diff(np.concatenate([first, [n]]))
    word_count = -(-sizes // 64)
    word_first = np.cumsum(word_count) - word_count
    rank = np.arange(n) - np.repeat(first, sizes)
    word = np.repeat(word_first, sizes) + rank // 64
    total = int(word_count.sum())
    slot = np.full(total * 64, -1, np.int64)
    slot[word * 64 + rank % 64] = np.arange(n)
    padded = np.where(slot >= 0, fps[slot], _U(0))
    planes = np.empty((64, total), _U)
    for p in range(64):
        planes[p] = np.packbits(((padded >> _U(p)) & _U(1)).astype(bool).reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
    taken = np.packbits((slot >= 0).reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel().astype(_U)
    # each row against its own word and the later words of its group
    each = np.repeat(word_first + word_count, sizes) - word
    left, right = [], []
    ends = np.cumsum(each)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + lanes, side="right")))
        q = np.repeat(np.arange(at, to), each[at:to])
        w = np.arange(len(q)) - np.repeat(np.cumsum(each[at:to]) - each[at:to], each[at:to]) + word[q]
        wanted = np.where(w == word[q], taken[w] & ((_ALL << (rank[q] % 64).astype(_U)) << _U(1)), taken[w])
        ones, twos, fours, over = (np.zeros(len(q), _U) for _ in range(4))
        for p in range(0, 64, 2):
            fq = fps[q]
            x = planes[p, w] ^ (_U(0) - ((fq >> _U(p)) & _U(1)))
            y = planes[p + 1, w] ^ (_U(0) - ((fq >> _U(p + 1)) & _U(1)))
            half = ones ^ x
            carry = (ones & x) | (half & y)
            ones = half ^ y
            carry, twos = twos & carry, twos ^ carry
            carry, fours = fours & carry, fours ^ carry
            over |= carry
            if p % 8 == 6:
                if radius == 4:
                    beyond = over | (fours & (ones | twos))
                else:
                    beyond = over.copy()
                    for count in range(radius + 1, 8):
                        beyond |= (ones if count & 1 else ~ones) & (twos if count & 2 else ~twos) & (fours if count & 4 else ~fours)
                wanted = wanted & ~beyond
                live = np.flatnonzero(wanted)
                if len(live) < len(q):
                    q, w, wanted, ones, twos, fours, over = (a[live] for a in (q, w, wanted, ones, twos, fours, over))
                if not len(q):
                    break
        if len(q):
            k, lane = np.nonzero(np.unpackbits(wanted.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            left.append(q[k])
            right.append(slot[w[k] * 64 + lane])
        at = to
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index in each one's component, for n nodes and index pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, root):
            return root
        root = new


def _group_links(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key = rest_fp = None

        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            # equal fingerprints are one class already, so each stands once in a group
            a, b = close_pairs(fp, key, radius)
            root = local_roots(len(fp), a, b)
            moved = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[root[moved]].view(np.int64))], ["a", "b"])

        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(_U)
            if rest_key is not None:
                key, fp = np.concatenate([rest_key, key]), np.concatenate([rest_fp, fp])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            if cut:
                yield links(key[:cut], fp[:cut])
            rest_key, rest_fp = key[cut:], fp[cut:]
        if rest_key is not None and len(rest_key):
            yield links(rest_key, rest_fp)

    return compare


def fingerprint_links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links that connect just the fingerprints (column fp, each once) that chains of pairs within ``radius`` bits connect."""
    if not 0 < radius < 8:
        raise ValueError("radius must be from 1 to 7")
    n = choose_blocks(distinct.count(), radius)
    keys = []
    for i, combo in enumerate(combinations(_blocks(n), n - radius)):
        parts = [F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1)) for start, width in combo]
        keys.append(F.xxhash64(F.lit(i), *parts))
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    crowded = keyed.groupBy("key").count().where(F.col("count") > CHUNK).select("key", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
    mates = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(j, chunk) * F.col("chunks") + F.greatest(j, chunk))
    )
    dealt = keyed.join(crowded, "key", "left").select("fp", F.explode(mates).alias("pair"), "key").select(F.xxhash64("key", "pair").alias("key"), "fp")
    # a hash of key and pair of chunks is the group; two groups that share it are merely compared together
    return dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_group_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(id, fingerprint, component_id): a row for each row of ``docs``; component_id is the smallest id that links reach."""
    prints = stored(fingerprints(docs, id_col, text_col, words), "simhash")
    distinct = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    roots = components(fingerprint_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # roots of more than one fingerprint are few; the others are their own
    of_print = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
