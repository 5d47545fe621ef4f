"""Repeated passages found by content-defined line chunks (operator 7).

Lines: what newlines separate, and, as paragraphs often stand on one line, the
sentences of it.  A rolling hash over the hashes of the last two lines says
where a chunk ends, so the same passage is cut the same way wherever it stands,
but for its edges; a line of 50 words or more is a chunk of its own.  A chunk
is repeated if its bytes also stand earlier: in the document with the smallest
id that has it, where it stays, or before in the same document.  A chunk of few
words would be repeated by chance; it goes only with a neighbour: if it and the
chunk before, or after, are repeated together.

The first and last chunk of a passage also hold lines of the document around
it, so there are runs as well: from each line on, and up to each line, the least
consecutive lines that have 50 words.  All runs within a passage depend on
nothing outside it, and those of a passage of 50 words or more cover all of its
lines, so it goes as a whole, however it is cut into lines.  Chunks and runs are
called pieces below; what goes are the lines of the repeated ones.

A first scan counts the 64-bit hashes of all pieces, already added up within
each slice of texts.  A bitmap of fixed size of the repeated hashes then lets
the second scan send hardly more than the places of the repeated pieces, with a
second key: a 64-bit polynomial over the BLAKE2b digests of the lines, so each
line is digested once, however many pieces it is in.  Sorted by both keys, each
place meets the first one; for hashes that have more than a bounded share of all
pieces an aggregation gives it, which no frequent line can skew.

Before a piece goes, its bytes are compared, be it a chunk or a run.  Within a
document that is done on the spot.  As pieces overlap, their bytes would be many
times the text; so those pieces of a document that overlap, and whose first
places stand in one document and as far apart, are joined to passages, and each
document sends the bytes of its passages once.  A passage goes only if all
documents that have it from one place have the bytes that stand there.

Words are what blanks separate; of text in scripts without blanks (three-byte
characters from U+3000 to U+DFFF) two characters count as a word.

Defined results: null and empty texts stay as they are, and so does a text
without repeated pieces, byte for byte; rows of one id and text are one
document; a row with a null id loses what any document with an id has, and keeps
what only such rows have; of documents with one piece the smallest id keeps it;
all other columns are kept, whatever their names, but for one that has the name
of the added column, which it replaces; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgraph.llm.batches import fresh
from symgraph.llm.bytescan import Texts, _mix, _tables, byte_set, hashes, prefix_sums, slices
from symgraph.storage import stored

_U = np.uint64

#: Words from which a line is a chunk of its own and that a run has, and words that a chunk (with its neighbour) must have to be removed.
LONG_LINE, LEAST_WORDS = 50, 10
#: A chunk ends where the rolling hash has no bit of this: every second line on average.
_END_MASK = _U(1)
#: The bitmap of repeated hashes; its size does not depend on the data. It goes to the driver in blocks of so many words.
BITMAP_BITS, BLOCK_WORDS = 25, 1 << 14
#: A hash with more than this share of all pieces is hot, so there are no more than so many of them.
HOT_SHARE = 4096
#: Passages are compared in blocks that end at multiples of so many bytes of the text where they stand first.
BLOCK_BYTES = 1024

_STOP = byte_set((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))
#: First bytes of characters in scripts without blanks.
_UNSPACED = byte_set((0xE3, 0xED))


def _lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and stops of the lines, and where each text's begin."""
    data = texts.data
    separator = data == 10
    before = np.flatnonzero(data[1:] == 32)
    separator[before[_STOP[data[before]]] + 1] = True
    return texts.runs(~separator)


#: (prefix sums, starts, stops) to a 64-bit hash of each span.
Hash = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Bytes to 8 bytes.
Digest = Callable[[bytes], bytes]


def blake(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


class _Chunks:
    """Chunks of some texts: words, and where each text's begin; bytes of the lines, and where each text's begin; first and last line of each piece, chunks before runs."""

    def __init__(self, texts: Texts, hashes: Hash = hashes):
        data = texts.data
        first, last, at = _lines(texts)
        self.hashes = hashes
        self.sums = prefix_sums(data)
        self.line_at, self.line_starts, self.line_stops = at, first, last
        n = len(first)
        if not n:
            self.words, self.at = np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
            self.piece_first = self.piece_last = np.zeros(0, np.int64)
            return
        blank = (data - np.uint8(9) < 5) | (data == 32)  # 9 to 13: what is below 9 comes out above
        word = ~blank
        word[1:] &= blank[:-1]
        inside = lambda at: np.searchsorted(at, last) - np.searchsorted(at, first)
        # a line that starts in the middle of a run of blanks or of text counts its first word too
        words = inside(np.flatnonzero(word)) + (~word[first] & ~blank[first])
        if data.max() >= 0xE3 and (unspaced := _UNSPACED[data]).any():
            words = words + inside(np.flatnonzero(unspaced)) // 2
        h = hashes(self.sums, first, last)
        begins = np.zeros(n, bool)
        begins[at[:-1][np.diff(at) > 0]] = True
        before = np.where(begins, _U(0), np.concatenate([[_U(0)], h[:-1]]))
        rolled = _mix(before * _U(0x9E3779B97F4A7C15) + h)
        long = words >= LONG_LINE
        ends = ((rolled & _END_MASK) == 0) | long
        ends[:-1] |= begins[1:] | long[1:]
        ends[-1] = True
        end = np.flatnonzero(ends)
        begin = np.concatenate([[0], end[:-1] + 1])
        total = np.concatenate([[0], np.cumsum(words)])
        self.words = total[end + 1] - total[begin]
        self.at = np.searchsorted(begin, at)
        line = np.arange(n)
        text_first, text_end = np.repeat(at[:-1], np.diff(at)), np.repeat(at[1:], np.diff(at))
        ahead = np.searchsorted(total, total[:-1] + LONG_LINE) - 1
        back = np.searchsorted(total, total[1:] - LONG_LINE, side="right") - 1
        # a run of one line is a chunk already
        on, up = np.flatnonzero((ahead < text_end) & (ahead > line)), np.flatnonzero((back >= text_first) & (back < line))
        run = np.unique(np.concatenate([on * n + ahead[on], back[up] * n + up]))
        self.piece_first, self.piece_last = np.concatenate([begin, run // n]), np.concatenate([end, run % n])

    def checks(self, data: bytes, digest: Digest, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A polynomial over the digests of lines and the hashes of what stands between them, for each run of lines (first, last)."""
        n = len(self.line_starts)
        if not len(begin):
            return np.zeros(0, np.int64)
        powers, inverses = (t[: 2 * n] for t in _tables(2 * n)[:2])
        terms = np.zeros(2 * n, _U)
        asked = np.flatnonzero(np.cumsum(np.bincount(begin, minlength=n + 1) - np.bincount(end + 1, minlength=n + 1))[:n])
        terms[2 * asked] = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(self.line_starts[asked].tolist(), self.line_stops[asked].tolist(), strict=True)]), _U)
        terms[1:-1:2] = self.hashes(self.sums, self.line_stops[:-1], self.line_starts[1:])
        sums = np.zeros(2 * n + 1, _U)
        np.cumsum(terms * powers, out=sums[1:])
        return _mix((sums[2 * end + 1] - sums[2 * begin]) * inverses[2 * begin]).view(np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(piece, hash, first line, last line) of what may be repeated: chunks, for short ones the pairs with their neighbours, and runs."""
        n = len(self.words)
        text = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        full = np.flatnonzero(self.words >= LEAST_WORDS)
        short = np.flatnonzero(self.words < LEAST_WORDS)
        left = short[short > 0]
        left = left[(text[left] == text[left - 1]) & (self.words[left] + self.words[left - 1] >= LEAST_WORDS)]
        right = short[short < n - 1]
        right = right[(text[right] == text[right + 1]) & (self.words[right] + self.words[right + 1] >= LEAST_WORDS)]
        run = np.arange(n, len(self.piece_first))
        piece = np.concatenate([full, left, right, run])
        first = self.piece_first[np.concatenate([full, left - 1, right, run])]
        last = self.piece_last[np.concatenate([full, left, right + 1, run])]
        # what goes is part of the key: a pair that stands for its first chunk is not one for its second
        kind = np.repeat(np.arange(4, dtype=_U) * _U(0xD1342543DE82EF95), [len(full), len(left), len(right), len(run)])
        return piece, _mix(self.hashes(self.sums, self.line_starts[first], self.line_stops[last]) + kind), first, last


class _Places:
    """The pieces of some rows whose hashes are in the bitmap: row, first and last line that go, bytes that are compared, hash, check, and whether the same bytes stood before in the row."""

    def __init__(self, texts: Texts, hashes: Hash, digest: Digest, keep: np.ndarray):
        found = _Chunks(texts, hashes)
        piece, self.hash, first, last = found.keys()
        place = (self.hash >> _U(64 - BITMAP_BITS)).astype(np.int64)
        sent = np.flatnonzero((keep[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
        piece, self.hash, first, last = piece[sent], self.hash[sent], first[sent], last[sent]
        begin, end = found.piece_first[piece], found.piece_last[piece]
        self.row = np.searchsorted(found.line_at, begin, side="right") - 1
        self.begin, self.end = begin - found.line_at[self.row], end - found.line_at[self.row]
        data = texts.data.tobytes()
        self.check = found.checks(data, digest, first, last)
        starts, stops = found.line_starts[first], found.line_stops[last]
        self.start, self.stop = starts - texts.offsets[self.row], stops - texts.offsets[self.row]
        # just those whose hash, mixed with the row, is there twice can stand again
        mixed = _mix(self.hash + self.row.astype(_U) * _U(0x9E3779B97F4A7C15))
        order = np.argsort(mixed)
        twin = np.zeros(len(order), bool)
        twin[1:] = mixed[order[1:]] == mixed[order[:-1]]
        twin[:-1] |= twin[1:].copy()
        order = order[twin]
        order = order[np.lexsort((piece[order], self.check[order], self.hash[order], self.row[order]))]
        again = np.ones(len(order), bool)
        again[:1] = False
        for x in (self.row, self.hash, self.check):
            again[1:] &= x[order[1:]] == x[order[:-1]]
        self.again = np.zeros(len(piece), bool)
        for at in np.flatnonzero(again).tolist():
            k, before = order[at], order[at - 1]
            self.again[k] = data[starts[k] : stops[k]] == data[starts[before] : stops[before]]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == _U else x.astype(np.int64))


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _count(source: DataFrame, hashes: Hash) -> DataFrame:
    """(hash, n): of each slice of texts and hash, how many pieces have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                h, n = np.unique(_Chunks(Texts.of(batch.column(0).slice(lo, hi - lo)), hashes).keys()[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([_long(h), _int(n)], ["hash", "n"])

    return source.select("text").mapInArrow(run, "hash long, n int")


def _places(source: DataFrame, kind: str, hashes: Hash, digest: Digest, keep, hot) -> DataFrame:
    """(id, print, begin, end, start, stop, hash, check, hot, again) of the pieces whose hashes are in the broadcast bitmap; those that stand again in a row have had their bytes compared."""
    names = ["id", "print", "begin", "end", "start", "stop", "hash", "check", "hot", "again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                found = _Places(Texts.of(part.column(2)), hashes, digest, keep.value)
                rows = pa.array(found.row)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(rows), part.column(1).take(rows), _int(found.begin), _int(found.end), _int(found.start), _int(found.stop), _long(found.hash), _long(found.check),
                    pa.array(np.isin(found.hash.view(np.int64), hot.value)), pa.array(found.again),
                ], names)

    return source.mapInArrow(run, f"id {kind}, print long, begin int, end int, start int, stop int, hash long, check long, hot boolean, again boolean")


def _passages(later: DataFrame, kind: str) -> DataFrame:
    """(id, print, start, first_id, first_print, first_start, length, gone): of places with their first places, the passages that overlapping ones as far from their first places join to, and the lines that go with each."""
    names = ["id", "print", "start", "first_id", "first_print", "first_start", "length", "gone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number = lambda name: batch.column(name).to_numpy()  # noqa: B023, E731
            code = lambda name: batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy()  # noqa: B023, E731
            begin, end, start, stop = (number(x).astype(np.int64) for x in ("begin", "end", "start", "stop"))
            shift = number("first_start") - start
            same = [code("id"), number("print"), code("first_id"), number("first_print"), shift]
            order = np.lexsort((start, *same))
            new = np.zeros(len(order), bool)
            new[:1] = True
            for x in same:
                new[1:] |= x[order[1:]] != x[order[:-1]]
            # the furthest stop so far of the same group: groups are moved apart
            group = np.cumsum(new) << 32
            far = np.maximum.accumulate(stop[order] + group)
            new[1:] |= start[order[1:]] + group[1:] > far[:-1]
            at = np.flatnonzero(new)
            length = (far - group)[np.append(at[1:], len(order)) - 1] - start[order[at]]
            passage, lines = np.cumsum(new) - 1, (begin << 32 | end)[order]
            kept = np.lexsort((lines, passage))
            kept = kept[np.append(True, (lines[kept[1:]] != lines[kept[:-1]]) | (passage[kept[1:]] != passage[kept[:-1]]))]
            gone = pa.ListArray.from_arrays(_int(np.searchsorted(passage[kept], np.arange(len(at) + 1))), pa.array(lines[kept]))
            rows = pa.array(order[at])
            own = [batch.column(x).take(rows) for x in ("id", "print", "start", "first_id", "first_print", "first_start")]
            yield pa.RecordBatch.from_arrays([*own, _int(length), gone], names)

    return later.mapInArrow(run, f"id {kind}, print long, start int, first_id {kind}, first_print long, first_start int, length int, gone array<long>")


def _blocks(passages: DataFrame) -> DataFrame:
    """(passage, id, print, start, first_id, first_print, first_start, length, span) of the blocks of passages. However many documents share a text, most of its blocks are the same."""
    block = F.explode(F.sequence(F.expr(f"first_start div {BLOCK_BYTES}"), F.expr(f"(first_start + length - 1) div {BLOCK_BYTES}")))
    found = passages.withColumn("block", block)
    at = F.greatest("first_start", F.col("block") * BLOCK_BYTES).cast("int")
    to = F.least(F.col("first_start") + F.col("length"), (F.col("block") + 1) * BLOCK_BYTES).cast("int")
    own = ["passage", "id", "print"]
    found = found.select(*own, (F.col("start") + at - F.col("first_start")).alias("start"), "first_id", "first_print", at.alias("first_start"), (to - at).alias("length"))
    return found.withColumn("span", F.xxhash64("first_id", "first_print", "first_start", "length"))


def _cut(texts: DataFrame) -> DataFrame:
    """(span, bytes) of texts (text, cuts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                own, cuts = Texts.of(part.column(0)), part.column(1)
                data, found = own.data.tobytes(), cuts.flatten()
                span, start, length = (x.to_numpy() for x in found.flatten())
                row = np.repeat(np.arange(len(cuts)), cuts.value_lengths().to_numpy())
                starts = own.offsets[row] + start
                stops = np.minimum(starts + length, own.offsets[row + 1])
                once = {(s, data[a:b]) for s, a, b in zip(span.tolist(), starts.tolist(), stops.tolist(), strict=True)}
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in once], pa.int64()), pa.array([x for _, x in once], pa.binary())], ["span", "bytes"])

    return texts.mapInArrow(run, "span long, bytes binary")


def _bitmap(repeated: DataFrame) -> np.ndarray:
    """The bitmap of the repeated hashes' first bits. Its bytes, whatever the data, are all that reaches the driver."""
    place = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    words = repeated.groupBy(F.shiftright(place, 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(hash, 39) & 31 as int))")).alias("bits"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            word, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint32)
            for block in np.unique(word // BLOCK_WORDS).tolist():
                own = word // BLOCK_WORDS == block
                blocks.setdefault(block, np.zeros(BLOCK_WORDS, "<u4"))[word[own] % BLOCK_WORDS] = bits[own]
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([x.tobytes() for x in blocks.values()], pa.binary())], ["block", "bits"])

    out = np.zeros(1 << (BITMAP_BITS - 5), "<u4")
    for block, bits in words.repartition(F.floor(F.col("word") / BLOCK_WORDS)).mapInArrow(pack, "block long, bits binary").collect():
        out[block * BLOCK_WORDS : (block + 1) * BLOCK_WORDS] = np.frombuffer(bits, "<u4")
    return out.view(np.uint8)


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: Hash = hashes, digest: Digest = blake) -> DataFrame:
    """(id, print, pieces): first (upper 32 bits) and last lines of the pieces to remove, for each document that has any; print is xxhash64 of id and text.

    ``hashes`` and ``digest`` may be any functions of the bytes; pieces of different bytes with equal keys remove nothing.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("print"), text.alias("text"))
    doc, key = ["id", "print"], ["hash", "check"]
    context = docs.sparkSession.sparkContext
    repeated = stored(_count(source, hashes).groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1"), "repeated")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    hot = repeated.where(F.col("n") * HOT_SHARE > total).select("hash").collect()  # fewer than HOT_SHARE rows
    keep, hot = context.broadcast(_bitmap(repeated)), context.broadcast(np.array([r.hash for r in hot], np.int64))
    # keys are as good as random, so a dictionary of them is begun in vain
    places = stored(_places(source, kind, hashes, digest, keep, hot), "places", **{f"parquet.enable.dictionary#{x}": "false" for x in key})
    once = places.where("NOT again")
    place = [F.col(x) for x in (*doc, "begin", "end", "start", "stop")]
    firsts = Window.partitionBy(*key).orderBy(F.col("id").asc_nulls_last(), "print", "start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = once.where("NOT hot").select(*place, *(F.first(x).over(firsts).alias(f"first_{x}") for x in (*doc, "start")))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct(*doc, "start")))
    often = once.where("hot").join(once.where("hot").groupBy(*key).agg(least.alias("least")), key).select(*place, *(F.col(f"least.{x}").alias(f"first_{x}") for x in (*doc, "start")))
    later = rare.unionByName(often).where(~F.col("id").eqNullSafe(F.col("first_id"))).repartition("print").sortWithinPartitions("print")
    passage = F.xxhash64(*doc, "start", "first_id", "first_print", "first_start", "length")
    passages = stored(_passages(later, kind).withColumn("passage", passage), "passages")
    blocks = _blocks(passages)
    # a document sends what others have of it once, however many they are
    theirs = blocks.select(F.col("first_id").alias("id"), F.col("first_print").alias("print"), "span", F.col("first_start").alias("start"), "length").distinct()
    cuts = blocks.select(*doc, "span", "start", "length").unionByName(theirs).groupBy(*doc).agg(F.collect_set(F.struct("span", "start", "length")).alias("cuts"))
    cut = _cut(source.join(cuts.withColumnsRenamed({"id": "of", "print": "of_print"}), (F.col("print") == F.col("of_print")) & F.col("id").eqNullSafe(F.col("of"))).select("text", "cuts"))
    different = stored(cut.distinct().groupBy("span").count().where("count > 1").select("span"), "different")
    same = passages if different.isEmpty() else passages.join(blocks.join(different, "span", "left_semi").select("passage"), "passage", "left_anti")
    lines = F.shiftleft(F.col("begin").cast("long"), 32).bitwiseOR(F.col("end").cast("long"))
    gone = same.select(*doc, "gone").unionByName(places.where("again").select(*doc, F.array(lines).alias("gone")))
    return gone.groupBy(*doc).agg(F.flatten(F.collect_set("gone")).alias("pieces"))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed: str = "n_removed", hashes: Hash = hashes, digest: Digest = blake) -> DataFrame:
    """``docs`` with the lines of repeated pieces removed from the texts, and the number of them in the column ``removed``; a column of that name is replaced."""
    docs = docs.drop(removed)
    own_id, own_print, id_, print_, pieces_ = (fresh(docs, x) for x in ("own_id", "own_print", "id", "print", "pieces"))
    flags = repeated_chunks(docs, id_col, text_col, hashes, digest).select(F.col("id").alias(id_), F.col("print").alias(print_), F.col("pieces").alias(pieces_))
    own = docs.withColumns({own_print: F.xxhash64(F.col(id_col), F.col(text_col).cast("string")), own_id: F.col(id_col)})
    joined = own.join(flags, (F.col(own_print) == F.col(print_)) & F.col(own_id).eqNullSafe(F.col(id_)), "left").select(*docs.columns, pieces_)
    position = docs.columns.index(text_col)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, pieces = batch.column(position), batch.column(batch.num_columns - 1)
            counts = np.zeros(batch.num_rows, np.int32)
            new = {}
            for i in np.flatnonzero(pieces.is_valid().to_numpy(zero_copy_only=False)).tolist():
                own = Texts.of(texts.slice(i, 1))
                starts = np.append(_lines(own)[0], len(own.data))
                piece = pieces[i].values.to_numpy()
                cover = np.bincount(piece >> 32, minlength=len(starts)) - np.bincount((piece & 0xFFFFFFFF) + 1, minlength=len(starts))
                gone = np.cumsum(cover[:-1]) > 0
                stays = np.concatenate([np.ones(starts[0], bool), np.repeat(~gone, np.diff(starts))])
                text = own.data[stays].tobytes().decode()
                new[i] = text.rstrip(" \n") if gone[-1] else text
                counts[i] = gone.sum()
            if new:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(new)] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([new[i] for i in sorted(new)], texts.type))
            columns = [texts if k == position else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], [*batch.schema.names[:-1], removed])

    return joined.mapInArrow(rewrite, T.StructType([*docs.schema.fields, T.StructField(removed, T.IntegerType())]))
