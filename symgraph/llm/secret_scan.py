"""Secret scan with a recursive decoding worklist (operator 10).

A text is a first layer.  Each layer is scanned for secrets and unwrapped: runs
of percent escapes, Unicode escapes and character references, base64 runs and
compressed bytes become further layers, which are scanned and unwrapped in turn
until nothing new comes up.  A layer seen before is not taken up again, so
cyclic encodings end.  Every layer knows for each of its code points the range
of the original text it came from; a secret found deep down is reported there.

Defined results: a null or empty text has no spans; repeated rows are each
reported; other columns of the input are ignored; an empty table gives an empty
table; a null id stays null.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: The kinds in the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # as long runs of [0-9a-f]+, without the short ones

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_BASE64_LINES = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{4,})+={0,2}")

_STRAY = re.compile("[\udc80-\udcff]")

#: What a text must hold (RE2, whole column at once) to be scanned or unwrapped at all.
_NEEDS_SCAN = r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]|[0-9a-f]{32}"
_NEEDS_UNWRAP = r"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#[xX0-9]|[A-Za-z0-9+/_-]{16}"

#: Expanded bytes are taken in windows of so many, each with the end of the one before.
WINDOW, OVERLAP = 64 << 20, 1 << 20
#: The share of its characters that text has at least, of those that print or are blank or invisible.
TEXT_SHARE = 0.75
_HARMLESS = frozenset("\t\n\v\f\r\x1b\0\xa0\xad\u200b\u200c\u200d\u200e\u200f\u2028\u2029\u2060\ufeff")

SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets that stand in ``text`` itself, in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _decompressor(data: bytes):
    """A new decompressor for compressed bytes, or None if they are not compressed."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    return None


def _blocks(data: bytes) -> Iterator[bytes]:
    """What compressed bytes hold, member after member, in blocks; it ends where they are damaged."""
    try:
        if data[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
            while block := reader.read(OVERLAP):
                yield block
            return
        while (member := _decompressor(data)) is not None:
            while not member.eof:
                block = member.decompress(data, OVERLAP)
                data = member.unconsumed_tail if hasattr(member, "unconsumed_tail") else b""
                if block:
                    yield block
                elif not data and not member.eof:
                    return  # cut short
            data = member.unused_data.lstrip(b"\0")
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
        return
    except Exception as error:  # zstandard's own error class
        if type(error).__name__ != "ZstdError":
            raise


def _expand(data: bytes) -> Iterator[bytes]:
    """What compressed bytes hold, in overlapping windows; nothing if they are not compressed."""
    held, size, fresh = [], 0, False
    for block in _blocks(data):
        held.append(block)
        size, fresh = size + len(block), True
        if size >= WINDOW:
            window = b"".join(held)
            yield window
            held, size, fresh = [window[-OVERLAP:]], min(OVERLAP, len(window)), False
    if fresh:
        yield b"".join(held)


def _readable(data: bytes) -> str | None:
    """Bytes as text, with one U+FFFD for each byte that is no UTF-8, or None if they are hardly text and hold no secret."""
    text = data.decode(errors="surrogateescape")
    if not text.isprintable():
        good = sum(n for c, n in Counter(text).items() if c.isprintable() or c in _HARMLESS)
        text = _STRAY.sub("\ufffd", text)
        if good < TEXT_SHARE * len(text) and not base_spans(text):
            return None
    return text or None


class _Layer:
    """A text with, for each code point, the range of the original that it came from."""

    def __init__(self, text: str, first: np.ndarray, last: np.ndarray):
        self.text, self.first, self.last = text, first, last

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return int(self.first[start:end].min()), int(self.last[start:end].max())


def _decoded_bytes(data: bytes, first: np.ndarray, last: np.ndarray, seen: frozenset = frozenset()) -> Iterator[_Layer]:
    """Layers of bytes each of which has a range; compressed bytes are expanded and then all have the whole range."""
    expanded = False
    print_ = hashlib.sha256(data).digest()
    if print_ not in seen:  # bytes may expand to themselves
        low, high = first.min(), last.max()
        for inner in _expand(data):
            expanded = True
            yield from _decoded_bytes(inner, np.broadcast_to(low, len(inner)), np.broadcast_to(high, len(inner)), seen | {print_})
    if expanded or (text := _readable(data)) is None:
        return
    if len(text) == len(data):
        yield _Layer(text, first, last)
        return
    # a stray byte stands as one character
    strict = data.decode(errors="surrogateescape")
    codes = np.frombuffer(strict.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    lengths[(codes >= 0xDC80) & (codes <= 0xDCFF)] = 1
    ends = np.cumsum(lengths)
    yield _Layer(text, first[ends - lengths], last[ends - 1])


def _substituted(layer: _Layer, pieces: list[tuple[int, int, _Layer]]) -> _Layer:
    """``layer`` with some spans of it replaced by layers."""
    texts, firsts, lasts, at = [], [], [], 0
    for start, end, new in pieces:
        for text, first, last in ((layer.text[at:start], layer.first[at:start], layer.last[at:start]), (new.text, new.first, new.last)):
            texts.append(text)
            firsts.append(first)
            lasts.append(last)
        at = end
    return _Layer("".join(texts) + layer.text[at:], np.concatenate([*firsts, layer.first[at:]]), np.concatenate([*lasts, layer.last[at:]]))


def _percent(layer: _Layer) -> Iterator[_Layer]:
    pieces = []
    for m in _PERCENT.finditer(layer.text):
        data = bytes.fromhex(m[0].replace("%", ""))
        at = m.start() + 3 * np.arange(len(data))
        windows = _decoded_bytes(data, layer.first[at], layer.last[at + 2])
        if (new := next(windows, None)) is not None:
            pieces.append((m.start(), m.end(), new))
            yield from windows
    if pieces:
        yield _substituted(layer, pieces)


def _escapes(layer: _Layer) -> Iterator[_Layer]:
    units = []
    for m in _ESCAPE.finditer(layer.text):
        digits = next(g for g in m.groups() if g)
        code = int(digits, 10 if m[6] else 16)
        if code < 0x110000:
            units.append((m.start(), m.end(), code))
    pieces, k = [], 0
    while k < len(units):
        start, end, code = units[k]
        if 0xD800 <= code < 0xDC00 and k + 1 < len(units) and units[k + 1][0] == end and 0xDC00 <= units[k + 1][2] < 0xE000:
            code, end, k = 0x10000 + ((code - 0xD800) << 10) + units[k + 1][2] - 0xDC00, units[k + 1][1], k + 1
        k += 1
        if not 0xD800 <= code < 0xE000:
            low, high = layer.origin(start, end)
            pieces.append((start, end, _Layer(chr(code), np.array([low]), np.array([high]))))
    if pieces:
        yield _substituted(layer, pieces)


def _base64(layer: _Layer) -> Iterator[_Layer]:
    found = [*_BASE64.finditer(layer.text), *(_BASE64_LINES.finditer(layer.text) if "\n" in layer.text else ())]
    for m in found:
        kept = np.array([m.start() + i for i, c in enumerate(m[0]) if c not in "=\r\n"])
        run = "".join(c for c in m[0] if c not in "=\r\n")
        if len(run) % 4 == 1:
            continue
        try:
            data = base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))
        except (binascii.Error, ValueError):
            continue
        at = np.arange(len(data))
        first, last = at * 8 // 6, np.minimum((at * 8 + 7) // 6, len(run) - 1)
        yield from _decoded_bytes(data, layer.first[kept[first]], layer.last[kept[last]])


def all_spans(text: str) -> tuple[set[tuple[int, int, int]], int]:
    """(start, kind, end) of the secrets of ``text`` and of all layers in it, and the number of layers."""
    at = np.arange(len(text))
    seen, found = {hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()}, set()
    # layers are made one at a time, so that windows of a long one are not held together
    work, layers = [iter([_Layer(text, at, at + 1)])], 0
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layers:
            # the same text from another place is another finding; the same text from the same place is a cycle
            key = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass") + b"\0%d:%d" % (layer.first.min(), layer.last.max())).digest()
            if key in seen:
                continue
            seen.add(key)
        layers += 1
        for start, kind, end in base_spans(layer.text):
            low, high = layer.origin(start, end)
            found.add((low, kind, high))
        work.append(chain.from_iterable(map(lambda unwrap, layer=layer: unwrap(layer), (_percent, _escapes, _base64))))
    return found, layers


def _joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_NOTHING = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 1)


def scan_text(text: str) -> tuple:
    """The columns of ``SCHEMA`` for one text."""
    base = base_spans(text)
    found, layers = all_spans(text)
    counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
    return *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(found | set(base))), layers


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and the columns of ``SCHEMA``.

    Row by row, so the job has no shuffle: a hot source or a lost executor only
    costs its own tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            need = pc.or_(pc.match_substring_regex(texts, _NEEDS_SCAN), pc.match_substring_regex(texts, _NEEDS_UNWRAP)).fill_null(False)
            rows = [_NOTHING] * batch.num_rows
            for i in np.flatnonzero(need.to_numpy(zero_copy_only=False)).tolist():
                rows[i] = scan_text(texts[i].as_py())
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [id_col, *names])

    return docs.select(id_col, docs[text_col].cast("string").alias("__text")).mapInArrow(scan, f"`{id_col}` {kind}, {SCHEMA}")
