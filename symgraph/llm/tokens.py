"""Token ids of text columns, by a byte-level BPE tokenizer whose file is a parameter.

A byte-level BPE looks at one pre-token (a word with the blank before it, a
number, some signs, a run of white space) at a time, and a corpus repeats its
pre-tokens.  So the pre-tokens of a slice of texts are found with a few numpy
passes over its bytes, hashed, and looked up; only those not met before go to
the tokenizer, all in one call.  Texts with characters outside ASCII and the
Latin letters up to U+024F, and tokenizers that pre-tokenise in another way,
are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from symgraph.llm.bytescan import Texts, byte_set, hashes, prefix_sums, ragged, slices

_U = np.uint64

#: Slots of a task's pre-token table, and ids kept before it starts anew; they bound its memory.
_SLOT_BITS, _MOST_IDS = 21, 1 << 23

_LETTER, _NUMBER, _SPACE, _SIGN, _ODD = 1, 2, 3, 4, 5
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[:32] = _CLASS[127] = _ODD
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _NUMBER
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[0x80:0xC0] = _LETTER  # after one of the lead bytes below
_CLASS[0xC0:] = _ODD
_CLASS[0xC3:0xCA] = _LETTER  # U+00C0 to U+024F: all letters but two
_CONTINUES = byte_set((0x80, 0xBF))
# What the pre-tokeniser splits off after an apostrophe.
_CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The path of one of the public tokenizer files installed beside Python."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pretokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pre-tokens start, where each text's begin (n + 1 entries), and which texts have characters this function does not know."""
    data, offsets = texts.data, texts.offsets
    kinds = _CLASS[data]
    start = np.ones(len(data), bool)
    start[1:] = kinds[1:] != kinds[:-1]
    full = offsets[:-1][np.diff(offsets) > 0]
    first = np.zeros(len(data), bool)
    first[full] = True
    start |= first
    # the last of some white space goes with what follows if it is a blank, and stands alone if not
    follows = np.flatnonzero(start & ~first & (kinds != _SPACE))
    follows = follows[kinds[follows - 1] == _SPACE]
    start[follows - 1] = True
    start[follows[data[follows - 1] == 32]] = False
    marks = np.flatnonzero(data == 39)
    for at in marks[(start & (data == 39))[marks]].tolist():  # an apostrophe that starts a pre-token
        stop = int(offsets[np.searchsorted(offsets, at, side="right")])
        after = data[at + 1 : min(at + 3, stop)].tobytes()
        for ending in _CONTRACTIONS:
            if after.startswith(ending):
                start[at + 1] = False
                if at + 1 + len(ending) < stop:
                    start[at + 1 + len(ending)] = True
                break
    odd = kinds == _ODD
    wide = np.flatnonzero(data >= 0x80)
    if len(wide):
        lead = ~_CONTINUES[data[wide]]
        before = np.where(wide > 0, data[np.maximum(wide - 1, 0)], 0)
        bad = ~lead & ((before < 0xC3) | (before > 0xC9) | (before == 0xC3) & ((data[wide] == 0x97) | (data[wide] == 0xB7)))
        odd[wide[bad]] = True
    unknown = np.zeros(len(texts), bool)
    unknown[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, offsets), unknown


class _Encoder:
    """A tokenizer with a table of the pre-tokens it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        before = config.get("pre_tokenizer") or {}
        model = config.get("model") or {}
        self.known = (
            before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not config.get("normalizer")
            and model.get("type") == "BPE" and not model.get("dropout") and self._ids("\n") == self._ids("a\nb")[1:-1] and len(self._ids("\n")) == 1
        )
        # ids of two bytes where the vocabulary allows it
        self.kind = "<u2" if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else "<u4"
        self._start_anew()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids  # the same ids, without offsets

    def _start_anew(self) -> None:
        self.keys = np.zeros(1 << _SLOT_BITS, _U)
        self.place = np.zeros(1 << _SLOT_BITS, np.int32)
        self.count = np.zeros(1 << _SLOT_BITS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def _keep(self, ids: np.ndarray) -> int:
        at = self.used
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), self.kind)])
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _encode_new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of some pre-tokens are kept, and how many they are."""
        blank = np.array([not w.strip() for w in words])
        place, count = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        for i in np.flatnonzero(blank).tolist():
            ids = np.array(self._ids(words[i].decode()), self.kind)
            place[i], count[i] = self._keep(ids), len(ids)
        # a line for each; no pre-token but white space holds the newline's id
        rest = np.flatnonzero(~blank)
        if len(rest):
            ids = np.array(self._ids(b"\n".join([words[i] for i in rest.tolist()] + [b"."]).decode()), self.kind)
            ends = np.flatnonzero(ids == self._ids("\n")[0])
            begins = np.concatenate([[0], ends[:-1] + 1])
            place[rest], count[rest] = self._keep(ids) + begins, ends - begins
        return place, count

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two slots where each hash may be."""
        return (h >> _U(64 - _SLOT_BITS)).astype(np.int64), (h & _U((1 << _SLOT_BITS) - 1)).astype(np.int64)

    def encode(self, texts: Texts, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text's begin (n + 1 entries), by their pre-tokens. For texts whose characters are all known."""
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        if self.used > _MOST_IDS:
            self._start_anew()
        stops = np.append(starts[1:], len(texts.data))
        h = hashes(prefix_sums(texts.data), starts, stops)
        slot, _ = self._slots(h)
        place, count = self.place[slot], self.count[slot]
        missed = np.flatnonzero((self.keys[slot] != h) | (count == 0))
        _, slot = self._slots(h[missed])
        other = (self.keys[slot] == h[missed]) & (self.count[slot] > 0)
        place[missed[other]], count[missed[other]] = self.place[slot[other]], self.count[slot[other]]
        missed = missed[~other]
        if len(missed):
            own, one, back = np.unique(h[missed], return_index=True, return_inverse=True)
            data, rows = texts.data.tobytes(), missed[one]
            new_place, new_count = self._encode_new([data[a:b] for a, b in zip(starts[rows].tolist(), stops[rows].tolist(), strict=True)])
            place[missed], count[missed] = new_place[back], new_count[back]
            into, slot = self._slots(own)
            into = np.where(self.count[into] == 0, into, slot)
            into, last = np.unique(into, return_index=True)
            self.keys[into], self.place[into], self.count[into] = own[last], new_place[last], new_count[last]
        count = count.astype(np.int64)
        ids = self.pool[ragged(place, count)].astype("<u4")
        return ids, np.concatenate([[0], np.cumsum(count)])[at]


@lru_cache(maxsize=4)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def token_ids(texts: pa.Array, path: str, end: int) -> Iterator[np.ndarray]:
    """For each text its ids and then ``end``; a null counts as empty."""
    encoder = _encoder(path)
    last = np.array([end], "<u4")
    for lo, hi in slices(texts, 1 << 19):
        own = Texts.of(texts.slice(lo, hi - lo))
        starts, first, unknown = pretokens(own)
        if not encoder.known:
            unknown[:] = True
        if unknown.any():
            data = own.data.tobytes()
            bounds = own.offsets.tolist()
            whole = {i: np.array(encoder._ids(data[bounds[i] : bounds[i + 1]].decode()), "<u4") for i in np.flatnonzero(unknown).tolist()}
            lengths = np.where(unknown, 0, np.diff(own.offsets))
            stays = np.repeat(~unknown, np.diff(own.offsets))
            own = Texts(own.data[stays], np.concatenate([[0], np.cumsum(lengths)]))
            starts, first, _ = pretokens(own)
        else:
            whole = {}
        ids, at = encoder.encode(own, starts, first)
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            yield np.concatenate([whole[i] if i in whole else ids[a:b], last])
