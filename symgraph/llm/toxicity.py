"""Toxicity scores with noisy-channel deobfuscation (operator 8).

Source model: a character trigram language model, counted over every document
of the corpus.  Channel model: leet signs stand for letters, spaced-out letters
belong to one word, letters repeat.  A suspicious span becomes a lattice of
what each of its characters may have been, and the best path (Viterbi, exact,
its state the last two letters) replaces it.  Disguised are: three or more
single letters or signs with one of blank, dot, hyphen, underscore and star
between; words in which a letter stands three times or more in turn; tokens
that hold a letter and a sign for one, whatever their length (``!``, ``*``,
``#`` and three or more of another sign at the end are punctuation).  ``SUSPICIOUS`` finds just the texts that may have any of these,
so what else stands in a text has no bearing on how a span is read.  The
restored text as a whole is scored.

Score: words and word beginnings that are significantly frequent in toxic
documents carry their log rate ratio; a document's sum, mean, maximum and
counts of those, with its length, go into a logistic regression.  Word weights
and regression come from a bounded sample of the labelled documents (training
module).  They are cross-fitted: the regression sees each document under
weights from the other folds, its shrinkage is chosen on the folds, and so is
the calibration that turns its outcome into a probability.

Defined results: a null or empty text scores as a text without words;
repeated rows are each scored; a null id is not held out; all other columns are
kept out of the score, and one that has the name of the added column is
replaced; of two labelled rows with one id the text with the least hash counts;
without labels of both kinds every score is the share of toxic labels; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgraph.llm.bytescan import Texts, byte_set, hashes, lowered, prefix_sums, slices
from symgraph.llm.training import TRAIN_ROWS, CrossFitted, labelled_sample, remainder

_U = np.uint64

# What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "#": "aeiou",
}

#: Log costs of the channel: a sign for a letter, signs that are just signs, a dropped separator, a kept one, an extra letter of a run.
_SIGN, _PLAIN, _JOIN, _BREAK, _REPEAT = -0.7, -14.0, -0.1, -2.5, -0.1
#: What is punctuation at the end of a token.
_FINAL = re.compile(r"(?:[!*#]+|([@$|+])\1{2,})+$")
#: Spans up to this length are remembered by a task.
_REMEMBERED = 64

_CLASSES = 64
_LETTERS = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
_OTHER = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
_LETTERS |= {c: 27 + i for i, c in enumerate(_OTHER)}
_REST = 63  # any other letter

#: Letters that may stand in a run, and the small ones of their capitals.
_RUN_LETTERS = "abcdefghijklmnopqrstuvwxyz" + _OTHER
_SMALL = str.maketrans({c.upper(): c for c in _RUN_LETTERS if len(c.upper()) == 1 and c.upper().lower() == c})

#: Characters that become one of those, but are no capitals of theirs.
_LIKE_SMALL = "\u212a\u212b\u1e9e"

_SPACED = re.compile(r"(?<!\w)[^\W_](?:[ .\-_*][^\W_]){2,}(?!\w)")
_RUN = re.compile(rf"([{_RUN_LETTERS}])\1\1")
_WORDY = re.compile(r"\w*")
_SIGNS = re.compile(r"[0-9@$!|+*#]+")
_TOKEN = re.compile(r"(?:[^\W_]|[@$!|+*#])*+")

#: What a text must hold (RE2, whole column at once) to have a disguised span: the patterns above without their context.
SUSPICIOUS = (
    r"\pL[!*#]*[\pN@$|+]|[\pN@$!|+*#]\pL|(?:^|[^\pL\pN_])[\pL\pN][ .\-_*][\pL\pN][ .\-_*][\pL\pN](?:[^\pL\pN]|$)|"
    + "|".join(f"[{c}{c.upper() if c.upper().translate(_SMALL) == c else ''}]{{3}}" for c in _RUN_LETTERS)
)


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case: A-Z, and the capitals of Latin-1."""
    data = lowered(data)
    if len(data) > 1:
        capital = np.zeros(len(data), bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data = np.where(capital, data + np.uint8(0x20), data)
    return data


def _char_classes() -> tuple[np.ndarray, np.ndarray]:
    """Classes of single bytes, and of the second byte of the two-byte Latin-1 letters (after 0xC3)."""
    one, two = np.zeros(256, np.int64), np.full(256, _REST, np.int64)
    for c, k in _LETTERS.items():
        code = c.encode()
        if len(code) == 1:
            one[code[0]] = k
        elif code[0] == 0xC3:
            two[code[1]] = k
    one[0x80:] = _REST
    return one, two


_ONE, _TWO = _char_classes()


def trigrams(texts: Texts) -> np.ndarray:
    """How often each run of three classes occurs (0: no letter; texts are apart)."""
    data = folded(texts.data)
    classes = _ONE[data]
    if len(data) > 1:
        follows = np.zeros(len(data), bool)
        follows[1:] = data[:-1] == 0xC3
        classes = np.where(follows, _TWO[data], classes)
    keep = ~((data >= 0xC0) | ((data >= 0x80) & (data < 0xC0) & (np.concatenate([[0], data[:-1]]) != 0xC3)))
    breaks = np.concatenate([[0], np.cumsum(keep)])[texts.offsets[1:-1]]  # before every text but the first
    classes = np.insert(classes[keep], breaks, 0)
    classes = np.concatenate([[0], classes, [0]])
    inner = classes[1:-1]
    return np.bincount((classes[:-2] * _CLASSES + inner) * _CLASSES + classes[2:], minlength=_CLASSES**3)


class CharacterModel:
    """log P(class | two classes before), interpolated with shorter contexts."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(_CLASSES, _CLASSES, _CLASSES).astype(np.float64)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + _CLASSES)
        p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
        p3 = (tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20)
        self.logs = np.log(p3).astype(np.float32)


def count_characters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The trigram counts of all documents. A task sends a row for each trigram it has seen, and as many rows as there are trigrams reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CLASSES**3, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in slices(texts):
                total += trigrams(Texts.of(texts.slice(lo, hi - lo)))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["code", "n"])

    found = docs.select(docs[text_col].cast("string").alias("t")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(_CLASSES**3, np.int64)
    rows = found.toPandas()
    out[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


class Restorer:
    """Decodes disguised spans under a character model."""

    def __init__(self, model: CharacterModel):
        self.logs = model.logs
        self._known = lru_cache(1 << 16)(self._decode)

    def __reduce__(self):
        return _restorer, (self.logs,)

    def decode(self, span: str, spaced: bool) -> str:
        return self._known(span, spaced) if len(span) <= _REMEMBERED else self._decode(span, spaced)

    def _lattice(self, span: str, spaced: bool) -> Iterator[list[tuple[str, float]]]:
        """For each step, what may be written and at what cost ("" is nothing, " " a break)."""
        i = 0
        while i < len(span):
            c, run = span[i], 1
            while i + run < len(span) and span[i + run] == c:
                run += 1
            if spaced and i % 2:
                yield [("", _JOIN), (" ", _BREAK)]
                run = 1
            elif c in LEET:
                # equal signs in turn stand for the same
                run = 1 if spaced else run
                likely, own = LEET[c], [min(run, 2), 1] if run > 2 else [run]
                yield [(x * k, k * _SIGN - np.log(len(likely))) for x in likely for k in own] + [(" ", _PLAIN)]
            elif c.isalpha():
                if spaced:
                    run = 1
                if run >= 3:
                    yield [(c, 0.0)]
                    yield [(c, _REPEAT), ("", _REPEAT)]
                else:
                    for _ in range(run):
                        yield [(c, 0.0)]
            else:
                yield [(" ", 0.0)]
            i += run

    def _decode(self, span: str, spaced: bool) -> str:
        logs = self.logs
        # best path to each state: the classes of the last two letters written
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for step in chain(self._lattice(span, spaced), ([(" ", 0.0)],)):
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in states.items():
                for letter, cost in step:
                    state, total, way = (a, b), score + cost, path
                    for one in letter:
                        before, b_ = state
                        k = 0 if one == " " else _LETTERS.get(one, _REST)
                        state, total, way = (b_, k), total + float(logs[before, b_, k]) * (k != 0 or b_ != 0), (way, one)
                    if state not in new or total > new[state][0]:
                        new[state] = (total, way)
            states = new
        _, path = max(states.values(), key=lambda x: x[0])
        letters = []
        while path:
            path, letter = path
            letters.append(letter)
        return re.sub(" +", " ", "".join(reversed(letters))).strip()

    def _replaced(self, text: str, marks: Iterator[re.Match], more: str, rest: re.Pattern, new) -> str:
        """``text`` with the tokens (letters, digits and the characters ``more``; ``rest`` matches what follows a mark) around ``marks`` replaced."""
        parts, at = [], 0
        for m in marks:
            if m.start() < at:
                continue  # in the token before
            start = m.start()
            while start > at and (text[start - 1].isalnum() or text[start - 1] in more):
                start -= 1
            end = rest.match(text, m.end()).end()
            parts += [text[at:start], new(text[start:end])]
            at = end
        return "".join(parts) + text[at:] if parts else text

    def _runs(self, text: str) -> str:
        """``text`` with the words that hold a run of a letter decoded."""
        small = text.lower()
        if len(small) != len(text) or any(c in text for c in _LIKE_SMALL):
            small = text.translate(_SMALL)
        return self._replaced(text, _RUN.finditer(small), "_", _WORDY, lambda word: self.decode(word.lower(), False))

    def _leet(self, text: str) -> str:
        """``text`` with the tokens that hold a letter and a sign for one decoded."""

        def new(token: str) -> str:
            bare = _FINAL.sub("", token)
            if not any(map(str.isalpha, bare)) or _SIGNS.search(bare) is None:
                return token
            return self.decode(bare.lower(), False) + token[len(bare) :]

        return self._replaced(text, _SIGNS.finditer(text), "@$!|+*#", _TOKEN, new)

    def restore(self, text: str) -> str:
        """``text`` with its disguised spans decoded."""

        def spaced(m: re.Match) -> str:
            return self.decode(m[0].lower(), True) if any(map(str.isalpha, m[0])) else m[0]

        return self._leet(self._runs(_SPACED.sub(spaced, text)))

    def restored(self, texts: pa.Array) -> pa.Array:
        """A column of texts restored; texts that cannot have a disguised span are not touched."""
        need = pc.match_substring_regex(texts, SUSPICIOUS).fill_null(False).to_numpy(zero_copy_only=False)
        if not need.any():
            return texts
        new = [self.restore(t) if s else None for t, s in zip(texts.filter(pa.array(need)).to_pylist(), need[need], strict=True)]
        return pc.replace_with_mask(texts, pa.array(need), pa.array(new, texts.type))


def _restorer(logs: np.ndarray) -> Restorer:
    found = Restorer.__new__(Restorer)
    found.logs = logs
    found._known = lru_cache(1 << 16)(found._decode)
    return found


_WORD = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_BEGINNINGS = (5, 6, 7, 8, 9)  # bytes
_BITS = 20


def _features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and of every word and word beginning its text and its hashed number."""
    data = folded(texts.data)
    starts, stops, at = texts.runs(_WORD[data])
    sums, n = prefix_sums(data), np.diff(at)
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    docs, found = [doc], [hashes(sums, starts, stops)]
    for k in _BEGINNINGS:
        long = np.flatnonzero(stops - starts > k)
        docs.append(doc[long])
        found.append(hashes(sums, starts[long], starts[long] + k) ^ _U(k * 0x9E3779B97F4A7C15 % (1 << 64)))
    return n, np.concatenate(docs), (np.concatenate(found) >> _U(64 - _BITS)).astype(np.int64)


#: Folds of the labelled documents.
FOLDS = 8


class _Tally:
    """How often each of some features occurs, and in how many documents, by label and fold. Features are those that two toxic documents have."""

    def __init__(self, parts: Iterator, toxic: np.ndarray):
        have = np.zeros(1 << _BITS, np.int32)
        for lo, (n, doc, number) in parts:
            own = toxic[lo : lo + len(n)][doc] == 1
            have += np.bincount(np.unique(doc[own].astype(np.int64) << _BITS | number[own]) & ((1 << _BITS) - 1), minlength=1 << _BITS).astype(np.int32)
        self.features = np.flatnonzero(have >= 2)
        self.place = np.full(1 << _BITS, -1, np.int32)
        self.place[self.features] = np.arange(len(self.features))
        self.times, self.have = (np.zeros((2, FOLDS, len(self.features)), np.int32) for _ in range(2))
        self.words, self.docs = np.zeros((2, FOLDS), np.int64), np.zeros((2, FOLDS), np.int64)

    def add(self, n: np.ndarray, doc: np.ndarray, number: np.ndarray, y: np.ndarray, fold: np.ndarray) -> None:
        place = self.place[number]
        hit = np.flatnonzero(place >= 0)
        doc, place = doc[hit], place[hit].astype(np.int64)
        size = len(self.features)
        kind = FOLDS * y + fold
        self.times += np.bincount(kind[doc] * size + place, minlength=2 * FOLDS * size).reshape(self.times.shape).astype(np.int32)
        once = np.unique(doc.astype(np.int64) * size + place) if size else place
        self.have += np.bincount(kind[once // max(size, 1)] * size + once % max(size, 1), minlength=2 * FOLDS * size).reshape(self.have.shape).astype(np.int32)
        self.words += np.bincount(kind, weights=n, minlength=2 * FOLDS).reshape(2, FOLDS).astype(np.int64)
        self.docs += np.bincount(kind, minlength=2 * FOLDS).reshape(2, FOLDS)

    def weights(self, without: int | None = None) -> np.ndarray:
        """The log rate ratio of each feature that significantly more of the toxic documents, but for a fold, have; 0 for the others, and one more 0."""
        folds = [f for f in range(FOLDS) if f != without]
        times, have = (x[:, folds].sum(1) for x in (self.times, self.have))
        words, docs = (np.maximum(1, x[:, folds].sum(1)) for x in (self.words, self.docs))
        share = [(have[c] + 0.5) / (docs[c] + 1) for c in (0, 1)]
        z = (share[1] - share[0]) / np.sqrt((have[0] + have[1] + 1) / docs.sum() * (1 / docs[0] + 1 / docs[1]))
        ratio = np.log((times[1] + 0.5 * words[1] / words[0]) / words[1]) - np.log((times[0] + 0.5) / words[0])
        return np.append(np.where((have[1] >= 2) & (z > 3) & (ratio > 0.7), ratio, 0.0), 0.0).astype(np.float32)


def _document_columns(n: np.ndarray, doc: np.ndarray, number: np.ndarray, weights: np.ndarray) -> np.ndarray:
    weight = weights[number]
    hit = np.flatnonzero(weight)
    doc, weight = doc[hit], weight[hit].astype(np.float64)
    size, words = len(n), np.maximum(n, 1)
    total = np.bincount(doc, weights=weight, minlength=size)
    hits = np.bincount(doc, minlength=size)
    strong = np.bincount(doc, weights=weight > 3, minlength=size)
    most = np.zeros(size)
    np.maximum.at(most, doc, weight)
    return np.stack([np.log1p(total), total / np.sqrt(words), total / words * 100, np.log1p(hits), most, np.log1p(strong), strong / words * 100, np.log(words), np.log1p(total) * np.log(words)], axis=1)


class ToxicityModel:
    """Restorer, word weights and calibrated regression; small and of a fixed size, so it is sent to all tasks."""

    def __init__(self, restorer: Restorer, texts: pa.Array | list[str], y: np.ndarray):
        self.restorer = restorer
        column = restorer.restored(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        fold = np.zeros(len(y), np.int64)
        for label in (0, 1):  # each label is dealt over the folds in turn
            fold[y == label] = np.arange((y == label).sum()) % FOLDS

        def parts() -> Iterator:  # features are made anew for each pass; only tallies of a fixed size are held
            for lo, hi in slices(column, 1 << 19):
                yield lo, _features(Texts.of(column.slice(lo, hi - lo)))

        tally = _Tally(parts(), y)
        for lo, found in parts():
            tally.add(*found, y[lo : lo + len(found[0])], fold[lo : lo + len(found[0])])
        columns = np.zeros((len(y), 9))
        crossed = [tally.weights(f) for f in range(FOLDS)]
        for lo, found in parts():
            own = fold[lo : lo + len(found[0])]
            for f in np.unique(own).tolist():
                columns[lo : lo + len(own)][own == f] = _document_columns(*found[:2], tally.place[found[2]], crossed[f])[own == f]
        self.regression = CrossFitted(columns, y, fold)
        self.weights = np.zeros(1 << _BITS, np.float32)
        self.weights[tally.features] = tally.weights()[:-1]

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        for lo, hi in slices(texts):
            column = self.restorer.restored(texts.slice(lo, hi - lo))
            out.append(self.regression(_document_columns(*_features(Texts.of(column)), self.weights)))
        return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held_out: int = 2, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """A model with characters counted over all ``docs`` and labels learnt from those that are not held out."""
    restorer = Restorer(CharacterModel(count_characters(docs, text_col)))
    sample = labelled_sample(docs, labels, label, remainder(id_col, modulus) != held_out, id_col, text_col, rows)
    return ToxicityModel(restorer, *sample)


def with_scores(docs: DataFrame, model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column of the model's scores of the texts; a column of that name is replaced. Row by row, without a shuffle."""
    docs = docs.select(*(c for c in docs.columns if c != out))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    position = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(position).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(texts), pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def score_table(docs: DataFrame, model, modulus: int, held_out: int, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of each row of ``docs``."""
    scored = with_scores(docs.select(F.col(id_col).alias("id"), docs[text_col].cast("string").alias("text")), model)
    return scored.select(F.col("id").alias(id_col), F.coalesce(remainder("id", modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
