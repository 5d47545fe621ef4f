"""Quality scores from random-indexing word vectors (operator 9).

Every token (a run of word characters, or of other signs; capitals count) has a
fixed sparse ternary index vector, drawn from its hash.  A token's word vector
adds up the index vectors of its neighbours over all documents of the corpus;
rows are hashed, so the table has a fixed size, and tasks' tables are added up
in a tree of bounded groups.  A document is the mean of its tokens' centred,
frequency-weighted vectors, with a few figures of its form.  A two-layer network in
numpy scores it; its logits are divided by a temperature fitted on labelled
documents the network has not seen, so that scores are probabilities.

Defined results: a null or empty text scores as a document without tokens;
repeated rows are each scored; without labels of both kinds every score is the
share of good labels; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.bytescan import Texts, byte_set, hashes, prefix_sums, slices
from symgraph.llm.toxicity import folded
from symgraph.llm.training import TRAIN_ROWS, labelled_sample, remainder, sigmoid
from symgraph.storage import stored

_U = np.uint64

#: Hashed rows of the vector table, dimensions, and non-zeros of an index vector.
_ROW_BITS, DIMENSIONS, _NONZEROS = 14, 32, 4
_ROWS = 1 << _ROW_BITS
#: Partial tables that one group adds up, and the pieces a table is sent in.
_FAN_IN, _PIECES = 64, 16

_WORD = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_SPACE = byte_set((0x09, 0x0D), (0x20, 0x20))
_UPPER = byte_set((0x41, 0x5A))
_DIGIT = byte_set((0x30, 0x39))


class _Tokens:
    """The tokens of some texts: hash, row, text, and where each text's begin."""

    def __init__(self, texts: Texts):
        data = texts.data
        word = _WORD[data]
        w0, w1, _ = texts.runs(word)
        s0, s1, _ = texts.runs(~word & ~_SPACE[data])
        starts, stops = np.concatenate([w0, s0]), np.concatenate([w1, s1])
        order = np.argsort(starts, kind="stable")
        self.starts, self.stops = starts[order], stops[order]
        self.sign = np.concatenate([np.zeros(len(w0), bool), np.ones(len(s0), bool)])[order]
        upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
        self.capitals = (upper[self.stops] - upper[self.starts]) > 1  # more than a first letter
        self.hash = hashes(prefix_sums(folded(data)), self.starts, self.stops) ^ (self.capitals.astype(_U) * _U(0x9E3779B97F4A7C15))
        self.row = (self.hash >> _U(64 - _ROW_BITS)).astype(np.int64)
        self.at = np.searchsorted(self.starts, texts.offsets)
        self.data, self.offsets = data, texts.offsets

    def __len__(self) -> int:
        return len(self.starts)


def _index_positions(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The non-zero places of the index vectors of hashes, and their signs."""
    for k in range(_NONZEROS):
        part = (h >> _U(8 * k)) & _U(63)
        yield (part >> _U(1)).astype(np.int64), 1.0 - 2.0 * (part & _U(1)).astype(np.float64)


def _contexts(tokens: _Tokens, table: np.ndarray) -> None:
    """Add to ``table`` (rows x (dimensions + 1), flat; the last column counts) what the tokens' neighbours give."""
    if not len(tokens):
        return
    width = DIMENSIONS + 1
    row, h = tokens.row, tokens.hash
    table += np.bincount(row * width + DIMENSIONS, minlength=len(table))
    inner = np.ones(len(row), bool)  # whether a token has one before it in its text
    first = tokens.at[:-1]
    inner[first[first < len(row)]] = False
    right = np.flatnonzero(inner)
    left = right - 1
    for here, there in ((right, left), (left, right)):
        for place, sign in _index_positions(h[there]):
            table += np.bincount(row[here] * width + place, weights=sign, minlength=len(table))


def word_vectors(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The word vectors and the weight of each row, from all documents. The table has one size for any corpus."""
    size = _ROWS * (DIMENSIONS + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size)
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                _contexts(_Tokens(Texts.of(batch.column(0).slice(lo, hi - lo))), table)
        task = TaskContext.get().partitionId()
        parts = np.split(table.astype("<f4"), _PIECES)
        yield pa.RecordBatch.from_arrays([pa.array([task] * _PIECES, pa.int64()), pa.array(range(_PIECES), pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "piece", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<f4").astype(np.float64) for x in group.column("sums"))
        return pa.table({"part": pa.array([group.column("up")[0].as_py()], pa.int64()), "piece": group.column("piece").slice(0, 1), "sums": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    found = stored(docs.select(docs[text_col].cast("string").alias("t")).mapInArrow(count, "part long, piece long, sums binary"), "contexts")
    while (found.agg(F.max("part")).first()[0] or 0) > 0:
        found = stored(found.withColumn("up", F.floor(F.col("part") / _FAN_IN)).groupBy("piece", "up").applyInArrow(add, "part long, piece long, sums binary"), "contexts")
    table = np.zeros((_PIECES, size // _PIECES))
    for r in found.collect():  # the pieces of one table
        table[r.piece] = np.frombuffer(r.sums, "<f4")
    table = table.reshape(_ROWS, DIMENSIONS + 1)
    count_of = table[:, -1:]
    vectors = table[:, :-1] / np.maximum(count_of, 1)
    vectors -= (vectors * count_of).sum(0) / max(count_of.sum(), 1)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    weights = 1e-3 / (1e-3 + count_of[:, 0] / max(count_of.sum(), 1))
    return vectors.astype(np.float32), weights.astype(np.float32)


def document_columns(texts: Texts, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pooled word vectors and figures of form of each text."""
    t = _Tokens(texts)
    size, n = len(texts), np.diff(t.at)
    full = np.flatnonzero(n)
    pooled, plain = np.zeros((size, DIMENSIONS)), np.zeros((size, 12))
    words = np.maximum(n, 1)
    if len(full):
        begin = t.at[:-1][full]
        add = lambda x: np.add.reduceat(x, begin)
        weight = weights[t.row].astype(np.float64)
        total = np.maximum(add(weight), 1e-9)
        for d in range(DIMENSIONS):
            pooled[full, d] = add(vectors[t.row, d] * weight) / total
        doc = np.repeat(np.arange(size), n)
        again = np.zeros(len(t))
        again[1:] = (t.hash[1:] == t.hash[:-1]) & (doc[1:] == doc[:-1])
        gap = np.zeros(len(t))
        gap[2:] = (t.hash[2:] == t.hash[:-2]) & (doc[2:] == doc[:-2])
        length = (t.stops - t.starts).astype(np.float64)
        for k, x in enumerate((t.sign, t.capitals, again, gap, length, length**2, t.sign & (length > 1), _DIGIT[t.data[t.starts]])):
            plain[full, k] = add(np.asarray(x, np.float64)) / words[full]
        plain[:, 8] = np.bincount(_distinct(doc, t.hash), minlength=size) / words
    plain[:, 9] = np.log1p(n)
    plain[:, 10] = np.linalg.norm(pooled, axis=1)
    lines = np.concatenate([[0], np.cumsum(t.data == 10)])
    plain[:, 11] = (lines[t.offsets[1:]] - lines[t.offsets[:-1]]) / words
    return np.concatenate([pooled, plain], axis=1)


def _distinct(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The text of each distinct (text, hash)."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    return doc[np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])]


class Network:
    """A network of one hidden layer, trained with Adam, and a temperature for its logits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7, l2: float = 1e-3):
        self.constant = None
        if not len(y) or y.min() == y.max():
            self.constant = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
            return
        rng = np.random.default_rng(seed)
        apart = rng.permutation(len(y))
        cut = max(1, len(y) // 5)
        check, own = apart[:cut], apart[cut:]
        self.mean, self.scale = x[own].mean(0), x[own].std(0) + 1e-6
        z = (x - self.mean) / self.scale
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log((y[own].mean() + 1e-3) / (1 - y[own].mean() + 1e-3)))]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            mixed = rng.permutation(own)
            for lo in range(0, len(mixed), 128):
                rows = mixed[lo : lo + 128]
                h = np.tanh(z[rows] @ p[0] + p[1])
                error = (sigmoid(h @ p[2] + p[3]) - y[rows]) / len(rows)
                back = error[:, None] * p[2] * (1 - h**2)
                slopes = [z[rows].T @ back + l2 * p[0], back.sum(0), h.T @ error + l2 * p[2], error.sum()]
                step += 1
                for k in range(4):
                    m[k] = 0.9 * m[k] + 0.1 * slopes[k]
                    v[k] = 0.999 * v[k] + 0.001 * slopes[k] ** 2
                    p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.layers = p
        self.temperature = 1.0
        logits = self._logits(x[check])

        def loss(t: float) -> float:
            q = np.clip(sigmoid(logits / t), 1e-9, 1 - 1e-9)
            return -np.mean(np.where(y[check] == 1, np.log(q), np.log(1 - q)))

        self.temperature = min(np.exp(np.linspace(np.log(0.5), np.log(8), 200)), key=loss)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(self._logits(x) / self.temperature)


class QualityModel:
    """Word vectors and network; of a fixed size, so it is sent to all tasks."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, texts: pa.Array | list[str], y: np.ndarray):
        self.vectors, self.weights = vectors, weights
        self.network = Network(self._columns(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())), y)

    def _columns(self, texts: pa.Array) -> np.ndarray:
        parts = [document_columns(Texts.of(texts.slice(lo, hi - lo)), self.vectors, self.weights) for lo, hi in slices(texts)]
        return np.concatenate(parts) if parts else np.zeros((0, DIMENSIONS + 12))

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.network(self._columns(texts))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held_out: int = 0, rows: int = TRAIN_ROWS) -> QualityModel:
    """A model with word vectors of all ``docs`` and labels learnt from those that are not held out."""
    vectors, weights = word_vectors(docs, text_col)
    sample = labelled_sample(docs, labels, label, remainder(id_col, modulus) != held_out, id_col, text_col, rows)
    return QualityModel(vectors, weights, *sample)
