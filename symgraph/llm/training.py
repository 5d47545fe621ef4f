"""Bounded samples of labelled documents, and small numpy models on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.storage import stored

#: Labelled documents a classifier is fitted on at most, and bytes of their texts. Only the fit is bounded; corpus statistics cover all documents.
TRAIN_ROWS, TRAIN_BYTES = 8000, 64 << 20


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, bytes_: int = TRAIN_BYTES) -> tuple[pa.Array, np.ndarray]:
    """(texts, labels), by id, of at most ``rows`` labelled documents that ``keep`` (over the labels' columns), those first in the order of a hash of the id, until their texts have ``bytes_``.

    Labels other than 0 and 1 are none; a document labelled twice has its larger
    label; of several rows of one id the text with the least hash counts.
    """
    known = labels.where(keep & F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).cast("int").alias("__y"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(rows)  # so many rows at most: safe to broadcast
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(chosen.select(F.col(id_col).alias("id"), F.col("__y").alias("y"))), "id")
    found = found.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "y")).alias("row"))
    found = stored(found.select("id", F.xxhash64("id").alias("place"), F.octet_length("row.text").alias("size"), "row.text", "row.y"), "sample")
    sizes = found.select("place", "size").toArrow().sort_by("place")  # ``rows`` at most
    fits = np.flatnonzero(np.cumsum(sizes["size"].to_numpy().astype(np.int64)) <= bytes_)
    last = sizes["place"][int(fits[-1])].as_py() if len(fits) else -(1 << 63)
    taken = found.where(F.col("place") <= F.lit(last)).select("id", "text", "y").toArrow().sort_by("id").combine_chunks()
    texts = taken["text"].cast(pa.large_string())
    return texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, taken["y"].to_numpy().astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Logistic:
    """Logistic regression on standardised columns, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 50):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.weights = np.zeros(x.shape[1] + 1)
        if not len(y) or y.min() == y.max():  # nothing to tell apart: the share of 1, kept off 0 and 1
            share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
            self.weights[-1] = np.log(share / (1 - share)) if share else -40.0
            return
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        free = np.r_[np.ones(x.shape[1]), 0.0] * l2
        for _ in range(rounds):
            p = sigmoid(z @ self.weights)
            slope = z.T @ (p - y) / len(y) + free * self.weights
            curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(free) + 1e-9 * np.eye(len(self.weights))
            step = np.linalg.solve(curve, slope)
            self.weights -= step
            if np.abs(step).max() < 1e-8:
                break

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x))


class CrossFitted:
    """Logistic regression whose shrinkage is chosen on folds, and a line through its outcomes there that makes them probabilities."""

    SHRINKAGE = (1e-3, 1e-2, 3e-2, 1e-1, 3e-1, 1.0)

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.slope, self.shift = 1.0, 0.0
        if len(y) and y.min() != y.max() and min((y == 0).sum(), (y == 1).sum()) > 1:
            outside = {}
            for l2 in self.SHRINKAGE:
                logits = np.zeros(len(y))
                for f in np.unique(fold).tolist():
                    own = fold == f
                    logits[own] = Logistic(x[~own], y[~own], l2).logits(x[own])
                outside[l2] = logits
            loss = {l2: np.mean(np.logaddexp(0, np.where(y == 1, -z, z))) for l2, z in outside.items()}
            l2 = min(loss, key=loss.get)
            z, ones, zeros = outside[l2], int((y == 1).sum()), int((y == 0).sum())
            # a few labels must not pass for certainty
            target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
            for _ in range(50):
                p = sigmoid(self.slope * z + self.shift)
                g = np.array([((p - target) * z).sum() + 1e-3 * (self.slope - 1), (p - target).sum()])
                w = p * (1 - p)
                h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
                step = np.linalg.solve(h, g)
                step *= min(1.0, 2 / max(np.abs(step).max(), 1e-12))
                self.slope, self.shift = max(self.slope - step[0], 1e-3), self.shift - step[1]
                if np.abs(step).max() < 1e-9:
                    break
        else:
            l2 = self.SHRINKAGE[0]
        self.model = Logistic(x, y, l2)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.model.logits(x) + self.shift)


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """The probability that a 1 scores above a 0, ties counted half."""
    _, place = np.unique(score, return_inverse=True)
    size = np.bincount(place)
    rank = (np.cumsum(size) - (size - 1) / 2)[place]
    ones = int(y.sum())
    return float((rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones)))
