"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are a text's distinct words, pairs of neighbouring words, pairs with one or two words between
them, and the stems (first six characters) of longer words, so that inflected and compound forms share
a weight; all are hashed to 2**20 bins. Words are runs of letters, digits and underscores, lower-cased.
Training follows FTRL-proximal: per-coordinate learning rates and an L1 term that leaves most weights
at zero, so that the model is a short list of bins, small enough for every task's closure.

Training uses at most `max_docs` labelled rows (a third of them of label 1, while there are enough), the
least by a hash of doc_id, and only texts of up to `max_chars` characters; scoring takes whole texts.

Defined results: null and empty texts have no features and get the score of the bias alone; a document
with several labels counts as toxic if one of them says so; null labels and ids are not learned from;
repeated rows get equal scores; without a label of either class every score is that class's, 0 or 1 (0
with no labels at all). Other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 20
#: Characters of a stem. This, the rates, L1 and the number of epochs had the least loss in a fourfold cross-validation
#: over the documents that may be learned from (crc32 of doc_id mod 5 from 1 to 4); the held-out ones had no say.
STEM = 6
#: Words remembered with their hashes by a task.
MEMO = 200_000


class WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def bins(words: list[str], memo: WordHashes) -> np.ndarray:
    """The bins of a text's n-grams, skip-grams and stems, with repeats."""
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    stems = [w[:STEM] + "*" for w in words if len(w) > STEM]  # a star is in no word
    s = np.fromiter(map(memo.__getitem__, stems), np.uint64, len(stems))
    shift = np.uint64(64 - BITS)
    parts = [(np.concatenate([h, s]) * np.uint64(0x9E3779B97F4A7C15)) >> shift]
    for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (3, 0x27D4EB2F165667C5)):
        if len(h) > gap:
            mixed = (h[:-gap] ^ (h[:-gap] >> np.uint64(29))) * np.uint64(odd) + h[gap:]
            parts.append(((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) >> shift)
    return np.concatenate(parts).astype(np.int32)


class Ftrl:
    """FTRL-proximal state for binary features; `weights` is sparse by construction."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, offset: float, y: int) -> float:
        """One example; returns the gradient of the logit."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(offset + w.sum(), -30, 30))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return g


class Model:
    """The bins with a weight, their weights, and the bias."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, bias: float):
        self.at, self.weight, self.bias = at, weight, bias


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, max_chars: int = 16384, epochs: int = 4) -> Model:
    """Train on docs (doc_id, text) with labels (doc_id, toxic)."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit(6))
    toxic = own.where("toxic = 1").orderBy(place, "doc_id").limit(max_docs // 3)
    clean = own.where("toxic = 0").orderBy(place, "doc_id").limit(max_docs - max_docs // 3)
    # At most max_docs rows of two numbers: a proven bound for the broadcast.
    picked = toxic.union(clean)
    rows = (
        docs.where("text is not null")
        .where(F.length("text") <= max_chars)
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
    )
    word = re.compile(r"\w+")

    def run(batches):
        memo = WordHashes()
        for b in batches:
            found = [np.unique(bins(word.findall(t.lower()), memo)).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["doc_id", "toxic", "bins"])

    got = rows.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, bins binary").toArrow().sort_by("doc_id").to_pydict()
    y = got["toxic"]
    if len(set(y)) < 2:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 30.0 if y and y[0] else -30.0)
    state, bias, seen = Ftrl(1 << BITS), 0.0, 1.0
    rng = np.random.default_rng(6)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            g = state.learn(np.frombuffer(got["bins"][i], np.int32), bias, y[i])
            seen += g * g
            bias -= 0.2 * g / np.sqrt(seen)
    w = state.weights(slice(None))
    at = np.flatnonzero(w).astype(np.int32)
    return Model(at, w[at].astype(np.float32), float(bias))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All columns of docs with the toxicity (0 to 1) of their text after them."""
    docs = docs.drop(column)
    at = docs.columns.index("text")
    word = re.compile(r"\w+")

    def run(batches):
        memo, table = WordHashes(), np.zeros(1 << BITS, np.float32)
        table[model.at] = model.weight
        for b in batches:
            out = np.full(b.num_rows, model.bias)
            for i, t in enumerate(b.column(at)):
                words = word.findall((t.as_py() or "").lower())
                if words:
                    found = bins(words, memo)
                    hit = np.unique(found[table[found] != 0])
                    out[i] += table[hit].sum(dtype=np.float64)
            p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{column}` double")


common.ship(__name__)
