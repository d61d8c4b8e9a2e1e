"""Language identification by error-correcting output codes.

Every language gets a binary codeword. One logistic classifier per code bit is trained on hashed
byte n-grams (2 to 4 bytes; A-Z lower-cased, other ASCII taken as a blank); whole texts are counted.
A text is decoded to the language whose codeword has the least weighted logistic loss over the bits,
each bit counting by how well its classifier did on the training rows. The score is the language's
share after a softmax of the losses; a small lead over the second language sets the flag `ambiguous`.

Training uses at most `max_docs` labelled rows, spread evenly over the languages (the least by a hash of doc_id,
then by id and text), and at most two times `max_langs` where there are more languages than that. The `max_langs`
commonest languages (the first by name, if equally common) are learned; texts of others are not learned from, and
`left_out` counts them. Both bounds keep the driver's share constant.

Defined results: a text that is null or has no letter gets `und` with score 0; if nothing could be
learned, every text does. Rows with a null label, null id or no letter are not learned from. Repeated
rows get equal results; other columns pass through, but for those of the results' names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
BINS = 4096


def byte_table() -> bytes:
    keep = {c: c for c in [*range(97, 123), *range(128, 256)]} | {c: c + 32 for c in range(65, 91)}
    return bytes(keep.get(c, 32) for c in range(256))


def features(text: bytes, table: bytes) -> np.ndarray:
    """Root of the share of each n-gram bin; the vector has length one unless the text is too short."""
    total = np.zeros(BINS, np.int64)
    for at in range(0, len(text), 1 << 20):
        b = np.frombuffer(text[at : at + (1 << 20) + 3].translate(table), np.uint8).astype(np.uint32)
        code = b
        for n in (2, 3, 4):
            if len(b) < n:
                break
            code = code[:-1] * np.uint32(16777619) + b[n - 1 :]
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(2246822519 + 2 * n)
            total += np.bincount(mixed >> np.uint32(20), minlength=BINS)
    return np.sqrt(total / max(1, total.sum())).astype(np.float32)


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n rows of +1 and -1: every split of the classes while that is short, else the best of random draws."""
    if n <= 6:
        columns = [[1 if (c >> k) & 1 or k == n - 1 else -1 for k in range(n)] for c in range(2 ** max(0, n - 1) - 1)]
        return np.array(columns or [[1] * n]).T
    rng, bits = np.random.default_rng(seed), math.ceil(10 * math.log2(n))
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], size=(n, bits))
        near = (bits - (code @ code.T)) // 2 + bits * np.eye(n, dtype=int)
        if near.min() > apart:
            best, apart = code, near.min()
    return best


def train(x: np.ndarray, y: np.ndarray, code: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights, offsets, feature means and bit weights of the code's classifiers (accelerated gradient steps)."""
    mean = x.mean(axis=0)
    x = x - mean
    target = (code[y] > 0).astype(np.float32)
    share = np.bincount(y, minlength=len(code))
    weight = (1 / share[y])[:, None].astype(np.float32)
    weight /= weight.mean()
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b = np.zeros(code.shape[1], np.float32)
    w0, b0 = w, b
    for k in range(rounds):
        ahead = k / (k + 3)
        wa, ba = w + ahead * (w - w0), b + ahead * (b - b0)
        g = weight * (1 / (1 + np.exp(-np.clip(x @ wa + ba, -30, 30))) - target) / len(x)
        w0, b0 = w, b
        w, b = wa - 4.0 * (x.T @ g + 1e-5 * wa), ba - 2.0 * g.sum(axis=0)
    right = np.clip(((x @ w + b > 0) == (target > 0)).mean(axis=0), 0.5, 0.999)
    return w, b, mean, np.log(right / (1 - right)) + 0.01


class Model:
    """Languages with their code and the bits' classifiers."""

    def __init__(self, langs: list[str], code=None, fitted=None, left_out: int = 0):
        self.langs, self.code, self.fitted, self.left_out = langs, code, fitted, left_out

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the best language's number, its score, and its lead over the second."""
        w, b, mean, bit_weight = self.fitted
        margin = (x - mean) @ w + b
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ (bit_weight / bit_weight.mean())
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        order = np.sort(share, axis=1)
        best = share.argmax(axis=1)
        lead = order[:, -1] - (order[:, -2] if share.shape[1] > 1 else 0)
        return best, order[:, -1], lead


def fit(labelled: DataFrame, max_docs: int = 1600, max_langs: int = 400) -> Model:
    """Train on labelled (doc_id, text, lang); see the module's notes for the bounds."""
    rows = labelled.where("lang is not null and doc_id is not null and text is not null")
    by_lang = rows.groupBy("lang").count()
    counts = by_lang.orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not counts:
        return Model([])
    left_out = by_lang.count() - len(counts)
    quota = max(2, max_docs // len(counts))
    spread = 1 << 30
    rate = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(spread, int(spread * (1.5 * quota + 20) / r["count"])))])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(spread))
    some = rows.withColumn("place", place).where(F.col("place") < F.try_element_at(rate, F.col("lang"))).where(F.col("text").rlike(r"\p{L}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", F.xxhash64("text")))
    picked = some.withColumn("rank", rank).where(F.col("rank") <= quota).select("lang", "place", "text")
    table = byte_table()

    def run(batches):
        for b in batches:
            x = [features(t, table).tobytes() for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["lang", "place", "x"])

    got = sorted(
        zip(*picked.mapInArrow(run, "lang string, place long, x binary").toArrow().to_pydict().values(), strict=True)
    )
    langs = sorted({g[0] for g in got})
    if not langs:
        return Model([])
    x = np.frombuffer(b"".join(g[2] for g in got), np.float32).reshape(len(got), BINS)
    y = np.array([langs.index(g[0]) for g in got])
    del got
    code = codewords(len(langs))
    return Model(langs, code, train(x, y, code), left_out)


def predict(docs: DataFrame, model: Model, lead: float = 0.1) -> DataFrame:
    """All columns of docs with lang_pred, lang_score and lang_ambiguous after them; needs a column text."""
    table, letter = byte_table(), regex.compile(r"\p{L}")
    new = ("lang_pred", "lang_score", "lang_ambiguous")
    docs = docs.drop(*new)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            pred, score, doubt = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
            some = [i for i, t in enumerate(texts) if t and letter.search(t)] if model.langs else []
            for k in range(0, len(some), 128):
                part = some[k : k + 128]
                best, top, ahead = model.decode(np.stack([features(texts[i].encode("utf-8", "surrogatepass"), table) for i in part]))
                for i, j, s, d in zip(part, best.tolist(), top.tolist(), ahead.tolist(), strict=True):
                    pred[i], score[i], doubt[i] = model.langs[j], s, d < lead
            cols = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, lang_score double, lang_ambiguous boolean")


common.ship(__name__)
