"""Quality by random-indexing word vectors and a two-layer network.

Terms are runs of letters and digits and runs of punctuation, as written. Each
term has a sparse ternary index vector drawn from its hash; its context
vector is the sum, over the whole corpus, of the index vectors of the terms
within ``REACH`` places, with other draws for places before and after. Context
vectors are kept for ``ROWS`` hashed terms, so their table has a fixed size and
tasks' tables are added up. A document is pooled into the mean context vector
of its terms, that of its distinct terms, and a few pooled quantities (share
of distinct terms, length of terms, length of the mean). A network with one
hidden layer is trained on a bounded number of labelled documents and its
logits are divided by a temperature fitted on documents it was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, sigmoid, text_slices, utf8
from .hashing import CASED, TERMS, mix, word_spans

ROWS, DIMS, NONZERO, REACH = 8192, 64, 4, 2
#: Rows of the table that travel as one.
BLOCK = 256
#: Labelled documents that a fit reads (lowest hash of the id first).
TRAIN_DOCS = 8192
HIDDEN, EPOCHS, BATCH = 24, 60, 128
POOLED = 2 * DIMS + 5


def _terms(column: pa.Array):
    hashes, _, size, bounds = word_spans(*utf8(column), TERMS, CASED)
    return hashes, size, bounds


def _row(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) & (ROWS - 1)


def _draws(hashes: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero places and signs of index vectors, by distance."""
    h = mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (place + 1) % (1 << 64)))
    at = np.stack([(h >> np.uint64(8 * i)).astype(np.int64) & (DIMS - 1) for i in range(NONZERO)], axis=1)
    sign = np.stack([((h >> np.uint64(40 + i)) & np.uint64(1)).astype(np.int64) * 2 - 1 for i in range(NONZERO)], axis=1)
    return at, sign


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ROWS * DIMS, np.int64)
    for b in text_slices(batches, "text"):
        hashes, _, bounds = _terms(b.column(0))
        n = len(hashes)
        if not n:
            continue
        row = _row(hashes) * DIMS
        end = np.repeat(bounds[1:], np.diff(bounds))
        for gap in range(1, REACH + 1):
            left = np.flatnonzero(np.arange(n) + gap < end)
            right = left + gap
            for of, to, place in ((right, left, gap), (left, right, REACH + gap)):
                at, sign = _draws(hashes[of], place)
                cell = (row[to][:, None] + at).ravel()
                total += np.bincount(cell, sign.ravel(), len(total)).astype(np.int64)
    for i in range(0, ROWS, BLOCK):
        part = total[i * DIMS:(i + BLOCK) * DIMS]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([part.tobytes()])], ["block", "sums"])


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK * DIMS, np.int64)
    for raw in pdf["sums"]:
        total += np.frombuffer(raw, np.int64)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "sums": [total.tobytes()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """``ROWS`` x ``DIMS`` context vectors of unit length, from all of
    ``docs(text)`` (2 MB, whatever the corpus)."""
    rows = (docs.select("text").mapInArrow(_contexts, "block int, sums binary")
            .groupBy("block").applyInPandas(_add, "block int, sums binary").collect())
    table = np.zeros((ROWS, DIMS))
    for r in rows:
        table[r.block * BLOCK:(r.block + 1) * BLOCK] = np.frombuffer(r.sums, np.int64).reshape(-1, DIMS)
    table = np.sign(table) * np.log1p(np.abs(table))
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row of ``POOLED`` numbers per text (zeros for no terms)."""
    hashes, size, bounds = _terms(column)
    n = len(column)
    out = np.zeros((n, POOLED), np.float32)
    count = np.diff(bounds)
    filled = np.flatnonzero(count > 0)
    if not len(filled):
        return out
    doc = np.repeat(np.arange(n), count)
    start = bounds[filled]
    c = count[filled][:, None]
    mean = np.add.reduceat(vectors[_row(hashes)], start) / c
    order = np.lexsort((hashes, doc))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    once = order[fresh]
    kinds = np.bincount(doc[once], minlength=n)
    ends = np.concatenate([[0], np.cumsum(kinds)])
    plain = np.add.reduceat(vectors[_row(hashes[once])], ends[:-1][filled]) / kinds[filled][:, None]
    out[filled, :DIMS], out[filled, DIMS:2 * DIMS] = mean, plain
    out[filled, -5] = kinds[filled] / count[filled]
    out[filled, -4] = np.log1p(count[filled]) / 5
    out[filled, -3] = np.add.reduceat(size, start) / count[filled] / 8
    out[filled, -2] = np.linalg.norm(mean, axis=1)
    out[filled, -1] = np.linalg.norm(plain, axis=1)
    return out


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x.astype(float) - self.centre) / self.scale @ self.w1.astype(float) + self.b1, 0)
        return h @ self.w2.astype(float) + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the logistic loss; every fifth row is kept for the temperature."""
    rng = np.random.default_rng(seed)
    held = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    centre, scale = x[~held].mean(0), x[~held].std(0) + 0.05 * x[~held].std() + 1e-6
    a, t = ((x - centre) / scale)[~held].astype(np.float32), y[~held].astype(np.float32)
    p = [rng.normal(0, np.sqrt(2 / a.shape[1]), (a.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
         rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN).astype(np.float32),
         np.array([np.log((t.mean() + 1e-3) / (1 - t.mean() + 1e-3))], np.float32)]
    m, v, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(a))
        rate = 0.004 * (1 - epoch / EPOCHS) + 0.0002
        for s in range(0, len(a), BATCH):
            i = order[s:s + BATCH]
            z = a[i] @ p[0] + p[1]
            h = np.maximum(z, 0)
            d = (sigmoid(h @ p[2] + p[3][0]) - t[i]) / len(i)
            back = np.outer(d, p[2]) * (z > 0)
            grads = [a[i].T @ back + 2e-4 * p[0], back.sum(0), h.T @ d + 2e-4 * p[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    net = Network(centre, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if held.any():
        z, t = net.logits(x[held]), y[held]
        heats = np.geomspace(0.3, 8, 60)
        loss = [np.mean(np.logaddexp(0, z / k) - t * z / k) for k in heats]
        net.temperature = float(heats[int(np.argmin(loss))])
    return net


def _apply(shared, scored: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, parts = shared.value
        net = parts and Network(*parts)
        for b in text_slices(batches, "text"):
            x = pool(b.column(b.schema.get_field_index("text")), vectors)
            names = [f.name for f in b.schema if f.name != "text"]
            cols = [b.column(b.schema.get_field_index(n)) for n in names]
            if scored:
                more = {"score": pa.array(net.scores(x))}
            else:
                more = {"pooled": pa.array([r.tobytes() for r in x], pa.binary())}
            yield pa.RecordBatch.from_arrays(cols + list(more.values()), names + list(more))
    return run


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, Network]:
    """Vectors from all ``docs(doc_id, text)`` and a network from at most
    ``train_docs`` rows of ``labels(doc_id, quality)``. With one class or no
    labels the scores are a constant."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    marks = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("quality").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)).collect()
    rows = []
    if marks:
        known = F.broadcast(spark.createDataFrame([(r.doc_id, int(r.quality == 1)) for r in marks], "doc_id bigint, quality int"))
        shared = spark.sparkContext.broadcast((vectors, None))
        rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(known, "doc_id")
                .mapInArrow(_apply(shared, False), "doc_id bigint, quality int, pooled binary").collect())
        # the order of training must not depend on the order of tasks
        rows.sort(key=lambda r: (r.doc_id, bytes(r.pooled)))
    y = np.array([r.quality for r in rows], float)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        zero = np.zeros(POOLED, np.float32)
        return vectors, Network(zero, zero + 1, np.zeros((POOLED, 1)), np.zeros(1), np.zeros(1), float(np.log(rate / (1 - rate))), 1.0)
    x = np.stack([np.frombuffer(r.pooled, np.float32) for r in rows])
    return vectors, train(x, y)


def score(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """``docs`` without ``text``, plus ``score``; NULL and empty texts have
    the score of no terms."""
    # plain values: workers need not have this package, where the class is
    shared = docs.sparkSession.sparkContext.broadcast((vectors, tuple(getattr(net, f.name) for f in fields(net))))
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(_apply(shared, True), f"{schema}, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; labels of
    fold ``out`` are never learned from."""
    vectors, net = fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality").where(fold("doc_id", folds) != out))
    scored = score(docs.select("doc_id", "text"), vectors, net)
    return scored.select("doc_id", (fold("doc_id", folds) == out).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
