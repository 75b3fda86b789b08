"""Toxicity by a subsequence-kernel support vector machine.

Strings are the words of labelled documents' sentences (a document's label
holds for its sentences). The kernel of two strings sums, over all common
subsequences of three characters, ``decay`` to the number of characters
skipped in either string, so an insult with characters put in between or left
out stays close to the plain one. Nystroem: the kernel against a bounded set
of landmark strings gives each string a short vector, on which a linear
support vector machine is trained. Since the kernel is a dot product of
subsequence weights, the trained machine folds into one table indexed by
character triples, and a string's margin is a sum over its triples.

A document's score is a logistic function of the margins of all its words
(largest margin, hits, length). Whole texts are read. Words are lower-cased,
characters other than letters and digits inside them are ignored
("i-d.i*o.t"), and runs of single letters ("i d i o t") are also read as one
word; words over ``WINDOW`` characters are covered by overlapping windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, fold, logistic_fit, per_doc, released, sigmoid, text_slices

#: Labelled documents that a fit reads (lowest hash of the id first).
TRAIN_DOCS = 8192
#: Training words of each class, and landmarks.
TRAIN_WORDS, LANDMARKS = 2500, 160
#: Plain words searched for hard negatives.
HARD_POOL = 30_000
DECAY, MAX_GAP = 0.55, 5
WINDOW, STRIDE = 24, 12

_DROP = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")


def words_of(text: str) -> set[str]:
    """Distinct lower-cased words, and each spelled-out run of characters as
    one more."""
    low = text.lower()
    out = set(low.split())
    out.update(m.group() for m in _SPELLED.finditer(low))
    return out


def windows(word: str) -> list[str]:
    bare = word if word.isalnum() else _DROP.sub("", word)
    if len(bare) <= WINDOW:
        return [bare]
    return [bare[i:i + WINDOW] for i in range(0, len(bare) - WINDOW + STRIDE, STRIDE)]


def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a string of that length and their decay."""
    at = [(i, j, k) for i in range(length) for j in range(i + 1, length)
          for k in range(j + 1, length) if k - i - 2 <= MAX_GAP]
    idx = np.array(at, np.int64).reshape(-1, 3)
    return idx, (DECAY ** (idx[:, 2] - idx[:, 0] - 2)).astype(np.float32)


class Alphabet:
    """Codes of characters; any other character has code 0, which never
    matches."""

    def __init__(self, characters: str):
        self.characters = characters
        self.size = len(characters) + 1
        self.code = np.zeros(max([0x300, *map(ord, characters)]) + 2, np.int32)
        for i, c in enumerate(characters):
            self.code[ord(c)] = i + 1
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}

    def encode(self, words: list[str], length: int) -> np.ndarray:
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        return self.code[np.minimum(points, len(self.code) - 1)].reshape(len(words), length)

    def known(self) -> np.ndarray:
        """Triple codes whose three characters are all in the alphabet."""
        on = np.arange(self.size) > 0
        return (on[:, None, None] & on[:, None] & on).ravel()

    def shape(self, length: int):
        if length not in self.by_length:
            idx, decay = _triples(length)
            self.by_length[length] = (idx, decay, float(np.sqrt((decay ** 2).sum())) or 1.0)
        return self.by_length[length]

    def codes(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per word length: (word numbers, triple codes, normalised decay)."""
        lengths = np.array([len(w) for w in words], np.int64)
        for length in np.unique(lengths):
            if length < 3:
                continue
            at = np.flatnonzero(lengths == length)
            idx, decay, norm = self.shape(int(length))
            step = max(1, 2_000_000 // len(idx))
            for s in range(0, len(at), step):
                part = at[s:s + step]
                c = self.encode([words[i] for i in part], int(length))
                code = (c * self.size ** 2)[:, idx[:, 0]]
                code += (c * self.size)[:, idx[:, 1]]
                code += c[:, idx[:, 2]]
                yield part, code, decay / norm

    def margins(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Dot product of each string's subsequence vector with ``weights``
        (0 where a character is outside the alphabet)."""
        out = np.zeros(len(words), np.float32)
        for at, code, decay in self.codes(words):
            out[at] = weights[code] @ decay
        return out


def _strings(word: str) -> list[str]:
    return [w for w in windows(word) if len(w) >= 3]


def _inserted(word: str) -> list[str]:
    """Variants of an insult with one character put in, one left out."""
    n = len(word)
    out = [word[:i] + c + word[i:] for i, c in ((n // 3, "x"), (n // 2, "z"), (2 * n // 3, "q")) if 0 < i < n]
    if n > 5:
        out.append(word[:n // 2] + word[n // 2 + 1:])
    return out


@dataclass
class Model:
    alphabet: Alphabet
    weights: np.ndarray
    bias: float
    calibration: np.ndarray


def svm_fit(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3,
            steps: int = 40) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps over the margin violators."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    reg = np.full(len(w), ridge * cost.sum())
    reg[-1] = 1e-6
    for _ in range(steps):
        gap = 1 - y * (x1 @ w)
        on = gap > 0
        g = reg * w - x1[on].T @ (cost[on] * y[on] * gap[on])
        h = (x1[on] * cost[on][:, None]).T @ x1[on] + np.diag(reg + 1e-9)
        d = np.linalg.solve(h, g)
        w = w - d
        if np.abs(d).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def fit_strings(positive: list[str], negative: list[str], hard: list[str] = ()) -> tuple[Alphabet, np.ndarray, float]:
    """The machine over strings: (alphabet, folded triple table, bias).

    ``hard``: plain words among which those that a first machine takes for
    insults join the negative strings and landmarks of the second."""
    seen: dict[str, int] = {}
    for w in positive * 3 + negative:
        for c in w:
            seen[c] = seen.get(c, 0) + 1
    alphabet = Alphabet("".join(sorted(sorted(seen, key=lambda c: (-seen[c], c))[:63])))
    marks = positive[:LANDMARKS // 2] + negative[:LANDMARKS // 4]
    weights, bias = _machine(alphabet, positive, negative, marks)
    hard = [w for w in hard if len(w) >= 3]
    if hard:
        margin = alphabet.margins(hard, weights) + bias
        order = [hard[i] for i in np.argsort(-margin, kind="stable")[:TRAIN_WORDS] if margin[i] > -0.5]
        more = list(dict.fromkeys(negative + order))
        weights, bias = _machine(alphabet, positive, more, marks + order[:LANDMARKS // 2])
    return alphabet, weights, bias


def _machine(alphabet: Alphabet, positive: list[str], negative: list[str], marks: list[str]):
    strings = positive + [v for w in positive for v in _inserted(w)] + negative
    y = np.array([1.0] * (len(strings) - len(negative)) + [-1.0] * len(negative))
    cost = np.where(y > 0, 0.4 / max(1, (y > 0).sum()), 0.6 / max(1, (y < 0).sum()))
    cost[:len(positive)] *= 3
    marks = list(dict.fromkeys(w for w in marks if len(w) >= 3))
    size, known = alphabet.size ** 3, alphabet.known()
    if not marks:
        return np.zeros(size, np.float32), -1.0
    k = np.zeros((len(strings), len(marks)))
    tables = []
    for j, mark in enumerate(marks):
        t = np.zeros(size, np.float32)
        for _, code, decay in alphabet.codes([mark]):
            np.add.at(t, code[0], decay)
        t *= known
        k[:, j] = alphabet.margins(strings, t)
        tables.append((np.flatnonzero(t), t[np.flatnonzero(t)]))
    row = {w: i for i, w in enumerate(strings)}
    kmm = k[[row[m] for m in marks]]
    value, vector = np.linalg.eigh((kmm + kmm.T) / 2 + 1e-6 * np.eye(len(marks)))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    v, bias = svm_fit(k @ root, y, cost)
    weights = np.zeros(size, np.float32)
    for a, (at, t) in zip(root @ v, tables):
        weights[at] += np.float32(a) * t
    return weights, bias


#: Margins over which a word counts as a hit of that strength.
LEVELS = (0.0, 0.35, 0.7)
FEATURES = len(LEVELS) + 2


def _pooled(memo: WordMemo, texts: list[str]) -> np.ndarray:
    """Per text: distinct words, hits at each level, largest margin."""
    words: list[str] = []
    counts = []
    for t in texts:
        w = words_of(t) if t else ()
        words += w
        counts.append(len(w))
    out = np.zeros((len(texts), FEATURES))
    out[:, -1] = -3.0
    if words:
        at = memo.look_up(words)
        margin = memo.values[at]
        doc = per_doc(counts)
        out[:, 0] = counts
        for i, level in enumerate(LEVELS):
            out[:, 1 + i] = np.bincount(doc, margin > level, len(texts))
        np.maximum.at(out[:, -1], doc, np.clip(margin, -3, 3))
    return out


def _memo(alphabet: Alphabet, weights: np.ndarray, bias: float) -> WordMemo:
    def evaluate(words: list[str]) -> np.ndarray:
        parts, owner = [], []
        for i, w in enumerate(words):
            for s in _strings(w):
                parts.append(s)
                owner.append(i)
        out = np.full(len(words), -3.0, np.float32)
        if parts:
            np.maximum.at(out, np.array(owner), alphabet.margins(parts, weights) + np.float32(bias))
        return out
    return WordMemo(evaluate)


def _design(pooled: np.ndarray) -> np.ndarray:
    n, hits, top = pooled[:, :1], pooled[:, 1:-1], pooled[:, -1:]
    return np.hstack([np.log1p(n), np.log1p(hits), np.minimum(hits, 1), np.log1p(1000 * hits / np.maximum(n, 1)),
                      top, np.maximum(top - 0.35, 0), np.maximum(top - 0.7, 0)])


def _shared(spark, parts):
    """The parts as a broadcast of plain values: a class of this package would
    be looked for in a module that workers need not have."""
    alphabet, weights, bias = parts
    return spark.sparkContext.broadcast((alphabet.characters, weights, bias))


def _score_udf(model_parts, calibration, with_text=False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters, weights, bias = model_parts.value
        memo = _memo(Alphabet(characters), weights, bias)
        for b in text_slices(batches, "text"):
            pooled = _pooled(memo, b.column(b.schema.get_field_index("text")).to_pylist())
            names = [f.name for f in b.schema if with_text or f.name != "text"]
            cols = [b.column(b.schema.get_field_index(n)) for n in names]
            if calibration is None:
                more = {f"p{i}": pa.array(pooled[:, i]) for i in range(pooled.shape[1])}
            else:
                more = {"_toxic_score" if with_text else "score": pa.array(sigmoid(_design(pooled) @ calibration[:-1] + calibration[-1]))}
            yield pa.RecordBatch.from_arrays(cols + list(more.values()), names + list(more))
    return run


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Train on ``docs(doc_id, text)`` joined with ``labels(doc_id, toxic)``.

    At most ``train_docs`` labelled documents are used, lowest hash of the id
    first. Word counts by class are made by Spark; only the training words
    (bounded) and one short row per training document reach the driver. With
    no positive or no negative document the scores are a constant."""
    spark = docs.sparkSession
    marks = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs))
    rows = marks.collect()
    n1 = sum(1 for r in rows if r.toxic == 1)
    n0 = len(rows) - n1
    empty = (Alphabet(""), np.zeros(1, np.float32), -1.0)
    rate = (n1 + 0.5) / (len(rows) + 1.0) if rows else 0.25
    constant = Model(*empty, np.array([0.0] * _design(np.zeros((1, FEATURES))).shape[1] + [np.log(rate / (1 - rate))]))
    if not n1 or not n0:
        return constant
    known = F.broadcast(spark.createDataFrame([(r.doc_id, int(r.toxic == 1)) for r in rows],
                                              "doc_id bigint, toxic int"))
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                         F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id")
    bare = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\s]+", "")
    counts = (sample.select("toxic", F.explode(F.array_distinct(F.split(bare, r"\s+"))).alias("w"))
              .where(F.length("w").between(3, WINDOW))
              .groupBy("w").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")))
    odds = (F.log((F.col("p") + 0.5) / (n1 - F.col("p") + 0.5))
            - F.log((F.col("n") + 0.5) / (F.greatest(n0 - F.col("n"), F.lit(0)) + 0.5)))
    counts = counts.withColumn("odds", odds)
    least = 4 if n1 >= 200 else 3 if n1 >= 20 else 2
    strong = (counts.where((F.col("p") >= least) & (F.col("odds") >= 3.0))
              .orderBy(F.desc(F.col("p") * F.col("odds")), "w").limit(TRAIN_WORDS))
    usual = counts.where((F.col("odds") < 1.5) & (F.col("n") >= 1))
    positive = [r.w for r in strong.select("w").collect()]
    plain = usual.orderBy(F.desc("n"), "w").limit(TRAIN_WORDS).select("w").collect()
    mixed = [r.w for r in usual.orderBy(F.xxhash64("w"), "w").limit(HARD_POOL).select("w").collect()]
    negative = list(dict.fromkeys([x for pair in zip(plain, mixed) for x in (pair[0].w, pair[1])]))
    if not positive or not negative:
        parts = empty
    else:
        parts = fit_strings(positive, negative, mixed)
    shared = _shared(spark, parts)
    pooled = sample.mapInArrow(released(_score_udf(shared, None)),
                               "doc_id bigint, toxic int, " + ", ".join(f"p{i} double" for i in range(FEATURES))).collect()
    if not pooled:
        return constant
    x = _design(np.array([[r[f"p{i}"] for i in range(FEATURES)] for r in pooled]))
    y = np.array([r.toxic for r in pooled], float)
    return Model(*parts, logistic_fit(x, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without ``text``, plus ``score``. Every input row gives one
    output row; a NULL or empty text has the score of no words."""
    shared = _shared(docs.sparkSession, (model.alphabet, model.weights, model.bias))
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(released(_score_udf(shared, model.calibration)), f"{schema}, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; labels
    are learned only from rows outside fold 0."""
    train = labels.select("doc_id", "toxic").where(fold("doc_id", folds) != 0)
    model = fit(docs.select("doc_id", "text"), train)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with their
    columns; the machine learns from all labelled rows of ``docs``."""
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    shared = _shared(docs.sparkSession, (model.alphabet, model.weights, model.bias))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    scored = docs.mapInArrow(released(_score_udf(shared, model.calibration, True)), f"{schema}, _toxic_score double")
    return scored.where(F.col("_toxic_score") < threshold).select(*docs.columns)
