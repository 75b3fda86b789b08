"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, scratch_path
from .hashing import CASED, Slots, word_spans

#: Bytes of text that one step of numpy work holds at a time (a single text
#: may be longer; it is then a step of its own).
SLICE_BYTES = 1_000_000
#: Rows per Arrow batch where the session has Spark's own default of 10,000,
#: which is far too many for long texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch from Spark's default; a value
    that someone has chosen stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (NULL for a NULL id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: the lineage ends
    at files that outlive executors, and several readers share one pass."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], column: str,
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece has about ``limit`` text bytes."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        at = batch.schema.get_field_index(column)
        size = pa.compute.binary_length(batch.column(at).fill_null("")).to_numpy(zero_copy_only=False)
        total = np.cumsum(size.astype(np.int64))
        start = 0
        while start < n:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, NULL as empty; offsets start at 0."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def released(run):
    """``run`` over Arrow batches, giving freed memory back to the system at
    its end: an idle Python worker stays beside the executor's JVM."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not this C library
                pass
    return wrapped


class WordMemo:
    """Rows of numbers per distinct word, computed in batches for words not
    seen before. Bounded: beyond ``limit`` words it starts anew."""

    def __init__(self, evaluate: Callable[[list[str]], np.ndarray], limit: int = 100_000):
        self.evaluate, self.limit = evaluate, limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.values: np.ndarray | None = None
        self.used = 0

    def look_up(self, words: list) -> np.ndarray:
        """Index of each word in ``values``; valid until the next call."""
        at = self.at
        new = [w for w in set(words) if w not in at]
        if len(at) + len(new) > self.limit and at:
            self.clear()
            at = self.at
            new = list(set(words))
        if new:
            rows = self.evaluate(new)
            need = self.used + len(new)
            if self.values is None or need > len(self.values):
                grown = np.empty((max(need, 2 * self.used, 4096), *rows.shape[1:]), rows.dtype)
                if self.used:
                    grown[:self.used] = self.values[:self.used]
                self.values = grown
            self.values[self.used:need] = rows
            at.update(zip(new, range(self.used, need)))
            self.used = need
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))


class SpanMemo:
    """Rows of numbers per distinct word of UTF-8 texts, found by the words'
    hashes, so that only words not seen before become strings. Bounded:
    beyond ``limit`` words it starts anew."""

    def __init__(self, evaluate: Callable[[list[str]], np.ndarray], classes: np.ndarray, limit: int = 300_000):
        self.evaluate, self.classes, self.limit = evaluate, classes, limit
        self.slots = Slots()
        self.values: np.ndarray | None = None

    def look_up(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``values`` per word, bounds); valid until the next call."""
        hashes, starts, size, bounds = word_spans(raw, offsets, self.classes, CASED)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slots) + len(distinct) > self.limit:
            self.slots = Slots()
        new = np.flatnonzero(self.slots.find(distinct) < 0)
        if len(new) or self.values is None:
            data, where = raw.tobytes(), first[new]
            rows = self.evaluate([data[s:s + n].decode("utf-8", "replace")
                                  for s, n in zip(starts[where].tolist(), size[where].tolist())])
            used, need = len(self.slots), len(self.slots) + len(new)
            if self.values is None or need > len(self.values):
                grown = np.empty((max(need, 2 * used, 4096), *rows.shape[1:]), rows.dtype)
                if used:
                    grown[:used] = self.values[:used]
                self.values = grown
            self.values[self.slots.add(distinct[new])] = rows
        return self.slots.find(distinct)[inverse], bounds


def per_doc(counts: list[int]) -> np.ndarray:
    """Document number of each word, from the words per document."""
    return np.repeat(np.arange(len(counts)), counts)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x1 @ w)
        g = x1.T @ (p - y) + penalty * w
        h = (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(penalty + 1e-9)
        d = np.linalg.solve(h, g)
        norm = np.abs(d).max()
        w -= d * min(1.0, 4.0 / norm) if norm else d
        if norm < 1e-8:
            break
    return w
