"""Language identification by interpolated Kneser-Ney character models.

Words are lower-cased runs of letters, read between a start and an end mark. A
model of each language gives every character a probability from the up to
``ORDER - 1`` characters before it in its word: absolute discounts, highest
order by count, lower orders by the number of different characters in front
(continuation counts), down to a uniform distribution. Character runs are
hashed into 12 bits per character, so a run is one 60-bit number whose context
and suffix are shifts of it. The models are one sorted array of these hashes
with, per language, the discounted probability of the run and the weight that
it, as a context, leaves to the lower order.

A text's language is the one with the lowest cross-entropy per character; the
score is a logistic function, fitted on training documents, of the distance
to the next language, the length and the cross-entropy itself, and below
``REJECT`` the answer counts as rejected.

Counts come from all training documents, gathered per distinct word in the
tasks and added up by Spark. Up to ``MODEL_RUNS`` of them become one array on
the driver. More stay in Spark: discounts, continuation counts and context
weights are aggregations there, and the model travels in blocks of at most
``BLOCK_CELLS`` numbers, which a task goes through one after another. Both ways
give the same model, of all runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, SpanMemo, fold, logistic_fit, sigmoid, stage, text_slices, utf8
from .hashing import CASED, LETTERS, word_spans

ORDER = 5
BITS = np.uint64(12)
START, STOP = 1, 2
SYMBOLS = 4096
#: Runs up to which the models are one array; beyond it they are in blocks.
MODEL_RUNS = 3_000_000
#: Distinct runs times languages that a block holds at most, and text bytes
#: that a task gathers before it goes through the blocks.
BLOCK_CELLS, GATHER_BYTES = 4_000_000, 16 * SLICE_BYTES
#: Spreads contexts over blocks.
SPREAD = 1_000_003
CALIBRATION_DOCS = 4096
REJECT = 0.5


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all words with their marks, position in its word of each).
    Characters that are no letters are left out; a word without letters has
    no symbols."""
    bare = [w if w.isalpha() else "".join(c for c in w if c.isalpha()) for w in words]
    size = np.array([len(w) + 2 if w else 0 for w in bare], np.int64)
    points = np.frombuffer("".join(f"\x01{w}\x02" for w in bare if w).encode("utf-32-le"), np.uint32).astype(np.uint64)
    wide = points >= 2048
    points[wide] = np.uint64(2048) + (points[wide] * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(2047)
    place = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
    return points, place


def runs(points: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, hashes): for each length the runs that end at each
    predicted character (a word's start mark is never predicted)."""
    key = np.zeros(len(points), np.uint64)
    for n in range(1, ORDER + 1):
        key[n - 1:] |= points[:len(points) - n + 1] << (BITS * np.uint64(n - 1))
        at = np.flatnonzero(place >= max(1, n - 1))
        yield n, at, key[at]


def _events(points: np.ndarray, place: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of each character with its longest context."""
    keys, counts = [], []
    for n, at, key in runs(points, place):
        last = place[at] >= ORDER - 1 if n == ORDER else place[at] == n - 1
        keys.append(key[last])
        counts.append(weight[at[last]])
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, dict[int, list]] = {}
    held = 0

    def made():
        for lang, table in words.items():
            names = [x[0] for x in table.values()]
            points, place = codes_of(names)
            if len(points):
                times = np.array([x[1] for x in table.values()], float)
                sized = np.array([sum(c.isalpha() for c in w) for w in names])
                weight = np.repeat(times, np.where(sized > 0, sized + 2, 0))
                key, count = _events(points, place, weight)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.view(np.int64)), pa.array(count)],
                                                 ["lang", "run", "count"])
        words.clear()

    for b in text_slices(batches, "text"):
        langs = b.column(b.schema.get_field_index("lang")).to_pylist()
        raw, offsets = utf8(pc.utf8_lower(b.column(b.schema.get_field_index("text")).fill_null("")))
        hashes, starts, size, bounds = word_spans(raw, offsets, LETTERS, CASED)
        if not len(hashes):
            continue
        names = sorted(set(langs))
        lang = np.repeat([names.index(x) for x in langs], np.diff(bounds))
        data = raw.tobytes()
        for i, name in enumerate(names):
            mine = np.flatnonzero(lang == i)
            if not len(mine):
                continue
            key, first, times = np.unique(hashes[mine], return_index=True, return_counts=True)
            table = words.setdefault(name, {})
            before = len(table)
            for k, f, t in zip(key.tolist(), mine[first].tolist(), times.tolist()):
                if k in table:
                    table[k][1] += t
                else:
                    table[k] = [data[starts[f]:starts[f] + size[f]].decode("utf-8", "replace"), t]
            held += len(table) - before
        if held > 250_000:
            yield from made()
            held = 0
    yield from made()


@dataclass
class Models:
    langs: list[str]
    keys: np.ndarray
    gain: np.ndarray
    rest: np.ndarray
    calibration: np.ndarray
    #: Where one array would be too large: per order the broadcast (keys, gain,
    #: rest) of its runs and their contexts, by context.
    blocks: list[list] = field(default_factory=list)


def _length(key: np.ndarray) -> np.ndarray:
    out = np.zeros(len(key), np.int64)
    for n in range(ORDER):
        out += key >= (np.uint64(1) << (BITS * np.uint64(n)))
    return out


def kneser_ney(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
    """Of one language's events: (runs, discounted probabilities, weights that
    contexts leave, by run; 0 is the empty context)."""
    length = _length(key)
    first = key >> (BITS * (length - 1).astype(np.uint64))
    out_keys, out_gain, rest = [], [], {}
    above = np.zeros(0, np.uint64)
    for n in range(ORDER, 0, -1):
        # whole counts where nothing can stand in front, else continuations
        own = length == n if n == ORDER else (length == n) & (first == START)
        runs_, counts = key[own], count[own].astype(float)
        if n < ORDER:
            tail = above & ((np.uint64(1) << (BITS * np.uint64(n))) - np.uint64(1))
            more, times = np.unique(tail, return_counts=True)
            runs_, counts = np.concatenate([runs_, more]), np.concatenate([counts, times.astype(float)])
        if not len(runs_):
            above = runs_
            continue
        n1, n2 = (counts == 1).sum(), (counts == 2).sum()
        cut = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
        context = runs_ >> BITS
        which, inverse = np.unique(context, return_inverse=True)
        total = np.bincount(inverse, counts)
        out_keys.append(runs_)
        out_gain.append(np.maximum(counts - cut, 0) / total[inverse])
        taken = np.bincount(inverse, np.minimum(counts, cut))
        rest.update(zip(which.tolist(), (taken / total).tolist()))
        above = runs_
    return np.concatenate(out_keys), np.concatenate(out_gain), rest


def build(langs: list[str], events: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    parts = {lang: kneser_ney(*events[lang]) for lang in langs}
    contexts = [np.fromiter(p[2], np.uint64, len(p[2])) for p in parts.values()]
    keys = np.unique(np.concatenate([p[0] for p in parts.values()] + contexts + [np.zeros(1, np.uint64)]))
    gain = np.zeros((len(keys), len(langs)), np.float32)
    rest = np.ones((len(keys), len(langs)), np.float32)
    for i, (k, g, r) in enumerate(parts.values()):
        gain[np.searchsorted(keys, k), i] = g
        rest[np.searchsorted(keys, np.fromiter(r, np.uint64, len(r))), i] = np.fromiter(r.values(), float, len(r))
    return Models(langs, keys, gain, rest, np.zeros(0))


def _levels(events: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """``kneser_ney`` of ``events(lang, run, count)`` of any size, by order from
    the highest: (context, run, lang, gain, rest), with a row per run and one
    per context."""
    level = None
    for n in range(ORDER, 0, -1):
        at = int(BITS) * (n - 1)
        own = events.where(F.col("run") >= 1 << at).where(F.col("run") < 1 << (at + int(BITS)))
        if n < ORDER:
            own = own.where(F.shiftright("run", at) == START)
            tails = (level.groupBy("lang", F.col("run").bitwiseAND((1 << (at + int(BITS))) - 1).alias("run"))
                     .agg(F.count(F.lit(1)).alias("count")))
            own = own.unionByName(tails)
        level = stage(own, "language-level")
        n1, n2 = (F.sum(F.when(F.col("count") == i, 1).otherwise(0)) for i in (1, 2))
        cuts = level.groupBy("lang").agg(n1.alias("n1"), n2.alias("n2")).select(
            "lang", F.when(F.col("n1") > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.col("n1") / (F.col("n1") + 2 * F.col("n2")))))
            .otherwise(0.5).alias("cut"))
        rows = level.join(F.broadcast(cuts), "lang").withColumn("context", F.shiftright("run", int(BITS)))
        contexts = rows.groupBy("lang", "context").agg(
            F.sum("count").alias("total"), F.sum(F.least(F.col("count").cast("double"), "cut")).alias("taken"))
        gains = rows.join(contexts, ["lang", "context"]).select(
            "context", "run", "lang", (F.greatest(F.col("count") - F.col("cut"), F.lit(0.0)) / F.col("total")).alias("gain"),
            F.lit(1.0).alias("rest"))
        yield n, gains.unionByName(contexts.select("context", F.col("context").alias("run"), "lang", F.lit(0.0).alias("gain"),
                                                   (F.col("taken") / F.col("total")).alias("rest")))


def build_blocks(langs: list[str], events: DataFrame) -> Models:
    """``build`` of events that are too many for one array."""
    spark = events.sparkSession
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(langs)), "number int, lang string"))
    blocks: list[list] = [[] for _ in range(ORDER)]
    for n, rows in _levels(events):
        rows = stage(rows.join(numbers, "lang").drop("lang"), "language-model")
        many = -(-rows.select("run").distinct().count() * len(langs) // BLOCK_CELLS)
        rows = rows.withColumn("block", F.col("context") % SPREAD % max(1, many))
        rows = stage(rows.repartition("block").sortWithinPartitions("block"), "language-blocks")
        for b in range(many):
            part = rows.where(F.col("block") == b).select("run", "number", "gain", "rest").toPandas()
            keys, at = np.unique(part["run"].to_numpy().view(np.uint64), return_inverse=True)
            gain = np.zeros((len(keys), len(langs)), np.float32)
            rest = np.ones((len(keys), len(langs)), np.float32)
            gain[at, part["number"]], rest[at, part["number"]] = part["gain"], part["rest"]
            blocks[n - 1].append(spark.sparkContext.broadcast((keys, gain, rest)))
    nothing = np.zeros((1, len(langs)), np.float32)
    return Models(langs, np.zeros(1, np.uint64), nothing, nothing + np.float32(1), np.zeros(0), blocks)


def _add_order(p: np.ndarray, at: np.ndarray, key: np.ndarray, keys: np.ndarray, gain: np.ndarray, rest: np.ndarray) -> None:
    """Interpolate the probabilities at ``at`` with those of the runs ``key``."""
    if not len(keys):
        return

    def row(key):
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return found, keys[found] == key

    c, c_known = row(key >> BITS)
    g, g_known = row(key)
    add = np.where(g_known[:, None], gain[g], np.float32(0))
    left = np.where(c_known[:, None], rest[c], np.float32(1))
    p[at] = add + left * p[at]


def word_costs(words: list[str], models: Models) -> np.ndarray:
    """Per word: minus log2 of its probability by language, and how many
    characters that covers (last column)."""
    points, place = codes_of(words)
    out = np.zeros((len(words), len(models.langs) + 1))
    if not len(points):
        return out
    p = np.full((len(points), len(models.langs)), 1.0 / SYMBOLS, np.float32)

    for n, at, key in runs(points, place):
        if not models.blocks:
            _add_order(p, at, key, models.keys, models.gain, models.rest)
            continue
        block = (key >> BITS) % np.uint64(SPREAD) % np.uint64(max(1, len(models.blocks[n - 1])))
        for i, part in enumerate(models.blocks[n - 1]):
            mine = np.flatnonzero(block == i)
            if len(mine):
                _add_order(p, at[mine], key[mine], *part.value)
                part.__dict__.pop("_value", None)  # a worker holds one block at a time
    cost = -np.log2(np.maximum(p, 1e-12))
    cost[place == 0] = 0
    size = np.flatnonzero(place == 0)
    covered = np.diff(np.append(size, len(points))) - 1
    has = np.array([any(map(str.isalpha, w)) for w in words])
    out[has, :-1] = np.add.reduceat(cost, size)
    out[has, -1] = covered
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined to about ``GATHER_BYTES``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= GATHER_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _shared(spark, models: Models):
    """The models as a broadcast of plain values: workers need not have this
    package, where the class is."""
    return spark.sparkContext.broadcast((models.langs, models.keys, models.gain, models.rest, models.calibration))


def _measure(shared, calibrated: bool, blocks: list[list]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Models(*shared.value, blocks)
        memo = SpanMemo(lambda words: word_costs(words, models), LETTERS)
        for b in text_slices(_gathered(batches), "text", GATHER_BYTES) if blocks else text_slices(batches, "text"):
            raw, offsets = utf8(pc.utf8_lower(b.column(b.schema.get_field_index("text")).fill_null("")))
            at, bounds = memo.look_up(raw, offsets)
            n = b.num_rows
            total = np.zeros((n, len(models.langs) + 1))
            filled = np.flatnonzero(np.diff(bounds) > 0)
            if len(filled):
                total[filled] = np.add.reduceat(memo.values[at], bounds[filled])
            chars = total[:, -1]
            entropy = total[:, :-1] / np.maximum(chars, 1)[:, None]
            best = entropy.argmin(axis=1)
            order = np.sort(entropy, axis=1)
            second = order[:, 1] if order.shape[1] > 1 else order[:, 0] + 1.0
            x = np.column_stack([second - order[:, 0], np.log1p(chars), order[:, 0]])
            columns = {f.name: b.column(i) for i, f in enumerate(b.schema) if f.name != "text"}
            if calibrated:
                letter = chars > 0
                score = np.where(letter, sigmoid(design(x) @ models.calibration[:-1] + models.calibration[-1]), 0.0)
                names = np.where(letter, np.array(models.langs, object)[best], "und")
                columns |= {"lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(score)}
            else:
                columns |= {"pick": pa.array(best.astype(np.int32))} | {f"x{i}": pa.array(x[:, i]) for i in range(3)} \
                    | {"chars": pa.array(chars)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    return run


def design(x: np.ndarray) -> np.ndarray:
    gap, size, entropy = x.T
    return np.column_stack([gap, gap * size, size, entropy])


def fit(docs: DataFrame) -> Models | None:
    """Models of all languages of ``docs(doc_id, text, lang)``, from all rows
    with a language; None if no row has words."""
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull()).select("doc_id", F.col("text"), "lang")
    counts = (known.select("text", "lang").mapInArrow(_count, "lang string, run bigint, count bigint")
              .groupBy("lang", "run").agg(F.sum("count").alias("count")))
    counts = stage(counts, "language-runs")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    if counts.count() <= MODEL_RUNS:
        rows = counts.toPandas()
        models = build(langs, {x: (g["run"].to_numpy().view(np.uint64), g["count"].to_numpy()) for x, g in rows.groupby("lang")})
    else:
        models = build_blocks(langs, counts)
    shared = _shared(spark, models)
    ids = [r.doc_id for r in known.select("doc_id").where("doc_id is not null").distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_DOCS).collect()]
    models.calibration = np.array([8.0, 1.0, 0.2, -0.05, -0.5])
    if ids:
        some = F.broadcast(spark.createDataFrame([(i,) for i in ids], known.select("doc_id").schema))
        rows = (known.join(some, "doc_id").mapInArrow(
            _measure(shared, False, models.blocks), f"doc_id {known.schema['doc_id'].dataType.simpleString()}, lang string, pick int, "
            "x0 double, x1 double, x2 double, chars double").where("chars > 0").toPandas())
        if len(rows):
            right = (np.array(langs, object)[rows["pick"].to_numpy()] == rows["lang"].to_numpy()).astype(float)
            x = design(rows[["x0", "x1", "x2"]].to_numpy())
            # two doubtful rows keep the fit finite where every answer is right
            x = np.vstack([x, np.zeros((2, 4))])
            models.calibration = logistic_fit(x, np.append(right, [0.0, 1.0]))
    return models


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """``docs`` without ``text``, plus lang_pred and score. Texts without
    letters (NULL and empty ones too) are ``und`` with score 0; so is every
    text if there is no model."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    if models is None:
        return docs.select(*(f.name for f in kept), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    shared = _shared(docs.sparkSession, models)
    return docs.mapInArrow(_measure(shared, True, models.blocks), f"{schema}, lang_pred string, score double")


def predict(docs: DataFrame, folds: int = 4, out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row of
    ``docs(doc_id, text, lang)``; fold ``out`` is never learned from."""
    models = fit(docs.where(fold("doc_id", folds) != out))
    got = identify(docs.select("doc_id", "text"), models)
    return got.select("doc_id", (fold("doc_id", folds) == out).alias("held_out"), "lang_pred", "score",
                      (F.col("score") < REJECT).alias("rejected"))
