"""Quality rules with line labels by a linear-chain conditional random field.

The lines of a text that hold a word form a chain; each is content or
boilerplate. A line is described by binned properties (``FEATURES``: length,
kinds of characters, repetition, place); the field has a weight per bin, a
weight for how a chain begins and one per pair of neighbouring labels. Viterbi
decoding finds the likeliest labels of a whole chain at once, and the
share of word characters that stand in content lines decides whether the
document is kept.

The field is trained here, by gradient ascent on the conditional likelihood
(forward-backward), from documents labelled good or bad. Lines of good
documents are content. The labels of a bad document's lines are latent: first
all boilerplate, then as the field decodes them, unless that leaves most of
the document content.

The plain rules count words, symbols, repeated lines and repeated 3-word
windows. Texts stream through tasks whole and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, sigmoid, text_slices, utf8
from .hashing import CASED, SPACE, TERM, WORDS, mix, word_spans

MIN_WORDS, REPEAT_SHARE = 50, 0.5
#: Least share of word characters in content lines of a kept document.
CONTENT_SHARE = 0.5
#: Labelled documents and chains of at most ``CHAIN`` lines that a fit reads
#: (lowest hash first).
TRAIN_DOCS, TRAIN_CHAINS, CHAIN = 4096, 8192, 64
ROUNDS, STEPS, RIDGE = 2, 150, 1e-3

_byte = np.arange(256)
_lead = (_byte & 0xC0) != 0x80
_char = _lead & ~SPACE
_symbol = np.isin(_byte, np.frombuffer(b"#*$%&|<>", np.uint8))
_upper = (_byte >= 65) & (_byte <= 90)
_digit = (_byte >= 48) & (_byte <= 57)
_letter = _upper | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 192)
_mark = (_byte > 32) & (_byte < 127) & ~_symbol & ~_letter & ~_digit
_LINE = (_byte != 10).astype(np.uint8)

#: Upper bounds of each property's bins; the last bin has none.
FEATURES = {
    "words": (1, 2, 4, 8, 16, 32, 64, 128),
    "symbols": (0, .01, .02, .05, .1, .2),
    "upper": (.02, .05, .1, .2, .4, .6, .8),
    "marks": (0, .02, .04, .07, .1, .15, .25),
    "digits": (0, .02, .05, .1, .3),
    "word length": (2, 3, 4, 5, 6, 8, 12, 20),
    "closed words": (0, .05, .1, .2, .3, .5, .8),
    "distinct words": (.2, .35, .5, .65, .8, .95),
    "repeated words": (0, .1, .3, .5, .8),
    "repeated line": (0,),
    "last character": (0, 1, 2, 3),
    "place": (0, 1, 2),
}
_FIRST = np.concatenate([[0], np.cumsum([len(b) + 1 for b in FEATURES.values()])])
WEIGHTS = int(_FIRST[-1])


class Lines:
    """Counts per text and binned properties per line with a word of some
    texts, given as bytes and offsets."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        words, at, size, bounds = word_spans(raw, offsets, WORDS, CASED)
        hashes, start, length, line_bounds = word_spans(raw, offsets, _LINE, CASED)
        self.raw, self.offsets = raw, offsets
        n_docs = len(offsets) - 1
        self.n_words = np.diff(bounds)

        def sums(kind):
            return np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int64)])

        chars, symbols = sums(_char), sums(_symbol)
        self.word_chars = np.diff(chars[offsets])
        self.n_symbols = np.diff(symbols[offsets])
        # 3-word windows of one text that occur twice
        doc = np.repeat(np.arange(n_docs), self.n_words)
        covered = np.zeros(len(words) + 1, np.int64)
        k = np.flatnonzero(np.arange(len(words)) + 3 <= bounds[1:][doc]) if len(words) else np.zeros(0, np.int64)
        if len(k):
            runs = mix(words[k] * TERM[0] + words[k + 1] * TERM[1] + words[k + 2] * TERM[2] + mix(doc[k].astype(np.uint64) + TERM[3]))
            _, which, count = np.unique(runs, return_inverse=True, return_counts=True)
            again = k[count[which] > 1]
            for j in range(3):
                covered[again + j] = 1
        covered_to = np.concatenate([[0], np.cumsum(covered[:-1])])
        self.n_repeat_words = np.diff(covered_to[bounds])
        # lines with a word, and those equal to an earlier line of their text
        lo, hi = np.searchsorted(at, start), np.searchsorted(at, start + length)
        solid = np.flatnonzero(hi > lo)
        line_doc = np.repeat(np.arange(n_docs), np.diff(line_bounds))[solid]
        start, length, lo, hi, hashes = start[solid], length[solid], lo[solid], hi[solid], hashes[solid]
        same = np.zeros(len(solid), bool)
        order = np.lexsort((np.arange(len(solid)), hashes, line_doc))
        same[order[1:]] = (hashes[order][1:] == hashes[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
        self.n_dup_lines = np.bincount(line_doc[same], minlength=n_docs)
        self.bounds = np.searchsorted(line_doc, np.arange(n_docs + 1))
        self.start, self.length = start, length
        end = start + length
        self.chars = chars[end] - chars[start]
        if not len(solid):
            self.bins = np.zeros((0, len(FEATURES)), np.uint8)
            return
        count = hi - lo

        def share(kind, of):
            total = kind if isinstance(kind, np.ndarray) and len(kind) == len(raw) + 1 else sums(kind)
            return (total[end] - total[start]) / np.maximum(of, 1)

        letters = sums(_letter)
        closing = np.concatenate([[0], np.cumsum((_mark | _symbol)[raw[at + size - 1]])])
        own = np.repeat(np.arange(len(solid)), count)
        inside = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        pair = np.sort(mix(words[inside] + mix(own.astype(np.uint64) + TERM[4])))
        fresh = mix(words[inside] + mix(own.astype(np.uint64) + TERM[4]))
        order = np.argsort(fresh, kind="stable")
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        distinct = np.bincount(own[order[new]], minlength=len(solid))
        last = raw[at[hi - 1] + size[hi - 1] - 1]
        ending = np.select([np.isin(last, np.frombuffer(b".?", np.uint8)), last == 33, _symbol[last], _mark[last]], [0, 1, 2, 3], 4)
        first_line, last_line = np.zeros(len(solid), bool), np.zeros(len(solid), bool)
        filled = self.bounds[:-1][np.diff(self.bounds) > 0]
        first_line[filled] = True
        last_line[self.bounds[1:][np.diff(self.bounds) > 0] - 1] = True
        values = {
            "words": count, "symbols": share(symbols, self.chars), "upper": share(_upper, letters[end] - letters[start]),
            "marks": share(_mark, self.chars), "digits": share(_digit, self.chars), "word length": self.chars / count,
            "closed words": (closing[hi] - closing[lo]) / count, "distinct words": distinct / count,
            "repeated words": (covered_to[hi] - covered_to[lo]) / count, "repeated line": same.astype(float),
            "last character": ending, "place": first_line + 2 * last_line}
        self.bins = np.stack([np.searchsorted(bins, values[f], "left") for f, bins in FEATURES.items()], axis=1).astype(np.uint8)


def emissions(bins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of boilerplate against content per line."""
    return weights[bins + _FIRST[:-1]].sum(axis=1)


def viterbi(scores: np.ndarray, start: float, pairs: np.ndarray) -> np.ndarray:
    """Likeliest labels (1: boilerplate; content where both are as likely) of
    a chain with these emissions; ``pairs[a, b]`` is the score of b after a."""
    (p00, p01), (p10, p11) = pairs.tolist()
    back = np.zeros((len(scores), 2), bool)
    a = b = 0.0
    for i, s in enumerate(scores.tolist()):
        if i:
            a0, a1, b0, b1 = a + p00, b + p10, a + p01, b + p11
            back[i, 0], back[i, 1] = a1 > a0, b1 > b0
            a, b = max(a0, a1), max(b0, b1) + s
        else:
            a, b = 0.0, start + s
    out = np.zeros(len(scores), np.int8)
    label = int(b > a)
    for i in range(len(scores) - 1, -1, -1):
        out[i] = label
        label = int(back[i, label])
    return out


def marginals(scores: np.ndarray, size: np.ndarray, start: float, pairs: np.ndarray) -> tuple:
    """(log-normaliser per chain, chance of boilerplate per line, expected
    pairs) of chains in the rows of ``scores``, longest first."""
    n, width = scores.shape
    ahead = np.zeros((width, n, 2))
    ahead[0, :, 1] = start + scores[:, 0]
    active = [int((size > t).sum()) for t in range(width)]
    for t in range(1, width):
        m = active[t]
        ahead[t, :m] = np.logaddexp(ahead[t - 1, :m, :1] + pairs[0], ahead[t - 1, :m, 1:] + pairs[1])
        ahead[t, :m, 1] += scores[:m, t]
    tail = ahead[size - 1, np.arange(n)]
    norm = np.logaddexp(tail[:, 0], tail[:, 1])
    behind = np.zeros((n, 2))
    chance, expected = np.zeros((n, width)), np.zeros((2, 2))
    for t in range(width - 1, -1, -1):
        m = active[t]
        both = ahead[t, :m] + behind[:m]
        chance[:m, t] = sigmoid(both[:, 1] - both[:, 0])
        if t:
            reach = behind[:m].copy()
            reach[:, 1] += scores[:m, t]
            joint = ahead[t - 1, :m, :, None] + pairs[None] + reach[:, None, :]
            expected += np.exp(joint - norm[:m, None, None]).sum(axis=0)
            behind[:m] = np.logaddexp(joint[:, :, 0], joint[:, :, 1]) - ahead[t - 1, :m]
    return norm, chance, expected


def ascend(chains: list[np.ndarray], labels: list[np.ndarray]) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, start score and pair scores of greatest penalised likelihood
    (Adam steps over all chains)."""
    order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
    size = np.array([len(chains[i]) for i in order])
    bins = np.concatenate([chains[i] for i in order]) + _FIRST[:-1]
    truth = np.concatenate([labels[i] for i in order]).astype(float)
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    joined = np.flatnonzero(col > 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[joined - 1].astype(int), truth[joined].astype(int)), 1)
    p = np.zeros(WEIGHTS + 5)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        pairs = p[WEIGHTS + 1:].reshape(2, 2)
        scores = np.zeros((len(size), int(size.max())))
        scores[row, col] = p[bins].sum(axis=1)
        _, chance, expected = marginals(scores, size, p[WEIGHTS], pairs)
        miss = truth - chance[row, col]
        g = np.concatenate([np.bincount(bins.ravel(), np.repeat(miss, bins.shape[1]), WEIGHTS), [miss[col == 0].sum()],
                            (seen - expected).ravel()]) / len(truth) - RIDGE * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return p[:WEIGHTS], float(p[WEIGHTS]), p[WEIGHTS + 1:].reshape(2, 2)


def train(chains: list[np.ndarray], good: list[bool]) -> tuple[np.ndarray, float, np.ndarray]:
    """A field from chains of binned lines of good and bad documents."""
    labels = [np.full(len(c), not g, np.int8) for c, g in zip(chains, good)]
    model = ascend(chains, labels)
    for _ in range(ROUNDS - 1):
        for i, g in enumerate(good):
            if not g:
                found = viterbi(emissions(chains[i], model[0]), *model[1:])
                if found.mean() >= 0.5:
                    labels[i] = found
        model = ascend(chains, labels)
    return model


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches, "text"):
        lines = Lines(*utf8(b.column(b.schema.get_field_index("text"))))
        rows = []
        for d, (doc, good) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            for i in range(int(lines.bounds[d]), int(lines.bounds[d + 1]), CHAIN):
                rows.append((doc, good, i - int(lines.bounds[d]), lines.bins[i:min(i + CHAIN, lines.bounds[d + 1])].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
                zip(*rows), (pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], ["doc_id", "good", "line", "bins"])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, np.ndarray]:
    """A field from at most ``TRAIN_DOCS`` rows of ``labels(doc_id, quality)``
    and ``TRAIN_CHAINS`` chains of their documents in ``docs(doc_id, text)``,
    lowest hashes first. Rows with a NULL id or label teach nothing; an id
    with several labels has the greatest. Without both kinds every line is
    content."""
    spark = docs.sparkSession
    marks = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)).collect()
    rows = []
    if marks:
        known = F.broadcast(spark.createDataFrame([(r.doc_id, r.good) for r in marks], "_id bigint, good boolean"))
        chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(known, F.col("doc_id") == F.col("_id"))
        rows = (chosen.select("doc_id", "good", "text").mapInArrow(released(_chains), "doc_id bigint, good boolean, line bigint, bins binary")
                .orderBy(F.xxhash64("doc_id", "line"), "doc_id", "line", "bins").limit(TRAIN_CHAINS).collect())
    if len({r.good for r in rows}) < 2:
        return np.zeros(WEIGHTS), -1.0, np.zeros((2, 2))
    rows.sort(key=lambda r: (r.doc_id, r.line, bytes(r.bins)))
    return train([np.frombuffer(r.bins, np.uint8).reshape(-1, len(FEATURES)) for r in rows], [r.good for r in rows])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines", "content_chars")
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("chars", pa.int64()), ("content", pa.bool_())]))


def _label(shared, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, start, pairs = shared.value
        for b in text_slices(batches, "text"):
            lines = Lines(*utf8(b.column(b.schema.get_field_index("text"))))
            scores = emissions(lines.bins, weights)
            content = np.zeros(len(scores), bool)
            for lo, hi in zip(lines.bounds[:-1].tolist(), lines.bounds[1:].tolist()):
                if hi > lo:
                    content[lo:hi] = viterbi(scores[lo:hi], start, pairs) == 0
            total = np.concatenate([[0], np.cumsum(content)])
            inside = np.concatenate([[0], np.cumsum(content * lines.chars)])
            counts = {c: getattr(lines, c) for c in COUNTS[:5]} | {
                "n_lines": np.diff(lines.bounds), "n_content_lines": np.diff(total[lines.bounds]),
                "content_chars": np.diff(inside[lines.bounds])}
            names = [f.name for f in b.schema if f.name != "text"]
            cols = [b.column(b.schema.get_field_index(n)) for n in names]
            cols += [pa.array(counts[c].astype(np.int64)) for c in COUNTS]
            if spans:
                point = np.concatenate([[0], np.cumsum(_lead[lines.raw])])
                base = np.repeat(point[lines.offsets[:-1]], np.diff(lines.bounds))
                at, to = point[lines.start] - base, point[lines.start + lines.length] - base
                rows = [{"start": s, "chars": e - s, "content": c} for s, e, c in zip(at.tolist(), to.tolist(), content.tolist())]
                cols.append(pa.array([rows[x:y] for x, y in zip(lines.bounds[:-1], lines.bounds[1:])], _SPAN))
            yield pa.RecordBatch.from_arrays(cols, names + list(COUNTS) + ["lines"] * spans)
    return run


def label_lines(docs: DataFrame, model: tuple[np.ndarray, float, np.ndarray], spans: bool = True) -> DataFrame:
    """Per row of ``docs(doc_id, text)`` its counts (``COUNTS``) and ``lines``,
    the place (code points), length and label of each line with a word. NULL
    texts are empty and have no lines."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    more = ", lines array<struct<start:bigint,chars:bigint,content:boolean>>" if spans else ""
    return docs.select("doc_id", "text").mapInArrow(released(_label(shared, spans)), schema + more)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of documents its counts, ``base_failed`` by the plain rules
    (too few words, too many repeated ones), the share of word characters in
    content lines (0 without words) and ``kept``. Repeated rows are judged
    each; other columns are ignored; a table without rows gives none."""
    pairs = docs.select("doc_id", "text")
    out = label_lines(pairs, fit(pairs, labels.select("doc_id", "quality")), spans=False)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    share = F.coalesce(F.try_divide(F.col("content_chars").cast("double"), F.col("word_chars")), F.lit(0.0))
    return out.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & (share >= CONTENT_SHARE)).alias("kept"),
                      "n_lines", "n_content_lines", share.alias("content_share"))
