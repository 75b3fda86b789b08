"""Sentences and sentiment: split (T14), quality filter (T15, T16), scorer
(N1), section aggregates (G3, G4), most negative sentence (W5), pivots (N3).

Scale notes: sentences are produced by ``posexplode`` in the stage that
reads the text; the scorer is a Column expression (lexicon) or an
Arrow-batched iterator pandas UDF (model), so scoring is spread over all
tasks. Section aggregates and the most negative sentence are plain
aggregates (``count``/``avg``/``max_by``) with map-side partial
aggregation, so a section with a very large share of all sentences never
lands in one task.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from types import ModuleType

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.text import is_quality_sentence, split_sentences, term_count

# Default lexicon scorer vocabulary (this library's own choice; the study
# used a fine-tuned language model that is not available here).
POSITIVE_TERMS = ["gain", "growth", "improve", "increase", "profit", "strong",
                  "success", "benefit", "favorable", "opportunit"]
NEGATIVE_TERMS = ["loss", "decline", "adverse", "default", "impair", "litigation",
                  "weak", "failure", "downturn", "volatil"]


def sentences(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """One row per non-empty sentence with its 0-based number."""
    keep = [c for c in (keep or df.columns) if c != text]
    return df.select(*keep, F.posexplode(split_sentences(F.col(text))).alias("sentence_no", "sentence"))


def quality_sentences(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """T14 then T15."""
    return sentences(df, text, keep).where(is_quality_sentence(F.col("sentence")))


def lexicon_scorer(positive: Sequence[str] = POSITIVE_TERMS,
                   negative: Sequence[str] = NEGATIVE_TERMS) -> Callable[[Column], Column]:
    """N1 default: label by substring hits of two term lists; the score is a
    confidence in [0.5, 1): 0.5 + 0.5 * |pos - neg| / (pos + neg + 1)."""
    def score(s: Column) -> Column:
        ls = F.lower(s)
        pos, neg = term_count(ls, positive, lowered=True), term_count(ls, negative, lowered=True)
        label = F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")
        conf = F.lit(0.5) + F.lit(0.5) * F.abs(pos - neg) / (pos + neg + 1)
        return F.struct(label.alias("label"), conf.alias("score"))
    return score


def word_ends(text: str) -> list[int]:
    """Ends of the runs outside white space."""
    return [m.end() for m in re.finditer(r"\S+", text)]


def per_worker(key: str, make: Callable[[], object]) -> object:
    """``make()``, called once in a Python worker process for each ``key``.
    Functions travel to workers by value and have no module of their own
    there, so a named place among the interpreter's modules holds the object."""
    place = sys.modules.setdefault("_per_worker", ModuleType("_per_worker")).__dict__
    if key not in place:
        place[key] = make()
    return place[key]


def model_scorer(predict: Callable[[list[str]], list[tuple[str, float]]] | None = None, batch_size: int = 32,
                 load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]] | None = None,
                 max_tokens: int | None = None,
                 token_ends: Callable[[str], list[int]] = word_ends) -> Callable[[Column], Column]:
    """N1 pluggable: a batch predictor ``list[str] -> [(label, score)]`` as an
    iterator pandas UDF.

    A model is made by ``load`` once per Python worker process, not per task
    (``predict`` is a predictor that needs no loading). Texts longer than
    ``max_tokens`` tokens, whose ends ``token_ends`` gives, are cut behind the
    last one (models commonly take 512; off by default). Texts of similar
    length are predicted together, ``batch_size`` a call, and results go back
    to their rows. A NULL text is empty."""
    if (predict is None) == (load is None):
        raise ValueError("either a predictor or its loader")
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
    key = uuid.uuid4().hex

    @F.pandas_udf(schema)
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = predict or per_worker(key, load)
        for s in batches:
            texts = s.fillna("").tolist()
            ends = [token_ends(t) for t in texts]
            if max_tokens is not None:
                texts = [t[:e[max_tokens - 1]] if len(e) > max_tokens else t for t, e in zip(texts, ends)]
            order = sorted(range(len(texts)), key=lambda i: (len(ends[i]), i))
            found: list = [None] * len(texts)
            for i in range(0, len(order), batch_size):
                some = order[i:i + batch_size]
                for k, (label, score) in zip(some, model([texts[k] for k in some])):
                    found[k] = (label, float(score))
            yield pd.DataFrame(found, columns=["label", "score"])

    return lambda c: _score(c)


def score_sentences(sents: DataFrame, scorer: Callable[[Column], Column] | None = None,
                    text_chars: int | None = None) -> DataFrame:
    """(…, sentence_no, text, label, score); ``text_chars`` cuts the text
    (the study keeps 120 characters)."""
    scorer = scorer or lexicon_scorer()
    x = sents.withColumn("_s", scorer(F.col("sentence")))
    # the struct is read twice below; keep it as one staged column
    keep = [c for c in sents.columns if c != "sentence"]
    text = F.col("sentence") if text_chars is None else F.substring("sentence", 1, text_chars)
    return x.select(*keep, text.alias("text"),
                    F.col("_s.label").alias("label"), F.col("_s.score").alias("score"))


def section_sentiment(scored: DataFrame, keys: Sequence[str],
                      min_sentences: int = C.MIN_SENTENCES) -> DataFrame:
    """G3 + G4: n, label shares, mean confidence of positives / negatives
    (0 when none), score = pos - neg; ratios NULL under ``min_sentences``."""
    lab = F.col("label")
    agg = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sentences"),
        # shares as exact count / n (independent of summation order)
        (F.count(F.when(lab == "positive", 1)) / F.count(F.lit(1))).alias("positive_ratio"),
        (F.count(F.when(lab == "negative", 1)) / F.count(F.lit(1))).alias("negative_ratio"),
        (F.count(F.when(lab == "neutral", 1)) / F.count(F.lit(1))).alias("neutral_ratio"),
        F.coalesce(F.avg(F.when(lab == "positive", F.col("score"))), F.lit(0.0)).alias("avg_positive_conf"),
        F.coalesce(F.avg(F.when(lab == "negative", F.col("score"))), F.lit(0.0)).alias("avg_negative_conf"),
    )
    ok = F.col("n_sentences") >= min_sentences
    cols = ["positive_ratio", "negative_ratio", "neutral_ratio", "avg_positive_conf", "avg_negative_conf"]
    out = agg.select(*keys, F.col("n_sentences").cast("int").alias("n_sentences"),
                     *[F.when(ok, F.col(c)).alias(c) for c in cols])
    return out.withColumn("sentiment_score", F.col("positive_ratio") - F.col("negative_ratio"))


def with_scaffold(agg: DataFrame, scaffold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every scaffold key gets a row; a missing text gives n = 0."""
    j = scaffold.join(agg, on=list(keys), how="left")
    return j.withColumn("n_sentences", F.coalesce(F.col("n_sentences"), F.lit(0)))


def most_negative(scored: DataFrame, keys: Sequence[str],
                  order: Sequence[str] = ("doc_id", "sentence_no"),
                  min_sentences: int = C.MIN_SENTENCES) -> DataFrame:
    """The highest-confidence negative sentence per key with at least
    ``min_sentences`` sentences (earliest on ties), as a partial aggregate
    (``max_by`` over a struct ordering)."""
    negative = F.col("label") == "negative"
    rank = F.struct(F.col("score"), *[(-F.col(o)).alias(o) for o in order])
    best = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(F.when(negative, F.col("text")), F.when(negative, rank)).alias("text"),
        F.max(F.when(negative, F.col("score"))).alias("score"))
    return best.where((F.col("_n") >= min_sentences) & F.col("score").isNotNull()).drop("_n")


def firm_year_cells(df: DataFrame, value: str, index: Sequence[str] = ("firm", "status"),
                    year: str = "fiscal_year") -> DataFrame:
    """N3 / G10 as rows (index..., year, value): one per firm and year with a
    value, the smallest where a firm has several."""
    return df.where(F.col(value).isNotNull()).groupBy(*index, year).agg(F.min(value).alias(value))


def pivot_by_year(df: DataFrame, value: str, years: Sequence[int] | None = None,
                  index: Sequence[str] = ("firm", "status"), year: str = "fiscal_year") -> DataFrame:
    """Firm x year with status, sorted by status and firm. The
    years are those that have a value (one pass finds them); given ``years``
    it is these, and no pass is needed."""
    cells = firm_year_cells(df, value, index, year)
    wide = cells.groupBy(*index).pivot(year, list(years) if years is not None else None).agg(F.first(value))
    return wide.orderBy(*reversed(index))
