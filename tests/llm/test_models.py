"""Held-out accuracy and odd rows of the three learned operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(-1, None), (-2, ""), (-3, "1234 !!"), (-4, "a" * 40000), (-5, "I.D.I.O.T x"), (None, "plain")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def accuracy(scored, labels, name):
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    return np.mean([r.predicted == r[name] for r in rows]), len(rows)


def odd(spark, docs):
    # a column that clashes with an output name must not matter
    extra = spark.createDataFrame([(i, t, None) for i, t in ODD], "doc_id bigint, text string, lang string")
    return docs.select("doc_id", "text", "lang").unionByName(extra).withColumn("score", F.lit(0))


def test_toxicity(spark, tables):
    docs, labels = tables
    scored = toxicity.classify(odd(spark, docs), labels).cache()
    assert scored.count() == docs.count() + len(ODD)
    acc, n = accuracy(scored, labels, "toxic")
    assert n > 50 and acc >= 0.93
    rows = {r.doc_id: r for r in scored.where("doc_id < 0 or doc_id is null").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert abs(rows[-1].score - rows[-2].score) < 1e-9 and rows[-5].score > rows[-2].score


def test_toxic_strings_with_gaps():
    bad = ["idiot", "moron", "stupid", "pathetic", "worthless"]
    rng = np.random.default_rng(0)
    good = ["".join(rng.choice(list("thersandiou"), rng.integers(3, 9))) for _ in range(400)]
    memo = toxicity._memo(*toxicity.fit_strings(bad, good[:200], good))
    words = ["idiot", "i-d-i-o-t", "stuxpid", "m.o.r.o.n", "patheticc"]
    at = memo.look_up(words + good)
    margin, plain = memo.values[at[:len(words)]], memo.values[at[len(words):]]
    assert (margin > np.quantile(plain, 0.99)).all()
    assert toxicity.words_of("you i d i o t!") >= {"you", "i d i o"} or "i d i o t" in toxicity.words_of("you i d i o t")


def test_toxicity_without_labels(spark, tables):
    docs, labels = tables
    few = docs.limit(5)
    assert toxicity.classify(few, labels.limit(0)).count() == 5
    assert toxicity.classify(few, labels.where("toxic = 0")).select("score").distinct().count() == 1
    assert toxicity.classify(few.limit(0), labels).count() == 0
    clean = toxicity.drop_toxic(docs, labels)
    assert clean.columns == docs.columns
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    assert np.mean([i in kept for i, t in marks.items() if t == 0]) > 0.97
    assert np.mean([i in kept for i, t in marks.items() if t == 1]) < 0.25


def test_language(spark, tables):
    docs, _ = tables
    got = langid.predict(odd(spark, docs)).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    held = [r for r in got if r.held_out and r.lang]
    assert len(held) > 150 and np.mean([r.lang_pred == r.lang for r in held]) >= 0.98
    odd_rows = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id < 0}
    assert all(odd_rows[i].lang_pred == "und" and odd_rows[i].score == 0 for i in (-1, -2, -3))
    assert all(0 <= r.score <= 1 for r in got) and odd_rows[-4].lang_pred in {"en", "fr", "de", "es"}
    empty = docs.limit(0)
    assert langid.predict(empty).count() == 0
    no_lang = docs.limit(3).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.predict(no_lang).collect()} == {"und"}


def test_kneser_ney_probabilities_sum_to_one():
    words = ["banana", "band", "nab", "an"] * 2
    points, place = langid.codes_of(words)
    models = langid.build(["x"], {"x": langid._events(points, place, np.ones(len(points)))})
    symbols = np.arange(langid.SYMBOLS, dtype=np.uint64)
    for context in ([], [langid.START], [langid.START, ord("b")], [ord("a"), ord("n"), ord("a"), ord("n")], [ord("q"), ord("n")]):
        p = np.full(langid.SYMBOLS, 1.0 / langid.SYMBOLS)
        for n in range(len(context) + 1):
            key = np.uint64(0)
            for c in context[len(context) - n:]:
                key = (key << langid.BITS) | np.uint64(c)
            at = np.searchsorted(models.keys, key)
            left = models.rest[at, 0] if at < len(models.keys) and models.keys[at] == key else 1.0
            runs = (key << langid.BITS) | symbols
            found = np.minimum(np.searchsorted(models.keys, runs), len(models.keys) - 1)
            p = np.where(models.keys[found] == runs, models.gain[found, 0], 0) + left * p
        assert abs(p.sum() - 1) < 1e-5 and (p > 0).all(), context
    seen = langid.word_costs(["banana"], models)[0]
    unseen = langid.word_costs(["zzzzzz"], models)[0]
    assert seen[-1] == unseen[-1] == 7 and seen[0] < unseen[0]


def test_quality(spark, tables):
    docs, labels = tables
    scored = quality.classify(odd(spark, docs), labels).cache()
    assert scored.count() == docs.count() + len(ODD)
    acc, n = accuracy(scored, labels, "quality")
    assert n > 80 and acc >= 0.95
    rows = {r.doc_id: r for r in scored.where("doc_id < 0 or doc_id is null").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert abs(rows[-1].score - rows[-2].score) < 1e-9
    assert quality.classify(docs.limit(3), labels.limit(0)).select("score").distinct().count() == 1
    assert quality.classify(docs.limit(0), labels).count() == 0
