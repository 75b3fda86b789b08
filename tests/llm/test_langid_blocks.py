"""Language models of more runs than one array may hold."""

import numpy as np
import pytest

from ledgerlens.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


def test_blocks_score_as_one_array_does(spark, docs, monkeypatch):
    want = {r.doc_id: r for r in langid.predict(docs).collect()}
    monkeypatch.setattr(langid, "MODEL_RUNS", 1000)
    monkeypatch.setattr(langid, "BLOCK_CELLS", 20_000)
    models = langid.fit(docs)
    assert models.langs == ["de", "en", "es", "fr"] and len(models.blocks[langid.ORDER - 1]) > 1
    got = {r.doc_id: r for r in langid.predict(docs).collect()}
    assert got.keys() == want.keys()
    for i, r in want.items():
        assert got[i].lang_pred == r.lang_pred and got[i].rejected == r.rejected
        assert abs(got[i].score - r.score) < 1e-5


def test_a_rare_language_beside_a_large_one_stays(spark, monkeypatch):
    rng = np.random.default_rng(3)

    def words(letters, n):
        return " ".join("".join(rng.choice(list(letters), rng.integers(3, 8))) for _ in range(n))

    large = words("abcdefghijklm", 1500)
    rows = [(i, large, "big") for i in range(20)] + [(100, words("nopqrstu", 12), "small")]
    monkeypatch.setattr(langid, "MODEL_RUNS", 2000)
    models = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    new = spark.createDataFrame([(1, words("nopqrstu", 12)), (2, words("abcdefghijklm", 12))], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(new, models).collect()} == {1: "small", 2: "big"}
