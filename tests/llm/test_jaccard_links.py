"""The number of links of each document against all pairs and SQL's ``degree``."""

import duckdb
import pytest

from ledgerlens.llm import jaccard

from test_jaccard import corpus, shingles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("hot", [jaccard.HOT, 3])
def test_link_counts_match_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    want = {i: sum(j != i and bool(s & t) and 100 * len(s & t) >= 80 * len(s | t) for j, t in sets.items())
            for i, s in sets.items()}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.n_links for r in jaccard.link_counts(docs).collect()} == want
    assert max(want.values()) > 2


def test_links_between_similar_texts_of_one_component(spark):
    base = [f"word{i}" for i in range(100)]
    texts = [" ".join(base[:i] + [f"new{i}"] + base[i + 1:]) for i in (0, 30, 60, 99)]
    rows = list(enumerate(texts + texts[:1])) + [(4, texts[0]), (None, texts[0]), (9, None), (10, "other")]
    got = jaccard.link_counts(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.doc_id, r.n_links) for r in got.collect()} == {*((i, 4) for i in range(5)), (None, 0), (9, 0), (10, 0)}


def test_link_counts_equal_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        want = sorted(con.execute(jaccard.LINKS_SQL).fetchall())
    got = sorted(map(tuple, jaccard.link_counts(docs).collect()))
    assert got == want and any(n for _, n in want)
