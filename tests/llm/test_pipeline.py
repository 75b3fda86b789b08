"""The pipeline stage by stage against plain Python, and as a whole."""

import os
import sys

from test_pii import brute as spans_of  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as cp  # noqa: E402
from ledgerlens.llm.common import stage  # noqa: E402

from test_jaccard import brute as components_of  # noqa: E402
from test_packing import ids_of  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    at = [docs]
    for name, step in cp.STAGES[:-1]:
        at.append(stage(step(spark, at[-1], SF), f"test-{name}"))
        assert at[-1].columns == columns, name
    texts = [{r.doc_id: r.text for r in d.collect()} for d in at]
    # toxicity: clean labelled documents stay, most toxic ones go
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(texts[0]) - set(texts[1])
    assert sum(toxic.get(i) == 0 for i in gone) <= 0.02 * len(texts[0])
    assert sum(t == 1 for i, t in toxic.items() if i in texts[1]) <= 0.4 * sum(t == 1 for t in toxic.values())
    # near duplicates: one document of each component
    assert set(texts[2]) == {i for i, (_n, c) in components_of(texts[1].items()).items() if c == i}
    # decontamination: no kept document holds a whole item
    flat = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i, t in texts[2].items() if any(f" {x} " in f" {flat(t)} " for x in items)}
    assert held and not held & set(texts[3])
    assert len(texts[2]) - len(texts[3]) <= 2 * len(held) + 3
    # personal data: replaced, and other texts unchanged
    assert set(texts[4]) == set(texts[3])
    for i, t in texts[3].items():
        if spans_of(t or ""):
            assert spans_of(texts[4][i]) == "" and texts[4][i] != t
        elif "[TERM]" not in (texts[4][i] or ""):
            assert texts[4][i] == t
    pieces = cp.STAGES[-1][1](spark, at[-1], SF).collect()
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {i: len(ids_of(t)) for i, t in texts[4].items()}
    # the run as a whole packs the same documents
    again = {}
    for p in cp.run(spark, SF).collect():
        again[p.doc_id] = again.get(p.doc_id, 0) + p.length
    assert again == total


def test_stages_on_odd_rows_and_on_none(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words), (1, words), (2, words), (3, None), (4, ""), (None, words + " more"), (None, None), (5, "write to a.b@example.org now"), (6, "x")]
    docs = spark.createDataFrame([(i, t, "en", None, 1, "kept") for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string")
    at = docs
    for name, step in cp.STAGES[:-1]:
        at = stage(step(spark, at, SF), f"odd-{name}")
        assert at.columns == docs.columns, name
    got = sorted(((r.doc_id or 0, r.text) for r in at.collect()), key=str)
    assert [i for i, _ in got] == [0, 0, 1, 3, 4, 5, 6]
    assert all(r.extra == "kept" and r.source is None for r in at.collect())
    assert dict(got)[3] is None and dict(got)[4] == "" and "example.org" not in dict(got)[5]
    pieces = cp.STAGES[-1][1](spark, at, SF).collect()
    assert sum(p.length for p in pieces) == sum(len(ids_of(t)) for _, t in got)
    at = docs.limit(0)
    for _, step in cp.STAGES:
        at = step(spark, at, SF)
        assert at.count() == 0
