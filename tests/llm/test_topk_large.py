"""Vectors with large finite components take part."""

import math
import random

import pytest

from ledgerlens.llm import topk


def brute(rows, k):
    whole = {i: [math.floor(x * 64) for x in v] for i, v in rows}
    out = set()
    for q, x in whole.items():
        ranked = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in whole.items() if c != q)[:k]
        out |= {(q, n, c, -s) for n, (s, c) in enumerate(ranked, 1)}
    return out


def test_large_components_take_part(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100, [2.0 ** 21, 0.5, 0.0, 0.0]), (101, [-3000001.25, 1.0, 2.0, 0.3]), (102, [0.0, 7e6 + 1 / 64, 0.0, -1e7]),
             (103, [0.0, 0.0, 1e12 + 0.25, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    queries = docs.where("vec_id <> 103")
    want = {r for r in brute(rows, 8) if r[0] != 103}
    assert {tuple(r) for r in topk.top_k(docs, queries, k=8).collect()} == want
    assert {100, 101, 102, 103} <= {r[2] for r in want}


def test_a_score_beyond_a_long_is_an_error(spark):
    docs = spark.createDataFrame([(1, [1e15]), (2, [1e15]), (3, [-1e15])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond 2"):
        topk.top_k(docs, docs.where("vec_id = 1"), k=1).collect()
