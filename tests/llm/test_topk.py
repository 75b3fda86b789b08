"""Exact top-k against scoring all pairs with whole numbers."""

import math
import random

from ledgerlens.llm import topk


def brute(rows, queries, k):
    def scaled(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(64 * x) for x in v]

    usable = [(i, scaled(v)) for i, v in rows if i is not None and scaled(v) is not None]
    out = []
    for q, x in queries:
        x = scaled(x)
        if x is None:
            continue
        best = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in usable if i != q and len(y) == len(x)))[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, queries, k):
    schema = "vec_id bigint, embedding array<float>"
    got = topk.top_k(spark.createDataFrame(rows, schema), spark.createDataFrame(queries, schema), k)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())


def test_matches_all_pairs_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng = random.Random(3)
    as32 = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [as32(rng.uniform(-1, 1)) for _ in range(4)]) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(150)]           # one vector, many times
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan")] * 4), (903, [float("inf"), 0.0, 0.0, 0.0]),
             (904, [1.0, 2.0]), (905, [3.0, -1.0]), (920, [2.0, 2.0]), (None, [1.0] * 4), (910, [1e4, -1e4, 1e4, 0.0]), (940, [0.0] * 4)]
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    assert run(spark, rows, queries, 7) == brute(rows, queries, 7)


def test_fewer_rows_than_k_and_no_queries(spark):
    rows = [(20, [1.0, -1.0]), (21, [0.5, 0.5]), (22, [-0.3, 0.2])]
    assert run(spark, rows, rows[:1], 20) == brute(rows, rows[:1], 20)
    assert run(spark, rows, [(40, None)], 3) == []
