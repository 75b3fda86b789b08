"""Decontamination: tiles by hand, reordered passages, odd rows."""

import random

import numpy as np

from ledgerlens.llm import decontam


def naive_tiles(item, text, least):
    """Greedy string tiling by trying every pair of starts."""
    mi, mt, tiles = [False] * len(item), [False] * len(text), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                k = 0
                while i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k] and not mt[i + k] and not mi[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return sorted(tiles)
        tiles.append((i, j, k))
        mt[i:i + k] = [True] * k
        mi[j:j + k] = [True] * k


def test_tiles_equal_the_naive_ones():
    rng = random.Random(2)
    for _ in range(60):
        item = [rng.randint(1, 6) for _ in range(rng.randint(5, 40))]
        text = [rng.randint(1, 6) for _ in range(rng.randint(5, 60))]
        if rng.random() < 0.7:
            a = rng.randrange(len(item))
            text = text[:10] + item[a:] + text[10:20] + item[:a] + text[20:]
        least = rng.choice([2, 3, 5])
        seeds = [i for i in range(len(text) - least + 1)
                 if any(text[i:i + least] == item[j:j + least] for j in range(len(item) - least + 1))]
        got = decontam.tile(np.array(item, np.uint64), np.array(text, np.uint64), np.array(seeds, np.int64), least)
        assert sum(t[2] for t in got) == sum(t[2] for t in naive_tiles(item, text, least))
        assert all(text[i:i + k] == item[j:j + k] for i, j, k in got)


W = [f"w{i}" for i in range(400)]


def test_documents_with_items(spark):
    item = " ".join(W[:30])
    docs = [
        (1, "intro " + item + " outro", True), (2, " ".join(W[15:30] + ["mid"] * 5 + W[:15]), True),        # reordered
        (3, ", ".join(w.upper() for w in W[:30]) + "!", True), (4, " ".join(W[:12]), False),                 # 40 % only
        (5, " ".join(x for i in range(0, 30, 4) for x in (*W[i:i + 4], "gap")), False),                      # runs too short
        (6, None, False), (7, "", False), (8, "z " * 20000 + item + " z" * 20000, True), (9, "tiny item", True), (9, "clean", False),
        (None, item, True), (10, " ".join(W[100:130]), True)]
    bench = [(1, item), (2, "tiny item"), (3, None), (4, "..."), (5, " ".join(W[100:130])), (5, " ".join(W[100:130])), (None, "clean")]
    df = spark.createDataFrame([(i, t, 0.0) for i, t, _ in docs], "doc_id bigint, text string, coverage double")
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    got = decontam.contamination(df, b).collect()
    assert sorted(((r.doc_id, r.contaminated) for r in got), key=str) == sorted(((i, c) for i, _, c in docs), key=str)
    two = next(r for r in got if r.doc_id == 2)
    assert two.coverage == 1.0 and two.tiles == "1:0:15,1:20:15"
    kept = decontam.drop_contaminated(df, b)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 9]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(W[i:i + 40])) for i in range(0, 300, 20)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(W[i:i + 20])) for i in range(0, 300, 10)], "item_id bigint, text string")
    whole = sorted((r.doc_id, r.item_ids) for r in decontam.contamination(docs, bench).collect())
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1500)
    assert sorted((r.doc_id, r.item_ids) for r in decontam.contamination(docs, bench).collect()) == whole
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(docs.limit(0), bench).count() == 0
