"""N-gram Jaccard join against comparing all pairs."""

import random
import re

from ledgerlens.llm import jaccard
from ledgerlens.llm.components import components


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    texts = [None, "", "  \t\n", "one two", "ONE two", "one two three four", "a b c d e", "A B\tC\x0bD E",
             "x" * 9000, "É b", "é b", "a b c d", "a b c d e f", "nbsp\xa0joined b c d e"]
    for size in (8, 30, 60, 200):
        base = [word() for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 12):
            t = base[:]
            for _ in range(edits):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
        # chains: each drops a little more from the start, so ends do not link
        texts += [" ".join(base[k * max(1, size // 30):]) for k in range(6)]
    texts += ["common passage shared by many documents here " * 3 + " ".join(word() for _ in range(n)) for n in range(5, 60, 5)]
    texts += [" ".join(word() for _ in range(5000))] * 2
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [(1000 - i if i % 3 else i, t) for i, t in rows]


def test_components_match_all_pairs(spark):
    rows = corpus()
    want = brute(rows)
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id bigint, text string, n int, component string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == want
    kept = jaccard.keep_one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_n, c) in want.items() if c == i)
    assert kept.columns == docs.columns


def test_null_ids_repeated_rows_and_empty_table(spark):
    t = "some words that are long enough to be shingled"
    docs = spark.createDataFrame([(None, t), (None, None), (4, t), (4, t), (7, t), (8, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 5, None), (None, 0, None), (4, 5, 4), (4, 5, 4), (7, 5, 4), (8, 0, 8)], key=str)
    kept = [r.doc_id for r in jaccard.keep_one_of_each(docs).collect()]
    assert sorted(kept, key=str) == [4, 8, None, None]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 99), (101, 100)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 99: 99, 100: 99, 101: 99}
