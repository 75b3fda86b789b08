"""The manifest against a plain tree, and proofs that fold to the root."""

import hashlib
import zlib

import pytest

from ledgerlens.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, path int"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        run = i // 8 * 8
        out.append((level[run:i], level[i + 1:run + 8]))
        i //= 8
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row, by
    plain lists."""
    marks = [((r[0], r[3], r[2], r[4], r[1]), r) for r in rows]
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(((m[0] is not None, m[0] or 0, leaf_of(m), r) for m, r in marks if r[2] == lang), key=lambda x: x[:3])
        trees[lang] = (own, levels([x[2] for x in own]))
    forest = levels([trees[lang][1][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        own, tree = trees[lang]
        for i, (_, _, leaf, r) in enumerate(own):
            path = siblings(tree, i) + siblings(forest, k)
            at = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                at = leaf_of((r[0], r[3], r[2], r[4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])))
            for left, right in path:
                at = h("".join(left) + at + "".join(right))
            out.append((r[0], leaf, tree[-1][0], forest[-1][0], h("".join("".join(a + b) for a, b in path)), at, at == forest[-1][0]))
    return out


def got(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    out = merkle.manifest(df)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in out.collect()]


def mixed():
    rows = [(i, f"Text {i}" if i % 5 else f"text {i}", "a", f"s{i % 3}", i) for i in range(530)]
    rows += [(i, "É Ω Z", "b", None, None) for i in range(1000, 1009)]
    rows += [(7, None, None, "s", 0), (None, "No Id", None, "s", 0), (8, "", None, "", 0), (9, "x" * 50_000 + "Q", "ü", "s", 1)]
    rows += [(11, "Same", "dup", "s", 1)] * 70 + [(11, "Other", "dup", "s", 1)]
    return rows + [(2000 + i, "T", f"lang {i}", "s", 1) for i in range(20)]


@pytest.mark.parametrize("digits", [1, 4])
def test_against_plain_trees(spark, monkeypatch, digits):
    # one digit to a block: four tiers of blocks; four: blocks partly filled
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(merkle, "BLOCK_BITS", 3 * digits)
    rows = mixed()
    key = lambda t: (t[0] is not None, t[0] or 0, t[1:])
    want = sorted(plain(rows), key=key)
    have = sorted(got(spark, rows), key=key)
    assert have == want
    assert {t[6] for t in have} == {True, False}


@pytest.mark.parametrize("rows", [[], [(5, "One", "a", "s", 1)], [(5, "One", "a", "s", 1), (6, "Two", "b", "s", 1)]])
def test_none_one_and_two(spark, rows):
    assert sorted(got(spark, rows)) == sorted(plain(rows))
