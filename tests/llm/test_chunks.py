"""Chunk deduplication: boundaries, shifts, copies and odd rows."""

import random

import numpy as np

from ledgerlens.llm import chunks


def text(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9))) for _ in range(words))


def bounds(s):
    raw = np.frombuffer(s.encode(), np.uint8)
    return chunks.cuts(raw, np.array([0, len(raw)]))[0].tolist()


def slow_hash(raw, i):
    h = 0
    for b in raw[i + 1 - chunks.WINDOW:i + 1]:
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFF
    return h


def test_hash_and_sizes():
    s = text(1, 800)
    raw = s.encode()
    fast = chunks.gear_hashes(np.frombuffer(raw, np.uint8))
    assert all(int(fast[i]) == slow_hash(raw, i) for i in range(31, 400))
    ends = bounds(s)
    sizes = np.diff([0] + ends)
    assert ends[-1] == len(raw) and sizes.max() <= chunks.MOST and (sizes[1:-1] >= chunks.LEAST).all()
    for e in ends:
        raw[:e].decode()
    assert max(np.diff([0] + bounds("a" * 5000))) <= chunks.MOST and bounds("") == []


def test_an_insertion_moves_only_near_boundaries():
    s = text(2, 600)
    a = {s.encode()[x:y] for x, y in zip([0] + bounds(s), bounds(s))}
    t = s[:1500] + "INSERTED" + s[1500:]
    b = {t.encode()[x:y] for x, y in zip([0] + bounds(t), bounds(t))}
    assert len(a - b) <= 10 and len(a & b) >= 0.8 * len(a)


def test_passages_go_and_clean_texts_stay(spark):
    passage = text(3, 90)
    rows = [(1, text(10, 100) + passage + text(11, 100)), (2, text(12, 80) + passage + text(13, 70)), (3, text(14, 300)),
            (4, text(14, 300)), (5, "short"), (6, "short"), (7, None), (8, ""), (9, passage + " " + passage), (None, text(14, 300))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, removed_spans string")
    got = {r.doc_id: r for r in chunks.deduplicate(docs).collect()}
    old = dict(rows)
    for i in (1, 3, 5, 6, 7, 8, None):
        assert got[i].text == old[i] and got[i].removed_bytes == 0, i
    assert got[4].text == "" and got[4].removed == f"0:{len(old[4])}"
    assert got[2].text.startswith(text(12, 80)[:-60]) and got[2].text.endswith(text(13, 70)[80:])
    assert len(passage.encode()) - 250 <= got[2].removed_bytes <= len(passage.encode()) + 60
    for i, r in got.items():
        spans = [tuple(map(int, s.split(":"))) for s in r.removed.split(",") if s]
        t, last, kept = old[i] or "", 0, ""
        for a, b in spans:
            kept, last = kept + t[last:a], b
        assert (r.text or "") == kept + t[last:]
    assert chunks.deduplicate(docs.limit(0)).count() == 0


def test_passages_of_just_over_fifty_words_are_found(spark):
    """Planted passages of 51 to 60 words, each in two else different texts;
    shared sentences of 20 words stay."""
    rows, spans = [], {}
    for i in range(120):
        passage = text(5000 + i, 51 + i % 10)
        for side in (0, 1):
            before, after = text(20_000 + 2 * i + side, 20 + i % 60), text(30_000 + 2 * i + side, 15 + i % 45)
            rows.append((2 * i + side, f"{before} {passage} {after}"))
        spans[2 * i + 1] = (len(before) + 1, len(before) + 1 + len(passage))
    short = text(77, 20)
    rows += [(1000 + i, f"{text(40_000 + i, 60)} {short} {text(50_000 + i, 60)}") for i in range(40)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, removed string")
    got = {r.doc_id: r for r in chunks.deduplicate(docs).collect()}
    caught, share = 0, []
    for i, (a, e) in spans.items():
        found = [tuple(map(int, s.split(":"))) for s in got[i].removed.split(",") if s]
        caught += bool(found)
        share.append(sum(min(e, y) - max(a, x) for x, y in found if x < e and y > a) / (e - a))
        # a cut lies beside the passage where both texts go on alike by chance
        assert all(x >= a - 40 and y <= e + 40 for x, y in found)
    assert caught >= 0.97 * len(spans) and np.mean(share) >= 0.75
    assert all(got[2 * i].removed_bytes == 0 for i in range(120)) and all(got[i].removed_bytes == 0 for i in range(1000, 1040))
