"""Line labels against all labelings, counts against plain Python."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import linecrf
from ledgerlens.llm.common import utf8

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def counts(texts):
    x = linecrf.Lines(*utf8(pa.array(texts, pa.string())))
    return [tuple(int(v[i]) for v in (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)) for i in range(len(texts))]


TEXTS = ["", None, "\n\n", " \t", "a", "a a a a", "a b c a b c", "x\nx\nx ", "é ß ü #|# <>\n\né ß ü #|# <>", "w" * 9000 + "\n" + "w" * 9000,
         "one two three\n" * 40, "\x0ba\x0cb\rc\x1cd", "😀 😀 😀 😀\n%", "tail\n", "\ntail"]


def test_counts_of_texts():
    assert counts(TEXTS) == [plain(t) for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é |", max_size=30), max_size=6))
def test_counts_of_random_texts(texts):
    assert counts(texts) == [plain(t) for t in texts]


def total(labels, scores, start, pairs):
    return start * labels[0] + sum(s for s, x in zip(scores, labels) if x) + sum(pairs[a, b] for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("seed", range(12))
def test_viterbi_and_marginals_by_enumeration(seed):
    rng = np.random.default_rng(seed)
    size = np.array(sorted(rng.integers(1, 8, 4))[::-1])
    start, pairs = float(rng.normal()), rng.normal(0, 1.5, (2, 2))
    scores = np.zeros((4, int(size[0])))
    for i, n in enumerate(size):
        scores[i, :n] = rng.normal(0, 2, n)
    norm, chance, expected = linecrf.marginals(scores, size, start, pairs)
    seen = np.zeros((2, 2))
    for i, n in enumerate(size):
        every = list(itertools.product((0, 1), repeat=int(n)))
        value = np.array([total(x, scores[i, :n], start, pairs) for x in every])
        assert tuple(linecrf.viterbi(scores[i, :n], start, pairs)) == every[int(value.argmax())]
        z = np.logaddexp.reduce(value)
        assert z == pytest.approx(norm[i])
        weight = np.exp(value - z)
        assert chance[i, :n] == pytest.approx(weight @ np.array(every))
        for x, w in zip(every, weight):
            for a, b in zip(x, x[1:]):
                seen[a, b] += w
    assert expected == pytest.approx(seen)


GOOD = "This is a plain sentence about the weather in the hills, and it goes on for a while.\n"
MENU = "Home | About | Login | Cart | Help\n"


def test_training_separates_lines_inside_mixed_documents(monkeypatch):
    monkeypatch.setattr(linecrf, "STEPS", 80)
    rng = np.random.default_rng(0)

    def lines(kind, n):
        out = []
        for _ in range(n):
            words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(rng.integers(4, 14))]
            out.append(" | ".join(words).upper() if kind else " ".join(words).capitalize() + ".")
        return out

    texts, good = [], []
    for i in range(60):
        bad = i % 3 == 0
        texts.append("\n".join(lines(0, 1) + lines(1, 6) if bad else lines(0, 6)))
        good.append(not bad)
    x = linecrf.Lines(*utf8(pa.array(texts)))
    model = linecrf.train([x.bins[a:b] for a, b in zip(x.bounds, x.bounds[1:])], good)
    mixed = linecrf.Lines(*utf8(pa.array(["\n".join(lines(0, 4) + lines(1, 5) + lines(0, 4))])))
    found = linecrf.viterbi(linecrf.emissions(mixed.bins, model[0]), *model[1:])
    assert found.tolist() == [0] * 4 + [1] * 5 + [0] * 4


def test_query_on_a_small_fixture(spark):
    long = [" ".join(f"Word{(i * 7 + j * j) % 997}x{j} of line" for j in range(12)) + "." for i in range(8)]
    docs = [(i, "\n".join(f"{x} number {i} {j}" for j, x in enumerate(long))) for i in range(30)]
    docs += [(100 + i, "\n".join(f"AA{i} | BB{j} | $$ && | CC{i + j} ## | {j} %% | DD*** | E{j}E{i} | F |" for j in range(12))) for i in range(30)]
    docs += [(200, None), (201, ""), (202, GOOD * 30), (203, "x " * 60_000), (None, docs[0][1]), (0, docs[0][1])]
    df = spark.createDataFrame([(*d, "en", 1, True) for d in docs], "doc_id bigint, text string, lang string, n_words int, kept boolean")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(100 + i, 0) for i in range(20)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    rows = linecrf.judge(df, labels).collect()
    assert len(rows) == len(docs)
    text = dict(docs)
    for r in rows:
        want = plain(text[r.doc_id]) if r.doc_id != 203 else (60_000, 60_000, 0, 0, 60_000)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.content_share >= 0.5)
    kept = {r.doc_id for r in rows if r.kept}
    assert kept == {*range(30), None}
    spans = linecrf.label_lines(df, linecrf.fit(df, labels)).where("doc_id = 100").first().lines
    assert [text[100][s.start:s.start + s.chars] for s in spans] == text[100].split("\n")


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(80)))], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.kept for r in linecrf.judge(docs, none).collect()] == [True]
    assert linecrf.judge(docs.limit(0), none).collect() == []
