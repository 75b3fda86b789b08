"""The position table against Python's re, pattern by pattern."""

import random
import re
import time

from pyspark.sql import functions as F

from ledgerlens import config as C
from ledgerlens.operators import extract as ex

PATTERNS = [r"total\s+assets", r"total\s+(?:assets|equity)\s*$", r"aba", r"a(b)a+", r"net\s+income"]


def texts():
    rng = random.Random(5)
    pieces = ["total assets", "Total\n equity\n", "abababa", "abaaab", "net  income", " ", "\n", "x", "é", "", "😀", "12", "TOTAL ASSETS"]
    return ["", "aba", *("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 150))) for _ in range(60))]


def test_every_position_and_disjoint_matches(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t string")
    got = df.select("id", ex.pattern_hits("t", PATTERNS, before=3, after=7).alias("h")).collect()
    flags = re.I | re.M
    for r in got:
        text = rows[r.id]
        want = [(i, at, m[0], text[max(0, at - 3):at], text[m.end():m.end() + 7])
                for at in range(len(text)) for i, p in enumerate(PATTERNS) if (m := re.compile(p, flags).match(text, at))]
        assert [(h.no, h.position, h.label, h.before, h.after) for h in r.h] == want
    plain = F.expr(f"transform(sequence(0, {len(PATTERNS) - 1}), k -> {ex._disjoint('filter(h, z -> z.no = k)')})")
    table = df.select("id", ex.pattern_hits("t", PATTERNS).alias("h")).select("id", plain.alias("of"))
    for r in table.collect():
        for p, found in zip(PATTERNS, r.of):
            assert [(h.position, h.label) for h in found] == [(m.start(), m[0]) for m in re.finditer(p, rows[r.id], flags)]


def by_re(text, label):
    """(match number, value, position) by a plain scan."""
    out = []
    for i, m in enumerate(re.finditer(label, text, re.I | re.M)):
        for n in re.finditer(C.NUMBER_PATTERN, text[m.end():m.end() + C.NUMBER_WINDOW]):
            v = float(n[1].replace(",", ""))
            if v >= C.NUMBER_MIN_VALUE:
                out.append((i, -v if "(" in n[0] and ")" in n[0] else v, m.start()))
                break
    return out


def test_numbers_of_all_labels_from_one_scan(spark):
    rng = random.Random(11)
    words = ["Total assets", "total  liabilities", "Total liabilities and", "Total equity", "Total stockholders' equity", "Cash and due from banks",
             "cash and cash equivalents", "commercial paper and other short-term borrowings", "short term borrowings", "Net income (loss)\n",
             "net loss\n", "net income attributable", "Provision for credit losses", "provision for loan, lease", "9", "(1,234)", "56.7", "3", "text", "\n"]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    labels = [p for pats in C.FIELD_PATTERNS.values() for p in pats]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t string")
    for r in df.select("id", ex.numbers_near_labels("t", labels).alias("n")).collect():
        want = [(k, *x) for k, p in enumerate(labels) for x in by_re(rows[r.id], p)]
        assert [(n.pattern_no, n.match_no, n.value, n.position) for n in r.n] == want


def test_time_grows_with_the_matches(spark):
    def seconds(n):
        df = spark.createDataFrame([("total assets 77 \n" * n,)], "t string")
        best = 1e9
        for _ in range(3):
            t = time.time()
            assert df.select(F.size(ex.numbers_near_label("t", r"total\s+assets")).alias("k")).first().k == n
            best = min(best, time.time() - t)
        return best
    seconds(2000)
    assert seconds(40_000) < 7 * max(seconds(10_000), 0.4)


def test_units_that_can_not_decide_are_left_out():
    kept = [p for p, _ in ex.deciding_units(C.UNIT_PATTERNS)]
    assert kept == [r"in\s+millions", r"in\s+thousands", r"in\s+billions"]
    assert len(ex.deciding_units([("a", 1), ("a|b", 2), ("[ab]a", 3), ("xa", 4)])) == 3
