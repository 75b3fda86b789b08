"""Sanitising against plain regular expressions and hand-made cases."""

import hashlib
import re

from ledgerlens.llm import pii

KINDS = ["email", "ip", "card", "phone"]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
               for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def brute(text):
    spans = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(pii.PLAIN[kind], text, re.A):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            spans.append((m.start(), k, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


TEXTS = [
    None, "", "nothing here", "a@b.c d@e.f@g.h x_a@b.c_d@e.f.", "@a.b ..@..", "a.b+c%d@x-y.z-w.q..r@s.t",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1 999.1.2.3.4 1.2.3", "é😀 10.0.0.1 ü@x.y z@ü.de a@b.cé",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111 4111111111111112 378282246310005 1-2-3",
    "+1 (456) 555-2186 +12 +1-2 ++1 234 567 8901 +49.(0)30 1234567- +1 234 567 890 123 456 789",
    "call +44 20 7946 0958 or 4111111111111111 at 4.4.4.4 via q@w.e", "a" * 3000 + "@" + "b." * 2000 + "c",
    "1" * 30000, "1 " * 20000, ("x@y.z " * 500), "." * 20000 + "@", "9" * 16 + " " + "+9" * 3000,
]


def test_base_spans_match_plain_patterns(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, spans string")
    got = sorted((r.doc_id, r.spans, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.report(docs).collect())
    want = []
    for i, t in rows:
        s = brute(t or "")
        want.append((i, s, hashlib.sha256(s.encode()).hexdigest(), *(s.count(k + ":") for k in KINDS)))
    assert got == sorted(want)


def test_disclosing_terms_are_masked(spark):
    lines = [f"word{chr(97 + i)} filler {chr(98 + i)}other Zanzibarian mail boss@corp.example ok then {chr(99 + i)}more" for i in range(6)]
    lines += ["plain text with mail and other words only " * 3] * 400 + ["about zanzibarian here"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(lines)], "doc_id bigint, text string, n_chars bigint")
    rows = {r.doc_id: r for r in pii.report(docs).collect()}
    assert all("term:" in rows[i].spans and "email:" in rows[i].spans for i in range(6))
    start = lines[406].index("zanz")
    assert rows[406].spans == f"term:{start}:{start + 11}"
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert "boss@" not in clean[0].text and "[EMAIL]" in clean[0].text and "anzibarian" not in clean[0].text
    assert clean[10].text == lines[10] and clean[10].n_chars == len(lines[10])
    assert clean[0].n_chars == len(clean[0].text)


def test_copies_of_one_context_are_no_evidence(spark):
    docs = spark.createDataFrame([(i, "Quixotian wrote x@y.example today") for i in range(50)], "doc_id bigint, text string")
    assert {r.spans for r in pii.report(docs).collect()} == {"email:16:27"}


def test_empty_table_and_overlaps(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert pii.report(empty).count() == 0 and pii.sanitise(empty).count() == 0
    docs = spark.createDataFrame([(None, "+4111111111111111 x", "en"), (1, None, None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert got[1] is None and "4111" not in got[None]
