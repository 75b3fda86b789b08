"""Text operators: worked examples and properties."""

from pyspark.sql import functions as F

from conftest import SF_SMALL, needs_testdata
from ledgerlens import config as C
from ledgerlens.functions import text as TX
from ledgerlens.operators import extract as ex
from ledgerlens.operators import sentiment as sen
from ledgerlens.sources.tables import table


def test_html_to_text(spark):
    rows = [("<p>A&nbsp;B &amp; C</p>x<br/>line<br >two", "A B & C\nx\nline\ntwo"),
            ("<td>x</td><TD>y</TD>&#160;&copy;end", "x\n y\n end"),
            ("<h3>Head</h3><li>i</li><span>k</span>", "Head\n i\n k")]
    df = spark.createDataFrame([(h,) for h, _ in rows], "html string")
    got = [r.f for r in df.select(TX.html_to_text_financial("html").alias("f")).collect()]
    assert [" ".join(g.split()) for g in got] == [" ".join(w.split()) for _, w in rows]
    assert all("<" not in g and "&" not in g.replace("& C", "") and "  " not in g for g in got)
    # table cells end lines in statements, not in sections
    s = df.select(TX.html_to_text_section("html").alias("s")).collect()
    assert "\n" in got[1] and "\n" not in s[1].s and s[1].s == s[1].s.strip()


LONG = " ".join(["Our business faces many risks that could matter."] * 20)
TOC = ("TABLE OF CONTENTS\nItem 1A. Risk Factors 10\nItem 1B. Unresolved Staff Comments 20\n"
       "Item 7. Management's Discussion and Analysis 30\n")


def test_sections(spark):
    docs = [
        (TOC + "Item 1A. Risk Factors\n" + LONG + "\nItem 1B. Unresolved\nItem 7. Management's Discussion and Analysis\n"
         + LONG + "\nItem 7A. Market\n", "Item 1A. Risk Factors " + LONG, "Item 7. Management's Discussion and Analysis " + LONG),
        ("ITEM 1A (continued) - risk factors\n" + LONG + "\nItem 2. Properties\n", "ITEM 1A (continued) - risk factors " + LONG, None),
        ("Risk Factors\n" + LONG, "Risk Factors " + LONG, None),
        ("Item 1A. Risk Factors\ntoo short\n", None, None),
        ("Item 1A. Risk Factors\n" + LONG + "", "Item 1A. Risk Factors " + LONG + "�", None),
        ("Item 1A. Risk Factors\n" + "w " * 150_000, "Item 1A. Risk Factors " + "w " * 149_999 + "w", None),
        ("", None, None), (None, None, None),
    ]
    df = spark.createDataFrame([(i, d[0]) for i, d in enumerate(docs)], "id int, text string")
    got = {(r.id, r.section): r.section_text for r in ex.extract_sections(df, "text", keep=["id"]).collect()}
    for i, (_t, risk, mda) in enumerate(docs):
        assert got[(i, "risk_factors")] == risk, i
        assert got[(i, "mda")] == mda, i
    # the study's limit on text without an end marker
    cut = df.select("id", ex.extract_section("text", "risk_factors", fallback_chars=C.SECTION_FALLBACK_CHARS).alias("s"))
    assert {r.id: r.s for r in cut.collect()}[5] == ("Item 1A. Risk Factors " + "w " * 150_000)[:200_000].strip()
    assert df.select(ex.extract_section(F.col("text"), "nope").alias("s")).collect()[0].s is None


def test_words_terms_sentences(spark):
    rows = [("", None, None, None), (None, None, None, None), ("   \n ", 0, 0, []),
            ("VIE review extensive SIV; uncertainty uncertain", 6, 7, ["VIE review extensive SIV; uncertainty uncertain"]),
            ("a\x1cb c", 3, 0, ["a\x1cb c"]),
            ("Costs rose! Why? Because. Ok stays. item 7 is here.", 10, 0,
             ["Costs rose!", "Why?", "Because.", "Ok stays. item 7 is here."])]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "id int, t string")
    got = df.select("id", TX.word_count("t").alias("wc"),
                    TX.term_count(F.col("t"), ["VIE", "SIV", "uncertain", "uncertainty"]).alias("tc"),
                    TX.split_sentences(F.col("t")).alias("ss")).collect()
    for r in got:
        _t, wc, tc, ss = rows[r.id]
        assert r.wc == wc, r.id
        if ss is not None:
            assert r.ss == ss and (tc is None or r.tc == tc), r.id


def test_quality_predicate_edges(spark):
    cases = [("one two three four five six seven", False), ("one two three four five six seven eight", True),
             (" ".join(["w"] * 200), True), (" ".join(["w"] * 201), False),
             ("abc 12 cd 34 ef 56 gh 789 12345", False),
             ("Item 7 management discussion of the results for the year", False),
             ("Table of contents appears here with many more words in it", False),
             ("See Note 4 for the details on this and several other items", False),
             ("In millions of dollars the following amounts are reported here", False)]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "id int, s string")
    for r in df.select("id", TX.is_quality_sentence(F.col("s")).alias("q")).collect():
        assert r.q == cases[r.id][1], cases[r.id]


def test_keyword_in_context(spark):
    text = "The cat\n" + "x" * 60 + " the end of THE line"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    n, s = ex.keyword_in_context(F.col("t"), "the", before=4, after=6)
    got = df.select(n.alias("n"), s.alias("s")).collect()[0]
    assert got.n == 3 and got.s == ["The cat\nx", "xxx the end o", "of THE line"]
    n, s = ex.keyword_in_context(F.col("t"), "the", shown=1, max_chars=5)
    assert df.select(s.alias("s")).collect()[0].s == ["The c"]


@needs_testdata
def test_sentences_and_headers_on_documents(spark):
    d = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in d.collect()}
    parts = {}
    for r in sen.sentences(d, "text", ["doc_id"]).collect():
        parts.setdefault(r.doc_id, []).append((r.sentence_no, r.sentence))
    for i, rows in parts.items():
        rows.sort()
        assert [n for n, _ in rows] == list(range(len(rows)))
        # sentences are the text again, but for white space
        assert "".join("".join(s for _, s in rows).split()) == "".join(texts[i].split())
    df = spark.createDataFrame([("Item 1A. Risk\nITEM 7: Management item 1a. Risk Item 1A. Risk",)], "t string")
    assert df.select(ex.headers_found("t").alias("h")).collect()[0].h == ["Item 1A. Risk", "ITEM 7: Management", "item 1a. Risk"]
    assert df.select(ex.headers_found("t", first=3, shown=1).alias("h")).collect()[0].h == ["Item 1A. Risk"]


def test_whitespace_classes_equal_python(spark):
    """The Java class, the RE2 class and the trim set all equal str.isspace()."""
    import duckdb
    cps = list(range(0, 0x3100)) + [0xFEFF, 0x180E]
    chars = [chr(c) for c in cps if not (0xD800 <= c <= 0xDFFF)]
    want = {ch for ch in chars if ch.isspace()}
    df = spark.createDataFrame([(ch,) for ch in chars], "c string")
    got_java = {r.c for r in df.where(F.col("c").rlike("^" + TX.JWS + "$")).collect()}
    assert got_java == want
    con = duckdb.connect()
    got_re2 = {ch for ch in chars if con.execute("SELECT regexp_full_match(?, ?)", [ch, TX.WS]).fetchone()[0]}
    assert got_re2 == want
    assert set(TX.PY_WS_LITERAL) == want
