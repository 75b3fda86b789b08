"""Amounts near labels as rows, the slots of the one scan, and the merged HTML
steps: few passes and short rows, with what the plain forms give."""

import random

from pyspark.sql import functions as F

from ledgerlens import config as C
from ledgerlens.functions import text as TX
from ledgerlens.operators import extract as ex

LABELS = [p for pats in C.FIELD_PATTERNS.values() for p in pats]
COLS = ["id", "pattern_no", "match_no", "value", "raw", "context", "position"]
PIECES = ["Total assets", "total  liabilities", "Total liabilities and", "Total equity", "caſh and due from banks", "ſhort term borrowings",
          "Net income (loss)\n", "net loss\n", "NET İNCOME\n", "9", "(1,234)", "56.7", "(1)", "( 2 )", "$ 5", "$$ 77", "(", "  )", "007", "0,005",
          "1,2345", "12,34", "1234,567", "5.123456", "10.5", "12.34567", " " * 4, " " * 12, "\n\n \n", " . . . ", "٣٤", "1٣",
          "4,٣٤٥", "\x1c", "\xa0", "\x01", "\x02", "\x03", "é", "😀", "x" * 40, "1,234,567,890,123,456,789,012", "9" * 30]


def test_number_rows_are_the_elements_of_the_column(spark):
    rng = random.Random(7)
    rows = ["".join(rng.choice(PIECES) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(0, 30))) for _ in range(1500)]
    rows += [None, "", "total assets" + " " * 20_000 + "12", "total assets 7 12 total equity 30 \x03" * 90]
    # amounts on either side of the window's end
    for n in range(440, 510, 3):
        for amount in ("1,234,567", "(12,345)", "7 88", "( 99 )", "$ 1,234.56"):
            for way in ("abcdefghijklmnop(", "(1) ", "12345678901234( ", "a "):
                rows.append("Total assets" + (way * n)[:n] + amount)
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t string").cache()
    want = df.select("id", F.inline(ex.numbers_near_labels("t", LABELS))).select(COLS)
    got = ex.number_rows(df, "t", LABELS, ["id"]).select(COLS)
    assert want.count() == got.count() > 1000
    assert want.exceptAll(got).count() == 0


def test_the_usual_amount_is_found_in_the_scan(spark):
    text = "Total assets\n $ 44,093.48\n\n Total liabilities (1)\n 40,419\n\nCash and cash equivalents\n December 31, 42\n"
    tail = (ex._near_number(), 3, C.NUMBER_WINDOW)

    def made(no, at, caught, own):
        return f"named_struct('near', {caught[2]}, 'window', {caught[3]})"
    df = spark.createDataFrame([(text,)], "t string")
    hits = df.select(ex._apply("t", ex._hits("t", LABELS, tail=tail, made=made)).alias("h")).first().h
    assert [(h.near, h.window) for h in hits] == [("$ 44,093.48", ""), ("40,419", ""), ("31", "")]


def test_patterns_of_other_first_letters_share_a_slot():
    assert ex.hit_slots(LABELS) == [[0, 4, 6, 8, 11], [1, 5, 9, 12], [2, 7, 10], [3]]
    assert ex.hit_slots(["net", "(?:b)+", "cash"]) == [[0], [1], [2]]


def test_merged_html_steps_are_the_steps_in_turn(spark):
    rng = random.Random(8)
    pieces = ["<", "</", ">", "p", "td>", "<BR />", "<br>", "</h3>", "</h٣>", "</lı>", "</div>", "&", "&amp;", "&AMP;", "amp;", "nbsp;",
              "&nbsp;", "&nbſp;", "&lt;", "&#", "8217;", "&#8217;", "&#٣;", " ", "  ", "\t", "\n", "\xa0", "x", "é", "<a href='&amp;'>", "&am"]
    rows = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 25))) for _ in range(3000)]
    rows += [None, " " * 50_000 + "<b>" * 20_000 + "&lt;" * 20_000, "&amp;" + " " * 50_000 + "<b>" * 20_000]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    for tags in (TX.FIN_BLOCK_TAGS, TX.SECTION_BLOCK_TAGS):
        c = F.col("t")
        for pattern, put, ignore_case in TX.html_steps(tags):
            c = F.regexp_replace(c, ("(?iu)" if ignore_case else "") + pattern, put)
        assert df.where(~c.eqNullSafe(TX._html_common(F.col("t"), tags))).count() == 0


def test_html_takes_two_passes_without_an_ampersand_entity(spark):
    df = spark.createDataFrame([("x",)], "t string").select(TX.html_to_text_financial("t").alias("t"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.split(" ELSE ")[1].count("regexp_replace") == 2
