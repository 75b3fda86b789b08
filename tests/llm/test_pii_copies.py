"""Terms beside an entity whose passages are copied."""

from ledgerlens.llm import pii

FILLER = [f"plain words number {chr(97 + i % 26)}{chr(97 + i // 26)} that say nothing about anybody at all " * 6 for i in range(300)]
SHARED = "on that quiet morning at the harbour office we met Quixotian by mail q@x.example before the ferry left for the island again"


def masked(spark, lines, term):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    return [term in r.text.lower() for r in pii.sanitise(docs).orderBy("doc_id").collect()]


def test_copies_of_a_context_do_not_hide_a_term(spark):
    others = ["nobody but Quixotian answers q@x.example on the weekend you know", "write to q@x.example or else Quixotian will be cross with us"]
    # copies of the text, and the same passage in texts that differ elsewhere
    assert not any(masked(spark, FILLER + others + [SHARED] * 200, "quixotian"))
    mixed = [f"{'abc' * (i % 7 + 1)} {i} starts here and " + SHARED + f" and ends with {i} {'xyz' * (i % 5 + 1)}" for i in range(100)]
    assert not any(masked(spark, FILLER + others + mixed, "quixotian"))


def test_copies_that_overlap_do_not_mask_a_common_term(spark):
    line = "mail q@x.example common q@x.example or common q@x.example now"
    plain = [f"the common word {i} stands in a common text {'z' * (i % 9 + 1)}" for i in range(120)]
    assert all(masked(spark, plain + [f"{'k' * (i % 5)} {i} {line} {i}" for i in range(100)], "common"))


def test_a_word_at_the_edge_of_a_text_counts(spark):
    lines = [f"Quixotian {'ab' * i} q@x.example {'cd' * i}" for i in range(1, 6)]
    assert not any(masked(spark, FILLER + lines, "quixotian"))
    assert not any(masked(spark, FILLER + [f"{'cd' * i} q@x.example {'ab' * i} Quixotian" for i in range(1, 6)], "quixotian"))
