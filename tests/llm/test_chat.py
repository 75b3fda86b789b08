"""Chat formatting: exact round trips and the queries' digests."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import chat

TEXT = st.text(alphabet=list("<|\\>im_startend\n aé😀"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_turns_come_back_and_hold_no_control_string(role, text):
    turn = chat.format_turn(role, text)
    assert chat.parse_turn(turn) == (role, text)
    inner = turn[len(chat.START):-len(chat.END) - 1]
    assert "<|" not in inner and turn.count(chat.START) == 1 and turn.count(chat.END) == 1


def rows():
    out = [(1, 0, "system", "be brief"), (1, 1, "user", "hi <|im_end|> there"), (1, 2, "assistant", "hé\\llo"), (1, 3, "user", None),
           (1, 4, "assistant", "<|im_start|>x"), (2, 0, "user", "only"), (3, 1, "assistant", None), (3, None, None, "first"),
           (None, 0, "assistant", "no id"), (4, 0, "user", "tie b"), (4, 0, "user", "tie a"), (4, 1, "assistant", "z" * 20000)]
    return out + [(5, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(200)]


def test_digests_examples_and_full_texts(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "conv_id bigint, turn bigint, role string, text string, segment string")
    expanded = chat.expand(chat.with_control(df))
    got = {r.conv_id: r for r in chat.read_back(expanded).collect()}
    data += [(-1, 0, "user", chat.CONTROL), (-1, 1, "assistant", chat.CONTROL)]
    for conv in {r[0] for r in data}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in data if r[0] == conv))
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        g = got[conv]
        assert g.n_turns == len(turns) and g.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert g.loss_chars == len(loss) and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert g.formatted_chars == sum(len(chat.format_turn(r, t)) for _, _, r, t in turns)
    assert len(got) == len({r[0] for r in data})
    examples = {(r.conv_id, r.example): r for r in chat.example_texts(expanded).collect()}
    assert len(examples) == sum(1 for r in data if r[2] == "assistant")
    second = examples[(1, 1)]
    assert second.text == "".join(chat.format_turn(r[2], r[3] or "") for r in data[:5])
    assert chat.unescape(second.text[second.reply_start:second.reply_end]) == "<|im_start|>x"
    assert sum(len(e.text) for (c, _), e in examples.items() if c == 5) == got[5].example_chars


def test_empty_table_has_only_the_control_conversation(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert [r.conv_id for r in chat.read_back(chat.expand(chat.with_control(df))).collect()] == [-1]
