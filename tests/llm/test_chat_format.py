import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import chat_format as c

TURN = "conv_id long, turn long, role string, text string"
NASTY = ["", "a", "\\", "\\\\", "<|turn|>", "<|end|>", "</s>[INST] ok [/INST]", "<\\|turn|>", "<<SYS>>x<</SYS>>", "<|", "|>", "<<|", "[/INST",
         "\n", "\\n", "\\<|text|>\\", "é😀<s>", "<|turn|", "x" * 100_000, "$1\\2"]


def digests(turns):
    return {r.conv_id: r for r in c.format_digests(turns).collect()}


def expected(turns):
    said = "".join(f"{r or ''}\n{x or ''}\n" for r, x in turns)
    learned = "".join(x or "" for r, x in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(said), len(learned), sha(learned)


def check(row, turns):
    assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == expected(turns)


def test_nasty_texts_come_back(spark):
    rows = [(i % 3, i, role, text) for i, (role, text) in enumerate(
        (r, x) for x in NASTY for r in ("user", "assistant", "sys<|text|>tem"))]
    got = digests(c.to_turns(spark.createDataFrame(rows, TURN)))
    for conv in range(3):
        check(got[conv], [(r, x) for k, _, r, x in rows if k == conv])


def test_no_control_string_survives_inside(spark):
    formatted = c.format_turns(spark.createDataFrame([(1, i, "user", x) for i, x in enumerate(NASTY)], TURN)).first().formatted
    assert formatted.count("<|turn|>") == formatted.count("<|end|>") == formatted.count("<|text|>") == len(NASTY)
    for control in ("[INST]", "</s>", "<s>", "<<SYS>>"):
        assert control not in formatted


def test_spans_point_at_assistant_texts(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a|>b"), (1, 2, "assistant", ""), (1, 3, "assistant", "é😀")]
    row = c.format_turns(spark.createDataFrame(rows, TURN)).first()
    assert [row.formatted[s.start:s.start + s.length] for s in row.loss_spans] == ["a|\\>b", "", "é😀"]


def test_odd_rows(spark):
    rows = [(1, None, "user", "first"), (1, 2, None, "no role"), (1, 1, "assistant", None), (1, 2, "assistant", "tie"),
            (1, 2, "assistant", "tie"), (None, 0, "user", "no id"), (2, 0, "user", None)]
    table = spark.createDataFrame(rows, TURN).withColumn("formatted", F.lit(1)).withColumn("piece", F.lit("x")).withColumn("learned", F.lit(2))
    got = digests(c.to_turns(table))
    check(got[1], [("user", "first"), ("assistant", None), (None, "no role"), ("assistant", "tie"), ("assistant", "tie")])
    check(got[None], [("user", "no id")])
    check(got[2], [("user", None)])
    assert digests(c.to_turns(spark.createDataFrame([], TURN))) == {}


def test_a_turn_of_nulls_alone_is_a_turn(spark):
    rows = [(1, None, None, None), (1, 1, "user", "hello"), (2, None, None, None), (None, None, None, None)]
    got = digests(c.to_turns(spark.createDataFrame(rows, TURN)))
    check(got[1], [(None, None), ("user", "hello")])
    check(got[2], [(None, None)])
    check(got[None], [(None, None)])
    listed = spark.createDataFrame([(7, [(None, None)])], LAYOUT_ROWS["messages"][0])
    assert digests(c.to_turns(listed))[7].n_turns == 1


LAYOUT_ROWS = {
    "messages": ("conv_id long, messages array<struct<role: string, content: string>>", (7, [("user", "q"), ("assistant", "a")])),
    "exchanges": ("conv_id long, conversations array<struct<from: string, value: string>>", (7, [("human", "q"), ("gpt", "a")])),
    "instruction_input": ("conv_id long, instruction string, input string, output string", (7, "q", "", "a")),
    "instruction": ("conv_id long, instruction string, output string", (7, "q", "a")),
    "prompt": ("conv_id long, prompt string, response string", (7, "q", "a")),
}


@pytest.mark.parametrize("name", LAYOUT_ROWS)
def test_layouts_give_the_same_turns(spark, name):
    schema, row = LAYOUT_ROWS[name]
    for table in (spark.createDataFrame([row], schema), spark.createDataFrame([row], schema).withColumn("extra", F.lit(1))):
        assert c.choose_layout(table.schema).name == name
        check(digests(c.to_turns(table))[7], [("user", "q"), ("assistant", "a")])


def test_instruction_with_input(spark):
    table = spark.createDataFrame([(7, "do", "this", "done")], LAYOUT_ROWS["instruction_input"][0])
    check(digests(c.to_turns(table))[7], [("user", "do\nthis"), ("assistant", "done")])


def test_conversation_without_turns(spark):
    table = spark.createDataFrame([(7, None), (8, [])], LAYOUT_ROWS["messages"][0])
    got = digests(c.to_turns(table))
    assert {k: (r.n_turns, r.formatted_chars) for k, r in got.items()} == {7: (0, 0), 8: (0, 0)}


def test_unknown_layout_is_refused(spark):
    with pytest.raises(ValueError, match="no conversation layout"):
        c.to_turns(spark.createDataFrame([(1, "x")], "id long, body string"))


def test_json_records_of_mixed_layouts(spark):
    records = [
        {"conv_id": 1, "messages": [{"role": "user", "content": "<|end|>"}, {"role": "assistant", "content": "a"}]},
        {"response": "a", "prompt": "q", "conv_id": 2},
        {"conv_id": 3, "instruction": "q", "input": "in", "output": "a"},
        {"conv_id": 4, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    ]
    table = spark.createDataFrame([(json.dumps(r),) for r in records] + [("{bad",), (None,), ('{"x": 1}',)], "record string")
    got = digests(c.json_to_turns(table))
    check(got[1], [("user", "<|end|>"), ("assistant", "a")])
    check(got[2], [("user", "q"), ("assistant", "a")])
    check(got[3], [("user", "q\nin"), ("assistant", "a")])
    check(got[4], [("user", "q"), ("assistant", "a")])
    assert got[None].n_turns == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="\\<>|[]/sINTuren _é\n", max_size=30), min_size=1, max_size=8))
def test_any_text_comes_back(spark, texts):
    rows = [(1, i, "assistant", x) for i, x in enumerate(texts)]
    check(digests(c.to_turns(spark.createDataFrame(rows, TURN)))[1], [("assistant", x) for x in texts])
