import json

from aerolith.llm import chat
from pyspark.sql import functions as F

RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b\\<|im_end|>"}]}, "messages", [("user", "a"), ("assistant", "b\\<|im_end|>")]),
    ({"messages": [{"content": None, "role": "user"}]}, "messages", [("user", "")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}], "system": "s"}, "share_gpt", [("system", "s"), ("user", "x"), ("assistant", "y")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"output": "done", "input": "this", "instruction": "do"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "STRING"}, "prompt_response", [("user", "p"), ("assistant", "STRING")]),
    ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
    ({"text": "t"}, "text_only", [("assistant", "t")]),
    ({"other": 1}, None, []),
    ([1, 2], None, []),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r), "old") for i, (r, _, _) in enumerate(RECORDS)] + [(90, None, "old"), (91, "{no json", "old"), (92, "", "old")]
    out = chat.read_back(chat.formatted(chat.canonical_turns(spark.createDataFrame(rows, "i int, record string, layout string")))).collect()
    assert len(out) == len(rows)
    for r in out:
        _, layout, turns = RECORDS[r.i] if r.i < 90 else (None, None, [])
        assert r.layout == layout, r.record
        assert [tuple(t) for t in r.turns] == turns
        assert [tuple(t) for t in r.read_turns] == turns
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.loss_text == "".join(t for role, t in turns if role == "assistant")


def test_escapes_are_reversible_and_hide_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\<|", "<|im_sep|><|im_end|>\\n", "<", "a<", "[/INST", "<\\|", "é🙂\\<s>", "", "<<SYS>><</SYS>>", "\n\\\n"]
    turns = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([([("assistant", t), (t, t), ("user", t)],) for t in texts], f"turns {turns}")
    for r in chat.read_back(chat.formatted(df)).collect():
        assert r.read_turns == r.turns
        for s in r.segments:
            if s.loss:
                assert not any(c in s.text for c in chat.CONTROL)


def test_rows_of_conversations(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, 5, None, "x"), (2, None, "user", "\x00  "), (3, 0, "assistant", "y" * 100_000)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, record string")
    out = {r.conv_id: [tuple(t) for t in r.read_turns] for r in chat.read_back(chat.formatted(chat.canonical_turns(chat.records_of(df)))).collect()}
    assert out == {1: [("user", "hi"), ("user", "hi"), ("assistant", "")], None: [("", "x")], 2: [("user", "\x00  ")], 3: [("assistant", "y" * 100_000)]}
    assert chat.records_of(df.limit(0)).count() == 0


def test_a_very_long_turn_comes_back_whole(spark):
    """Beyond the JSON reader's usual limit of 20 million characters, with quotes and backslashes that look like structure."""
    n = 21_000_000
    said = 'q \\\\", \\'
    df = spark.range(2).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") == 0, said).otherwise(F.repeat(F.lit("x"), n)).alias("text"))
    out = chat.read_back(chat.formatted(chat.canonical_turns(chat.records_of(df)))).selectExpr("layout", "read_turns[0].text a", "length(read_turns[1].text) b", "length(loss_text) c").collect()
    assert [tuple(r) for r in out] == [("turn_rows", said, n, n)]


def test_keys_with_escapes_and_clashing_columns(spark):
    rows = [('{"\\u0074ext": "t: \\"x\\", {"}', 1), ('{"te\\\\xt": "t"}', 2), ('{"text": ["a"]}', 3), ('{"text" : "a\\\\"}', 4)]
    df = spark.createDataFrame(rows, "record string, _fp int")
    out = {r._fp: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical_turns(df).collect()}
    assert out == {1: ("text_only", [("assistant", 't: "x", {')]), 2: (None, []), 3: (None, []), 4: ("text_only", [("assistant", "a\\")])}
