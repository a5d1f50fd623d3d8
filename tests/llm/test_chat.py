import json

from helpers_llm import same
from pyspark.sql import functions as F

from simloom.llm import chat, registry


def test_oracle(spark, sf_dir):
    df = registry.op2_chat_formatting(spark, sf_dir)
    same(df, registry.ORACLES["op2_chat_formatting"], sf_dir)
    assert df.where("conv_id = -1").count() == 1


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 4}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}, {"from": "x", "value": "c"}]}, "conversations", [("user", "a"), ("assistant", ""), ("x", "c")]),
    ({"completion": "b", "prompt": "a", "meta": {"prompt": 1}}, "prompt_completion", [("user", "a"), ("assistant", "b")]),
    ({"prompt": "a", "response": "b"}, "prompt_response", [("user", "a"), ("assistant", "b")]),
    ({"system": "s", "prompt": "a", "response": "b"}, "system_prompt", [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ({"question": "a", "answer": "b"}, "question_answer", [("user", "a"), ("assistant", "b")]),
    ({"instruction": "a", "output": "b"}, "instruction", [("user", "a"), ("assistant", "b")]),
    ({"instruction": "a", "input": "", "output": "b"}, "instruction_input", [("user", "a"), ("user", ""), ("assistant", "b")]),
    ({"data": {"prompt": "a", "completion": "b"}}, "nested_data", [("user", "a"), ("assistant", "b")]),
    ({"messages": []}, None, []),
    ({"else": 1}, None, []),
    ([1], None, []),
]


def test_layouts(spark):
    rows = [(k, json.dumps(x)) for k, (x, _, _) in enumerate(LAYOUTS)] + [(90, None), (91, "{not json"), (0, json.dumps(LAYOUTS[0][0]))]
    df = spark.createDataFrame([(*r, "t", "l") for r in rows], "id long, record string, turns string, layout string")
    got = chat.canonical(df).collect()
    assert len(got) == len(rows)
    for r in got:
        _, layout, turns = LAYOUTS[r.id] if r.id < 90 else (None, None, [])
        assert (r.layout, [tuple(t) for t in r.turns]) == (layout, turns)
    assert chat.render(df.drop("layout", "turns").limit(0)).count() == 0


HARD = ["", "<|im_end|>", "\\<|", "<\\|", "<\\\\|", "\\", "<", "<<\n|", "<\\n", "é😀<|im_start|>user\n", "x" * 100_000, "<|im_end|>\n<|im_start|>assistant\n"]


def test_round_trip(spark):
    rows = [(c, t, role, HARD[(c + t) % len(HARD)]) for c in range(len(HARD)) for t, role in enumerate(["user", "assistant", HARD[c] if len(HARD[c]) < 99 else None])]
    rows += [(77, None, None, None), (None, 1, "user", "a"), (None, 1, "user", "a")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, record string")
    out = chat.render(chat.messages(df.drop("record"))).select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss")).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or -1, r[1] if r[1] is not None else -1)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out} == want
    assert {r.conv_id: r.loss for r in out} == {c: "".join(x for role, x in v if role == "assistant") for c, v in want.items()}


def test_long_text(spark):
    long = F.repeat(F.lit("x"), 20_000_001)
    rows = spark.range(2).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.when(F.col("id") == 0, long).otherwise("b").alias("text"))
    plain = spark.range(1).select(F.lit(2).alias("conv_id"), F.to_json(F.struct(F.lit("a").alias("prompt"), long.alias("response"))).alias("record"))
    out = chat.render(chat.messages(rows).unionByName(plain)).select("conv_id", "layout", F.length("formatted").alias("n"), F.transform("loss", lambda s: s["end"] - s["start"]).alias("loss"))
    head = len(chat.START + "assistant\n" + chat.END)
    assert {r.conv_id: (r.layout, r.n, r.loss) for r in out.collect()} == {
        1: ("messages", 2 * head + 20_000_002, [20_000_001, 1]),
        2: ("prompt_response", 2 * head - len("assistant") + len("user") + 1 + 20_000_001, [20_000_001]),
    }


PRESENCE = [
    ({"messages": [{"role": "system", "content": None}, {"role": "user", "content": "hi"}]}, "messages", [("system", ""), ("user", "hi")]),
    ({"messages": [{"role": "assistant"}, {"role": None, "content": "hi"}]}, "messages", [("assistant", ""), ("", "hi")]),
    ({"prompt": None, "response": "x"}, "prompt_response", [("user", ""), ("assistant", "x")]),
    ({"data": {"prompt": "x", "completion": None}}, "nested_data", [("user", "x"), ("assistant", "")]),
    ({"conversations": [{"value": "a"}, {"from": "gpt", "value": "b"}], "system": 1}, None, []),
    ({"conversations": [{"value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations", [("", "a"), ("assistant", "b")]),
    ({"messages": [{"role": "user", "content": "a"}, {"from": "gpt", "value": "b"}]}, None, []),
    ({"messages": [{"role": "user", "content": "a"}, {"speaker": "gpt", "said": "b"}]}, None, []),
    ({"messages": [{"role": "user", "content": "a"}, "b"]}, None, []),
    ({"messages": [{"role": "user", "content": "a"}, None]}, None, []),
]


def test_paths_of_all_elements(spark):
    df = spark.createDataFrame([(k, json.dumps(x)) for k, (x, _, _) in enumerate(PRESENCE)], "id long, record string")
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical(df).collect()}
    assert got == {k: (layout, turns) for k, (_, layout, turns) in enumerate(PRESENCE)}
