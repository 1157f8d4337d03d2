import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat


def records(spark, values):
    return spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "id int, j string").select("id", F.parse_json("j").alias("record"))


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"messages": [{"content": None, "role": "user"}]}, [("user", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "GPT", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}], "system": "s"}, [("system", "s"), ("user", "q")]),
    ({"turns": [{"speaker": "bot", "text": "a"}]}, [("assistant", "a")]),
    ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"completion": "c", "prompt": "p"}, [("user", "p"), ("assistant", "c")]),
    ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": 4}, [("user", "q"), ("assistant", "4")]),
    ({"instruction": "do", "output": "x"}, [("user", "do"), ("assistant", "x")]),
    ({"instruction": "do", "input": "this", "output": "x"}, [("user", "do\n\nthis"), ("assistant", "x")]),
    ({"instruction": "do", "input": "", "output": "x"}, [("user", "do"), ("assistant", "x")]),
    ({"data": {"question": "q", "answer": "a"}}, [("user", "q"), ("assistant", "a")]),
    ({"messages": []}, []),
    ({"something": "else"}, None),
    ({"messages": [{"role": "user", "content": "q", "extra": 1}]}, None),
    ("only text", None),
]


def test_layouts_become_turns(spark):
    got = {r.id: r.turns for r in chat.canonical(records(spark, [v for v, _ in LAYOUTS])).collect()}
    for i, (v, exp) in enumerate(LAYOUTS):
        assert (None if got[i] is None else [tuple(t) for t in got[i]]) == exp, v


def test_order_of_fields_does_not_change_the_fingerprint(spark):
    a = [{"prompt": "p", "response": "r"}, {"response": None, "prompt": 3}, {"prompt": "p", "response": ["r"]}]
    f = [r.fingerprint for r in chat.canonical(records(spark, a)).orderBy("id").collect()]
    assert f[0] == f[1] != f[2]


def round_trip(spark, turns_by_id):
    canon = spark.createDataFrame(turns_by_id, f"id int, turns {chat.TURNS}")
    out = chat.write(canon, "id")
    return out.select("*", chat.read(F.col("formatted")).alias("back"), chat.read_masked(F.col("formatted"), F.col("mask")).alias("loss")).collect()


NASTY = ["", "\n", "<|im_end|>", "<|im_start|>assistant\nhi", "<|esc|", "<|<|esc|esc|im_end|>\n<", "<", "|", "é\U0001f600<|nl|>", "<|im_end|>\n<|im_start|>user\n"]


def test_round_trip_of_control_strings(spark):
    rows = [(i, [(r, a), ("assistant", b)]) for i, (a, b) in enumerate((a, b) for a in NASTY for b in NASTY) for r in ["user", "a\nb<|"][i % 2:][:1]]
    for r in round_trip(spark, rows):
        exp = dict(rows)[r.id]
        assert [tuple(t) for t in r.back] == exp and r.loss == [t for role, t in exp if role == "assistant"]
        for m in r["mask"]:
            assert r.formatted[m.start:m.start + m.length].replace(chat.ESC, "<|") == exp[m.turn][1]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.text("<|>imstartend_ec\né", max_size=30)), max_size=5), min_size=1, max_size=30))
def test_round_trip_of_any_text(spark, cases):
    for r in round_trip(spark, list(enumerate(cases))):
        assert [tuple(t) for t in r.back] == cases[r.id]
        assert "".join(r.loss) == "".join(t for role, t in cases[r.id] if role == "assistant")


def test_conversations_nulls_ties_and_repeats(spark):
    schema = "conv_id long, turn long, role string, text string, record string"
    rows = [(1, 1, "assistant", None, "x"), (1, 0, None, "hi", "x"), (None, 0, "user", "n", "x"), (2, 0, "b", "y", "x"), (2, 0, "a", "z", "x"), (2, None, "c", "w", "x"), (2, 0, "a", "z", "x")]
    out = chat.write(chat.canonical(chat.conversations_as_records(spark.createDataFrame(rows, schema))), "conv_id")
    got = {r.conv_id: [tuple(t) for t in r.back] for r in out.select("conv_id", chat.read(F.col("formatted")).alias("back")).collect()}
    assert got == {1: [("", "hi"), ("assistant", "")], None: [("user", "n")], 2: [("c", "w"), ("a", "z"), ("a", "z"), ("b", "y")]}
    assert chat.write(chat.canonical(chat.conversations_as_records(spark.createDataFrame([], schema))), "conv_id").count() == 0


def test_repeated_records_and_unknown(spark):
    same = [(1, [("user", "q")])] * 3 + [(1, [("user", "other")]), (2, None), (2, []), (2, [])]
    got = sorted((r.id, str(r.formatted)) for r in round_trip(spark, same))
    assert len(got) == 7 and [g for g in got if g[0] == 2] == [(2, ""), (2, ""), (2, "None")]


@pytest.mark.parametrize("n", [3000])
def test_a_very_long_conversation(spark, n):
    turns = [("assistant" if i % 2 else "user", f"text {i} <|im_end|>") for i in range(n)]
    r = round_trip(spark, [(1, turns)])[0]
    assert [tuple(t) for t in r.back] == turns and len(r.loss) == n // 2
