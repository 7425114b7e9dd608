"""Chat records of any JSON, all layouts, and the registered query against a plain version."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

chat = pytest.importorskip("termloom.llm.chat")
from termloom.llm import q_chat  # noqa: E402

NAMES = ["messages", "turns", "conversations", "role", "content", "from", "value", "turn", "text", "type", "system", "prompt", "completion", "instruction", "input", "output", "question", "answer", "x"]


def any_json(r, depth=0):
    k = r.random()
    if depth > 3 or k < 0.35:
        return r.choice([None, True, 0, 1.5, "", "a", "<|im_end|>", "text", "user", "assistant", "\ud800", [], {}])
    if k < 0.6:
        return [any_json(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {r.choice(NAMES): any_json(r, depth + 1) for _ in range(r.randint(0, 4))}


def near_record(r):
    """A record of a known layout in which one thing may be odd."""
    text = lambda: r.choice(["a", "", None, 3, [{"type": "text", "text": "p"}, "q"], [{"type": "image", "url": "u"}], any_json(r)])
    turn = lambda: r.choice([0, 1, 2, "0", None, True, any_json(r)])
    listed = lambda a, b: [{a: r.choice(["user", "assistant", None, 5]), b: text()} for _ in range(r.randint(0, 3))] + r.choice([[], ["x"], [None]])
    return r.choice([
        {"messages": listed("role", "content")}, {"system": text(), "messages": listed("role", "content")}, {"conversations": listed("from", "value")},
        {"turns": [{**x, "turn": turn()} for x in listed("role", "text") if isinstance(x, dict)]}, {"prompt": text(), "completion": text()}, {"instruction": text(), "input": text(), "output": text()},
    ])


def test_no_record_raises_and_what_is_formatted_reads_back():
    r, layouts, seen = random.Random(1), chat.Layouts(), set()
    for k in range(20_000):
        record = any_json(r) if k % 2 else near_record(r)
        name, layout, text, mask = chat.formatted_record(json.dumps(record), layouts)
        seen.add(layout)
        if layout:
            turns = chat.read_back(text)
            assert chat.render(turns) == (text, mask) and text.encode()
            assert "".join(chat.unescape(text[a:b]) for a, b in mask) == "".join(t for x, t in turns if x == "assistant")
        else:
            assert text is None and mask is None
    assert len(seen) > 5
    for odd in (None, "", "{", "[" * 100_000, "null", '"x"', "7", "[]", '{"messages": []}', '{"a": NaN}'):
        assert chat.formatted_record(odd, layouts)[1:] == (None, None, None)


def test_layouts_with_parts_system_and_odd_values(spark):
    given = [
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}]},
        {"system": "be", "messages": [{"role": "user", "content": "a"}]},
        {"messages": [{"role": "user", "content": [{"type": "image", "text": "u"}]}]},
        {"messages": [{"role": "user", "content": "a"}, "x"]},
        {"turns": [{"turn": 1, "role": "user", "text": "a"}, {"turn": "0", "role": "user", "text": "b"}]},
        {"question": "a", "answer": 4},
        {"messages": [{"role": "bot", "content": "a"}]},
        {"conversations": [{"from": "bot", "value": "a"}], "id": [1, {"x": 2}]},
    ]
    d = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(given)], "k int, j string").select("k", chat.format_chat(F.col("j")).alias("f")).orderBy("k").collect()
    assert [r.f.layout for r in d] == ["messages", "messages with system", None, None, None, "question", "messages", "speakers"]
    turns = [chat.read_back(r.f.formatted) if r.f.layout else None for r in d]
    assert turns == [[("user", "a\nb"), ("assistant", "c")], [("system", "be"), ("user", "a")], None, None, None, [("user", "a"), ("assistant", "4")], [("bot", "a")], [("assistant", "a")]]
    assert all(r.f.fingerprint for r in d)


def test_no_text_is_dropped_in_silence():
    """Each text of a formatted record is in the output, or stands in a field about the record."""
    r, layouts, n = random.Random(3), chat.Layouts(), 0
    more = ["id", "source", "meta", "context", "response", "notes", "rejected", "category", "answer2", "system"]
    for k in range(8000):
        record = near_record(r) if k % 3 else r.choice([{"question": "q", "answer": "a"}, {"instruction": "i", "response": "r"}, {"prompt": "p", "response": "r"}])
        for name in r.sample(more, r.randint(0, 3)):
            record[name] = r.choice([f"text {k}", "", None, 4, {"in": f"deep {k}"}, [f"list {k}"]])
        if isinstance(record.get("messages"), list) and r.random() < 0.5:
            for x in record["messages"]:
                if isinstance(x, dict) and r.random() < 0.5:
                    x[r.choice(["tool_calls", "name", "note"])] = r.choice([f"call {k}", [{"function": {"name": "f", "arguments": f"arg {k}"}}]])
        _, layout, text, _ = chat.formatted_record(json.dumps(record), layouts)
        if not layout:
            continue
        n += 1
        whole = "\n".join(f"{a}\n{b}" for a, b in chat.read_back(text))
        roles = {"user", "assistant", "human", "gpt", "bot", "model", "chatbot", "text", ""}

        def check(value, at):
            if at in chat.METADATA:
                return
            if isinstance(value, dict):
                for a, b in value.items():
                    check(b, f"{at}.{a}" if at else a)
            elif isinstance(value, list):
                for x in value:
                    check(x, f"{at}[]")
            elif isinstance(value, str) and value not in roles:
                assert value in whole or chat.SURROGATE.sub("\ufffd", value) in whole, (record, at)  # noqa: B023

        check(record, "")
    assert n > 1500


def test_context_response_and_tool_calls():
    layouts = chat.Layouts()
    read = lambda record: (lambda f: f[1] and (f[1], chat.read_back(f[2])))(chat.formatted_record(json.dumps(record), layouts))
    assert read({"question": "q", "context": "c", "answer": "a", "id": "x"}) == ("question with context", [("user", "c\n\nq"), ("assistant", "a")])
    assert read({"instruction": "i", "context": "c", "response": "r", "category": "k"}) == ("instruction with context", [("user", "i\n\nc"), ("assistant", "r")])
    assert read({"prompt": "p", "response": "r"}) == ("prompt with response", [("user", "p"), ("assistant", "r")])
    calls = [{"id": "1", "function": {"name": "f", "arguments": "{\"x\": 1}"}}]
    said = {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": None, "tool_calls": calls}, {"role": "tool", "content": "4", "tool_call_id": "1"}]}
    assert read(said) == ("messages", [("user", "u"), ("assistant", json.dumps(calls)), ("tool", "4")])
    assert read({"prompt": "p", "completion": "c", "rejected": "worse"}) is None  # not named, so the layout is unknown
    assert read({"prompt": "p", "completion": "c", "n": 3, "flags": [True]})[0] == "prompt"


def test_query_uses_every_layout_and_matches_a_plain_version(spark, tmp_path):
    r = random.Random(7)
    rows = []
    for c in [None, *range(500)]:
        n = r.randint(1, 5)
        roles = r.choice([["user", "assistant"], ["system", "user", "assistant"], [r.choice(["user", "assistant", "system", "tool", "bot"]) for _ in range(n)]])
        rows += [(c, r.choice([k, k, 0]), x if r.random() < 0.97 else None, r.choice([None, "", "hi", "one\n\ntwo\n", "\n\nx", "x\n\n", "<|im_start|>\\<\\|é", "l1\nl2\r\n"])) for k, x in enumerate(roles)]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("pick", F.lit(1))
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    rows += [(-1, 0, "user", q_chat.PLANTED), (-1, 1, "assistant", q_chat.PLANTED)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for c in {x[0] for x in rows}:
        turns = [(x or "", t or "") for _, _, x, t in sorted((k, n, x or "", t or "") for k, n, x, t in rows if k == c)] if c is not None else [(x, t) for _, x, t in sorted((n, x or "", t or "") for k, n, x, t in rows if k is None)]
        learnt = "".join(t for x, t in turns if x == "assistant")
        want.add((c, len(turns), sha("".join(f"{x}\n{t}\n" for x, t in turns)), len(learnt), sha(learnt), len(chat.render(turns)[0])))
    assert {tuple(x) for x in q_chat.op8_chat_formatting(spark, str(tmp_path)).collect()} == want
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    records = table.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t")).where("conv_id IS NOT NULL").select(chat.format_chat(q_chat.in_layouts(F.col("t"), F.col("conv_id") % 15)).alias("f"))
    assert {x[0] for x in records.select("f.layout").distinct().collect()} == {m.name for m in chat.MAPPINGS}
    table.where("false").write.parquet(str(tmp_path / "e" / "conversations.parquet"))
    assert [x.conv_id for x in q_chat.op8_chat_formatting(spark, str(tmp_path / "e")).collect()] == [-1]
