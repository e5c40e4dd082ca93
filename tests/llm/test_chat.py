import hashlib
import json

import pytest
from brute import SF
from cohortlake.llm import chat as C
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

HARD = ["", "<|end|>", "\\<|turn|>user<|body|>", "\\", "\\\\<", "<", "|>", "a\\|b", "<\\|image:0|>", "<|image:3|>", "### Assistant: </turn>\n\r\u2028ok", "🙂 é"]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a<|b", ""]), st.one_of(st.sampled_from(HARD), st.text(alphabet="\\<|>aturn:0é🙂\n")))))
def test_every_text_is_read_back(turns):
    visitor, said, learnt, whole = C.Visitor(), [], "", ""
    for role, text in turns:
        row = visitor.turn(role, [{"kind": "text", "text": text}])
        assert row["start"] == len(whole)
        whole += row["formatted"]
        back, parts = C.read_turn(row["formatted"])
        said.append((back, "".join(t for k, t in parts if k == "text")))
        learnt += "".join(C.unescape(whole[s["start"] : s["end"]]) for s in row["loss"])
    assert said == turns
    assert learnt == "".join(t for r, t in turns if r == "assistant")
    assert whole.count(C.TURN) == whole.count(C.END) == len(turns)


def digest(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    learnt = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def test_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    turns = C.format_conversations(C.text_parts(df))
    got = {r["conv_id"]: tuple(r)[1:5] for r in C.digests(turns).collect()}
    want = {}
    for r in df.orderBy("conv_id", "turn").collect():
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {c: digest(t) for c, t in want.items()}
    whole = {r["conv_id"]: r["formatted"] for r in C.conversation_texts(turns).collect()}
    sizes = {r["conv_id"]: r["formatted_chars"] for r in C.digests(turns).collect()}
    assert {c: len(t) for c, t in whole.items()} == sizes


def test_hard_rows_in_any_order(spark):
    rows = [(1, None, "user", "first"), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (1, 3, None, None), (None, 0, "user", "x"), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS position", "2 AS formatted", "3 AS loss", "4 AS start")
    want = {
        1: digest([("user", "first"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b"), (None, None)]),
        None: digest([("user", "x")]), 2: digest([("assistant", "")]),
    }
    for frame in (df, df.orderBy(F.desc("text")).coalesce(1)):
        got = {r["conv_id"]: tuple(r)[1:5] for r in C.digests(C.format_conversations(C.text_parts(frame))).collect()}
        assert got == want
    assert C.digests(C.format_conversations(C.text_parts(df.where("false")))).count() == 0


def test_typed_parts(spark):
    parts = [
        {"kind": "text", "text": "Look <|image:0|>"}, {"kind": "image", "ref": "a.png", "size": [28, 15]}, {"kind": "audio", "ref": "b.wav", "size": [2500]},
        {"kind": None, "text": None}, {"kind": "document", "ref": None, "size": [3]}, {"kind": "image", "ref": "c.png", "size": None}, None,
    ]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [{"kind": "text", "text": "ok"}, {"kind": "image", "ref": "d.png", "size": [1, 1]}, {"kind": "text", "text": "!"}]), (1, 2, "user", None)]
    schema = f"conv_id long, turn long, role string, parts array<{C.PART.simpleString()}>"
    df = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(dict(zip(("conv_id", "turn", "role", "parts"), r))) for r in rows]))
    turns = sorted(C.format_conversations(df).collect(), key=lambda r: r["position"])
    whole = "".join(t["formatted"] for t in turns)
    assert turns[0]["formatted"] == "<|turn|>user<|body|>Look <\\|image:0|><|image:0|><|audio:1|><|document:2|><|image:3|><|end|>"
    found = [a for t in turns for a in t["attachments"]]
    assert [(a["number"], a["kind"], a["ref"], a["tokens"]) for a in found] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 63), (2, "document", None, 1536), (3, "image", "c.png", 1), (4, "image", "d.png", 1)]
    assert all(whole[a["at"] :].startswith(f"<|{a['kind']}:{a['number']}|>") for a in found)
    assert [whole[s["start"] : s["end"]] for t in turns for s in t["loss"]] == ["ok", "!"]
    assert C.digests(C.format_conversations(df)).first()["expanded_tokens"] == 1605


def test_unknown_kind_is_an_error():
    with pytest.raises(ValueError, match="unknown kind"):
        C.Visitor().turn("user", [{"kind": "video"}])
