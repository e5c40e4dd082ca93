"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor
goes through them in order and writes the turn into the conversation's text:
texts are escaped, every attachment becomes a numbered placeholder, its reference
and the number of tokens that it will expand to are recorded, and what the
assistant says is marked by spans of a loss mask.

Template, with <|turn|>, <|body|>, <|end|> and <|kind:number|> as control strings:

    <|turn|>user<|body|>Look: <|image:0|><|end|>

Inside texts and roles a backslash is doubled and <| becomes <\\|, so no control
string can stand there, and undoing it gives every text back.

Scale: one shuffle by conversation; partitions are sorted and streamed, a turn at
a time, with a running offset and attachment number as all the state. Output is a
row per turn, so a conversation of any length never has to fit in memory, and
joining the rows' texts in order gives its formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"

#: Parts of a turn. ``size`` holds what a kind is measured by: see EXPANSION.
PART = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("size", T.ArrayType(T.LongType())),
    ]
)
ATTACHMENT = T.StructType(
    [T.StructField("number", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("at", T.LongType()), T.StructField("tokens", T.LongType())]
)
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
TURN_ROW = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("position", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("loss", T.ArrayType(SPAN)),
        T.StructField("attachments", T.ArrayType(ATTACHMENT)),
    ]
)

IMAGE_PATCH, AUDIO_TOKENS_A_SECOND, DOCUMENT_TOKENS_A_PAGE = 14, 25, 512

#: Tokens that an attachment expands to, from its size: [width, height], [milliseconds], [pages]; one at least.
EXPANSION = {
    "image": lambda width=0, height=0: -(-width // IMAGE_PATCH) * -(-height // IMAGE_PATCH),
    "audio": lambda ms=0: -(-ms * AUDIO_TOKENS_A_SECOND // 1000),
    "document": lambda pages=0: pages * DOCUMENT_TOKENS_A_PAGE,
}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@dataclass
class Visitor:
    """Writes the turns of one conversation; positions count code points from its start."""

    at: int = 0
    position: int = 0
    number: int = 0
    out: list[str] = field(default_factory=list)
    loss: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def turn(self, role: str | None, parts: list[dict]) -> dict:
        start = self.at
        self.out, self.loss, self.attachments = [], [], []
        self.write(f"{TURN}{escape(role or '')}{BODY}")
        for part in parts:
            self.part(part, learn=role == "assistant")
        self.write(END)
        self.position += 1
        return {"position": self.position - 1, "start": start, "formatted": "".join(self.out), "loss": self.loss, "attachments": self.attachments}

    def part(self, part: dict | None, learn: bool) -> None:
        part = part or {}
        kind = part.get("kind") or "text"
        if kind == "text":
            start = self.at
            self.write(escape(part.get("text") or ""))
            if learn and self.at > start:
                self.loss.append({"start": start, "end": self.at})
            return
        if kind not in EXPANSION:
            raise ValueError(f"unknown kind of part: {kind!r}")
        arity = 2 if kind == "image" else 1
        tokens = max(1, EXPANSION[kind](*[max(0, x or 0) for x in (part.get("size") or [])[:arity]]))
        self.attachments.append({"number": self.number, "kind": kind, "ref": part.get("ref"), "at": self.at, "tokens": tokens})
        self.write(f"<|{kind}:{self.number}|>")
        self.number += 1


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("conv_id", pa.int64()), ("position", pa.int64()), ("start", pa.int64()), ("formatted", pa.string()),
            ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("attachments", pa.list_(pa.struct([("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))),
        ]
    )
    conv, visitor = object(), Visitor()
    for batch in batches:
        rows = []
        for c, role, parts in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "parts")), strict=True):
            if c != conv:
                conv, visitor = c, Visitor()
            rows.append({"conv_id": c} | visitor.turn(role, parts or []))
        yield pa.RecordBatch.from_pylist(rows, schema)


def text_parts(rows: DataFrame, text: str = "text", parts: str = "parts") -> DataFrame:
    """``rows`` with the column ``parts``: its text as a single text part."""
    part = F.struct(F.lit("text").alias("kind"), F.col(text).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("array<bigint>").alias("size"))
    return rows.withColumn(parts, F.array(part.cast(PART)))


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """A row for each turn: conv_id, position, start, formatted, loss, attachments.

    Turns go by ``turn``, nulls first; equal ones by role and parts, so the result
    does not depend on the input's order, and repeated rows are turns each. Null
    roles and texts are empty, null lists have no parts, a null kind is text and
    an unknown kind is an error. Rows with a null conv_id are one conversation.
    Spans and places count code points from the conversation's start. Rows of a
    conversation stand in order in one partition. An empty table gives an empty
    result; other columns are not looked at.
    """
    rows = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(parts).alias("parts"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
    return ordered.select("conv_id", "role", "parts").mapInArrow(_format, TURN_ROW)


def read_turn(formatted: str) -> tuple[str, list[tuple[str, str]]]:
    """The role, and the parts as ("text", its text) or (kind, its number), of one formatted turn."""
    if not formatted.startswith(TURN) or not formatted.endswith(END):
        raise ValueError("not a formatted turn")
    role, _, body = formatted[len(TURN) : -len(END)].partition(BODY)
    out, at = [], 0
    for m in re.finditer(r"<\|(\w+):(\d+)\|>", body):
        if m.start() > at:
            out.append(("text", unescape(body[at : m.start()])))
        out.append((m[1], m[2]))
        at = m.end()
    if at < len(body):
        out.append(("text", unescape(body[at:])))
    return unescape(role), out


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"


class _Digest:
    def __init__(self, conv: int | None):
        self.conv, self.turns, self.learnt = conv, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss = self.chars = self.attached = self.tokens = 0

    def add(self, formatted: str, start: int, loss: list[dict], attachments: list[dict]) -> None:
        role, parts = read_turn(formatted)
        self.turns.update(f"{role}\n{''.join(text for kind, text in parts if kind == 'text')}\n".encode())
        for span in loss:
            text = unescape(formatted[span["start"] - start : span["end"] - start])
            self.learnt.update(text.encode())
            self.loss += len(text)
        self.n += 1
        self.chars += len(formatted)
        self.attached += len(attachments)
        self.tokens += sum(a["tokens"] for a in attachments)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss, self.learnt.hexdigest(), self.chars, self.attached, self.tokens


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]

    def rows(done: list[_Digest]) -> pa.RecordBatch:
        columns = list(zip(*[d.row() for d in done], strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    now = None
    for batch in batches:
        done = []
        for c, *turn in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "start", "loss", "attachments")), strict=True):
            if now is None or c != now.conv:
                done += [now] if now else []
                now = _Digest(c)
            now.add(*turn)
        yield rows(done)
    if now:
        yield rows([now])


def digests(turns: DataFrame) -> DataFrame:
    """Each conversation as read back from the rows of ``format_conversations``, which must be in their order.

    conv_id, n_turns, turns_sha256 (role, \\n, text, \\n of every turn), loss_chars and
    loss_sha256 (the unescaped text under the loss mask), formatted_chars, n_attachments
    and expanded_tokens. Streams its partitions; no shuffle.
    """
    return turns.select("conv_id", "formatted", "start", "loss", "attachments").mapInArrow(_read, DIGEST)


def conversation_texts(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): the whole text of each conversation, for those that fit in a row."""
    pieces = F.array_sort(F.collect_list(F.struct("position", "formatted")))
    return turns.groupBy("conv_id").agg(pieces.alias("pieces")).select("conv_id", F.array_join(F.transform("pieces", lambda p: p["formatted"]), "").alias("formatted"))
