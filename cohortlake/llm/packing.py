"""Bounded-space online packing of token ids into training windows.

Every Spark partition keeps a fixed number of open windows. A document's ids are
cut into whole windows first; the rest goes to the open window that it fills
best (best fit), and when none has room the fullest is emitted and its place
taken. What is open at the end of a partition is written out with its ids, and a
second, much smaller pass lays these leftovers on end and cuts them into full
windows. Memory is the open windows and one batch of documents; nothing is
shuffled but the leftovers, a bounded number of windows for each partition.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import freeze
from cohortlake.llm.text import per_process

WINDOW, OPEN_WINDOWS, END_ID = 1024, 64, 0
#: About so many ids of leftovers go to one task of the merge.
MERGE_IDS = 1 << 20
_MERGED = 1 << 62

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("left_over", T.BooleanType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
_ARROW = pa.schema(
    [(n, pa.int64()) for n in PIECE.names[:7]] + [("left_over", pa.bool_()), ("ids", pa.binary())]
)

#: Characters on which both libraries split words alike whatever Unicode version they follow.
_PLAIN = re.compile("[\t\n\r -~¡-¬®-ɏ‐-‧]*")


class Encoder:
    """Ids as ``tokenizers`` gives them for a byte-level BPE file.

    The same merges run several times faster in tiktoken. It takes the texts of
    plain Latin characters without a special token's string, if the file's merges
    are in the order of the ids; ``tokenizers`` itself takes all others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._fast(spec["model"]["vocab"], spec["model"]["merges"])

    def _fast(self, vocab: dict[str, int], merges: list):
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        joined = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if joined != sorted(joined) or len(vocab) - len(joined) - 256 != len([s for s in self.special if s in vocab]):
            return None
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        return tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.fast is not None and _PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        out: list = [self.fast.encode_ordinary(t) if p else None for t, p in zip(texts, plain, strict=True)]
        for i, p in enumerate(plain):
            if not p:
                out[i] = self.slow.encode(texts[i], add_special_tokens=False).ids
        return [np.array(ids, np.uint32) for ids in out]


class _Rows:
    """Pieces on their way out, as Arrow batches."""

    def __init__(self, with_ids: bool):
        self.rows: list[tuple] = []
        self.with_ids = with_ids

    def put(self, sequence: int, pieces: list[tuple], left_over: bool = False) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, sequence, at, left_over, raw if left_over or self.with_ids else None))
            at += len(ids)

    def batches(self, least: int = 4096) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            columns = [pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), _ARROW.types, strict=True)]
            self.rows = []
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _pack(path: str, window: int, open_windows: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(f"encoder {path}", lambda: Encoder(path))
        sequence = TaskContext.get().partitionId() << 33
        fill = np.zeros(open_windows, np.int64)
        held: list[list[tuple]] = [[] for _ in range(open_windows)]
        out = _Rows(with_ids)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                total = len(ids)
                for at in range(0, total, window):
                    piece = (doc, at, ids[at : at + window], total)
                    size = len(piece[2])
                    if size == window:
                        out.put(sequence, [piece])
                        sequence += 1
                        continue
                    best = int(np.where(fill + size <= window, fill, -1).argmax())
                    if fill[best] + size > window:
                        best = int(fill.argmax())
                        out.put(sequence, held[best])
                        sequence += 1
                        held[best], fill[best] = [], 0
                    held[best].append(piece)
                    fill[best] += size
            yield from out.batches()
        for pieces in held:
            if pieces:
                out.put(sequence, pieces, left_over=True)
                sequence += 1
        yield from out.batches(1)

    return run


def _merge(window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = _MERGED + (TaskContext.get().partitionId() << 33)
        room, held, out = window, [], _Rows(with_ids)
        for batch in batches:
            for row in batch.to_pylist():
                ids, start = np.frombuffer(row["ids"], "<u4"), row["start"]
                while len(ids):
                    part, ids = ids[:room], ids[room:]
                    held.append((row["doc_id"], start, part, row["doc_tokens"]))
                    start += len(part)
                    room -= len(part)
                    if room == 0:
                        out.put(sequence, held)
                        sequence, room, held = sequence + 1, window, []
            yield from out.batches()
        if held:
            out.put(sequence, held)
        yield from out.batches(1)

    return run


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
    window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``path`` is a byte-level BPE file of ``tokenizers``, readable on every executor.
    A document is its text's ids and ``end_id``; a null text is empty, so it is that
    id alone. Every id of every row lies in one piece. A sequence's pieces lie on
    end from offset 0 and hold at most ``window`` ids. Null, equal and repeated
    doc_ids are carried as they are; an empty table gives no pieces; other columns
    are not looked at. ``ids`` is little-endian unsigned 32-bit, null without
    ``with_ids``.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    pieces = freeze(rows.mapInArrow(_pack(path, window, open_windows, end_id, with_ids), PIECE))
    left = pieces.where("left_over")
    total = left.agg(F.sum("length")).first()[0] or 0
    parts = max(1, -(-total // MERGE_IDS))
    merged = left.repartition(parts, "sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(_merge(window, with_ids), PIECE)
    return pieces.where("NOT left_over").unionByName(merged).drop("left_over")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids, n_ids): whole windows as arrays of ints, padded; from pieces with ids.

    A window is a group of at most ``window`` ids, so a group's size is bounded.
    """

    def join(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch:
            ids = [np.frombuffer(b"".join(p["ids"] for p in row), "<u4").astype(np.int32) for row in b.column(1).to_pylist()]
            padded = [np.concatenate((x, np.full(window - len(x), pad_id, np.int32))) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(padded, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())], names=["sequence_id", "ids", "n_ids"])

    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return rows.mapInArrow(join, "sequence_id long, ids array<int>, n_ids long")
