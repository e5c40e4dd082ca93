"""Words, lines and their hashes over the raw UTF-8 bytes of an Arrow batch.

All work is vectorised with numpy inside a Spark task. A word is a maximal run
of bytes other than space and 0x09-0x0D, which are single bytes in UTF-8, so no
text has to be decoded. Null texts count as empty.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2**64
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Text bytes handled at once; numpy temporaries are a small multiple of this.
SLICE_BYTES = 1 << 20

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def per_process(key: str, make: Callable[[], Any]) -> Any:
    """A read-only object that is made once in a Python process: workers outlive tasks."""
    kept = sys.__dict__.setdefault("_cohortlake_llm", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(2 * SLICE_BYTES, 1 << (n - 1).bit_length())

    def make() -> list[np.ndarray]:
        tables = []
        for base in (_BASE, _BASE_INV):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        return tables

    up, down = per_process("powers", make) if size == 2 * SLICE_BYTES else make()
    return up, down


class Texts:
    """The bytes of some texts on end: ``data[offsets[i]:offsets[i + 1]]`` is text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._prefix: np.ndarray | None = None

    @classmethod
    def of(cls, texts: list[str | None]) -> Texts:
        return next(slices(pa.array(texts, pa.string()), 1 << 62))[1]

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """The text in which each byte position lies."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many of the per-byte flags hold in each text."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of flagged bytes within one text: starts, ends, text number."""
        first = np.zeros(len(inside) + 1, bool)
        first[self.offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
        after = np.concatenate((inside[1:], [False])) if len(inside) else inside
        starts = np.flatnonzero(inside & (first[:-1] | ~before))
        ends = np.flatnonzero(inside & (first[1:] | ~after)) + 1
        return starts, ends, self.doc_of(starts)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(~IS_SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """\\n-split lines with at least one byte."""
        return self.spans(self.data != 0x0A)

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span, the same wherever they stand."""
        up, down = _power_tables(len(self.data) + 1)
        if self._prefix is None:
            terms = (self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)]
            self._prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        raw = (self._prefix[ends] - self._prefix[starts]) * down[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * _M2)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """Runs of rows with about ``limit`` bytes of text (one row at least): first row, texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, Texts(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def window_hashes(hashes: np.ndarray, docs: np.ndarray, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``size`` consecutive words of one text: first word, hash."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = (total + hashes[j : j + n]) * _BASE
    at = np.flatnonzero(docs[:n] == docs[size - 1 :])
    return at, mix64(total[at] + np.uint64(size + 1000 * salt))


def least_reached(n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least node that edges (r, c) reach."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, r, least[c])
        np.minimum.at(least, c, least[r])
        least = least[least]
        if (least == before).all():
            return least
