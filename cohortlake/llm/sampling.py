"""Sampled SentencePiece segmentations without replacement, and decoding.

The lattice of a text has an edge for every piece of the model that fits there; a
path is a segmentation, with a probability proportional to the product of its
pieces' probabilities to the power ``alpha``. Gumbel top-k draws k distinct paths
as if one drew without replacement (Kool et al., 2019): every path's log
probability gets Gumbel noise and the k largest win. They are found by best-first
(A*) search on the tree of path beginnings, top down: a beginning's bound is the
largest perturbed value among its paths, known from its total probability alone,
and goes over to one child, while the others get smaller ones (Maddison et al.,
2014). So each path costs one walk down the lattice; all ways that turn off from
it are kept as bounds only.

No piece goes over the start of a word, so a text's lattice is a chain of its
words' lattices. In each Arrow batch the distinct words' lattices and their
backward sums are built at once with numpy, and all words of all texts are walked
side by side. Random numbers are hashes of (seed, row key, sample, word, step),
so results do not depend on partitions or retries.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.text import mix64, per_process

SAMPLES, ALPHA, SEED = 2, 0.5, 7
#: Piece probabilities fall with the rank r of a merge as 1 / (r + ZIPF_SHIFT); a byte's is that of a last rank.
ZIPF_SHIFT = 10.0
#: Characters walked side by side.
SLICE_CHARS = 5 << 19
_SPACE = 0x2581
#: Characters that end a word if no piece joins them with others.
_BREAKS = "\t\n\r"
_MUL = np.uint64(0x9E3779B97F4A7C55)
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))
#: Noise never exceeds this with 53-bit random numbers, nor does a bound its log probability by more.
_MOST_NOISE = 37.0


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers within (0, 1)."""
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Pieces:
    """A SentencePiece model's pieces by hash, with log probabilities."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = model.get_piece_size()
        self.byte0 = next(i for i in range(self.n) if model.is_byte(i))
        self.special = np.array([model.is_control(i) or model.is_unknown(i) for i in range(self.n)])
        own = [i for i in range(self.n) if not (self.special[i] or model.is_byte(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in own}
        self.longest = max(map(len, text.values()))
        if any("▁" in p.lstrip("▁") for p in text.values()):
            raise ValueError("a piece goes over a word's start")
        self.alone = np.array([ord(c) for c in _BREAKS if not any(c in p and len(p) > 1 for p in text.values())], np.uint32)
        ranks = np.array([-model.get_score(i) for i in own])
        log = -np.log(ranks - ranks.min() + ZIPF_SHIFT)
        self.log = np.zeros(self.n)
        self.log[own] = log
        self.byte_log = float(log.min())
        flat = np.frombuffer("".join(text.values()).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for p in text.values()])
        hashes = Hashed(flat).spans(np.concatenate(([0], ends[:-1])), ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(own, np.int32)[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have the same hash")
        #: Of all hashes with the same first bits, where the pieces' begin and how many there are at most.
        self.cell = np.searchsorted(self.hashes >> np.uint64(43), np.arange(1 << 21, dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.unique(self.hashes >> np.uint64(43), return_counts=True)[1].max())
        self.hashes = np.append(self.hashes, np.zeros(self.deepest, np.uint64))
        self.begins = np.zeros(1 << 21, bool)  # of the beginnings of longer pieces
        size = np.diff(ends, prepend=0)
        for n in range(1, self.longest):
            at = (ends - size)[size > n]
            self.begins[(Hashed(flat).spans(at, at + n) >> np.uint64(43)).astype(np.int64)] = True
        #: The UTF-8 bytes of every piece, on end, with spaces for word marks; none for control pieces.
        raw = [b"" if self.special[i] else bytes([i - self.byte0]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(self.n)]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    @staticmethod
    def of(path: str) -> Pieces:
        return per_process(f"pieces {path}", lambda: Pieces(path))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and their ids."""
        k = self.cell[(hashes >> np.uint64(43)).astype(np.int64)]
        hit = self.hashes[k] == hashes
        for i in range(1, self.deepest):
            also = self.hashes[k + i] == hashes
            k[also] += i
            hit |= also
        at = np.flatnonzero(hit)
        return at, self.ids[k[at]]


class Hashed:
    """Hashes of spans of code points."""

    def __init__(self, points: np.ndarray):
        up, down = per_process(f"points {len(points).bit_length()}", lambda: self._powers(1 << len(points).bit_length()))
        self.down = down
        terms = (points.astype(np.uint64) + np.uint64(1)) * up[: len(points)]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))

    @staticmethod
    def _powers(size: int) -> list[np.ndarray]:
        out = []
        for base in (_MUL, _INV):
            steps = np.full(size + 1, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        return out

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


class Lattice:
    """The words' lattices of some texts: edges by position, longer ones first, with P(edge | position).

    Positions are the distinct words' characters, in the order of their distance
    from their word's end; -1 is any word's end. ``word_at`` and ``word_size`` tell
    where each word of the texts begins and its length, ``bounds`` each text's words.
    A position's edges are first[at]:first[at + 1]; ``to`` is where an edge leads. A
    piece below 0 stands for the bytes of the character -piece - 1.
    """

    def __init__(self, pieces: Pieces, texts: list[str], alpha: float):
        lengths = np.array([len(t) for t in texts], np.int64)
        sizes = lengths + (lengths > 0)  # a mark stands before every text that is not empty
        doc_end = np.cumsum(sizes)
        points = np.full(int(sizes.sum()), _SPACE, np.uint32)
        own = np.ones(len(points), bool)
        own[(doc_end - sizes)[sizes > 0]] = False
        points[own] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        points[points == 0x20] = _SPACE
        mark, alone = points == _SPACE, np.isin(points, pieces.alone)
        start = alone.copy()
        start[1:] |= (mark[1:] & ~mark[:-1]) | alone[:-1]
        start[~own] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(points)).astype(np.int64)
        self.bounds = np.searchsorted(starts, np.concatenate(([0], doc_end)))
        _, first, word = np.unique(Hashed(points).spans(starts, ends), return_index=True, return_inverse=True)
        self.word_size = ends - starts
        size = self.word_size[first]
        end = np.cumsum(size)
        points = points[np.repeat(starts[first] - (end - size), size) + np.arange(int(size.sum()))]
        left = np.repeat(end, size) - np.arange(len(points))
        order = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        rank = np.empty(len(points) + 1, np.int32)
        rank[order] = np.arange(len(points))
        self.word_at = rank[(end - size)[word]]
        self._edges(pieces, points, left, rank, np.append(np.flatnonzero(np.diff(left[order], prepend=0)), len(points)), alpha)

    def _edges(self, pieces: Pieces, points: np.ndarray, left: np.ndarray, rank: np.ndarray, cuts: np.ndarray, alpha: float) -> None:
        """``left``: distance from the word's end; ``cuts``: where it changes among ranked positions."""
        n = len(points)
        hashed, at = Hashed(points), np.arange(n, dtype=np.int32)
        found = []  # (positions, pieces) by length
        for length in range(1, pieces.longest + 1):
            at = at[left[at] >= length]
            if not len(at):
                break
            hashes = hashed.spans(at, at + length)
            hit, ids = pieces.find(hashes)
            froms = at[hit]
            if length == 1:  # characters without a piece of their own: their bytes
                lone = np.ones(n, bool)
                lone[froms] = False
                lone = np.flatnonzero(lone)
                froms, ids = np.concatenate((froms, lone)), np.concatenate((ids, -points[lone].astype(np.int32) - 1))
            found.append((froms, ids))
            at = at[pieces.begins[(hashes >> np.uint64(43)).astype(np.int64)]]
        count = np.zeros(n, np.int64)
        for froms, _ in found:
            count[rank[froms]] += 1
        self.first = np.concatenate(([0], np.cumsum(count)))
        self.piece, self.to, self.size = (np.empty(self.first[-1], t) for t in (np.int32, np.int32, np.uint8))
        fill = self.first[:-1].copy()
        for length in range(len(found), 0, -1):
            froms, ids = found[length - 1]
            edge = fill[rank[froms]]
            fill[rank[froms]] += 1
            self.piece[edge], self.size[edge] = ids, length
            self.to[edge] = np.where(left[froms] == length, -1, rank[froms + length])
        log = (pieces.log * alpha)[self.piece.clip(0)]
        lone = np.flatnonzero(self.piece < 0)
        log[lone] = pieces.byte_log * alpha * _utf8_size(-self.piece[lone] - 1)
        # backward sums, position by position from the words' ends; all words at once
        rest = np.zeros(n + 1)  # the last is the ends'
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = self.first[i], self.first[j]
            rest[i:j] = np.logaddexp.reduceat(log[a:b] + rest[self.to[a:b]], self.first[i:j] - a)
        self.start = np.repeat(np.arange(n, dtype=np.int32), count)
        self.given = np.minimum(log + rest[self.to] - rest[self.start], 0.0)
        total = np.concatenate(([0.0], np.cumsum(np.exp(self.given))))
        self.upto = total[1:] - total[self.first[self.start]]
        self.upto[self.first[1:] - 1] = 2.0  # the last edge takes what rounding leaves
        self.first = self.first.astype(np.int32)

    def pick(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge at each position that a random number falls on."""
        edge = self.first[at]
        more = np.flatnonzero(self.upto[edge] < u)
        while len(more):
            edge[more] += 1
            more = more[self.upto[edge[more]] < u[more]]
        return edge

    def walk(self, at: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random paths from positions to their words' ends: edges on end, and how many each."""
        steps, count = [], np.zeros(len(at), np.int64)
        on = np.flatnonzero(at >= 0)
        at = at[on]
        while len(on):
            edge = self.pick(at, _unit(mix64(seeds[on] + np.uint64((len(steps) + 1) * 0xD1B54A33))))
            steps.append((on, edge))
            count[on] += 1
            at = self.to[edge]
            on, at = on[at >= 0], at[at >= 0]
        out = np.empty(int(count.sum()), np.int32)
        before = np.cumsum(count) - count
        for i, (on, edge) in enumerate(steps):
            out[before[on] + i] = edge
        return out, count


def _utf8_size(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def _gumbel_below(log: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel noise around ``log``, given that it stays below ``bound``."""
    return log - np.log(np.exp(np.minimum(log - bound, 700.0)) - np.log(u))


class Search:
    """Top-k paths of every text of a lattice."""

    def __init__(self, lattice: Lattice, keys: np.ndarray, k: int):
        self.lattice, self.keys, self.k = lattice, keys, k
        self.n = len(keys)
        self.heaps: list[list] = [[] for _ in range(self.n)]
        self.paths: list[tuple[np.ndarray, np.ndarray]] = []  # edges on end, and each text's bounds
        self.values: list[np.ndarray] = []  # perturbed log probabilities, -inf: no such path
        self.logs: list[np.ndarray] = []
        self.tie = 0
        self.chars = np.cumsum(lattice.word_size)
        self.run()

    def seeds(self, what: int, docs: np.ndarray, i: np.ndarray) -> np.ndarray:
        return mix64(mix64(self.keys[docs] + np.uint64(what * 0x51ED2701)) + i.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def run(self) -> None:
        lat, all_ = self.lattice, np.arange(self.n)
        root = -np.log(-np.log(_unit(self.seeds(0, all_, np.zeros(self.n, np.int64)))))
        doc = np.repeat(all_, np.diff(lat.bounds))
        edges, count = lat.walk(lat.word_at, self.seeds(1, doc, np.arange(len(doc)) - lat.bounds[doc]))
        ends = np.concatenate(([0], np.cumsum(count)))
        self.emit(edges, ends[lat.bounds], root, np.zeros(self.n, np.int64), np.zeros(self.n))
        for sample in range(2, self.k + 1):
            self.next(sample)

    def emit(self, edges, bounds, value, since, before) -> None:
        """Add a path to every text, and the turns off it from step ``since`` on to its heap."""
        lat, given = self.lattice, self.lattice.given[edges]
        total = np.concatenate(([0.0], np.cumsum(given)))
        self.paths.append((edges, bounds))
        self.values.append(value)
        self.logs.append(np.where(np.isfinite(value), total[bounds[1:]] - total[bounds[:-1]], -np.inf))
        size = np.diff(bounds)
        doc = np.repeat(np.arange(self.n), size)
        step = np.arange(len(edges)) - bounds[doc]
        log = total[:-1] - total[bounds[doc]]
        # a turn below every heap's need can be left out: noise is bounded
        near = (step >= since[doc]) & (log > -2 * _MOST_NOISE) & (given < -1e-15)
        at = np.flatnonzero(near)
        doc, step = doc[at], step[at]
        log = log[at] + np.log(-np.expm1(given[at]))
        noise = _unit(self.seeds(1000 + len(self.paths), doc, step))
        turn = _gumbel_below(log, value[doc], noise)
        which, j = len(self.paths) - 1, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=self.n))))
        for d in np.unique(doc):
            part = slice(j[d], j[d + 1])
            best = np.argsort(-turn[part], kind="stable")[: self.k]
            for b in best + j[d]:
                self.push(d, float(turn[b]), which, int(step[b]), (int(edges[at[b]]),))

    def push(self, d: int, value: float, path: int, step: int, without: tuple[int, ...]) -> None:
        self.tie += 1
        heapq.heappush(self.heaps[d], (-value, self.tie, path, step, without))

    def next(self, sample: int) -> None:
        """Every text's next best path: the beginning that its best bound stands for, walked to the end."""
        lat = self.lattice
        value, since = np.full(self.n, -np.inf), np.zeros(self.n, np.int64)
        parts: list[np.ndarray] = []  # edges up to and with the turn
        turned = np.full(self.n, -1)
        words = np.zeros(self.n, np.int64)  # the turn's word
        after = np.zeros(self.n, np.int64)  # the position after it
        draw = _unit(self.seeds(2000 + sample, np.arange(self.n), np.zeros(self.n, np.int64)))
        noise = _unit(self.seeds(3000 + sample, np.arange(self.n), np.zeros(self.n, np.int64)))
        none = np.zeros(0, np.int32)
        for d in range(self.n):
            if not self.heaps[d]:
                parts.append(none)
                continue
            least, _, path, step, without = heapq.heappop(self.heaps[d])
            edges, bounds = self.paths[path]
            head = edges[bounds[d] : bounds[d] + step]
            at = int(lat.start[without[0]])
            open_ = [e for e in range(lat.first[at], lat.first[at + 1]) if e not in without]
            p = np.exp(lat.given[open_])
            edge = open_[min(int(np.searchsorted(np.cumsum(p), draw[d] * p.sum())), len(open_) - 1)]
            value[d], since[d] = -least, step + 1
            parts.append(np.append(head, edge))
            words[d] = self.word_at_step(d, path, step)
            turned[d], after[d] = words[d], lat.to[edge]
            left = p.sum() - np.exp(lat.given[edge])
            if len(open_) > 1 and left > 1e-300:
                log = float(lat.given[head].sum() + np.log(left))
                self.push(d, float(_gumbel_below(np.array(log), np.array(-least), noise[d])), len(self.paths), step, (*without, edge))
        # the rest of the turn's word, and all words after it
        doc = np.repeat(np.arange(self.n), np.where(turned >= 0, lat.bounds[1:] - np.maximum(turned, 0), 0))
        number = np.arange(len(doc)) - np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=self.n))))[doc] + turned[doc]
        at = np.where(number == turned[doc], after[doc], lat.word_at[number])
        rest, count = lat.walk(at, self.seeds(sample, doc, number - lat.bounds[doc]))
        tail = np.bincount(doc, count, self.n).astype(np.int64)
        head = np.array([len(p) for p in parts], np.int64)
        bounds = np.concatenate(([0], np.cumsum(head + tail)))
        out = np.empty(bounds[-1], np.int32)
        here = np.repeat(bounds[:-1], head) + np.arange(int(head.sum())) - np.repeat(np.cumsum(head) - head, head)
        out[here] = np.concatenate(parts) if parts else none
        there = np.repeat(bounds[:-1] + head, tail) + np.arange(int(tail.sum())) - np.repeat(np.cumsum(tail) - tail, tail)
        out[there] = rest
        self.emit(out, bounds, value, since, None)

    def word_at_step(self, d: int, path: int, step: int) -> int:
        """The word in which step ``step`` of a text's path lies, by the characters before it."""
        (edges, bounds), first = self.paths[path], self.lattice.bounds[d]
        done = int(self.lattice.size[edges[bounds[d] : bounds[d] + step]].sum()) + (self.chars[first - 1] if first else 0)
        return int(np.searchsorted(self.chars, done, side="right"))

    def log_inclusion(self) -> list[np.ndarray]:
        """Log probability that each path is among the k, given the best value that is not."""
        best = np.array([-h[0][0] if h else -np.inf for h in self.heaps])
        out = []
        for log in self.logs:
            over = np.where(np.isfinite(best), log - np.where(np.isfinite(best), best, 0), np.inf)
            with np.errstate(over="ignore", divide="ignore"):
                out.append(np.where(over < -30, over, np.log(-np.expm1(-np.exp(np.minimum(over, 700))))))
        return out


def edge_ids(pieces: Pieces, lattice: Lattice, edges: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of edges, bytes for characters without a piece; and the texts' new bounds."""
    piece = lattice.piece[edges]
    if (piece >= 0).all():
        return piece.astype(np.int32), bounds
    point = np.maximum(-piece - 1, 0)
    size = np.where(piece < 0, _utf8_size(point), 1)
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(ends[-1], np.int64)
    out[ends[:-1][piece >= 0]] = piece[piece >= 0]
    lone = np.flatnonzero(piece < 0)
    for n in range(1, 5):
        own = lone[size[lone] == n]
        if n == 1:
            out[ends[own]] = pieces.byte0 + point[own]
        else:
            for i in range(n):
                bits = point[own] >> (6 * (n - 1 - i))
                out[ends[own] + i] = pieces.byte0 + ((0x100 - (0x100 >> n)) | bits if i == 0 else 0x80 | (bits & 0x3F))
    return out.astype(np.int32), ends[bounds]


def decode_ids(pieces: Pieces, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of id lists, the mark before a text taken off; and the texts' bounds."""
    size = pieces.raw_size[ids]
    ends = np.concatenate(([0], np.cumsum(size)))
    take = np.repeat(pieces.raw_at[ids] - ends[:-1], size) + np.arange(ends[-1])
    raw, at = pieces.raw[take], ends[bounds]
    keep = np.ones(len(raw), bool)
    begin = at[:-1][np.diff(at) > 0]
    keep[begin[raw[begin] == 0x20]] = False
    return raw[keep], np.concatenate(([0], np.cumsum(keep)))[at]


SAMPLED = "doc_id long, sample int, ids binary, log_prob double, log_inclusion double, perturbed double"


def _sample(path: str, k: int, alpha: float, seed: int):
    names = [x.split()[0] for x in SAMPLED.split(", ")]

    def give(pieces: Pieces, own: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        key = [d if d is not None else zlib.crc32(t.encode()) + (1 << 62) for d, t in zip(own, texts, strict=True)]
        lattice = Lattice(pieces, texts, alpha)
        search = Search(lattice, mix64(np.array(key, np.int64).view(np.uint64) + mix64(np.array([seed], np.uint64))), k)
        for j, inclusion in enumerate(search.log_inclusion()):
            there = np.isfinite(search.values[j])
            ids, bounds = edge_ids(pieces, lattice, *search.paths[j])
            lists = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            columns = [pa.array(own, pa.int64()), pa.array(np.full(len(own), j + 1, np.int32)), lists, pa.array(search.logs[j]), pa.array(inclusion), pa.array(search.values[j])]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(there))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        docs, texts, size = [], [], 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if size and size + len(t or "") > SLICE_CHARS:
                    yield from give(pieces, docs, texts)
                    docs, texts, size = [], [], 0
                docs.append(d)
                texts.append(t or "")
                size += len(t or "")
        if docs:
            yield from give(pieces, docs, texts)

    return run


def sample_encodings(docs: DataFrame, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Up to k distinct segmentations of every text: doc_id, sample, ids, log_prob, log_inclusion, perturbed.

    ``path`` is a SentencePiece model, readable on every executor. Samples come in
    the order of their perturbed log probabilities, from 1 on; a text with fewer
    segmentations gives them all, with an inclusion of 1 (log 0). ``ids`` is
    little-endian unsigned 32-bit. Null and empty texts have one segmentation
    without ids. Repeated rows give the same samples,
    as do equal texts with equal ids; rows with a null id are seeded by their text.
    The model writes a space as U+2581, so that character itself reads back as a space.
    An empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_sample(path or public_tokenizers.path("piece_bpe_32k.model"), k, alpha, seed), SAMPLED)


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of their id lists (null for a null list; control pieces are empty, broken UTF-8 becomes U+FFFD)."""
    from pyspark.sql import types as T

    from cohortlake.llm.common import fresh

    model = path or public_tokenizers.path("piece_bpe_32k.model")
    schema = T.StructType([*rows.schema.fields, T.StructField(fresh(rows.columns, out), T.StringType())])
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            column = batch.column(at)
            flat = np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), "<u4")
            size = np.array([len(x.as_buffer()) // 4 if x.is_valid else 0 for x in column], np.int64)
            raw, bounds = decode_ids(pieces, flat, np.concatenate(([0], np.cumsum(size))))
            texts = [raw[a:b].tobytes().decode(errors="replace") if x.is_valid else None for x, a, b in zip(column, bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
