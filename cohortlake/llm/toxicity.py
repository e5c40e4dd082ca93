"""Toxicity by the nearest labelled examples.

Texts become TF-IDF vectors over words and word beginnings (five and six
characters, which also see compounds). Each is compared, by exact cosine, with a
bounded set of labelled examples held in a block-max inverted index: the lists of
telling and of very frequent terms, and the short ones, are added up for all examples; of the many
middling lists every block's largest weight is known, and only the examples that these
bounds still let reach the k-th best are scored to the end, exactly; blocks without such are never opened. The neighbours vote with the square of their similarity, and
isotonic regression on the examples' own leave-one-out votes turns the vote into
a probability. The nearest examples are the evidence.

Scale: learning reads a bounded sample of labelled documents (MAX_EXAMPLES), and
every term of theirs is in the index, so the examples bound the model, which goes
out with the task. One Arrow pass counts the terms over all documents, one scores
them. Terms that no example has would only shorten all cosines of a text alike:
neither ranks nor votes see them, so the norm leaves them out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.compute import binary_length
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortlake.llm.common import append_columns, freeze, map_arrow
from cohortlake.llm.text import Texts, mix64, slices

#: Labelled documents that are learnt from at most: for each label those with the least hashes of doc_id.
MAX_EXAMPLES = 4096
#: The share of the examples that the rarer label gets at least, while it has so many.
LEAST_SHARE = 0.25
#: Terms with a chi-squared above MIN_CHI2 for the label, and the COMMON most frequent, weigh in full; all others OTHER times as much.
MIN_CHI2, MIN_DF, COMMON, OTHER = 30.0, 5, 100, 0.03
BEGINNINGS = (5, 6)
NEIGHBOURS, EVIDENCE, BLOCK = 10, 3, 64
#: A list of one example in DENSE is a dense row; lists of light terms of more than RARE examples are bounded.
DENSE, RARE = 24, 64
#: Where a bound leaves more examples than this, the next and dearer one is taken before they are scored from their own terms.
MANY = 16
#: Texts whose dense parts are added up at once; what single precision may lose of a cosine.
TEXTS, SLACK = 256, 1e-4
#: Terms of examples that the driver works on at once: it holds their numbers and weights, and temporaries of so many.
PIECE = 1 << 18
CUT = 0.7

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals as small letters, in UTF-8; other scripts as they are."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 0x20
    after_c3 = np.concatenate(([False], data[:-1] == 0xC3))[: len(data)]
    out[after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return out


def terms(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term hash, count) of all texts, by text and term."""
    low = Texts(_lower(t.data), t.offsets)
    starts, ends, docs = low.spans(_LETTER[low.data])
    lead = np.append(np.flatnonzero((low.data & 0xC0) != 0x80), len(low.data))
    first = np.searchsorted(lead, starts)
    chars = np.searchsorted(lead, ends) - first
    hashes, owner = [mix64(low.hash_spans(starts, ends) + np.uint64(1))], [docs]
    for n in BEGINNINGS:
        long = chars >= n
        hashes.append(low.hash_spans(starts[long], lead[first[long] + n]))
        owner.append(docs[long])
    h, d = np.concatenate(hashes), np.concatenate(owner)
    h >>= np.uint64(16)
    if t.n <= 1 << 16:  # text number and 48 bits of hash in one key, which sorts several times faster
        key = np.sort(h | d.astype(np.uint64) << np.uint64(48))
        h, d = key & np.uint64((1 << 48) - 1), (key >> np.uint64(48)).astype(np.int64)
    else:
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
    at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))[: len(h)])
    return d[at], h[at], np.diff(np.append(at, len(h)))


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges on end, and the range of each."""
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) + (first - (np.cumsum(size) - size))[owner], owner


@dataclass
class Index:
    """Unit TF-IDF vectors of the examples, by example; :class:`Lists` inverts them where they are searched."""

    vocabulary: np.ndarray  # sorted term hashes
    number: np.ndarray  # of each: terms are numbered from the most frequent on, so what is read often lies together
    idf: np.ndarray
    light: np.ndarray  # of each term: whether it weighs OTHER times as much
    examples: np.ndarray  # doc_ids
    toxic: np.ndarray
    bounds: np.ndarray  # where each example's terms begin
    term: np.ndarray
    weight: np.ndarray
    steps: np.ndarray  # calibration: raw votes
    rates: np.ndarray  # and the probability from each on

    def shared(self, df: DataFrame) -> Broadcast:
        """The arrays as a broadcast, made once for all jobs; ``_index`` of it in a task, without the calibration."""
        kept = self.__dict__
        if "_shared" not in kept:
            kept["_shared"] = df.sparkSession.sparkContext.broadcast({k: v for k, v in kept.items() if k != "_lists"})
        return kept["_shared"]

    def vectors(self, docs: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bounds of each text, term numbers, unit weights) for the vocabulary's terms."""
        term = np.searchsorted(self.vocabulary, hashes)
        term[term == len(self.vocabulary)] = 0
        known = self.vocabulary[term] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        docs, term = docs[known], self.number[term[known]]
        weight = (1 + np.log(counts[known])) * self.idf[term]
        norm = np.sqrt(np.bincount(docs, weight * weight, n))
        bounds = np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=n))))
        return bounds, term, weight / np.where(norm > 0, norm, 1)[docs]

    def lists(self) -> Lists:
        kept = self.__dict__
        if "_lists" not in kept:
            kept["_lists"] = Lists(self)
        return kept["_lists"]

    def vote(self, hit: np.ndarray, cosine: np.ndarray) -> float:
        mass = cosine * cosine
        return float((mass * self.toxic[hit]).sum() / mass.sum()) if len(hit) else 0.0


def _index(held: Broadcast) -> Index:
    """The broadcast's index, in a task: one a process, inverted once, which goes with the broadcast when a worker drops that."""
    kept = held.value
    if "_index" not in kept:
        kept["_index"] = Index(**kept)
    return kept["_index"]


class Lists:
    """The inverted index: what the search adds up for all examples, and what it only bounds.

    The lists of very frequent terms are dense rows. Other lists hold postings by
    term. Those of light terms in more than RARE examples, which are most of all
    postings and say little, lie by blocks of examples: with each block's largest weight, and with
    the norms of the light terms, the search bounds what they can add to an example.
    """

    def __init__(self, index: Index):
        size, terms_ = len(index.examples), len(index.vocabulary)
        owner = np.repeat(np.arange(size, dtype=np.int32), np.diff(index.bounds))
        df = np.bincount(index.term, minlength=terms_)
        dense = df * DENSE >= size
        self.row = np.where(dense, np.cumsum(dense) - 1, -1).astype(np.int32)
        self.bounded = index.light & (df > RARE) & ~dense
        self.dense = np.zeros((int(dense.sum()), size), np.float32)
        here = dense[index.term]
        self.dense[self.row[index.term[here]], owner[here]] = index.weight[here]

        here = ~here & ~self.bounded[index.term]
        by = np.flatnonzero(here)[np.argsort(index.term[here], kind="stable")]
        self.posting, self.weight = owner[by], index.weight[by]
        self.start = np.searchsorted(index.term[by], np.arange(terms_ + 1))

        self.blocks = -(-size // BLOCK)
        here = self.bounded[index.term]
        self.rest = np.sqrt(np.bincount(owner[here], index.weight[here].astype(np.float64) ** 2, size))
        by = np.flatnonzero(here)[np.argsort(index.term[here], kind="stable")]  # and by example, as they come
        cell = index.term[by].astype(np.int64) * self.blocks + owner[by] // BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cells = np.searchsorted(cell[first], np.arange(terms_ + 1) * self.blocks)
        self.block = (cell[first] % max(self.blocks, 1)).astype(np.int32)
        self.first, self.low_posting, self.low_weight = np.append(first, len(cell)), owner[by], index.weight[by]
        self.block_max = np.maximum.reduceat(self.low_weight, first) if len(first) else np.zeros(0, np.float32)
        self.query, self.term, self.full, self.ends = np.zeros(terms_, np.float32), index.term, index.weight, index.bounds.tolist()

    def nearest(self, bounds: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the k examples of the largest cosine above 0 (ties: least example number), best first.

        ``without``: an example of each text that does not count (-1: none).
        """
        for at in range(0, len(bounds) - 1, TEXTS):
            ends = bounds[at : at + TEXTS + 1]
            mine = slice(ends[0], ends[-1])
            text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            row = self.row[term[mine]]
            heavy = np.zeros((len(ends) - 1, len(self.dense)), np.float32)
            heavy[text[row >= 0], row[row >= 0]] = weight[mine][row >= 0]
            sums = heavy @ self.dense
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                yield self._settled(sums[i], term[a:b], weight[a:b], k, -1 if without is None else int(without[at + i]))

    def _settled(self, sums: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        pick, of = _ranges(self.start[term], self.start[term + 1] - self.start[term])
        if len(pick):
            sums += np.bincount(self.posting[pick], self.weight[pick] * weight[of], len(sums)).astype(np.float32)
        if without >= 0:
            sums[without] = -1
        # the most promising are scored from their own terms, which gives a k-th best to reach
        self.query[term] = weight
        size = min(k + 2, len(sums))
        done = np.argpartition(sums, len(sums) - size)[len(sums) - size :] if size else np.zeros(0, np.int64)
        done = done[done != without]
        scores = self._cosines(done)
        kth = lambda: np.partition(scores, -k)[-k] - SLACK if len(scores) > k else 0.0
        low = self.bounded[term]
        light = weight[low]
        bound = sums + self.rest * np.sqrt((light * light).sum())
        sums[done] = bound[done] = -1
        may = np.flatnonzero(bound >= kth())
        if len(may) > MANY:  # look at the blocks' maxima
            cell, of = _ranges(self.cells[term[low]], self.cells[term[low] + 1] - self.cells[term[low]])
            by_block = np.bincount(self.block[cell], light[of] * self.block_max[cell], self.blocks)
            bound = np.minimum(bound, sums + np.repeat(by_block, BLOCK)[: len(sums)])
            may = np.flatnonzero(bound >= kth())
            if len(may) > MANY:  # open the light lists, in the blocks that are left
                hot = np.zeros(self.blocks, bool)
                hot[may // BLOCK] = True
                use = np.flatnonzero(hot[self.block[cell]])
                pick, at = _ranges(self.first[cell[use]], self.first[cell[use] + 1] - self.first[cell[use]])
                bound = sums + np.bincount(self.low_posting[pick], self.low_weight[pick] * light[of[use]][at], len(sums))
                may = may[bound[may] >= kth()]
        may = may[may != without]
        may = may[np.argsort(-bound[may], kind="stable")]
        at = 0
        while at < len(may):
            now = may[at : at + k]
            done, scores, at = np.append(done, now), np.append(scores, self._cosines(now)), at + k
            may = may[: max(at, int(np.searchsorted(-bound[may], -kth(), side="right")))]
        self.query[term] = 0
        order = np.lexsort((done, -scores.round(12)))[:k]
        order = order[scores[order] > 0]
        return done[order], scores[order]

    def _cosines(self, examples: np.ndarray) -> np.ndarray:
        spans = [slice(self.ends[i], self.ends[i + 1]) for i in examples.tolist()]
        return np.array([self.query.take(self.term[s]).dot(self.full[s]) for s in spans])


def calibrated(raw: np.ndarray, steps: np.ndarray, rates: np.ndarray) -> np.ndarray:
    return rates[np.maximum(np.searchsorted(steps, raw, side="right") - 1, 0)]


def isotonic(raw: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: from which raw value on which rate (slightly towards a tenth) holds."""
    weight = np.ones(len(raw)) if weight is None else weight
    pools: list[list[float]] = []  # first raw value, positives, size
    for x in np.unique(raw):
        at = raw == x
        pools.append([float(x), float((label * weight)[at].sum()), float(weight[at].sum())])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, pos, n = pools.pop()
            pools[-1][1] += pos
            pools[-1][2] += n
    if not pools:
        return np.zeros(1), np.full(1, 0.1)
    x, pos, n = np.array(pools).T
    return x, np.maximum.accumulate((pos + 0.1) / (n + 1))


def _pieces(size: int) -> list[slice]:
    return [slice(at, at + PIECE) for at in range(0, size, PIECE)]


def _counted(term: np.ndarray, size: int) -> np.ndarray:
    """How often each of ``size`` numbers comes."""
    out = np.zeros(size, np.int64)
    for at in _pieces(len(term)):
        np.add.at(out, term[at], 1)
    return out


def build_index(vocabulary, df, n, examples, toxic, bounds, term, counts, factor=None) -> Index:
    """The index, not yet calibrated, of examples with these terms (numbers in the sorted vocabulary) and counts.

    ``df`` and ``n`` count all documents; a term's IDF is multiplied by its ``factor``.
    """
    factor = np.ones(len(vocabulary)) if factor is None else factor
    order = np.argsort(-_counted(term, len(vocabulary)), kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order))
    idf, light = (np.log((n + 1) / (df + 1)) * factor)[order], factor[order] < 1
    numbers, weight, rarity = np.empty(len(term), np.int32), np.empty(len(term), np.float32), idf.astype(np.float32)
    at = 0
    while at < len(examples):  # whole examples with about PIECE terms
        to = max(int(np.searchsorted(bounds, bounds[at] + PIECE, side="right")) - 1, at + 1)
        mine, owner = slice(bounds[at], bounds[to]), np.repeat(np.arange(to - at), np.diff(bounds[at : to + 1]))
        numbers[mine] = number[term[mine]]
        part = (1 + np.log(counts[mine], dtype=np.float32)) * rarity[numbers[mine]]
        norm = np.sqrt(np.bincount(owner, part.astype(np.float64) ** 2, to - at))
        weight[mine] = part / np.where(norm > 0, norm, 1)[owner].astype(np.float32)
        at = to
    return Index(vocabulary, number, idf, light, examples, toxic, bounds, numbers, weight, *isotonic(np.zeros(0), np.zeros(0)))


def _sample(one: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """At most MAX_EXAMPLES rows of (doc_id, toxic), and for how many rows one of each label stands, relative to the average.

    Labels share the places in proportion, but none gets fewer than LEAST_SHARE of them while it has rows.
    """
    one = freeze(one)
    sizes = {int(r["toxic"]): r["count"] for r in one.groupBy("toxic").count().collect()}  # 0 and 1
    n, n1 = sum(sizes.values()), sizes.get(1, 0)
    places, least = min(n, MAX_EXAMPLES), int(MAX_EXAMPLES * LEAST_SHARE)
    toxic = min(max(round(places * n1 / max(n, 1)), min(n1, least)), places - min(n - n1, least))
    take = {1: toxic, 0: places - toxic}
    parts = [one.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(v) for k, v in take.items()]
    return freeze(parts[0].unionByName(parts[1])), {k: sizes.get(k, 0) / v * places / n if v else 1.0 for k, v in take.items()}


def _factor(term: np.ndarray, owner: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """How much each of ``size`` terms weighs, given the examples' (term, example) pairs and labels."""
    df, with_ = _counted(term, size).astype(float), np.zeros(size)
    for at in _pieces(len(term)):
        np.add.at(with_, term[at], toxic[owner[at]])
    n, n1 = float(len(toxic)), toxic.sum()
    n0, without = n - n1, df - with_
    across = with_ * (n0 - without) - without * (n1 - with_)
    below = n1 * n0 * df * (n - df)
    chi2 = np.where(below > 0, n * across * across / np.where(below > 0, below, 1), 0)
    full = (chi2 > MIN_CHI2) & (df >= MIN_DF)
    full[np.argsort(-df, kind="stable")[:COMMON]] = True
    return np.where(full, 1.0, OTHER)


def _document_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of rows of ``docs`` and, for each sorted term hash, of those whose text has the term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, t in slices(batch.column(0)):
                _, h, _ = terms(t)
                at = np.searchsorted(vocabulary, np.sort(h))
                at[at == len(vocabulary)] = 0
                df += np.bincount(at[vocabulary[at] == np.sort(h)] if len(vocabulary) else at[:0], minlength=len(df))
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(has, -1)), pa.array(np.append(df[has], n))], names=["at", "n"])

    # sums of each partition, so at most a row for each of the examples' terms
    totals = docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    df, n = np.zeros(len(vocabulary)), 0
    for batch in totals.to_batches():
        at, count = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        df[at[at >= 0]] = count[at >= 0]
        n += int(count[at < 0].sum())
    return n, df


def learn(docs: DataFrame, labels: DataFrame) -> Index:
    """An index of at most MAX_EXAMPLES of the labelled documents, with all their terms.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic; rows with a null in
    either column of labels are left out, and of several labels for a document the
    largest holds. Of several texts for a doc_id one is taken, by its hash. Term
    weights count all of ``docs``.
    """
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sample, stands = _sample(one.join(docs.select("doc_id"), "doc_id", "left_semi"))  # labels of absent documents take no places
    schema = "doc_id long, toxic int, hashes binary, counts binary"

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, t in slices(batch.column(2)):
            d, h, c = terms(t)
            ends = np.cumsum(np.bincount(d, minlength=t.n))
            packed = [[x[i:j].tobytes() for i, j in zip([0, *ends[:-1]], ends, strict=True)] for x in (h, c.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, t.n), batch.column(1).slice(at, t.n), *(pa.array(x, pa.binary()) for x in packed)], names=["doc_id", "toxic", "hashes", "counts"])

    texts = docs.join(F.broadcast(sample), "doc_id")  # at most MAX_EXAMPLES rows
    chosen = texts.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))).where("_n = 1")
    chosen = freeze(chosen.select("doc_id", "toxic", "text"))
    # the terms of MAX_EXAMPLES texts, 12 bytes each; blocks of one label prune better
    found = map_arrow(chosen, each, schema).toArrow().to_batches()
    ids = np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in found)])
    label = np.concatenate([np.zeros(0, np.int32), *(b.column(1).to_numpy() for b in found)])
    sizes = np.concatenate([np.zeros(0, np.int32), *(binary_length(b.column(3)).to_numpy() // 4 for b in found)])
    order = np.lexsort((ids, label))
    examples, toxic = ids[order], label[order].astype(float)
    bounds = np.concatenate(([0], np.cumsum(sizes[order], dtype=np.int64)))
    hashes, counts = np.empty(bounds[-1], np.uint64), np.empty(bounds[-1], np.int32)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    last = len(place)
    while found:  # each goes as soon as it is copied
        batch = found.pop()
        last -= batch.num_rows
        for i, to in enumerate(place[last : last + batch.num_rows].tolist()):
            mine = slice(bounds[to], bounds[to + 1])
            hashes[mine] = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
            counts[mine] = np.frombuffer(batch.column(3)[i].as_buffer(), np.int32)
        del batch
    vocabulary = np.zeros(0, np.uint64)
    for at in _pieces(len(hashes)):
        vocabulary = np.union1d(vocabulary, hashes[at])
    term = np.empty(len(hashes), np.int32)
    for at in _pieces(len(hashes)):
        term[at] = np.searchsorted(vocabulary, hashes[at])
    del hashes
    factor = _factor(term, np.repeat(np.arange(len(examples), dtype=np.int32), np.diff(bounds)), toxic, len(vocabulary))
    n, df = _document_counts(docs, vocabulary)
    index = build_index(vocabulary, df, n, examples, toxic, bounds, term, counts, factor)
    del term, counts
    raw = _own_votes(chosen, index)
    index.steps, index.rates = isotonic(raw, toxic, np.where(toxic > 0, stands[1], stands[0]))
    return index


def _own_votes(chosen: DataFrame, index: Index) -> np.ndarray:
    """The vote on each example by the others: at most MAX_EXAMPLES rows, scored in tasks."""
    places, held = {d: i for i, d in enumerate(index.examples.tolist())}, index.shared(chosen)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        index = _index(held)
        own = np.array([places[d] for d in batch.column(0).to_pylist()], np.int64)
        votes = [index.vote(*found) for at, t in slices(batch.column(1)) for found in index.lists().nearest(*index.vectors(*terms(t), t.n), NEIGHBOURS, own[at : at + t.n])]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(votes, pa.float64())], names=["place", "vote"])

    found = map_arrow(chosen.select("doc_id", "text"), each, "place long, vote double").toArrow()
    raw = np.zeros(len(places))
    raw[found["place"].to_numpy()] = found["vote"].to_numpy()
    return raw


def _scores(held: Broadcast, steps: np.ndarray, rates: np.ndarray):
    def columns(texts: pa.Array) -> list[pa.Array]:
        index, raw, ids, cosines = _index(held), [], [], []
        for _, t in slices(texts):
            for hit, cosine in index.lists().nearest(*index.vectors(*terms(t), t.n), NEIGHBOURS):
                raw.append(index.vote(hit, cosine))
                ids.append(index.examples[hit[:EVIDENCE]])
                cosines.append(cosine[:EVIDENCE])
        return [pa.array(calibrated(np.array(raw), steps, rates)), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))]

    return columns


def score(docs: DataFrame, index: Index, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """All rows and columns of ``docs`` and the new ones' names: score, evidence (doc_ids), similarity.

    A text without any term of the vocabulary (null and empty ones too) has no
    neighbours and gets the examples' rate for such texts. Equal texts get equal
    scores. New names that clash get underscores in front.
    """
    numbers = T.ArrayType(T.DoubleType())
    fields = [("score", T.DoubleType()), ("evidence", T.ArrayType(T.LongType())), ("similarity", numbers)]
    out, names = append_columns(docs, text, _scores(index.shared(docs), index.steps, index.rates), fields)
    return out, dict(zip([n for n, _ in fields], names, strict=True))


def held_out(doc_id: str) -> Column:
    """The share of ids whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
