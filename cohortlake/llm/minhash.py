"""Near-duplicate documents by DartMinHash and banding.

Similarity is the weighted Jaccard similarity of the texts' bags of five-word
shingles (a text of one to four words is one shingle). DartMinHash
(Christiani, 2020): every shingle owns a region of (weight x rank) space; hash
seeded darts fall into it as a Poisson process, so a text only ever looks at
the earliest darts of its shingles, about k ln k of them whatever its weight.
Each dart names a coordinate, and the earliest dart that a text's weights admit
is its signature there; two texts agree on a coordinate with a probability
equal to their similarity.

Plan: one Arrow pass over the texts gives digests, band keys, sketches (a byte of each
coordinate) and shingle bags (a table in the shared folder, by columns). Equal texts
collapse to one representative by a hash aggregate. Every bucket of representatives with
the same band key has a leader, the one that shares buckets with most others, and its
members are compared with it: first by sketches, which rule out pairs that agree on far
fewer coordinates than similar ones do, then by exact similarity of their shingle bags.
A group of n near copies costs about n comparisons, not n * n. Bags stay where they are
unless a pair that is left needs them. What this leaves in different components is
compared as well, so no link is lost: pair by pair in buckets of bounded size, and
in larger groups by blocks, where those outside the largest component meet all
others and each pair of blocks gives a spanning set of its links. Components come
from large-star/small-star.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortlake.llm.common import append_columns, arrow_rows, connected_components, freeze, fresh, map_arrow
from cohortlake.llm.text import SLICE_BYTES, Texts, least_reached, mix64, slices, window_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Bands x rows coordinates. A pair at 0.8 shares no band once in 300,000 times.
BANDS, ROWS = 32, 5
#: Buckets up to this size are compared pair by pair, larger ones in blocks of so many rows.
SMALL_BUCKET, BLOCK_ROWS = 48, 256
#: Members of a leader that one task compares in a run, and block pairs of an Arrow batch.
STAR_ROWS, PAIR_ROWS = 256, 16
#: Standard deviations by which a pair may agree on fewer coordinates than expected at the threshold.
SKETCH_SIGMAS = 8

_SEED = np.uint64(0xD1B54A32D192ED03)


def shingles(t: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, sorted within each text, and their text numbers."""
    starts, ends, docs = t.words()
    words = t.hash_spans(starts, ends)
    at, hashes = window_hashes(words, docs, size)
    counts = np.bincount(docs, minlength=t.n)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    owner = docs[at]
    for n in range(1, size):  # texts of fewer words
        few = np.flatnonzero(counts == n)
        total = np.zeros(len(few), np.uint64)
        for j in range(n):
            total = mix64(total + words[first[few] + j] + _SEED)
        hashes, owner = np.concatenate((hashes, total)), np.concatenate((owner, few))
    order = np.lexsort((hashes, owner))
    return hashes[order], owner[order]


def _step(i: int) -> np.uint64:
    """The i-th of a row of well-spread constants."""
    return np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def dart_signatures(hashes: np.ndarray, owner: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k dart ids for n weighted sets given as (element hash, set, weight > 0) triples.

    An element's region is cut into strips of weight [2**s - 1, 2**(s + 1) - 1).
    In each strip darts arrive along the rank axis with rate 2**s; every property
    of the i-th dart is a hash of (element, strip, i), so all sets that hold the
    element see the same darts, and admit those below their own weight. Ranks are
    looked at up to t / total weight, with t = k ln k + 2 k; sets that still miss a
    coordinate look twice as far. Empty sets get zeros.
    """
    sig = np.zeros((n, k), np.uint64)
    best = np.full(n * k, np.inf)
    total = np.bincount(owner, weights, n)
    reach = np.where(total > 0, (k * np.log(k + 1) + 2 * k) / np.where(total > 0, total, 1), 0.0)
    todo = total > 0
    ids = sig.reshape(-1)
    while todo.any():
        use = np.flatnonzero(todo[owner])
        strip = 0
        while len(use):
            seed = mix64(hashes[use] + _step(strip + 1))
            _throw(seed, owner[use], weights[use], float(2**strip), 2.0**strip - 1, reach, best, ids, k)
            strip += 1
            use = use[weights[use] > 2.0**strip - 1]
        todo &= np.isinf(best).reshape(n, k).any(1)
        reach[todo] *= 2
    return sig


def _throw(seed, owner, weight, width, low, reach, best, ids, k) -> None:
    """The darts of one strip of many elements, in order of arrival, until each is past its set's reach."""
    rank = np.zeros(len(seed))
    throw = 0
    while len(seed):
        throw += 1
        dart = mix64(seed ^ _step(throw))
        rank = rank - np.log(_unit(dart)) / width
        on = rank < reach[owner]
        if not on.all():
            seed, owner, weight, rank, dart = seed[on], owner[on], weight[on], rank[on], dart[on]
        height = mix64(dart ^ _SEED)
        hit = low + width * _unit(height) <= weight
        slot = owner[hit] * k + (mix64(height + _SEED) % np.uint64(k)).astype(np.int64)[hit]
        ranks = rank[hit]
        np.minimum.at(best, slot, ranks)
        earliest = best[slot] == ranks
        ids[slot[earliest]] = dart[hit][earliest]


def bag(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted shingles with repeats as (hash, set, weight): the weight is the number of repeats."""
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return hashes[at], owner[at], np.diff(np.concatenate((at, [len(hashes)]))).astype(np.float64)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sig), bands), np.uint64)
    for j in range(rows):
        keys = mix64(keys + sig.reshape(len(sig), bands, rows)[:, :, j] + _SEED)
    return mix64(keys + np.arange(1, bands + 1, dtype=np.uint64)[None, :])


def least_agreement(k: int, threshold: float = THRESHOLD) -> int:
    """Coordinates of k, compared by a byte, that a pair at the threshold agrees on but for a chance below 1e-12 (k = 160)."""
    p = threshold + (1 - threshold) / 256
    return max(0, int(k * p - SKETCH_SIGMAS * (k * p * (1 - p)) ** 0.5))


def packed_bags(hashes: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Each text's shingles, sorted by 64-bit hash, as sorted 32-bit ones.

    The i-th repeat of a shingle has a hash of its own, so that the bag is a set and
    its Jaccard similarity is the weighted one. Of two bags of 1,000 shingles one in
    4,000 pairs has a chance agreement, which moves their similarity by a thousandth.
    """
    run = np.arange(len(hashes))
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))[: len(run)]
    repeat = (run - np.maximum.accumulate(np.where(new, run, 0))).astype(np.uint64)
    key = np.sort(mix64(hashes + repeat * _SEED) >> np.uint64(32) | owner.astype(np.uint64) << np.uint64(32))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))) * 4
    data = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(key.astype(np.uint32).tobytes())]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, data).cast(pa.binary())


def _signature_columns(bands: int, rows: int):
    def columns(texts: pa.Array) -> list[pa.Array]:
        keys, sizes, bags, bits = [], [], [], []
        for _, t in slices(texts, SLICE_BYTES):
            hashes, owner = shingles(t)
            sizes.append(np.bincount(owner, minlength=t.n))
            bags.append(packed_bags(hashes, owner, t.n))
            sig = dart_signatures(*bag(hashes, owner), t.n, bands * rows)
            keys.append((band_keys(sig, bands, rows) >> np.uint64(32)).astype(np.uint32))
            bits.append(sig.astype(np.uint8))
        size = np.concatenate(sizes)
        flat = np.concatenate(keys).view(np.int32)
        offsets = np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0)))).astype(np.int32)
        sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bands * rows), len(size), [None, pa.py_buffer(np.concatenate(bits).tobytes())])
        return [pa.array(size), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[size > 0].reshape(-1))), sketch.cast(pa.binary()), pa.concat_arrays(bags)]

    return columns


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, node, key, digest, n_shingles, bands, sketch, bag) of every (doc_id, text) row; no shuffle.

    ``node`` is a row number, fixed once the table is written; ``key`` is doc_id and
    text digest. ``digest`` is the text's MD5, null for a null text. ``bands`` has 32
    bits of each band's key, and is empty for texts without a word. A chance agreement of
    different keys costs a comparison, no more.
    """
    docs = docs.withColumn("digest", F.unhex(F.md5("text"))).withColumn("key", _key("doc_id", "text"))
    docs = docs.withColumn("node", F.monotonically_increasing_id())
    fields = [("n_shingles", T.LongType()), ("bands", T.ArrayType(T.IntegerType())), ("sketch", T.BinaryType()), ("bag", T.BinaryType())]
    out, _ = append_columns(docs, "text", _signature_columns(bands, rows), fields)
    return out.drop("text")


def similar(one: np.ndarray, many: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the bags that lie on end in ``many`` reach the threshold with the bag ``one``; an empty bag is like none."""
    if not len(one):
        return np.zeros(len(sizes), bool)
    at = np.searchsorted(one, many)
    at[at == len(one)] = 0
    hits = np.concatenate(([0], np.cumsum(one[at] == many)))
    ends = np.cumsum(sizes)
    both = hits[ends] - hits[ends - sizes]
    return both >= threshold * (len(one) + sizes - both) - 1e-9


_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of bags: all hashes on end, and the bags' sizes."""
    sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32), sizes


@contextmanager
def _bloom_joins(spark: SparkSession) -> Iterator[None]:
    """Joins that run within are by shuffle at any size, behind Spark's Bloom filter of the side that has a condition."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": str(1 << 50),
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _with(sig: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``rows``, written, with columns of ``sig`` by node, for use in ``_bloom_joins``: of ``sig`` hardly more than the wanted rows is shuffled.

    Spark makes its filter of a side that has a condition, so ``rows`` get one, on a column that ``sig`` has not.
    """
    rows = freeze(rows.withColumn("wanted", F.lit(1)))
    return rows.where("wanted = 1").drop("wanted").join(sig.select("node", *columns), "node")


def _likely_pairs(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sketches agree as those of similar texts do; ``nodes``: (node, sketch, ...), a row for each."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}"))

    def agree(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            keep = (one == two).sum(1) >= least_agreement(one.shape[1], threshold)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b"), agree, _EDGE)


def _similar_pairs(pairs: DataFrame, sig: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose bags are at least ``threshold`` similar, as a written table.

    Bags of a travel to their leaders b; a partition streams a leader's bag, then
    those of its members, so a leader of any size needs one bag and one batch of
    memory. A leader with many members has several runs, by a salt.
    """
    runs = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("runs"))
    member = pairs.join(runs, "b").select("b", F.pmod(F.xxhash64("a"), "runs").cast("int").alias("run"), "a", F.col("a").alias("node"))
    leader = runs.select("b", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(None).cast("long").alias("a"), F.col("b").alias("node"))
    rows = _with(sig, member.unionByName(leader), "bag").select("b", "run", "a", "bag")  # each bag is shuffled once to meet its pairs
    rows = rows.repartition("b", "run").sortWithinPartitions("b", "run", F.asc_nulls_first("a"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag: dict[int, list] = {}
        for batch in batches:
            b, a = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True])))
            found_a, found_b = [], []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                lead = [k for k in range(i, j) if not a[k].is_valid] if a.null_count else []
                if lead:  # of rows with the same id, each text counts
                    if b[i] not in bag or bag[b[i]][0] is not None:
                        bag = {b[i]: [None, []]}
                    bag[b[i]][1] += [np.frombuffer(batch.column(3)[k].as_py(), np.uint32) for k in lead]
                keep = pa.array([k for k in range(i, j) if k not in set(lead)], pa.int64())
                if not len(keep):
                    continue
                bag[b[i]][0] = True
                many, sizes = _read(batch.column(3).take(keep))
                ids = a.take(keep).to_numpy(zero_copy_only=False)
                hit = np.zeros(len(ids), bool)
                for one in bag[b[i]][1]:
                    hit |= similar(one, many, sizes, threshold)
                found_a += ids[hit].tolist()
                found_b += [int(b[i])] * int(hit.sum())
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    with _bloom_joins(pairs.sparkSession):
        return freeze(rows.mapInArrow(each, _EDGE))


def _block_links(members: DataFrame, sig: DataFrame, threshold: float) -> DataFrame:
    """Spanning links (a, b) between components of each group; members: (node, n, grp, component).

    A block is up to BLOCK_ROWS members of a group, either of its largest component
    or not; blocks of the latter kind meet all blocks of the group.
    """
    per = members.groupBy("grp", "component").agg(F.count("*").alias("n"))
    main = per.groupBy("grp").agg(F.max(F.struct("n", "component")).alias("top"), F.ceil(F.sum("n") / (4 * BLOCK_ROWS)).cast("int").alias("parts"))
    rows = members.join(main, "grp").withColumn("stray", F.col("component") != F.col("top.component"))
    rows = _with(sig, rows, "bag").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).repartition("grp", "part").sortWithinPartitions("grp", "part", "stray", "node")
    rows = rows.select("grp", "part", "stray", "node", "component", "bag")
    schema = "block long, grp long, stray boolean, nodes binary, components binary, sizes binary, bags binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, key, held = TaskContext.get().partitionId() << 40, None, []

        def block() -> pa.RecordBatch:
            data = [np.array(x, np.int64).tobytes() for x in ([h[0] for h in held], [h[1] for h in held], [len(h[2]) // 4 for h in held])]
            values = [number, key[0], key[2], *data, b"".join(h[2] for h in held)]
            types = [pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["block", "grp", "stray", "nodes", "components", "sizes", "bags"])

        for batch in batches:
            for *now, node, component, bag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (now != key or len(held) == BLOCK_ROWS):
                    yield block()
                    number, held = number + 1, []
                key = now
                held.append((node, component, bag))
        if held:
            yield block()

    with _bloom_joins(members.sparkSession):
        blocks = freeze(rows.mapInArrow(cut, schema))
    a = blocks.where("stray").select(F.col("block").alias("a_block"), "grp")
    b = blocks.select(F.col("block").alias("b_block"), "grp", F.col("stray").alias("both"))
    pairs = freeze(a.join(b, "grp").where("NOT both OR a_block <= b_block").select("a_block", "b_block"))
    side = lambda x: blocks.select(*(F.col(k).alias(f"{x}_{k}") for k in ("block", "nodes", "components", "sizes", "bags")))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (nodes, comps, sizes, bags_a), (others, comps_b, sizes_b, bags_b) = (
                    [np.frombuffer(row[f"{x}_{k}"], np.uint32 if k == "bags" else np.int64) for k in ("nodes", "components", "sizes", "bags")] for x in "ab"
                )
                ends, r, c = np.cumsum(sizes), [], []
                owner = np.repeat(np.arange(len(others)), sizes_b)
                for i in range(len(nodes)):
                    near = (comps_b != comps[i]) & (np.minimum(sizes[i], sizes_b) >= threshold * np.maximum(sizes[i], sizes_b))
                    if near.any():
                        to = np.flatnonzero(near)
                        hit = to[similar(bags_a[ends[i] - sizes[i] : ends[i]], bags_b[near[owner]], sizes_b[to], threshold)]
                        r += [i] * len(hit)
                        c += hit.tolist()
                every = np.concatenate((nodes, others))
                root = least_reached(len(every), np.array(r, int), np.array(c, int) + len(nodes))
                span = np.flatnonzero(root != np.arange(len(every)))
                yield pa.RecordBatch.from_arrays([pa.array(every[span]), pa.array(every[root[span]])], names=["a", "b"])

    with arrow_rows(members.sparkSession, PAIR_ROWS):
        return freeze(pairs.join(side("a"), "a_block").join(side("b"), "b_block").mapInArrow(join, _EDGE))


def near_links(sig: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges (a, b) that connect every class of nodes: equal texts, similar texts that share a band, rows with equal id and null text.

    ``sig`` is the written table of ``signatures``. No text is shuffled; of the bags
    go those of pairs that share a bucket and have sketches alike.
    """
    # a table: the join then has an exchange of its own, and AQE splits a digest of very many copies
    copies = sig.withColumn("digest", F.coalesce("digest", F.col("key").cast("binary")))
    same = freeze(copies.groupBy("digest").agg(F.min("node").alias("rep")))
    exact = copies.join(same, "digest").select(F.col("node").alias("a"), F.col("rep").alias("b")).where("a <> b")
    # one row of each text; band entries, which are most of the rows, are shuffled once, and a key's are counted as they stream by
    reps = sig.join(same.select(F.col("rep").alias("node")).hint("merge"), "node", "left_semi")
    entries = reps.select("node", F.posexplode("bands").alias("band", "key")).select("node", (F.col("band") * F.lit(1 << 32) + F.col("key")).alias("key"))
    entries = entries.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1")
    entries = freeze(entries)
    degrees = entries.groupBy("node").agg(F.sum(F.col("size") - 1).alias("degree"))
    with _bloom_joins(sig.sparkSession):
        nodes = freeze(_with(sig.withColumnRenamed("n_shingles", "n"), degrees, "n", "sketch"))
    entries = freeze(entries.join(nodes.select("node", "degree", "n"), "node"))

    def fits(a: str, b: str) -> Column:  # sizes alone rule most pairs out
        return F.least(a, b) >= threshold * F.greatest(a, b)

    # every member with the member that shares buckets with most others
    best = F.max(F.struct("degree", -F.col("node"), "n"))
    leaders = entries.groupBy("key").agg(best.alias("top")).select("key", (-F.col("top.col2")).alias("b"), F.col("top.n").alias("nb"))
    pairs = entries.join(leaders, "key").where((F.col("node") != F.col("b")) & fits("n", "nb")).select(F.col("node").alias("a"), "b").distinct()
    pairs = freeze(_likely_pairs(pairs, nodes, threshold))
    links = exact.unionByName(_similar_pairs(pairs, sig, threshold))

    # the rest: pairs of different components, by pairs in small buckets and by blocks in large groups
    comps = freeze(connected_components(links))
    links = comps.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
    placed = entries.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    placed = freeze(placed.join(open_, "key"))
    small = placed.where(F.col("size") <= SMALL_BUCKET)
    left = small.select("key", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "component")))
    right = small.select("key", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "component")))
    both = left.join(right, "key").where((F.col("node_a") > F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & fits("n_a", "n_b"))
    pairs = both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    pairs = freeze(_likely_pairs(pairs, nodes, threshold))
    links = links.unionByName(_similar_pairs(pairs, sig, threshold))

    large = placed.where(F.col("size") > SMALL_BUCKET)
    if not large.isEmpty():
        groups = connected_components(large.join(large.groupBy("key").agg(F.min("node").alias("first")), "key"), "node", "first")
        members = large.select("node", "n", "component").distinct().join(groups.withColumnRenamed("component", "grp"), "node")
        links = links.unionByName(_block_links(freeze(members), sig, threshold))
    return links


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of all rows of ``docs`` (doc_id, text) and of all classes.

    Rows: doc_id, node, key, component. Classes: component, n_members, and the
    doc_id and node of the row that is kept, the least doc_id's (nulls come last).
    """
    sig = freeze(signatures(docs))
    comps = connected_components(near_links(sig))
    rows = sig.select("doc_id", "node", "key").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = freeze(rows)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))
    classes = rows.groupBy("component").agg(F.count("*").alias("n_members"), first.alias("first"))
    return rows, freeze(classes.select("component", "n_members", F.col("first.doc_id").alias("component_id"), F.col("first.node").alias("first")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id, n_members, kept, node, n_rows): the near-duplicate class of every document.

    One row for each doc_id and class; a doc_id has several classes if its rows have
    different texts, which are documents of their own. component_id is the least
    doc_id of the class (null if all are null), n_members its number of rows, kept
    marks the one document that stays, n_rows counts the document's rows, and node is
    a number of the first of them. Texts are linked when equal, or at a similarity of
    0.8 or more. Empty texts equal one another; null texts link with those of the same
    doc_id only, and texts without a word only when equal. An empty table gives an
    empty result. Other columns of ``docs`` are not looked at.
    """
    rows, classes = _classes(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    rows = freeze(rows.groupBy("doc_id", "component").agg(F.count("*").alias("n_rows"), F.min("node").alias("node")))
    kept = F.col("node") == F.col("first")
    return rows.join(classes, "component").select("doc_id", "component_id", "n_members", kept.alias("kept"), "node", "n_rows")


def _key(doc_id: str, text: str) -> Column:
    """A document: its id (empty for null) and its text's digest (empty for null)."""
    return F.concat(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.col(text)), F.lit("")))


def without_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate class of ``near_duplicates``, all columns.

    The texts are joined with the documents (id and digest) that go, which are a small side unless most rows are copies.
    """
    key = fresh(docs.columns, "key")
    rows, classes = _classes(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    own = rows.groupBy(F.col("key").alias(key)).agg(F.min("node").alias("first"), F.count("*").alias("n_rows"))
    own = freeze(own.join(classes.select("first", F.lit(True).alias("kept")), "first", "left"))
    repeated, go = own.where("kept AND n_rows > 1").select(key), own.where("kept IS NULL").select(key)
    keyed = docs.withColumn(key, _key(doc_id, text))
    out = keyed.join(go, key, "left_anti")
    if not repeated.isEmpty():
        out = out.join(repeated, key, "left_anti").unionByName(keyed.join(repeated, key, "left_semi").dropDuplicates([key]))
    return out.drop(key)
