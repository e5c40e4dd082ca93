"""A Merkle manifest of a dataset, and proofs of its rows by Octopus multiproofs.

Every row is a leaf: the SHA-256 of its fields, each ``-`` if null, else its UTF-8
length, a colon and the value. In each group (``lang``, say) the leaves stand in id
order under nodes of eight; a node is the SHA-256 of its children's hex digests on
end. The groups' tops stand in group order under a tree of the same kind, whose
top is the root of the dataset.

Proofs are made for many rows at a time (Octopus multiproof): the wanted leaves of a
partition know their places, walk up together and collect the least set of
coordinates (level, place) that none of them can derive. That set is fetched once,
by an equi-join with the node table; the partition then derives all shared interior
nodes, and expands each row's own proof locally.

Scale: texts are hashed in the scan, only digests move. Places come from a range
exchange with prefix sums, so a hot group is spread over all tasks. A partition is
an aligned run of CHUNK leaves of a group, which is also its own subtree; a task
holds one at a time. The tree above is a CHUNK-th of the leaves and is built level
by level with groupBy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import freeze, fresh, null_safe, ranked, union_all

#: Fixed by the contract: children of a node.
FAN = 8
#: Leaves of a partition: a power of FAN, so that a partition is a whole subtree.
CHUNK_LEVELS = 4
CHUNK = FAN**CHUNK_LEVELS
#: The number of the tree over the groups' tops; groups are numbered from 0.
TOP = -1


def leaf(fields: list[Column]) -> Column:
    """The leaf digest (hex) of a row's fields, each as a length-prefixed text, ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Manifest:
    """The tables of a tree. Digests are binary; a place is a node's number in its level.

    ``leaves``: the rows given with ``tree``, ``place`` and ``digest``. ``nodes``: (tree, level, place, digest)
    of all levels, the leaves too; the tree TOP has the groups' tops as its level 0. ``trees``: (tree, group, n)
    with the number of leaves. ``names``: what tree, place and digest are called in ``leaves``.
    """

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    names: dict[str, str]
    root: str | None


def _hash(digests: list[bytes]) -> bytes:
    return sha256("".join([d.hex() for d in digests]).encode()).digest()


def _subtree(digests: list[bytes], levels: int) -> list[list[bytes]]:
    """The levels above aligned leaves, up to ``levels`` of them."""
    out = []
    for _ in range(levels):
        digests = [_hash(digests[i : i + FAN]) for i in range(0, len(digests), FAN)]
        out.append(digests)
    return out


def depth(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _chunk_nodes(batch: pa.Table) -> pa.Table:
    """The nodes that a chunk's leaves have above them, within the chunk."""
    order = np.argsort(batch["place"].to_numpy())
    places, digests = batch["place"].to_numpy()[order], batch["digest"].combine_chunks().take(pa.array(order)).to_pylist()
    tree, n = batch["tree"][0].as_py(), batch["n"][0].as_py()
    levels = _subtree(digests, min(depth(n), CHUNK_LEVELS))
    rows = [(level, int(places[0]) // FAN**level + i, d) for level, own in enumerate(levels, 1) for i, d in enumerate(own)]
    level, place, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"tree": pa.array([tree] * len(rows), pa.int64()), "level": pa.array(level, pa.int32()), "place": pa.array(place, pa.int64()), "digest": pa.array(digest, pa.binary())})


_NODE = "tree long, level int, place long, digest binary"


def _above(nodes: DataFrame) -> DataFrame:
    """The nodes one level above: (tree, level, place, digest, n) of trees with more than one node."""
    many = nodes.where("n > 1").withColumn("up", F.expr(f"div(place, {FAN}L)"))
    run = F.array_sort(F.collect_list(F.struct("place", F.lower(F.hex("digest")).alias("h"))))  # FAN at most
    up = many.groupBy("tree", "up").agg(F.max("level").alias("level"), F.max("n").alias("n"), run.alias("run"))
    digest = F.unhex(F.sha2(F.array_join(F.transform("run", lambda r: r["h"]), ""), 256))
    return up.select("tree", (F.col("level") + 1).cast("int").alias("level"), F.col("up").alias("place"), digest.alias("digest"), F.expr(f"div(n + {FAN - 1}L, {FAN}L)").alias("n"))


def _grown(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, level, place, digest, n), written, until every tree has one node; ``most``: of the largest."""
    out = []
    while most > 1:
        nodes, most = freeze(_above(nodes)), -(-most // FAN)
        out.append(nodes)
    return out


def build(rows: DataFrame, group: str, order: str, digest: str) -> Manifest:
    """The manifest of ``rows`` with their leaf digests (hex), one tree for each value of ``group``.

    A null group is a group, the first. Leaves stand in ``order``, a null first; rows
    that are equal there stand by digest. Extra columns stay with the leaves; names
    that clash get underscores in front. An empty table has no root.
    """
    names: dict[str, str] = {}
    for name in ("tree", "place", "bytes", "mark", "n_leaves"):
        names[name] = fresh([*rows.columns, *names.values()], name)
    tree, place, binary = names["tree"], names["place"], names["bytes"]
    rows = freeze(rows.withColumn(binary, F.unhex(digest)).withColumn(names["mark"], F.monotonically_increasing_id()))
    found = rows.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"))
    trees = freeze(ranked(found.withColumn("all", F.lit(0)), ["all"], ["group"], {}, "tree").select("tree", "group", "n"))

    mine = fresh([*rows.columns, tree], "own")
    side = trees.select(F.col("tree").alias(tree), F.col("group").alias(mine), F.col("n").alias(names["n_leaves"]))
    placed = rows.join(side, null_safe([group], [mine])).drop(mine)
    # a mark tells equal rows apart, so that many copies of a row are spread over tasks as well
    leaves = freeze(ranked(placed, [tree], [order, binary, names["mark"]], {}, place).drop(names["mark"]))
    level0 = leaves.select(F.col(tree).alias("tree"), F.col(place).alias("place"), F.col(binary).alias("digest"), F.col(names["n_leaves"]).alias("n"))
    chunked = level0.withColumn("chunk", F.expr(f"div(place, {CHUNK}L)"))
    inner = freeze(chunked.groupBy("tree", "chunk").applyInArrow(_chunk_nodes, _NODE))
    sizes = trees.select("tree", "n")
    most = trees.agg(F.max("n")).first()[0] or 0
    # the chunks' own tops, from which the rest grows
    high = inner.where(f"level = {CHUNK_LEVELS}").join(sizes.where(f"n > {CHUNK}"), "tree")
    upper = _grown(high.withColumn("n", F.expr(f"div(n + {CHUNK - 1}L, {CHUNK}L)")), -(-most // CHUNK))
    nodes = union_all([level0.select("tree", F.lit(0).alias("level"), "place", "digest"), *(d.select("tree", "level", "place", "digest") for d in (inner, *upper))])
    nodes = nodes.where(f"tree <> {TOP}")

    last = F.max_by("digest", "level")  # a tree's top is its only node of the highest level
    tops = freeze(nodes.where("place = 0").groupBy("tree").agg(last.alias("digest"), F.max("level").alias("level")))
    n_trees = tops.count()
    ground = tops.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("place"), "digest", F.lit(n_trees).cast("long").alias("n"))
    levels = [ground, *_grown(ground, n_trees)]
    root = levels[-1].first()["digest"].hex() if n_trees else None
    nodes = union_all([nodes, *(d.select("tree", "level", "place", "digest") for d in levels)])
    summit = fresh([*leaves.columns], "top")
    return Manifest(leaves, nodes, trees.join(tops.select("tree", F.col("digest").alias(summit)), "tree"), {"tree": tree, "place": place, "digest": binary, "n": names["n_leaves"], "top": summit}, root)


def missing(places: np.ndarray, n: int) -> list[np.ndarray]:
    """For each level of a tree of n leaves, the places of the nodes that the given leaves need and cannot derive."""
    own, out = np.unique(places), []
    while n > 1:
        runs = np.unique(own // FAN)
        full = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        out.append(np.setdiff1d(full[full < n], own, assume_unique=True))
        own, n = runs, -(-n // FAN)
    return out


def _coordinates(n_trees: int):
    """The multiproof coordinates of a chunk's wanted leaves, from the leaf's tree to the tree over all."""

    def each(batch: pa.Table) -> pa.Table:
        tree, chunk, n = (batch[c][0].as_py() for c in ("tree", "chunk", "n"))
        levels = [(tree, i, p) for i, p in enumerate(missing(batch["place"].to_numpy(), n))]
        levels += [(TOP, i, p) for i, p in enumerate(missing(np.array([tree]), n_trees))]
        size = sum(len(p) for *_, p in levels)
        column = lambda values, kind: pa.array(np.concatenate([*values, np.zeros(0, np.int64)]), kind)
        return pa.table({
            "of": pa.array(np.full(size, tree), pa.int64()), "chunk": pa.array(np.full(size, chunk), pa.int64()),
            "tree": column([np.full(len(p), t) for t, _, p in levels], pa.int64()),
            "level": column([np.full(len(p), i) for _, i, p in levels], pa.int64()).cast(pa.int32()), "place": column([p for *_, p in levels], pa.int64()),
        })

    return each


def _expand(n_trees: int, keep: list[str], fields: pa.Schema, with_siblings: bool):
    """Each wanted leaf's proof and fold, from a chunk's leaves and the nodes fetched for it."""

    def each(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        if not leaves.num_rows:
            return fields.empty_table()
        tree, n = leaves["tree"][0].as_py(), leaves["n"][0].as_py()
        known = dict(zip(zip(*(fetched[c].to_pylist() for c in ("tree", "level", "place")), strict=True), (d.hex() for d in fetched["digest"].to_pylist()), strict=True))
        places, digests, claims = (leaves[c].to_pylist() for c in ("place", "digest", "claim"))
        # all interior nodes on the way up, once for all leaves of the chunk
        own = {p: d.hex() for p, d in zip(places, digests, strict=True)}
        steps: list[dict[int, tuple[str, str, str]]] = []  # of a level: place -> (hex before, hex after, both)
        tops: list[str] = []
        for at, count in ((tree, n), (TOP, n_trees)):
            if at == TOP:
                own = {tree: next(iter(own.values()))}
            level = 0
            while count > 1:
                step, up = {}, {}
                for run in {p // FAN for p in own}:
                    places_of = range(run * FAN, min(run * FAN + FAN, count))
                    nodes = [own[p] if p in own else known[at, level, p] for p in places_of]
                    up[run] = sha256("".join(nodes).encode()).hexdigest()
                    for i, p in enumerate(places_of):
                        if p in own:
                            before, after = "".join(nodes[:i]), "".join(nodes[i + 1 :])
                            step[p] = (before, after, before + after)
                steps.append(step)
                own, count, level = up, -(-count // FAN), level + 1
            tops.append(own[0])
        in_tree = depth(n)
        proofs, folds, siblings = [], [], []
        for place, claim in zip(places, claims, strict=True):
            fold, p, parts = claim.hex(), place, []
            for i, step in enumerate(steps):
                if i == in_tree:
                    p = tree
                before, after, both = step[p]
                parts.append(both)
                fold = sha256((before + fold + after).encode()).hexdigest()
                p //= FAN
            whole = "".join(parts)
            proofs.append(sha256(whole.encode()).hexdigest())
            folds.append(fold)
            if with_siblings:
                siblings.append(bytes.fromhex(whole))
        extra = [pa.array(siblings, pa.binary())] if with_siblings else []
        return pa.Table.from_arrays([*(leaves[c].combine_chunks() for c in keep), *(pa.array([t] * len(proofs)) for t in tops), pa.array(proofs), pa.array(folds), *extra], schema=fields)

    return each


def prove(tree: Manifest, wanted: DataFrame | None = None, claim: str | None = None, with_siblings: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """The rows of ``wanted`` (some or all of ``tree.leaves``) with their proofs; the new columns' names.

    ``subroot`` and ``root`` are the tops that the partition derives;
    ``proof_sha256`` is the digest of the proof's sibling digests on end, from the
    leaf up, and ``siblings`` (``with_siblings``) these digests as bytes; ``folded_root`` is what the leaf digest
    in the column ``claim`` (hex; the row's own where none is named) and the siblings
    fold to. All digests but ``siblings`` are hex. An empty table gives an empty result.
    """
    # with all leaves at hand, partitions derive all nodes within: only those above are fetched
    nodes = tree.nodes.where(f"level >= {CHUNK_LEVELS} OR tree = {TOP}") if wanted is None else tree.nodes
    wanted = tree.leaves if wanted is None else wanted
    at, place, digest, n = (tree.names[k] for k in ("tree", "place", "digest", "n"))
    base = [c for c in wanted.columns if c not in (at, place, digest, n)]
    names = {}
    for name in ("subroot", "root", "proof_sha256", "folded_root", *(["siblings"] if with_siblings else [])):
        names[name] = fresh([*wanted.columns, *names.values()], name)
    n_trees = tree.trees.count()
    # the operator's own columns under plain names, the others numbered
    keep = [f"c{i}" for i in range(len(base))]
    own = [F.col(at).alias("tree"), F.col(place).alias("place"), F.col(digest).alias("digest"), F.col(n).alias("n"), (F.unhex(claim) if claim else F.col(digest)).alias("claim")]
    rows = wanted.select(*own, *(F.col(c).alias(k) for c, k in zip(base, keep, strict=True))).withColumn("chunk", F.expr(f"div(place, {CHUNK}L)"))
    spots = rows.select("tree", "chunk", "place", "n").groupBy("tree", "chunk").applyInArrow(_coordinates(n_trees), "of long, chunk long, tree long, level int, place long")
    fetched = freeze(spots).join(nodes, ["tree", "level", "place"]).select("of", "chunk", "tree", "level", "place", "digest")
    from pyspark.sql.pandas.types import to_arrow_schema

    out = rows.select(*keep, *(F.lit("").alias(c) for c in ("subroot", "root", "proof", "fold")), *([F.lit(b"").alias("siblings")] if with_siblings else [])).schema
    fields = to_arrow_schema(out)
    work = _expand(n_trees, keep, fields, with_siblings)
    done = rows.groupBy("tree", "chunk").cogroup(fetched.groupBy("of", "chunk")).applyInArrow(work, out)
    return done.toDF(*base, *names.values()), names
