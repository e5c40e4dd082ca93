"""Mixing sources to target weights.

Tokens are summed for each source; a budget is dealt to the sources by weight,
none getting more than ``most`` times its own tokens, and what a full source
cannot take goes to the others by weight until none is above (water filling). A
source's repetition rate is its target over its size. Every document is emitted
floor(rate) times plus one copy more with the fraction's probability, by a seeded
hash of the document: a rerun takes the same copies, whatever the partitions.

Only DataFrame functions. One narrow pass counts words and draws the numbers;
a groupBy with map-side combine gives a row for each source. Water
filling never puts all sources into one window: they are ranked by how soon they
fill, with prefix sums over range partitions, and the level is a scalar. Documents
meet their source's row in a join whose small side Spark broadcasts by its
measured size, or else shuffles with AQE splitting a hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import freeze, fresh, ranked

#: Fixed by the contract: weights in source order, the budget and a target's limit as multiples of sizes.
WEIGHTS, BUDGET, MOST = (5, 2, 1), 1.5, 2
SEED = 20240
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: list[str], seed: int) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed and key columns; nulls are values."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in key]
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), *parts)), 1, 13), 16, 10).cast("double") / 2.0**52


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, size, weight): the weights in turn over the sources by code point, null last."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    last = F.col("source").isNull().alias("none")
    numbered = ranked(sources.select("source", "size", last, F.lit(0).alias("all")), ["all"], ["none", "source"], {}, "place")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    return numbered.select("source", "size", weight.cast("long").alias("weight"))


def targets(sources: DataFrame, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, size, target) from (source, size, weight): ``budget`` times all sizes by weight, at most ``most`` times a source's size.

    The level at which the budget is used up is found from the order in which
    sources fill: after the k that fill first, the rest share what is left. A
    budget beyond all limits fills every source.
    """
    if not 0 <= budget < float("inf") or most < 0:
        raise ValueError("budget and most must be finite and not negative")
    sources = freeze(sources.withColumn("fill", F.col("size") / F.col("weight")).withColumn("all", F.lit(0)))
    size, weight = sources.agg(F.sum("size"), F.sum("weight")).first()
    if size is None:
        return sources.select("source", "size", F.lit(0.0).alias("target"))
    order = ranked(sources, ["all"], ["fill", "size", "source"], {"size_before": "size", "weight_before": "weight"})
    rest = F.lit(float(budget * size)) - most * F.col("size_before")  # exact up to 2 ** 53 tokens
    left = F.lit(weight) - F.col("weight_before")
    fits = F.col("weight") * rest <= most * F.col("size") * left
    level = order.where(fits).agg(F.min(F.struct("fill", "size_before", "weight_before")).alias("at")).first()["at"]
    limit = (most * F.col("size")).cast("double")
    if level is None:
        return sources.select("source", "size", limit.alias("target"))
    over, under = float(budget * size - most * level["size_before"]), weight - level["weight_before"]
    target = F.when(F.col("fill") < level["fill"], limit).otherwise(F.least(limit, F.col("weight") * F.lit(over) / F.lit(float(under))))
    return sources.select("source", "size", target.alias("target"))


def measured(docs: DataFrame, text: str = "text", key: tuple[str, ...] = ("doc_id", "text"), seed: int = SEED) -> tuple[DataFrame, str, str]:
    """``docs`` with each row's words and its number in [0, 1), a narrow step; the names of these columns.

    Rows equal in all ``key`` columns draw the same number. A null or blank text has no words.
    """
    size = fresh(docs.columns, "size")
    number = fresh([*docs.columns, size], "number")
    return docs.withColumn(size, n_words(text)).withColumn(number, draw(list(key), seed)), size, number


def mixture(
    docs: DataFrame, source: str = "source", size: str = "size", number: str = "number",
    weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST,
) -> tuple[DataFrame, dict[str, str]]:
    """All rows and columns of ``docs`` with source_size, target and copies; the new columns' names.

    ``size`` and ``number`` are the columns that :func:`measured` adds; ``docs`` is
    read twice, so write it first where it is dear. A row of size 0 has copies as
    any other; a source without words has target and copies 0. Null sources are one
    source, the last. New names that clash get underscores in front. An empty
    table gives an empty result.
    """
    names: dict[str, str] = {}
    for name in ("source_size", "target", "copies", "of"):
        names[name] = fresh([*docs.columns, *names.values()], name)
    of = names.pop("of")
    per_source = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("size"))
    dealt = targets(weighted(freeze(per_source), weights), budget, most)
    dealt = freeze(dealt.select(F.col("source").alias(of), F.col("size").alias(names["source_size"]), F.col("target").alias(names["target"])))
    met = docs.join(dealt, F.col(source).eqNullSafe(F.col(of))).drop(of)
    rate = F.col(names["target"]) / F.nullif(F.col(names["source_size"]), F.lit(0))
    copies = F.floor(rate) + (F.col(number) < rate - F.floor(rate)).cast("long")
    return met.withColumn(names["copies"], F.coalesce(copies, F.lit(0).cast("long"))), names


def emitted(mixed: DataFrame, copies: str = "copies") -> tuple[DataFrame, str]:
    """Each row ``copies`` times, and the name of the column that numbers a row's copies from 1; rows of 0 copies go."""
    name = fresh(mixed.columns, "copy")
    some = mixed.where(F.col(copies) > 0)
    return some.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))), name
