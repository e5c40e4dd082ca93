"""Quality by weak supervision.

Rules look at word, line and symbol statistics of a whole text and vote good,
bad, or abstain. A generative label model (accuracies of every rule for good
documents and for each cause of bad ones, and class priors) is fitted by
expectation-maximisation on how often each vote pattern occurs, counted over
all documents; a document is kept when its
posterior probability of being good reaches a half. No rule rejects alone,
except the two base rules of the contract.

Scale: one pass over the texts (numpy in Arrow batches), then a groupBy over at
most 3 ** len(RULES) vote patterns with map-side combine; only those pattern
counts reach the driver, and only they are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import append_columns, freeze, fresh
from cohortlake.llm.text import Texts, slices, window_hashes

#: Statistics of one text, all long.
STATS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_bangs", "n_plain_words", "n_echo_words", "n_symbol_words",
]

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PCT = 20, 30

_flags = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
IS_SYMBOL = _flags(b"#*$%&|<>")
IS_BANG = _flags(b"!")
IS_UPPER = _flags(bytes(range(0x41, 0x5B)))
#: ASCII letters, and the lead bytes of all longer characters.
IS_LETTER = _flags(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]))
IS_LEAD = ~_flags(bytes(range(0x80, 0xC0)))


def _repeats(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: whether an equal key stands in the same text, and whether one stands earlier."""
    order = np.lexsort((keys, docs))  # stable: equal keys stay in reading order
    same = (keys[order][1:] == keys[order][:-1]) & (docs[order][1:] == docs[order][:-1])
    any_, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, earlier


def text_stats(t: Texts) -> list[np.ndarray]:
    """The STATS of every text, in that order."""
    n = t.n
    count = lambda docs, weights=None: np.bincount(docs, weights, n).astype(np.int64)
    starts, ends, docs = t.words()
    words = t.hash_spans(starts, ends)
    sums = lambda table: np.concatenate(([0], np.cumsum(table[t.data], dtype=np.int64)))
    lead, letters, symbols = sums(IS_LEAD), sums(IS_LETTER), sums(IS_SYMBOL)
    in_words = lead[ends] - lead[starts]
    plain = letters[ends] > letters[starts]

    at, hashes = window_hashes(words, docs, WINDOW)
    found, _ = _repeats(hashes, docs[at])
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[found], 1)
    np.add.at(cover, at[found] + WINDOW, -1)
    repeat = np.cumsum(cover[:-1]) > 0

    from_, to, line_docs = t.lines()
    word_at = np.searchsorted(starts, from_)
    with_word = word_at < len(starts)
    with_word[with_word] = starts[word_at[with_word]] < to[with_word]
    from_, to, line_docs = from_[with_word], to[with_word], line_docs[with_word]
    _, dup = _repeats(t.hash_spans(from_, to), line_docs)
    echo = np.concatenate(([False], (words[1:] == words[:-1]) & (docs[1:] == docs[:-1])))[: len(words)]
    return [
        count(docs), count(docs, in_words), t.per_doc(IS_SYMBOL[t.data]), count(line_docs, dup), count(docs, repeat),
        count(line_docs), t.per_doc(IS_UPPER[t.data]), t.per_doc(IS_LETTER[t.data]), t.per_doc(IS_BANG[t.data]), count(docs, plain), count(docs, echo),
        count(docs, symbols[ends] > symbols[starts]),
    ]


def stats_columns(texts: pa.Array) -> list[pa.Array]:
    parts = [text_stats(t) for _, t in slices(texts)]
    return [pa.array(np.concatenate([p[i] for p in parts])) for i in range(len(STATS))]


Stat = dict[str, Column]


def _per(top: str, bottom: str) -> Callable[[Stat], Column]:
    """A ratio of two statistics; null where the lower one is 0."""
    return lambda s: s[top] / F.nullif(s[bottom], F.lit(0))


@dataclass(frozen=True)
class Rule:
    """Votes bad (0) beyond ``bad``, good (1) up to ``good``, and abstains (2) between or on null."""

    name: str
    cause: str
    measure: Callable[[Stat], Column]
    good: float
    bad: float


RULES = [
    Rule("symbols", "symbols", _per("n_symbols", "n_words"), 0.05, 0.15),
    Rule("symbol_words", "symbols", _per("n_symbol_words", "n_words"), 0.05, 0.15),
    Rule("wordless_tokens", "symbols", lambda s: 1 - _per("n_plain_words", "n_words")(s), 0.02, 0.1),
    Rule("repeated_windows", "repeats", _per("n_repeat_words", "n_words"), 0.1, 0.3),
    Rule("repeated_lines", "repeats", _per("n_dup_lines", "n_lines"), 0.15, 0.5),
    Rule("echoes", "repeats", _per("n_echo_words", "n_words"), 0.02, 0.1),
    Rule("capitals", "shouting", _per("n_upper", "n_letters"), 0.15, 0.25),
    Rule("exclamations", "shouting", _per("n_bangs", "n_words"), 0.05, 0.15),
]
#: Ways to be bad: rules that see the same defect fire together, so the model has a class for each.
#: Each defect is seen by two rules at least: from one alone no accuracy can be estimated.
CAUSES = list(dict.fromkeys(rule.cause for rule in RULES))


def vote_pattern(stat: dict[str, str]) -> Column:
    """All votes as one integer, a base-3 digit for each rule."""
    columns = {name: F.col(stat[name]) for name in STATS}
    total = F.lit(0)
    for k, rule in enumerate(RULES):
        value = rule.measure(columns)
        total = total + F.when(value > rule.bad, 0).when(value <= rule.good, 1).otherwise(2) * 3**k
    return total.cast("int")


@dataclass(frozen=True)
class LabelModel:
    priors: np.ndarray  # of good, then of each cause
    tables: np.ndarray  # class x rule x vote (bad, good), given that the rule votes

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Patterns x classes: the probability of each class."""
        votes = _digits(patterns)
        log = np.log(self.priors) + np.zeros((len(patterns), len(self.priors)))
        for k in range(len(RULES)):
            voted = votes[:, k] < 2
            log[voted] += np.log(self.tables[:, k][:, votes[voted, k]].T)
        odds = np.exp(log - log.max(1, keepdims=True))
        return odds / odds.sum(1, keepdims=True)


def _digits(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(RULES)) % 3


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, smooth: float = 1.0) -> LabelModel:
    """Expectation-maximisation; it starts from "a bad vote is right nine times in ten".

    Within a class the rules vote independently. Bad documents are a mixture of
    one class for each cause; with a single bad class, EM explains the largest
    defect and calls the others good.
    """
    votes = _digits(patterns)
    blame = np.stack([(votes[:, [k for k, r in enumerate(RULES) if r.cause == c]] == 0).any(1) for c in CAUSES], 1).astype(float)
    some = blame.any(1, keepdims=True)
    bad = np.where(some, 0.9 * blame / np.maximum(blame.sum(1, keepdims=True), 1), 0.1 / len(CAUSES))
    share = np.concatenate((1 - bad.sum(1, keepdims=True), bad), 1)
    model = LabelModel(np.ones(len(CAUSES) + 1), np.empty(0))
    for _ in range(rounds):
        mass = share * counts[:, None]
        tables = np.stack([((votes == v).T @ mass).T + smooth for v in (0, 1)], 2)
        priors = mass.sum(0) + smooth
        model = LabelModel(priors / priors.sum(), tables / tables.sum(2, keepdims=True))
        before, share = share, model.posterior(patterns)
        if np.abs(before - share).max(initial=0) < 1e-9:
            break
    return model


def with_stats(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the STATS of its text, and the names that they got."""
    out, names = append_columns(docs, text, stats_columns, [(s, T.LongType()) for s in STATS])
    return out, dict(zip(STATS, names, strict=True))


def base_failed(stat: dict[str, str]) -> Column:
    words, repeat = F.col(stat["n_words"]), F.col(stat["n_repeat_words"])
    return (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PCT * words)


def learn(stats: DataFrame, stat: dict[str, str]) -> LabelModel:
    """Label model from the vote patterns of all rows (at most 3 ** len(RULES) counts reach the driver)."""
    rows = sorted(map(tuple, stats.groupBy(vote_pattern(stat).alias("pattern")).count().collect()))
    got = np.array(rows, np.int64).reshape(-1, 2)
    return fit_label_model(got[:, 0], got[:, 1].astype(float))


def posterior(model: LabelModel, stat: dict[str, str]) -> Column:
    """Probability of good: the model's tables as one expression over the statistics."""
    columns, against = {name: F.col(stat[name]) for name in STATS}, F.lit(0.0)
    for c in range(1, len(model.priors)):
        log = F.lit(float(np.log(model.priors[c] / model.priors[0])))
        for k, rule in enumerate(RULES):
            weights, value = np.log(model.tables[c, k] / model.tables[0, k]), rule.measure(columns)
            log = log + F.when(value > rule.bad, float(weights[0])).when(value <= rule.good, float(weights[1])).otherwise(0.0)
        against = against + F.exp(log)
    return 1 / (1 + against)


def judged(stats: DataFrame, stat: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """``stats`` with ``base_failed``, ``quality`` (posterior of good) and ``kept``; all names."""
    model = learn(stats, stat)
    names = dict(stat)
    for name in ("base_failed", "quality", "kept"):
        names[name] = fresh(stats.columns, name)
        value = {
            "base_failed": lambda: base_failed(stat),
            "quality": lambda: posterior(model, stat),
            "kept": lambda: ~F.col(names["base_failed"]) & (F.col(names["quality"]) >= 0.5),
        }[name]()
        stats = stats.withColumn(names[name], value)
    return stats, names


def quality(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Every row and column of ``docs`` with its statistics and verdict; the new columns' names.

    Null, empty and blank texts have no words and fail the base rules. Repeated
    rows get the same verdict and each counts in the fit; an empty table gives
    an empty result. New columns that clash with given ones get underscores in
    front of their names. The texts are read twice, to learn and to judge, so
    that they never have to be shuffled or stored.
    """
    return judged(*with_stats(docs, text))


def quality_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the STATS, base_failed, quality and kept of every row, the texts read once."""
    stats, stat = with_stats(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return judged(freeze(stats.drop("text")), stat)[0]
