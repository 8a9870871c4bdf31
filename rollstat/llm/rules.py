"""Quality rules as weak supervision.

Each rule looks at one statistic of the whole text and votes good, votes bad or abstains.  The
true quality is hidden; expectation-maximisation over the votes of all documents estimates the
share of good documents and, for each rule and each of the two classes, the chances of its three
votes.  A document's posterior probability of being good replaces "every rule must pass": a lone
vote of a rule that often errs is outvoted, one of a rule that never errs is not.

What a rule is supposed to be keeps the two classes from changing places or from splitting the
corpus by something else: it calls at most ``MOST_FALSE`` of the good documents bad, and the
first round starts from ``START``.

The model depends on the votes only through the number of documents of each vote pattern, at
most 3 ** rules rows, which Spark counts over all documents and the driver reads.  Scores are
sums of constants by vote, in Spark expressions.

Defined cases: a null or empty text has no words, and every rule abstains; a share of nothing
abstains; copies and ties are scored row by row, and count as documents; a null id is kept; an empty table
gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollstat.llm.common import bounded_batches
from rollstat.llm.periods import numbered
from rollstat.session import materialize

_WHITE = b" \t\n\x0b\x0c\r"
_INSIDE = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no code point
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_SYMBOLS = b"#*$%&|<>"
_END = re.compile(rb"[.!?](?![^\x20\x09-\x0D])")

STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_adjacent", "n_upper", "n_lower", "n_ends", "n_top")


def _present(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def repeated_words(ids: np.ndarray, window: int = 3) -> int:
    """Words that lie in a window found twice or more, the first find included."""
    n = len(ids)
    if n <= window:
        return 0
    key = ids[:n - window + 1].astype(np.int64)
    for off in range(1, window):  # numbers stay below n, so keys of two words fit a long
        size = int(key.max()) + 1
        key = key + size * ids[off:n - window + 1 + off].astype(np.int64)
        if off < window - 1:
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for off in range(window):
        inside[off:n - window + 1 + off] |= again
    return int(inside.sum())


def statistics(data: bytes) -> tuple[int, ...]:
    """Counts over the whole text, in the order of ``STATISTICS``."""
    words = data.split()
    ids = numbered(words)
    lines = [line for line in data.split(b"\n") if line.strip(_WHITE)]
    return (
        len(words), len(data.translate(None, _WHITE + _INSIDE)), _present(data, _SYMBOLS), len(lines), len(lines) - len(set(lines)),
        repeated_words(ids), int((ids[1:] == ids[:-1]).sum()), _present(data, _UPPER), _present(data, _LOWER), len(_END.findall(data)),
        int(np.bincount(ids).max()) if len(ids) else 0)


def text_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id and its counts."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in batch.column("text")]
            table = np.array(rows, np.int64).reshape(len(rows), len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c) for c in table.T]], ["id", *STATISTICS])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, " + ", ".join(f"{n} bigint" for n in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """Votes bad below ``low`` or above ``high``, good from ``good_low`` to ``good_high``, else abstains."""

    name: str
    value: str  # SQL over the statistics; null abstains
    good_high: float
    high: float
    good_low: float | None = None
    low: float | None = None

    def vote(self) -> Column:
        v = F.expr(self.value)
        bad, good = v > self.high, v <= self.good_high
        if self.low is not None:
            bad, good = bad | (v < self.low), good & (v >= self.good_low)
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


#: Limits as usual in web corpora; repeats of neighbouring words and of phrases are one rule, as they agree by nature.
RULES = (
    Rule("symbols", "n_symbols / nullif(n_words, 0)", 0.02, 0.1),
    Rule("word_length", "word_chars / nullif(n_words, 0)", 7, 10, 4, 3),
    Rule("duplicate_lines", "n_dup_lines / nullif(n_lines, 0)", 0.1, 0.3),
    Rule("repetition", "greatest(n_repeat_words, 3 * n_adjacent) / nullif(n_words, 0)", 0.1, 0.3),
    Rule("capitals", "n_upper / nullif(n_upper + n_lower, 0)", 0.15, 0.4),
    Rule("sentence_ends", "n_ends / nullif(n_words, 0)", 0.3, 0.5, 0.02, 0.005),
    Rule("top_word", "n_top / nullif(n_words, 0)", 0.12, 0.25),
)
VOTES = (1, 0, -1)
#: Assumption: a rule calls no more of the good documents bad.
MOST_FALSE = 0.01
#: Share of good documents, chances of (good, abstain, bad) among good and among bad ones, documents these count for.
START = (0.8, (0.8, 0.18, 0.02), (0.4, 0.3, 0.3), 10)


@dataclass(frozen=True)
class VoteModel:
    good_share: float
    chances: np.ndarray  # class (good, bad) x rule x vote

    def log_odds(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.log(self.chances)
        score = np.full(len(patterns), np.log(self.good_share / (1 - self.good_share)))
        for at, vote in enumerate(VOTES):
            score += (patterns == vote) @ (logs[0, :, at] - logs[1, :, at])
        return score

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(patterns), -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Per rule: how often a vote on a good and on a bad document is right."""
        good, bad = self.chances
        return np.stack([good[:, 0] / (good[:, 0] + good[:, 2]), bad[:, 2] / (bad[:, 0] + bad[:, 2])], axis=1)

    def score(self, rules: tuple[Rule, ...]) -> Column:
        """The posterior as an expression over columns named like the rules."""
        logs = np.log(self.chances)
        terms = [F.lit(float(np.log(self.good_share / (1 - self.good_share))))]
        for r, rule in enumerate(rules):
            good, none, bad = (float(logs[0, r, a] - logs[1, r, a]) for a in range(3))
            terms.append(F.when(F.col(rule.name) == 1, good).when(F.col(rule.name) == -1, bad).otherwise(none))
        odds = reduce(lambda a, b: a + b, terms)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, most_false: float = MOST_FALSE, most_rounds: int = 1000, close: float = 1e-10) -> VoteModel:
    """Expectation-maximisation over distinct vote patterns (rows) and their numbers of documents."""
    share, good, bad, weight = START
    rules = patterns.shape[1]
    prior = np.stack([np.tile(good, (rules, 1)), np.tile(bad, (rules, 1))])
    shown = np.stack([patterns == v for v in VOTES], axis=2).astype(float)  # pattern x rule x vote
    model = VoteModel(share, prior)
    for _ in range(most_rounds):
        is_good = model.posterior(patterns)
        weights = np.stack([counts * is_good, counts * (1 - is_good)])
        seen = np.einsum("cp,prv->crv", weights, shown) + weight * prior
        chances = seen / seen.sum(axis=2, keepdims=True)
        false = np.minimum(chances[0, :, 2], most_false)
        chances[0, :, :2] *= ((1 - false) / (1 - chances[0, :, 2]))[:, None]
        chances[0, :, 2] = false
        after = VoteModel((weights[0].sum() + weight * share) / (counts.sum() + weight), chances)
        moved = abs(after.chances - model.chances).max()
        model = after
        if moved < close:
            break
    return model


def vote_counts(votes: DataFrame, rules: tuple[Rule, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct patterns and their counts: at most 3 ** rules rows reach the driver."""
    names = [r.name for r in rules]
    rows = votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(tuple(r) for r in rows)  # one order of adding up for every run
    table = np.array(rows, np.int64).reshape(len(rows), len(names) + 1)
    return table[:, :-1], table[:, -1].astype(float)


def judge_quality(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5,
) -> DataFrame:
    """One row per document: id, its counts, one vote (1, 0, -1) per rule, posterior, good (posterior >= threshold)."""
    if len(rules) > 12:
        raise ValueError("the patterns of at most 12 rules are counted")
    stats = text_statistics(docs, id_column, text_column)
    votes = materialize(stats.select("*", *[r.vote().alias(r.name) for r in rules]), "votes")
    model = fit_votes(*vote_counts(votes, rules))
    judged = votes.withColumn("posterior", model.score(rules))
    return judged.withColumn("good", F.col("posterior") >= threshold).withColumnRenamed("id", id_column)


def all_patterns(rules: int) -> np.ndarray:
    return np.array(list(product(VOTES, repeat=rules)))
