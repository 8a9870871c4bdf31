"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each class is a Gaussian over transformed statistics of the whole text.  Its covariance is the
sample covariance shrunk toward the pooled one and toward its own diagonal; the Cholesky factors
are computed once and travel with the tasks.  A document's log odds are the difference of the two
log densities (half the Mahalanobis distances, the log determinants, the class shares).

The moments are sums over every learning row, added up by Spark; only the sums
(2 x (1 + d + d(d+1)/2) numbers for d statistics) reach the driver.

Defined cases: a null text counts as empty and is scored like any other; a null label or a label
without a document teaches nothing; ids that repeat are scored row by row and teach once per
pair; with no learning row of a class every score is the share of good rows (0.5 with no rows
at all); an empty table gives an empty result; further columns are ignored or carried.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollstat.llm.common import blocks, bounded_batches, fold
from rollstat.session import materialize

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_COMMON = b".,!?'-"
_DIGIT = re.compile(rb"[0-9]")
_WHITE = b" \t\n\x0b\f\r"
NAMES = ("words", "word_length", "marks", "stops", "commas", "bars", "new_words", "repeats", "top_word", "marked_words")


def _share(part: float, whole: float, usual: float, strength: float) -> float:
    """Log odds of a share after ``strength`` more units at the usual share: a short text says little."""
    part, whole = part + usual * strength, whole + strength
    return math.log(part / (whole - part))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of the whole text, in the order of ``NAMES``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = len(data.translate(None, _WHITE))
    words, repeats, last = 0, 0, b""
    seen: dict[bytes, int] = {}
    for block in blocks(data):
        parts = block.split()
        words += len(parts)
        for word in parts:
            seen[word] = seen.get(word, 0) + 1
            if word == last:
                repeats += 1
            last = word

    def words_share(part: float, usual: float) -> float:
        return _share(min(part, words), words, usual, 10)

    plain = _LETTERS + _DIGITS + _COMMON
    marked, marks = 0, 0  # contact data, keys and numbers are no junk: words with a digit don't count
    for word, n in seen.items():
        odd = word.translate(None, plain)
        if odd and not _DIGIT.search(word):
            marked, marks = marked + n, marks + n * len(odd)
    return [
        math.log(words + 10), math.log((size + 50) / (words + 10)), _share(marks, size, 0.001, 50),
        words_share(data.count(b"."), 0.1), words_share(data.count(b","), 0.05), words_share(data.count(b"|"), 0.001),
        words_share(len(seen), 0.8), words_share(repeats, 0.005), words_share(max(seen.values(), default=0), 0.08), words_share(marked, 0.005),
    ]


def statistics_of(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return of(text)


class Discriminant:
    """Two Gaussians; ``log_odds`` of the second against the first."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float, diagonal: float, floor: float = 1e-2):
        self.n = counts
        self.ready = bool((counts > 0).all())
        total = counts.sum()
        self.share = counts[1] / total if total else 0.5
        if not self.ready:
            return
        means = sums / counts[:, None]
        within = [squares[k] - counts[k] * np.outer(means[k], means[k]) for k in (0, 1)]
        pooled = (within[0] + within[1]) / max(total - 2, 1)
        self.scale = np.sqrt(np.maximum(np.diag(pooled), floor ** 2))
        self.means = means / self.scale
        self.factors, self.logdets = [], []
        for k in (0, 1):
            own = within[k] / max(counts[k] - 1, 1)
            # few rows lean on the pooled covariance
            weight = (counts[k] / (counts[k] + 2 * len(self.scale))) * (1 - shrink)
            mixed = (weight * own + (1 - weight) * pooled) / np.outer(self.scale, self.scale)
            mixed = (1 - diagonal) * mixed + diagonal * np.diag(np.diag(mixed)) + floor * np.eye(len(self.scale))
            factor = np.linalg.cholesky(mixed)
            self.factors.append(factor)
            self.logdets.append(2 * np.log(np.diag(factor)).sum())

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), math.log(self.share / (1 - self.share)))
        for k, sign in ((0, -1), (1, 1)):
            solved = np.linalg.solve(self.factors[k], (rows / self.scale - self.means[k]).T)
            out += sign * (-0.5 * (solved ** 2).sum(axis=0) - 0.5 * self.logdets[k])
        return out

    def scores(self, rows: np.ndarray, temper: float) -> np.ndarray:
        if not self.ready:
            return np.full(len(rows), self.share)
        return 1 / (1 + np.exp(-np.clip(self.log_odds(rows) / temper, -500, 500)))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch and class: count, sums and products, as one flat vector."""
    for batch in batches:
        rows = np.array(batch["stats"].tolist(), float).reshape(len(batch), len(NAMES))
        label = batch["label"].to_numpy()
        out = [(k, np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]) for k in (0, 1) if len(own := rows[label == k])]
        yield pd.DataFrame({"label": [k for k, _ in out], "sums": [v.tolist() for _, v in out]})


def fit(scored: DataFrame, shrink: float = 0.3, diagonal: float = 0.1) -> Discriminant:
    """The model from rows (stats, label 0 or 1); every row counts."""
    size = len(NAMES)
    partial = scored.mapInPandas(_moments, "label int, sums array<double>")
    flat = partial.select("label", F.posexplode("sums").alias("at", "value")).groupBy("label", "at").agg(F.sum("value").alias("value"))
    sums = np.zeros((2, 1 + size + size * size))
    for r in flat.collect():  # two rows of 1 + d + d * d numbers
        sums[r["label"], r["at"]] = r["value"]
    return Discriminant(sums[:, 0], sums[:, 1:1 + size], sums[:, 1 + size:].reshape(2, size, size), shrink, diagonal)


def _learning(docs: DataFrame, labels: DataFrame, id_column: str, label_column: str, learn: Column) -> DataFrame:
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).filter("label in (0, 1)").distinct()
    return docs.filter(learn).join(known, "id").select("stats", "label")


def score_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_out_fold: int = 0,
    id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", temper: float = 1.0,
) -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 if score >= threshold).

    Labels of rows whose crc32(id as text) modulo ``folds`` is ``held_out_fold`` are never read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    stats = docs.select(F.col(id_column).alias("id"), statistics_of(F.col(text_column)).alias("stats"))
    stats = materialize(stats, "statistics")
    out = fold("id", folds) == held_out_fold
    model = fit(_learning(stats, labels, id_column, label_column, ~out))

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(rows.tolist(), float).reshape(len(rows), len(NAMES)), temper))

    scored = stats.select(F.col("id").alias(id_column), out.alias("held_out"), score("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_out_fold: int = 0,
    id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", temper: float = 1.0,
) -> DataFrame:
    """The rows whose score reaches ``threshold``, whole; texts are scored where they lie, not shuffled."""
    spark = docs.sparkSession
    bounded_batches(spark)
    # statistics of all rows, then a narrow join with the labels: reading texts twice costs less than shuffling them
    stats = materialize(docs.select(F.col(id_column).alias("id"), statistics_of(F.col(text_column)).alias("stats")), "statistics")
    model = fit(_learning(stats, labels, id_column, label_column, fold("id", folds) != held_out_fold))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(NAMES))
        return pd.Series(model.scores(rows, temper))

    return docs.filter(score(F.col(text_column)) >= threshold)
