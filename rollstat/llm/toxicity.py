"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives.  The unlabelled rows are drawn from all learning rows,
whatever their labels and the positives included, so they hold toxic rows at the full prior, which
is what the correction takes off.  Linear classifiers over the presence of words and word beginnings
minimise the class-prior-corrected risk

    prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])

with the sigmoid loss, which is bounded: with an unbounded one a sample that holds a little less
than the prior would raise the margins of clean rows.  The prior is the share of toxic rows among the labelled learning rows.
Features are those over-represented in the positives, by one test at every size of the sample.
A run above ``LONG`` characters is text without blanks: a word may begin at every place of it.  Each of ``members`` classifiers leaves
out another slice of the sample; their margins are averaged.

Learning sample: ``positives`` and ``unlabelled`` rows per member at most in expectation, chosen
by hashes of the id that know nothing of each other.  The prior counts all labelled learning rows; all texts are scored whole.

Defined cases: a null text counts as empty and is scored like any other; without a positive every
score is the prior, at most 0.25 (0 without labels); null ids hash as the empty id and match no
label; rows that repeat are scored one by one; an empty table gives an empty result; further
columns are ignored.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollstat.llm.common import blocks, bounded_batches, fold
from rollstat.session import materialize

STARTS = (4, 5, 6)
SHARED = (2, 3, 5)
#: Longer runs are no words.
LONG = 40
#: What makes a feature: see ``vocabulary``.
PURITY, DEVIATIONS = 0.5, 3.0
#: Counts that a task holds before it passes them on.
HELD = 1 << 20
_EDGE = ".,;:!?\"'()[]{}<>*#%&|"


def features(text: str | None) -> set[str]:
    """Words (lower case, bare of marks) as ``=word``, the beginnings of longer words, and beginnings that several words share.

    A beginning that clean words have now and then still tells when many words of a text have it.
    """
    data, words = (text or "").encode("utf-8", "surrogatepass"), set()
    for block in blocks(data):
        words.update(block.decode("utf-8", "replace").lower().split())
    words = {w.strip(_EDGE) for w in words}
    out = {"=" + w for w in words if w and len(w) <= LONG}
    unbroken = [w for w in words if len(w) > LONG]
    for n in STARTS:
        shared = Counter([w[:n] for w in words if n < len(w) <= LONG])
        for w in unbroken:
            shared.update({w[i:i + n] for i in range(len(w) - n + 1)})
        out.update(shared)
        for many in SHARED:
            out.update([f"{many}{start}" for start, c in shared.items() if c >= many])
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = {True: Counter(), False: Counter()}

    def counted(positive: bool) -> pd.DataFrame:
        found = counts[positive]
        counts[positive] = Counter()
        return pd.DataFrame({"feature": list(found), "positive": positive, "n": list(found.values())})

    for batch in batches:
        for text, positive in zip(batch["text"], batch["positive"], strict=True):
            counts[bool(positive)].update(features(text))
            if len(counts[bool(positive)]) > HELD:
                yield counted(bool(positive))
    for positive, found in list(counts.items()):
        if found:
            yield counted(positive)


def vocabulary(sample: DataFrame, size: int, prior: float, purity: float = PURITY, deviations: float = DEVIATIONS) -> list[str]:
    """The features most over-represented in the positives, at most ``size``.

    A feature's purity is the share of the unlabelled rows with it that must be toxic: the prior
    times its rate in the positives, over its rate in the unlabelled.  It must also occur in the positives by
    ``deviations`` standard deviations more often than its rate in the unlabelled explains.
    """
    totals = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = totals.get(True, 0), totals.get(False, 0)
    found = sample.select("text", "positive").mapInPandas(_count, "feature string, positive boolean, n bigint").groupBy("feature").agg(
        F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("positive"), F.col("n")).otherwise(0)).alias("u"))
    rate_p, rate_u = (F.col("p") + 0.5) / (n_p + 1.0), (F.col("u") + 0.5) / (n_u + 1.0)
    expected = F.col("u") / float(max(n_u, 1)) * n_p
    best = found.filter(F.col("p") >= expected + deviations * F.sqrt(expected + 1)).filter(prior * rate_p > purity * rate_u).orderBy(F.desc(F.col("p") / float(n_p + 1) - F.col("u") / float(n_u + 1)), "feature").limit(size)
    return sorted(r["feature"] for r in best.select("feature").collect())


def corrected_risk(g: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """(risk, its gradient by the margins ``g``)."""
    n_p, n_u = max(int(positive.sum()), 1), max(int((~positive).sum()), 1)
    up = 1 / (1 + np.exp(-np.clip(g, -40, 40)))  # loss(-g); loss(g) is 1 - up
    rest = up[~positive].sum() / n_u - prior * up[positive].sum() / n_p
    toxic = -prior * up * (1 - up) / n_p
    slope = np.where(positive, 2 * toxic, up * (1 - up) / n_u) if rest >= 0 else np.where(positive, toxic, 0.0)
    return float(prior * (1 - up[positive]).sum() / n_p + max(0.0, rest)), slope


def train(rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, size: int, prior: float, steps: int = 400, sparsity: float = 2e-5) -> np.ndarray:
    """Weights (the last is the intercept) of one classifier by full-batch Adam on the corrected risk.

    ``sparsity`` is a penalty on absolute weights: the words of a few long positives, each a little
    over-represented, would add up in other long texts.

    ``rows``/``columns`` are the present features; ``positive`` has one entry per row.
    """
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = math.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        g = np.bincount(rows, weights=w[columns], minlength=len(positive)) + w[-1]
        _, slope = corrected_risk(g, positive, prior)
        grad = np.r_[np.bincount(columns, weights=slope[rows], minlength=size)[:size], slope.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        rate = 0.05 / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-5)
        w -= rate * m / (1 - 0.9 ** step)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate[:-1] * sparsity, 0)
    return w


def learn(
    docs: DataFrame, labels: DataFrame, learn_rows: Column, id_column: str, text_column: str, label_column: str,
    members: int, positives: int, unlabelled: int, size: int,
) -> tuple[list[str], np.ndarray, float]:
    """(features, mean weights, prior)."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).filter("label in (0, 1)")
    known = known.filter(learn_rows).groupBy("id").agg(F.max("label").alias("label"))
    counted = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    n_known, n_toxic = counted[0], int(counted[1] or 0)
    prior = n_toxic / n_known if n_known else 0.0
    if not n_toxic:
        return [], np.zeros(1), prior
    prior = min(max(prior, 1e-3), 0.5)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter(learn_rows)
    n_rows = rows.count()

    def chance(kind: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(kind), "id"), F.lit(1 << 30)) / float(1 << 30)

    part = F.pmod(F.xxhash64(F.lit("member"), "id"), F.lit(members)).cast("int")
    share = members / max(members - 1, 1)  # of the sample that one member doesn't see
    toxic = known.filter("label = 1").select("id").filter(chance("toxic") < share * positives / max(n_toxic, 1)).withColumn("toxic", F.lit(True))
    # the sampled ids of positives are bounded: texts stay where they are; a row may be drawn as both
    roles = F.array_compact(F.array(F.col("toxic"), F.when(chance("pu") < share * unlabelled / max(n_rows, 1), F.lit(False))))
    picked = rows.join(F.broadcast(toxic), "id", "left").select("id", "text", part.alias("part"), F.explode(roles).alias("positive"))
    sample = materialize(picked.select("id", "text", "positive", "part"), "sample")
    names = vocabulary(sample, size, prior)
    if not names:
        return [], np.zeros(1), prior
    at = {name: k for k, name in enumerate(names)}

    @F.pandas_udf("array<int>")
    def present(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(at[f] for f in features(t) if f in at) for t in texts])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        sizes = frame["present"].map(len).to_numpy()
        columns = np.concatenate([np.asarray(x, int) for x in frame["present"]] or [np.empty(0, int)]).astype(int)
        w = train(np.repeat(np.arange(len(frame)), sizes), columns, frame["positive"].to_numpy(bool), len(names), prior)
        return pd.DataFrame({"weights": [w.tolist()]})

    slices = F.explode(F.array(*[F.lit(m) for m in range(members)])).alias("member")
    sparse = sample.select(slices, "part", "positive", F.xxhash64("id", "positive").alias("key"), present("text").alias("present"))
    if members > 1:
        sparse = sparse.filter("member <> part")
    fitted = sparse.groupBy("member").applyInPandas(fit, "weights array<double>").collect()  # ``members`` rows
    return names, np.mean([r["weights"] for r in sorted(fitted, key=lambda r: r["weights"])], axis=0), prior


def score_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0, threshold: float = 0.5,
    id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
    members: int = 3, positives: int = 4000, unlabelled: int = 8000, size: int = 4096,
) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Labels of rows whose crc32(id as text) modulo ``folds`` is ``held_out_fold`` are never read.
    """
    bounded_batches(docs.sparkSession)
    out = fold("id", folds) == held_out_fold
    names, weights, prior = learn(docs, labels, ~out, id_column, text_column, label_column, members, positives, unlabelled, size)
    known = dict(zip(names, weights[:-1].tolist(), strict=True))
    base = float(weights[-1])

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not known:
            return pd.Series(np.full(len(texts), min(prior, 0.25)))
        margins = np.array([math.fsum(known[f] for f in features(t) if f in known) + base for t in texts], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(margins, -500, 500))))

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    scored = rows.select(F.col("id").alias(id_column), out.alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
