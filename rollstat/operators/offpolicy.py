"""Off-policy correction tables from logged log-probs: weights, masks, metrics."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollstat.functions.columns import clamp
from rollstat.operators.advantages import MASK_EPS
from rollstat.operators.ranking import scalar_struct, with_group_stats

SAFETY = 20.0


def _masked(x: Column, mask: str) -> Column:
    return F.when(F.col(mask) > 0, x).otherwise(0.0)


def raw_weights(df: DataFrame, seq: str, log_ratio: Column, mask: str, level: str) -> DataFrame:
    """Append ``_lr`` (the level's log-ratio) and ``_w`` = exp of it, clamped to +-20."""
    if level == "token":
        out = df.withColumn("_lr", log_ratio)
    elif level in ("sequence", "geometric"):
        total = F.sum(_masked(log_ratio, mask))
        if level == "geometric":
            total = total / (F.sum(mask) + MASK_EPS)
        out = with_group_stats(df, [seq], _lr=total)
    else:
        raise ValueError(f"unknown level {level!r}")
    return out.withColumn("_w", F.exp(clamp("_lr", -SAFETY, SAFETY)))


def importance_weights(
    df: DataFrame, seq: str, log_ratio: Column, mask: str, *, level: str = "token", threshold: float = 2.0
) -> DataFrame:
    """Truncated weights, zero on masked tokens (metrics come from the untruncated ones)."""
    rows = raw_weights(df, seq, log_ratio, mask, level)
    return rows.withColumn("weight", F.least(F.col("_w") * F.col(mask), F.lit(float(threshold)))).drop("_lr", "_w")


def rejection_mask(
    df: DataFrame, seq: str, log_ratio: Column, mask: str, *, level: str, upper: float, lower: float | None = None
) -> DataFrame:
    """``kept`` = mask where lower <= weight <= upper."""
    low = 1.0 / upper if lower is None else lower
    rows = raw_weights(df, seq, log_ratio, mask, level)
    return rows.withColumn("kept", F.when(F.col("_w").between(low, upper), F.col(mask)).otherwise(0)).drop("_lr", "_w")


def veto_mask(df: DataFrame, seq: str, log_ratio: Column, mask: str, *, threshold: float, kept: str | None = None) -> DataFrame:
    """A valid token below log(threshold) rejects its whole sequence."""
    bad = (log_ratio < math.log(threshold)) & (F.col(mask) > 0)
    rows = with_group_stats(df, [seq], _veto=F.max(F.coalesce(bad, F.lit(False))))
    return rows.withColumn("catastrophic", bad.cast("int")).withColumn(
        "kept", F.when(F.col("_veto"), 0).otherwise(F.col(kept or mask))).drop("_veto")


def veto_fractions(df: DataFrame, seq: str, log_ratio: Column, mask: str, *, threshold: float) -> DataFrame:
    bad = F.when((log_ratio < math.log(threshold)) & (F.col(mask) > 0), 1).otherwise(0)
    per_seq = df.groupBy(seq).agg(F.max(bad).alias("v"), F.sum(bad).alias("b"), F.sum(mask).alias("m"))
    return per_seq.agg(F.avg("v").alias("veto_fraction"),
                       (F.sum("b") / (F.sum("m") + MASK_EPS)).alias("catastrophic_fraction"))


def weight_metrics(
    df: DataFrame, seq: str, log_ratio: Column, mask: str, *, level: str, upper: float, lower: float | None = None
) -> DataFrame:
    """Mean, extremes, shares, clamped std, effective sample size and per-sequence statistics."""
    low = 1.0 / upper if lower is None else lower
    rows = raw_weights(df, seq, log_ratio, mask, level)
    w, m = F.col("_w"), F.col(mask)
    c = clamp("_w", low, upper)
    valid = F.when(m > 0, w)
    per_seq = rows.groupBy(seq).agg(
        F.sum(m).alias("n"), F.sum(w * m).alias("w"), F.sum(c * m).alias("c"), F.sum(c * c * m).alias("c2"),
        F.max(valid).alias("hi"), F.min(valid).alias("lo"), F.max("_lr").alias("lr"),
        F.sum(F.when(w > upper, m).otherwise(0)).alias("above"), F.sum(F.when(w < low, m).otherwise(0)).alias("below"),
    ).withColumn("sm", F.col("w") / (F.col("n") + MASK_EPS))
    n = F.sum("n") + MASK_EPS
    if level == "token":
        top, bottom = F.max("hi"), F.min("lo")
        above, below = F.sum("above") / n, F.sum("below") / n
    else:
        top, bottom = F.exp(F.least(F.max("lr"), F.lit(SAFETY))), F.exp(F.min("lr"))
        above = F.avg(F.when(F.col("lr") > math.log(upper), 1.0).otherwise(0.0))
        below = F.avg(F.when(F.col("lr") < math.log(low), 1.0).otherwise(0.0))
    mean_c = F.sum("c") / n
    return per_seq.agg(
        (F.sum("w") / n).alias("w_mean"), top.alias("w_max"), bottom.alias("w_min"),
        above.alias("frac_high"), below.alias("frac_low"),
        F.sqrt(F.greatest(F.sum("c2") / n - mean_c * mean_c, F.lit(0.0))).alias("w_std"),
        (1.0 / (F.sum("c2") / F.pow(mean_c + 1e-8, 2) / n)).alias("eff_sample_size"),
        F.avg("sm").alias("seq_mean"), F.coalesce(F.stddev_samp("sm"), F.lit(0.0)).alias("seq_std"),
        F.max("sm").alias("seq_max"), F.min("sm").alias("seq_min"),
        F.max(F.abs(F.col("sm") - 1.0)).alias("seq_max_deviation"),
        F.avg(F.when(F.col("sm") > upper, 1.0).otherwise(0.0)).alias("seq_frac_high"),
        F.avg(F.when(F.col("sm") < low, 1.0).otherwise(0.0)).alias("seq_frac_low"),
    )


def offpolicy_metrics(df: DataFrame, seq: str, new: str, rollout: str, mask: str) -> DataFrame:
    """Divergence, perplexities, log-perplexity difference and chi-square, token and sequence level."""
    m, d = F.col(mask), F.col(new) - F.col(rollout)
    rho = F.exp(clamp(d, -SAFETY, SAFETY))
    per_seq = df.groupBy(seq).agg(
        F.sum(m).alias("n"), F.sum(F.col(new) * m).alias("a"), F.sum(F.col(rollout) * m).alias("b"),
        F.sum(d * m).alias("d"), F.sum((F.exp(d) - d - 1) * m).alias("k3"), F.sum(rho * rho * m).alias("r2"))
    n1 = F.col("n") + MASK_EPS
    s = per_seq.select("*", (F.col("a") / n1).alias("ma"), (F.col("b") / n1).alias("mb"))
    diff = F.col("mb") - F.col("ma")
    n = F.sum("n") + MASK_EPS
    return s.agg(
        F.avg(F.exp(-F.col("ma"))).alias("training_ppl"), F.avg(-F.col("ma")).alias("training_log_ppl"),
        (-F.sum("d") / n).alias("kl"), (F.sum("k3") / n).alias("k3_kl"),
        F.avg(F.exp(-F.col("mb"))).alias("rollout_ppl"), F.avg(-F.col("mb")).alias("rollout_log_ppl"),
        F.avg(diff).alias("log_ppl_diff"), F.avg(F.abs(diff)).alias("log_ppl_abs_diff"),
        F.max(diff).alias("log_ppl_diff_max"), F.min(diff).alias("log_ppl_diff_min"),
        F.avg(F.exp(diff)).alias("ppl_ratio"), (F.sum("r2") / n - 1.0).alias("chi2_token"),
        (F.avg(F.exp(2.0 * clamp("d", -SAFETY, SAFETY))) - 1.0).alias("chi2_seq"))


def probability_agreement(df: DataFrame, a: str, b: str, mask: str) -> DataFrame:
    """Absolute probability difference and Pearson correlation of two engines on valid tokens."""
    p, q = F.exp(a), F.exp(b)
    valid = df.filter(F.col(mask) > 0).select(p.alias("p"), q.alias("q"), F.abs(p - q).alias("d"))
    return valid.agg(F.max("d").alias("diff_max"), F.avg("d").alias("diff_mean"),
                     F.stddev_samp("d").alias("diff_std"), F.corr("p", "q").alias("pearson"))


def token_differences(df: DataFrame, seq: str, a: Column, b: Column, mask: str) -> DataFrame:
    """Number of valid tokens that differ, per sequence."""
    return df.groupBy(seq).agg(F.count_if((a != b) & (F.col(mask) == 1)).alias("n_diff"))
