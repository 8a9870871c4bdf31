"""Group and token statistics over rollouts: advantages, penalties, pair measures."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollstat.functions.columns import clamp
from rollstat.operators.ranking import (
    cumulative_counts, join_null_safe, position, scalar_struct, with_group_stats,
)
from rollstat.operators.scans import (
    advantage_recursion, discounted_return, running_sum, running_sums, suffix_sum,
)
from rollstat.session import materialize

MASK_EPS = 1e-8


# ---- masked statistics ------------------------------------------------------------

def _masked_moments(value: str, mask: str) -> dict[str, Column]:
    valid = F.when(F.col(mask) > 0, F.col(value))
    return {
        "m": F.sum(mask).cast("double"), "total": F.coalesce(F.sum(valid), F.lit(0.0)),
        "mean_": F.avg(valid), "spread": F.coalesce(F.var_pop(valid), F.lit(0.0)),
    }


def _mean_var(s) -> tuple[Column, Column]:
    """Masked mean (denominator + 1e-8) and variance with the m/(m-1) factor."""
    mean = s("total") / (s("m") + MASK_EPS)
    shift = F.coalesce(s("mean_"), F.lit(0.0)) - mean
    squares = s("m") * (s("spread") + shift * shift)
    var = squares / (s("m") + MASK_EPS) * F.try_divide(s("m"), s("m") - 1)
    return mean, var


def masked_stats(df: DataFrame, value: str, mask: str, keys: Sequence[str] = ()) -> DataFrame:
    """Masked sum, mean and variance, global or per key."""
    rows = df.groupBy(*keys).agg(*[a.alias(n) for n, a in _masked_moments(value, mask).items()])
    mean, var = _mean_var(F.col)
    return rows.select(*keys, F.col("m").alias("n_valid"), F.col("total").alias("masked_sum"),
                       mean.alias("masked_mean"), var.alias("masked_var"))


def whiten(df: DataFrame, value: str, mask: str, name: str, *, shift_mean: bool = True) -> DataFrame:
    """(x - mean) / sqrt(var + 1e-8) with masked moments over all rows."""
    stats = scalar_struct(df, **_masked_moments(value, mask))
    out = df.withColumn("_s", stats)
    mean, var = _mean_var(lambda c: F.col(f"_s.{c}"))
    white = (F.col(value) - mean) / F.sqrt(var + MASK_EPS)
    return out.withColumn(name, white if shift_mean else white + mean).drop("_s")


def response_mask(df: DataFrame, seq: str, pos: str, is_end: str, name: str = "response_mask") -> DataFrame:
    """1 up to and including the first end token of the sequence, 0 after it."""
    ends = running_sum(df, seq, pos, F.col(is_end), name="_ends")
    return ends.withColumn(name, (F.col("_ends") - F.col(is_end) == 0).cast("int")).drop("_ends")


# ---- outcome advantages per prompt group ------------------------------------------

def _singleton(n: Column, single: Column, many: Column) -> Column:
    return F.when(n <= 1, single).otherwise(many)


def group_mean_std(df: DataFrame, group: str, score: str, eps: float = 1e-6) -> DataFrame:
    """Mean, std with variance floored at eps, and count; singletons get mean 0 and std 1."""
    g = df.groupBy(group).agg(
        F.count(score).alias("n"), F.avg(score).alias("_m"), F.var_samp(score).alias("_v"))
    return g.select(
        group, F.col("n"),
        _singleton(F.col("n"), F.lit(0.0), F.col("_m")).alias("mean"),
        _singleton(F.col("n"), F.lit(1.0), F.sqrt(F.greatest(F.col("_v"), F.lit(eps)))).alias("std"),
    )


def adv_group_relative(
    df: DataFrame, group: str, score: str, *, eps: float = 1e-6, by_std: bool = True,
    floor_variance: bool = False, excluded: Column | None = None, name: str = "advantage",
) -> DataFrame:
    """(score - group mean) / (group sample std + eps), one value per row.

    Rows where ``excluded`` holds stay out of the statistics and get 0.
    """
    skip = F.lit(False) if excluded is None else F.coalesce(excluded, F.lit(False))
    used = F.when(~skip, F.col(score))
    rows = with_group_stats(df, [group], _n=F.count(used), _mean=F.avg(used), _var=F.var_samp(used))
    mean = _singleton(F.col("_n"), F.lit(0.0), F.col("_mean"))
    var = F.greatest(F.col("_var"), F.lit(eps)) if floor_variance else F.col("_var")
    std = _singleton(F.col("_n"), F.lit(1.0), F.sqrt(var))
    adv = F.col(score) - mean
    if by_std:
        adv = adv / (std + eps)
    return rows.withColumn(name, F.when(skip, F.lit(0.0)).otherwise(adv)).drop("_n", "_mean", "_var")


def truncated_rows(score: str, length: str, budget: int, *, zero_score_only: bool = False) -> Column:
    """Rows that used the full response budget, optionally only those with score 0."""
    full = F.col(length) >= budget
    return full & (F.col(score) == 0) if zero_score_only else full


def adv_pass_k(
    df: DataFrame, group: str, score: str, pos: str, *, eps: float = 1e-6, by_std: bool = True
) -> DataFrame:
    """Best minus second best score for the best row of each group, 0 for the others."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(pos).asc())
    top = df.select(group, pos, score).withColumn("_r", F.row_number().over(order)).filter("_r <= 2")
    best = top.groupBy(group).agg(
        F.min(F.when(F.col("_r") == 1, F.col(pos))).alias("_best"),
        (F.max(score) - F.min(score)).alias("_gap"))
    stats = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(score).alias("_sd"))
    gap = F.col("_gap") / (F.col("_sd") + eps) if by_std else F.col("_gap")
    checked = F.when(F.col("_n") < 2, F.raise_error(F.lit("a group needs at least 2 rows")).cast("double")
                     ).otherwise(F.when(F.col(pos) == F.col("_best"), gap).otherwise(0.0))
    return join_null_safe(df, join_null_safe(best, stats, [group]), [group]).withColumn("advantage", checked).drop(
        "_best", "_gap", "_n", "_sd")


def adv_leave_one_out(df: DataFrame, group: str, score: str, *, singleton_keeps_score: bool) -> DataFrame:
    """n/(n-1) * (score - mean); a singleton keeps its score or gets 0."""
    rows = with_group_stats(df, [group], _n=F.count(score), _mean=F.avg(score))
    n = F.col("_n")
    single = F.col(score) if singleton_keeps_score else F.lit(0.0)
    return rows.withColumn("advantage", _singleton(
        n, single, F.try_divide(n, n - 1) * (F.col(score) - F.col("_mean")))).drop("_n", "_mean")


def adv_length_weighted(df: DataFrame, group: str, score: str, length: str) -> DataFrame:
    """Score minus the length-weighted mean score of the group."""
    rows = with_group_stats(df, [group], _n=F.count(score), _ws=F.sum(F.col(length) * F.col(score)),
                            _w=F.sum(length))
    base = _singleton(F.col("_n"), F.lit(0.0), F.try_divide(F.col("_ws"), F.col("_w")))
    return rows.withColumn("advantage", F.col(score) - base).drop("_n", "_ws", "_w")


def adv_scaled_centered(df: DataFrame, group: str, score: str, *, f_norm: float = 1.0) -> DataFrame:
    """(rows / rows with non-zero score) * (score - group mean) / f_norm."""
    totals = scalar_struct(df, n=F.count(F.lit(1)), nz=F.count_if(F.col(score) != 0))
    rows = with_group_stats(df, [group], _n=F.count(score), _mean=F.avg(score)).withColumn("_t", totals)
    alpha = F.col("_t.n") / F.greatest(F.col("_t.nz"), F.lit(1))
    mean = _singleton(F.col("_n"), F.lit(0.0), F.col("_mean"))
    return rows.withColumn("advantage", alpha * (F.col(score) - mean) / f_norm).drop("_n", "_mean", "_t")


def soft_mean_center(df: DataFrame, group: Sequence[str], reward: str, *, beta: float = 1.0) -> DataFrame:
    """Reward minus (logsumexp(beta*x) - log n) / beta; the plain mean when beta is 0."""
    if beta == 0:
        rows = with_group_stats(df, group, _c=F.avg(reward))
        return rows.withColumn("centered", F.col(reward) - F.col("_c")).drop("_c")
    x = F.col(reward) * beta
    shifted = with_group_stats(df, group, _mx=F.max(x))
    rows = with_group_stats(shifted, group, _me=F.avg(F.exp(x - F.col("_mx"))))
    centre = (F.col("_mx") + F.log("_me")) / beta
    return rows.withColumn("centered", F.col(reward) - centre).drop("_mx", "_me")


# ---- token level advantages -------------------------------------------------------

def adv_process(df: DataFrame, group: str, seq: str, pos: str, reward: str, mask: str, *, eps: float = 1e-6) -> DataFrame:
    """Token rewards normalised over the valid tokens of the group, then summed to the end."""
    valid = F.when(F.col(mask) > 0, F.col(reward))
    rows = with_group_stats(df, [group], _n=F.count(valid), _mean=F.avg(valid), _sd=F.stddev_samp(valid))
    mean = _singleton(F.col("_n"), F.lit(0.0), F.col("_mean"))
    sd = _singleton(F.col("_n"), F.lit(1.0), F.col("_sd"))
    norm = F.when(F.col(mask) > 0, (F.col(reward) - mean) / (sd + eps)).otherwise(0.0)
    out = suffix_sum(rows.withColumn("_norm", norm), seq, pos, F.col("_norm"), name="advantage")
    return out.withColumn("advantage", F.col("advantage") * F.col(mask)).drop("_n", "_mean", "_sd", "_norm")


def adv_group_baseline_whitened(df: DataFrame, group: str, seq: str, reward: str, mask: str) -> DataFrame:
    """Sequence score minus group mean, spread over the tokens and whitened."""
    scores = df.groupBy(group, seq).agg(F.sum(reward).alias("_score"))
    base = with_group_stats(scores, [group], _n=F.count(F.lit(1)), _mean=F.avg("_score")).select(
        group, seq, (F.col("_score") - _singleton(F.col("_n"), F.lit(0.0), F.col("_mean"))).alias("_adv"))
    tokens = join_null_safe(df, base, [group, seq]).withColumn("_adv", F.col("_adv") * F.col(mask))
    white = whiten(tokens, "_adv", mask, "advantage")
    return white.withColumn("advantage", F.col("advantage") * F.col(mask)).drop("_adv")


def adv_discounted_return(
    df: DataFrame, seq: str, pos: str, reward: str, mask: str, *, gamma: float = 1.0
) -> DataFrame:
    """Discounted return that restarts at padding, plus its whitened value on valid tokens."""
    rows = discounted_return(df, seq, pos, F.col(reward), mask, gamma=gamma, name="returns")
    white = whiten(rows, "returns", mask, "advantage")
    return white.withColumn("advantage", F.col("advantage") * F.col(mask))


def adv_greedy_baseline(df: DataFrame, baselines: DataFrame, seq: str, pos: str, reward: str, mask: str) -> DataFrame:
    """Suffix reward sum minus a per-sequence baseline (columns seq, baseline)."""
    rows = suffix_sum(df, seq, pos, F.col(reward) * F.col(mask), name="returns")
    joined = join_null_safe(rows, baselines, [seq])
    return joined.withColumn("advantage", F.col("returns") - F.col("baseline") * F.col(mask)).drop("baseline")


def adv_gae(
    df: DataFrame, seq: str, pos: str, reward: str, value: str, mask: str, *, gamma: float, lam: float,
) -> DataFrame:
    """Generalised advantage: masked tokens pass the state through; returns before whitening."""
    rows = advantage_recursion(df, seq, pos, reward, value, mask, gamma=gamma, lam=lam, name="gae")
    rows = rows.withColumn("returns", F.col("gae") + F.col(value))
    return whiten(rows, "gae", mask, "advantage")


def adv_process_loo(
    df: DataFrame, outcomes: DataFrame, group: str, seq: str, pos: str, reward: str, mask: str,
    *, process_coef: float = 1.0, outcome_coef: float = 1.0,
) -> DataFrame:
    """Leave-one-out on token rewards and on the outcome at the last valid token, summed to the end.

    ``outcomes`` has (seq, acc). Sequences without a valid token carry no reward.
    """
    valid = F.when(F.col(mask) > 0, F.col(reward))
    seqs = df.groupBy(group, seq).agg(
        F.avg(valid).alias("_sm"), F.max(F.when(F.col(mask) > 0, F.col(pos))).alias("_last"),
    ).filter("_last is not null")
    seqs = join_null_safe(seqs, outcomes.select(seq, F.col("acc").cast("double").alias("_acc")), [seq])
    base = with_group_stats(seqs, [group], _n=F.count(F.lit(1)), _ps=F.sum("_sm"), _as=F.sum("_acc")).select(
        group, seq, "_last", "_acc", "_n", "_ps", "_as")
    n = F.col("_n")
    loo = lambda x, total: F.when(n > 1, x * n / (n - 1) - total / (n - 1)).otherwise(x)
    rows = join_null_safe(df, base, [group, seq], "left")
    token = F.coalesce(F.when(F.col(mask) > 0, loo(F.col(reward), F.col("_ps"))), F.lit(0.0))
    final = F.when(F.col(pos) == F.col("_last"), loo(F.col("_acc"), F.col("_as"))).otherwise(0.0)
    rows = rows.withColumn("_r", (process_coef * token + outcome_coef * final) * F.col(mask)).drop(
        "_last", "_acc", "_n", "_ps", "_as")
    rows = suffix_sum(rows, seq, pos, F.col("_r"), name="returns").drop("_r")
    return whiten(rows, "returns", mask, "advantage")


def adv_token_direct(df: DataFrame, reward: str, mask: str, *, top_k: bool = False) -> DataFrame:
    """Token reward times mask; with ``top_k`` the reward is an array over candidates."""
    m = F.col(mask)
    adv = F.transform(reward, lambda r: r * m) if top_k else F.col(reward) * m
    return df.withColumn("advantage", adv)


def adv_direct_plus_outcome(
    df: DataFrame, ids: str, sampled: str, reward: str, outcome: str, mask: str, *, weight: float = 1.0
) -> DataFrame:
    """Direct candidate rewards plus the outcome advantage on the sampled candidate only."""
    pairs = F.arrays_zip(F.col(ids).alias("i"), F.col(reward).alias("r"))
    adv = F.transform(pairs, lambda p: p["r"] * F.col(mask) + F.when(
        p["i"] == F.col(sampled), weight * F.col(outcome) * F.col(mask)).otherwise(0.0))
    return df.withColumn("advantage", adv).withColumn(
        "sampled_hit", (F.array_contains(F.col(ids), F.col(sampled))).cast("int") * F.col(mask))


def sampled_coverage(df: DataFrame, seq: str, mask: str) -> DataFrame:
    """Share of valid tokens per sequence whose sampled id is among the candidates."""
    return df.groupBy(seq).agg(
        (F.sum("sampled_hit") / F.greatest(F.sum(mask), F.lit(1))).alias("coverage"))


# ---- divergence estimates ---------------------------------------------------------

def kl_estimate(a: Column, b: Column, kind: str) -> Column:
    """k1 = a-b, abs, k2 = half square, k3 = exp(d)-d-1 with d = b-a clamped."""
    if kind == "k1":
        return a - b
    if kind == "abs":
        return F.abs(a - b)
    if kind == "k2":
        return 0.5 * (a - b) * (a - b)
    if kind == "k3":
        d = clamp(b - a, -20, 20)
        return clamp(F.exp(d) - d - 1, -10, 10)
    raise ValueError(f"unknown estimate {kind!r}")


def kl_path(
    df: DataFrame, step: str, seq: str, kl: Column, mask: str, *, beta: float, target: float, horizon: float,
) -> DataFrame:
    """Per step: batch divergence, the coefficient in force and the one after the update."""
    per_seq = df.groupBy(step, seq).agg(
        (F.sum(kl * F.col(mask)) / (F.sum(mask) + MASK_EPS)).alias("_k"))
    steps = per_seq.groupBy(step).agg(F.avg("_k").alias("kl"), F.count(F.lit(1)).alias("n"))
    # the coefficient is a running product over the steps: sums of logarithms, signs and zeros
    factor = 1 + clamp(F.col("kl") / target - 1, -0.2, 0.2) * F.col("n") / horizon
    rows = position(steps, [step], name="_t").withColumn("_f", factor).select(
        "*", F.lit(0).alias("_run"), F.when(F.col("_f") == 0, 0.0).otherwise(F.log(F.abs("_f"))).alias("_l"),
        (F.col("_f") < 0).cast("int").alias("_n"), (F.col("_f") == 0).cast("int").alias("_z"))
    sums = running_sums(rows, "_run", "_t", {f"_sum{c}": F.col(c) for c in ("_l", "_n", "_z")})

    def after(log: Column, negatives: Column, zeros: Column) -> Column:
        size = F.when(zeros > 0, 0.0).otherwise(F.exp(log))
        return float(beta) * F.when(negatives % 2 == 1, -size).otherwise(size)

    upto = [F.col(f"_sum{c}") for c in ("_l", "_n", "_z")]
    before = [s - F.col(c) for s, c in zip(upto, ("_l", "_n", "_z"), strict=True)]
    return sums.select(step, "kl", "n", after(*before).alias("beta"), after(*upto).alias("next_beta"))


def kl_penalised_reward(
    df: DataFrame, step: str, seq: str, reward: str, a: str, b: str, mask: str, *,
    kind: str = "k1", beta: float, target: float, horizon: float,
) -> DataFrame:
    """reward = score - beta(step) * kl * mask, with the adaptive coefficient path."""
    kl = kl_estimate(F.col(a), F.col(b), kind)
    path = kl_path(df, step, seq, kl, mask, beta=beta, target=target, horizon=horizon)
    return join_null_safe(df, path.select(step, "beta"), [step]).withColumn(
        "penalised", F.col(reward) - F.col("beta") * kl * F.col(mask))


def aggregate_token_values(
    df: DataFrame, seq: str, value: str, mask: str, mode: str, keys: Sequence[str] = (), *, length: int | None = None
) -> DataFrame:
    """One value per key: token-mean, seq-mean-token-sum, seq-mean-token-mean, seq-sum-norm."""
    m = F.col(mask)
    v = F.when(m > 0, F.col(value)).otherwise(0.0)
    if mode == "token-mean":
        return df.groupBy(*keys).agg((F.sum(v) / (F.sum(m) + MASK_EPS)).alias("value"))
    seqs = df.groupBy(*keys, seq).agg(F.sum(v).alias("_s"), F.sum(m).alias("_m"))
    alive = F.when(F.col("_m") > 0, 1.0).otherwise(0.0)
    if mode == "seq-mean-token-sum":
        out = F.sum(F.col("_s") * alive) / (F.sum(alive) + MASK_EPS)
    elif mode == "seq-mean-token-mean":
        out = F.sum(F.col("_s") / (F.col("_m") + MASK_EPS) * alive) / (F.sum(alive) + MASK_EPS)
    elif mode == "seq-sum-norm":
        if not length:
            raise ValueError("seq-sum-norm needs a fixed length")
        out = F.sum("_s") / length
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return seqs.groupBy(*keys).agg(out.alias("value"))


# ---- ratio diagnostics ------------------------------------------------------------

def ratio_diagnostics(
    df: DataFrame, seq: str, new: str, old: str, adv: str, mask: str, *,
    low: float = 0.2, high: float = 0.2, dual: float = 3.0,
) -> DataFrame:
    """Clipped fractions and mean losses of the token, sequence and geometric ratios (values only)."""
    m, a = F.col(mask), F.col(adv)
    d = F.col(new) - F.col(old)
    safe = clamp(d, -20, 20)
    ratio = F.exp(safe)
    l1, l2, l3 = -a * ratio, -a * clamp(ratio, 1 - low, 1 + high), -a * dual
    worst = F.greatest(l1, l2)
    loss = F.when(a < 0, F.least(l3, worst)).otherwise(worst)
    sign = F.signum(a)
    geo = sign * F.least(sign * d, sign * clamp(d, -low, high))
    flag = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0) * m)
    per_seq = df.groupBy(seq).agg(
        F.sum(m).alias("n"), F.sum(loss * m).alias("loss"), F.sum(-safe * m).alias("kl"),
        flag(l2 > l1).alias("hi"), flag((worst > l3) & (a < 0)).alias("lo"),
        F.sum(d * m).alias("ds"), F.sum(a * m).alias("as_"),
        F.sum(F.when(a > 0, a * m).otherwise(0.0)).alias("apos"),
        F.sum(F.when(a < 0, a * m).otherwise(0.0)).alias("aneg"),
        flag(a > 0).alias("npos"), flag(a < 0).alias("nneg"),
        F.sum(geo * m).alias("gs"),
        flag((d != clamp(d, -low, high)) & (a > 0)).alias("ghi"),
        flag((d != clamp(d, -low, high)) & (a < 0)).alias("glo"),
    )
    n = F.col("n")
    sr = F.exp(F.least(F.col("ds") / F.greatest(n, F.lit(1)), F.lit(10.0)))
    clipped = clamp(sr, 1 - low, 1 + high)
    # -a*sr against -a*clip(sr): the larger one depends only on the sign of a
    seq_loss = -(F.col("apos") * F.least(sr, clipped) + F.col("aneg") * F.greatest(sr, clipped)) / (n + MASK_EPS)
    seq_hi = F.when(sr > clipped, F.col("npos")).when(sr < clipped, F.col("nneg")).otherwise(0.0)
    alive = F.when(n > 0, 1.0).otherwise(0.0)
    geo_loss = -(F.col("as_") / (n + MASK_EPS)) * F.exp(F.col("gs") / (n + MASK_EPS))
    tokens = F.sum("n") + MASK_EPS
    return per_seq.agg(
        F.sum("n").cast("bigint").alias("n_tokens"),
        (F.sum("loss") / tokens).alias("token_loss"), (F.sum("kl") / tokens).alias("token_kl"),
        (F.sum("hi") / tokens).alias("clip_high"), (F.sum("lo") / tokens).alias("clip_low"),
        (F.sum(seq_loss * alive) / (F.sum(alive) + MASK_EPS)).alias("seq_loss"),
        (F.sum(seq_hi) / tokens).alias("seq_clip"),
        F.avg(geo_loss).alias("geo_loss"), (F.sum("ghi") / tokens).alias("geo_clip_high"),
        (F.sum("glo") / tokens).alias("geo_clip_low"),
    )


def covariance_outliers(
    df: DataFrame, new: str, old: str, adv: str, mask: str, order: Sequence[str], *,
    share: float = 0.0002, low: float = 1.0, high: float = 5.0, digits: int = 9,
) -> DataFrame:
    """Valid tokens whose advantage/log-prob covariance is in the band, and the top share of all."""
    valid = df.filter(F.col(mask) > 0)
    s = scalar_struct(valid, a=F.avg(adv), l=F.avg(new), n=F.count(F.lit(1)))
    rows = valid.withColumn("_s", s)
    cov = (F.col(adv) - F.col("_s.a")) * (F.col(new) - F.col("_s.l"))
    rows = rows.withColumn("cov", F.round(cov, digits)).drop("_s").withColumn("_neg", -F.col("cov"))
    total = valid.count()
    top = position(rows, ["_neg", *order], keep=max(1, int(total * share)))
    band = (F.col("cov") > low) & (F.col("cov") < high)
    gap = F.abs(F.col(new) - F.col(old))
    tops = top.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(gap).alias("g"), F.min("cov").alias("c")).alias("t"))
    return rows.agg(F.count(F.lit(1)).alias("n_valid"), F.count_if(band).alias("in_band")).select(
        "n_valid", "in_band", F.greatest(F.lit(1), F.floor(F.col("n_valid") * share)).alias("band_budget"),
        tops.scalar().alias("_t"),
    ).select("n_valid", "in_band", "band_budget", F.col("_t.n").alias("top_n"),
             F.col("_t.g").alias("top_abs_ratio"), F.col("_t.c").alias("top_cov_min"))


def value_clip_diagnostics(df: DataFrame, pred: str, value: str, returns: str, mask: str, *, clip: float = 0.5) -> DataFrame:
    """Clipped value error (half the larger square) and the clipped fraction."""
    m = F.col(mask)
    clipped = F.greatest(F.col(value) - clip, F.least(F.col(value) + clip, F.col(pred)))
    e1, e2 = F.pow(F.col(pred) - F.col(returns), 2), F.pow(clipped - F.col(returns), 2)
    n = F.sum(m) + MASK_EPS
    return df.agg((0.5 * F.sum(F.greatest(e1, e2) * m) / n).alias("value_loss"),
                  (F.sum(F.when(e2 > e1, 1.0).otherwise(0.0) * m) / n).alias("value_clip"))


# ---- pair measures ----------------------------------------------------------------

def pairwise_ranking_accuracy(df: DataFrame, group: str, score: str, acc: str, pos: str) -> DataFrame:
    """Share of |accuracy difference| over all pairs of a group where the score order agrees.

    Pairs are never built. Rows are placed in (score, pos) order; accuracy levels are
    numbered per group, and two rows with different levels are compared at the highest
    binary digit where the level numbers differ. Per digit a running count and sum of the
    lower side give the agreeing weight: n log(levels) rows instead of n squared.
    """
    ranked = position(df.select(group, pos, score, acc), [score, pos], [group], name="_pos")
    levels = position(df.select(group, acc).distinct(), [acc], [group], name="_lv").withColumn("_lv", F.col("_lv") - 1)
    levels = materialize(with_group_stats(levels, [group], _top=F.max("_lv")), "levels")
    rows = join_null_safe(ranked, levels, [group, acc])
    bits = F.when(F.col("_top") > 0, F.floor(F.log2(F.col("_top").cast("double"))).cast("int"))
    digit = F.col("_b")
    split = rows.select("*", F.explode(F.sequence(F.lit(0), bits)).alias("_b")).select(
        F.struct(F.col(group).alias("g"), digit.alias("b"), F.call_function("shiftright", F.col("_lv"), digit + 1).alias("p")).alias("_cell"),
        "_pos", F.col(acc).alias("_a"), (F.call_function("shiftright", F.col("_lv"), digit) % 2 == 1).alias("_hi"),
    )
    low = ~F.col("_hi")
    counted = running_sums(split, "_cell", "_pos", {
        "_lc": low.cast("bigint"), "_ls": F.when(low, F.col("_a")).otherwise(0.0)})
    cells = counted.groupBy("_cell").agg(
        F.sum(F.when(F.col("_hi"), F.col("_a") * F.col("_lc") - F.col("_ls")).otherwise(0.0)).alias("_agree"),
        F.count_if("_hi").alias("_nh"), F.count_if(low).alias("_nl"),
        F.sum(F.when(F.col("_hi"), F.col("_a")).otherwise(0.0)).alias("_sh"),
        F.sum(F.when(low, F.col("_a")).otherwise(0.0)).alias("_sl"),
    )
    weights = cells.groupBy(F.col("_cell.g").alias(group)).agg(
        F.sum("_agree").alias("_agree"),
        F.sum(F.col("_sh") * F.col("_nl") - F.col("_sl") * F.col("_nh")).alias("_all"))
    return join_null_safe(df.select(group).distinct(), weights, [group], "left").select(
        group, F.coalesce(F.try_divide("_agree", "_all"), F.lit(0.5)).alias("pair_accuracy"))


def sign_accuracy(df: DataFrame, score: str, acc: str) -> DataFrame:
    hit = F.signum(F.col(score)) == F.signum(F.col(acc) * 2 - 1)
    return df.agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("sign_accuracy"))


def best_of_n_weights(df: DataFrame, group: str, score: str) -> DataFrame:
    """n * P(score <= own)^(n-1) within the group."""
    cums = cumulative_counts(df, score, [group]).drop("n")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    rows = join_null_safe(df, join_null_safe(cums, sizes, [group]), [group, score])
    return rows.withColumn("weight", F.col("_n") * F.pow(F.col("cum") / F.col("_n"), F.col("_n") - 1)).drop(
        "cum", "_n")


def pair_preference_loss(
    df: DataFrame, chosen: str, rejected: str, ref_chosen: str, ref_rejected: str, *,
    beta: float, smoothing: float = 0.0, kind: str = "sigmoid", reference_free: bool = False,
) -> DataFrame:
    """Append ``logits`` and the preference loss value of each pair."""
    ref = F.lit(0.0) if reference_free else F.col(ref_chosen) - F.col(ref_rejected)
    logits = F.col(chosen) - F.col(rejected) - ref
    log_sigmoid = lambda x: F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))
    if kind == "sigmoid":
        loss = -log_sigmoid(beta * logits) * (1 - smoothing) - log_sigmoid(-beta * logits) * smoothing
    elif kind == "squared":
        loss = F.pow(logits - 1 / (2 * beta), 2)
    else:
        raise ValueError(f"unknown loss {kind!r}")
    return df.withColumn("logits", logits).withColumn("loss", loss)
