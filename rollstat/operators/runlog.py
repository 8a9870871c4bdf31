"""Run-log metrics: batches, timings, reducers, staleness."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollstat.operators.ranking import exact_quantiles, join_null_safe, scalar_struct


def batch_data_metrics(
    tokens: DataFrame, samples: DataFrame, step: str, seq: str, *, adv: str, ret: str, value: str, mask: str, pos: str,
    score: str, reward: str, prompt_length: str, turns: str, max_response: int, max_prompt: int, cutoffs: Sequence[int] = (),
) -> DataFrame:
    """Per step: sample scores, advantages, returns, values, lengths, clip shares, aborted share, turns.

    ``tokens`` has one row per token, ``samples`` one row per sample; ``cutoffs`` adds the mean
    advantage over the first positions. Sample scores leave out aborted (empty) responses.
    """
    m = F.col(mask) > 0
    a, r, v = (F.when(m, F.col(c)) for c in (adv, ret, value))
    nz = lambda x: F.when(x != 0, x)
    err = F.when(m, F.col(ret) - F.col(value))
    tok = tokens.groupBy(step).agg(
        F.avg(nz(a)).alias("adv_mean"), F.stddev_samp(nz(a)).alias("adv_std"), F.avg(F.abs(nz(a))).alias("adv_abs_mean"),
        F.count_if(F.abs(a) > 5).alias("adv_extreme"), F.max(F.abs(a)).alias("adv_abs_max"), F.max(a).alias("adv_max"), F.min(a).alias("adv_min"),
        F.avg(nz(r)).alias("return_mean"), F.max(r).alias("return_max"), F.min(r).alias("return_min"),
        F.avg(v).alias("value_mean"), F.max(v).alias("value_max"), F.min(v).alias("value_min"),
        (1 - F.var_samp(err) / (F.var_samp(r) + 1e-5)).alias("explained_var"),
        *[F.avg(F.when(m & (F.col(pos) <= c), F.col(adv))).alias(f"adv_mean_first_{c}") for c in cutoffs])
    lengths = tokens.groupBy(step, seq).agg(F.sum(F.col(mask)).alias("_len"))
    s = join_null_safe(samples, lengths, [step, seq], "left").withColumn("_len", F.coalesce("_len", F.lit(0)))
    alive = F.col("_len") > 0
    spread = lambda c, n, w=None: [f(F.when(w, F.col(c)) if w is not None else F.col(c)).alias(f"{n}_{k}")
                                   for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    smp = s.groupBy(step).agg(
        *spread(score, "score", alive), *spread(reward, "reward", alive), *spread("_len", "length"), *spread("_len", "length_alive", alive),
        share(F.col("_len") == max_response).alias("length_clip"), share(~alive).alias("aborted_share"),
        *spread(prompt_length, "prompt"), share(F.col(prompt_length) == max_prompt).alias("prompt_clip"), *spread(turns, "turns"))
    return join_null_safe(smp, tok, [step], "left")


def timing_throughput(timings: DataFrame, totals: DataFrame, step: str, stage: str, seconds: str, devices: int) -> DataFrame:
    """Milliseconds per token and stage (generation over response tokens, others over all) and throughput.

    ``totals`` has (step, prompt_tokens, response_tokens); the stage "step" is the whole step.
    """
    rows = join_null_safe(timings.groupBy(step, stage).agg(F.sum(seconds).alias("seconds")), totals, [step])
    everything = F.col("prompt_tokens") + F.col("response_tokens")
    used = F.when(F.col(stage) == "gen", F.col("response_tokens")).otherwise(everything)
    return rows.select(step, stage, "seconds", F.try_divide(F.col("seconds") * 1000, used).alias("ms_per_token"),
                       F.when(F.col(stage) == "step", F.try_divide(everything, F.col("seconds") * devices)).alias("tokens_per_second"))


def reduce_metrics(log: DataFrame, metric: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """One value per metric: names with max take the maximum, with min the minimum, others the mean."""
    name = F.col(metric)
    out = F.when(F.contains(name, F.lit("max")), F.max(value)).when(F.contains(name, F.lit("min")), F.min(value)).otherwise(F.avg(value))
    return log.groupBy(*keys, metric).agg(out.alias("value"))


# Metrics that keep their last value or add up over a run.
LAST_METRICS = (
    "fully_async/count/total_generated_samples", "fully_async/count/stale_samples_processed", "fully_async/count/stale_trajectory_processed",
    "fully_async/count/current_param_version", "fully_async/count/dropped_stale_samples", "training/global_step",
)
SUM_METRICS = ("perf/time_per_step",)


def run_rule(metric: Column) -> Column:
    """How a metric is reduced over a run: by listed name, then by words in the name."""
    low = F.lower(metric)
    has = lambda *ws: F.rlike(low, F.lit("|".join(ws)))
    return (F.when(metric.isin(*SUM_METRICS), "sum").when(metric.isin(*LAST_METRICS), "last").when(has("timing_s/"), "sum")
            .when(has("mean", "avg", "average"), "avg").when(has("max"), "max").when(has("min"), "min").when(has("sum", "total"), "sum").otherwise("avg"))


def reduce_run(log: DataFrame, run: str, step: str, metric: str, value: str, *, devices: int) -> DataFrame:
    """Run-level value per metric, with spread, throughput and idle ratio recomputed from the reduced values."""
    rule = run_rule(F.col(metric))
    by = log.withColumn("_rule", rule).groupBy(run, metric, "_rule").agg(
        F.sum(value).alias("s"), F.avg(value).alias("a"), F.max(value).alias("x"), F.min(value).alias("n"), F.max_by(value, step).alias("l"))
    r = F.col("_rule")
    by = by.select(run, F.col(metric).alias("metric"), F.when(r == "sum", F.col("s")).when(r == "last", F.col("l")).when(r == "max", F.col("x")).when(
        r == "min", F.col("n")).otherwise(F.col("a")).alias("value"))
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    parts = by.groupBy(run).agg(
        pick("global_seqlen/max").alias("hi"), pick("global_seqlen/min").alias("lo"), pick("perf/total_num_tokens").alias("tok"),
        pick("perf/time_per_step").alias("sec"), pick("perf/throughput").alias("thr"), pick("timing_s/gen").alias("gen"), pick("timing_s/step").alias("st"),
        pick("global_seqlen/minmax_diff").alias("diff"))
    fixed = parts.select(run, F.explode(F.array(
        F.struct(F.lit("global_seqlen/minmax_diff").alias("metric"), F.when(F.col("diff").isNotNull(), F.col("hi") - F.col("lo")).alias("value")),
        F.struct(F.lit("perf/throughput").alias("metric"), F.when(F.col("thr").isNotNull(), F.try_divide(F.col("tok"), F.col("sec") * devices)).alias("value")),
        F.struct(F.lit("trainer/idle_ratio").alias("metric"), F.try_divide("gen", "st").alias("value")))).alias("e")).select(run, "e.*").filter("value is not null")
    return join_null_safe(by, fixed.select(run, "metric"), [run, "metric"], "left_anti").unionByName(fixed)


def staleness_metrics(df: DataFrame, *, current: int, version_start: str, version_end: str, seconds: str, keys: Sequence[str] = ()) -> DataFrame:
    """Stale samples and trajectories, partial rollouts, processing-time quantiles, version diversity."""
    span = F.abs(F.col(version_end) - F.col(version_start))
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.lit(current) - F.col(version_start) >= 1).alias("stale_samples"),
        F.count_if(F.lit(current) - F.col(version_end) >= 1).alias("stale_trajectories"), F.count_if(span > 0).alias("partial"),
        F.avg(F.when(span > 0, 1.0).otherwise(0.0)).alias("partial_ratio"), F.max(span).alias("max_span"),
        F.avg(seconds).alias("time_avg"), F.max(seconds).alias("time_max"), F.min(seconds).alias("time_min"),
        F.countDistinct(version_start).alias("version_diversity"))
    quant = exact_quantiles(df, seconds, {"time_p50": 0.5, "time_p95": 0.95, "time_p99": 0.99}, keys)
    if keys:
        return join_null_safe(counts, quant, list(keys))
    return counts.withColumn("_q", quant.select(F.struct("*").alias("q")).scalar()).select("*", "_q.*").drop("_q")


def dynamic_sampling_metrics(df: DataFrame, group: str, acc: str, length: str, budget: int) -> DataFrame:
    """Accuracy before and after the group filter, group shares, truncation, length median and p95."""
    from rollstat.operators.sampling import group_outcome_report, informative_groups

    kept = informative_groups(df, group, acc)
    full = F.col(length) >= budget
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    after = kept.agg(F.avg(acc).alias("acc_kept"), share(full).alias("trunc_rate"), F.avg(F.when(full, F.col(acc))).alias("acc_truncated"),
                     F.avg(F.when(~full, F.col(acc))).alias("acc_others"))
    lower = exact_quantiles(kept, length, {"p50": 0.5}, discrete=True).scalar()
    p95 = exact_quantiles(kept, length, {"p95": 0.95}).scalar()
    rows = group_outcome_report(df, group, acc).withColumn("acc_full", df.agg(F.avg(acc).alias("a")).scalar()).withColumn(
        "_k", after.select(F.struct("*").alias("k")).scalar()).withColumn("length_p50", lower).withColumn("length_p95", p95)
    return rows.select("*", "_k.*").drop("_k")


def subspace_energy(df: DataFrame, vector: str, keys: Sequence[str], ranks: Sequence[int], *, seed: int = 0) -> DataFrame:
    """Share of squared norm in the leading directions, next to a random-coordinate control of the same size.

    Every Arrow batch gives its partial Gram matrix per key (width x width cells instead of
    one row per vector and cell); the partial cells are summed by Spark, and the eigenvalues
    of a key are taken from its width x width sums, a fixed number of rows.
    """
    import numpy as np
    import pandas as pd

    keys = list(keys)

    def plain(value, n):
        return pd.Series([None if pd.isna(value) else value] * n, dtype=object)

    def partial_gram(batches):
        for batch in batches:
            for key, part in (batch.groupby(keys, dropna=False) if keys else [((), batch)]):
                x = np.stack(part[vector].to_numpy()).astype(np.float64)
                i, j = np.triu_indices(x.shape[1])
                out = pd.DataFrame({"i": i, "j": j, "g": (x.T @ x)[i, j]})
                for name, value in zip(keys, key if isinstance(key, tuple) else (key,)):
                    out[name] = plain(value, len(out))
                yield out[[*keys, "i", "j", "g"]]

    kinds = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    cells = df.select(*keys, vector).mapInPandas(partial_gram, f"{kinds}i int, j int, g double")
    gram = cells.groupBy(*keys, "i", "j").agg(F.sum("g").alias("g"))

    def energies(part: pd.DataFrame) -> pd.DataFrame:
        width = int(part["j"].max()) + 1
        g = np.zeros((width, width))
        g[part["i"], part["j"]] = part["g"]
        g = g + np.triu(g, 1).T
        values = np.sort(np.clip(np.linalg.eigvalsh(g), 0, None))[::-1]
        total = values.sum()
        picked = np.random.default_rng(seed).permutation(width)
        share = lambda x: float(x.sum() / total) if total > 0 else 0.0
        out = pd.DataFrame({"rank": list(ranks), "energy": [share(values[:r]) for r in ranks],
                            "random_energy": [share(np.diag(g)[picked[:r]]) for r in ranks]})
        for name in keys:
            out[name] = plain(part[name].iloc[0], len(out))
        return out[[*keys, "rank", "energy", "random_energy"]]

    return gram.groupBy(*keys).applyInPandas(energies, f"{kinds}rank int, energy double, random_energy double")
