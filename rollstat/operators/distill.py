"""Per-token distillation rewards over candidate lists (arrays of log-probs)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollstat.functions.columns import col

NEG_INF = float("-inf")


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column, valid: Column | None = None, *, normalise: bool = True) -> Column:
    """Weights over an array; invalid entries get 0, as do rows without a valid entry."""
    z = logits if valid is None else F.zip_with(logits, valid, lambda x, v: F.when(v, x))
    if not normalise:
        return F.transform(z, lambda x: F.coalesce(F.exp(x), F.lit(0.0)))
    top = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.coalesce(F.exp(x - top), F.lit(0.0)))
    return F.transform(z, lambda x: F.coalesce(F.try_divide(F.exp(x - top), total), F.lit(0.0)))


def distill_reward(
    student: str | Column, teacher: str | Column, *, weight: str = "student", valid: Column | None = None,
    normalise: bool = True,
) -> Column:
    """-(student - teacher) * weight per candidate, 0 where not valid."""
    s, t = col(student), col(teacher)
    logits = {"student": s, "teacher": t, "none": F.transform(s, lambda _: F.lit(0.0))}[weight]
    w = softmax(logits, valid, normalise=normalise)
    gap = F.zip_with(t, s, lambda a, b: a - b)
    if valid is not None:
        gap = F.zip_with(gap, valid, lambda g, v: F.when(v, g).otherwise(0.0))
    return F.zip_with(gap, w, lambda g, p: g * p)


def distill_reward_topk(
    df: DataFrame, strategy: str, *, s_ids: str, s_logp: str, t_on_s: str, t_ids: str, t_logp: str, s_on_t: str,
    weight: str = "student",
) -> DataFrame:
    """Rewards over a candidate set: only_stu, only_tch, intersection, union, union-intersection.

    Adds ``cand_ids`` and ``reward`` (arrays of the same length).
    """
    in_teacher = F.transform(s_ids, lambda i: F.array_contains(F.col(t_ids), i))
    in_student = F.transform(t_ids, lambda i: F.array_contains(F.col(s_ids), i))
    negate = lambda a: F.transform(a, lambda x: ~x)
    yes = lambda a: F.transform(a, lambda _: F.lit(True))
    if strategy == "only_stu":
        return df.withColumn("cand_ids", F.col(s_ids)).withColumn(
            "reward", distill_reward(s_logp, t_on_s, weight=weight))
    if strategy == "only_tch":
        return df.withColumn("cand_ids", F.col(t_ids)).withColumn(
            "reward", distill_reward(s_on_t, t_logp, weight=weight))
    if strategy == "intersection":
        return df.withColumn("cand_ids", F.col(s_ids)).withColumn(
            "reward", distill_reward(s_logp, t_on_s, weight=weight, valid=in_teacher))
    if strategy not in ("union", "union-intersection"):
        raise ValueError(f"unknown strategy {strategy!r}")
    first = yes(F.col(s_ids)) if strategy == "union" else negate(in_teacher)
    both = df.withColumn("cand_ids", F.concat(s_ids, t_ids)).withColumn("_s", F.concat(s_logp, s_on_t)).withColumn(
        "_t", F.concat(t_on_s, t_logp)).withColumn("_valid", F.concat(first, negate(in_student)))
    return both.withColumn("reward", distill_reward(
        "_s", "_t", weight=weight, valid=F.col("_valid"), normalise=strategy == "union")).drop("_s", "_t", "_valid")


def delta_reward(student: str, teacher: str, teacher_ref: str) -> Column:
    """softmax(student) * (teacher - teacher reference) per candidate."""
    gap = F.zip_with(F.col(teacher), F.col(teacher_ref), lambda a, b: a - b)
    return F.zip_with(softmax(F.col(student)), gap, lambda w, g: w * g)


def extrapolated_reward(base: Column, delta: Column, lam: float) -> Column:
    """base + (lam - 1) * delta per candidate."""
    return base if lam == 1.0 else F.zip_with(base, delta, lambda b, d: b + (lam - 1.0) * d)


def delta_metrics(
    df: DataFrame, student: str, teacher: str, teacher_ref: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Moments of the teacher shift and its weighted reward per key (for example a position chunk)."""
    z = F.arrays_zip(
        F.zip_with(F.col(teacher), F.col(teacher_ref), lambda a, b: a - b).alias("d"),
        delta_reward(student, teacher, teacher_ref).alias("r"),
        F.transform(student, lambda x: F.exp(x)).alias("p"))
    fold = lambda pick: F.aggregate("_z", F.lit(0.0), lambda a, x: a + pick(x))
    pos = lambda x, v: F.when(x["d"] > 0, v).otherwise(0.0)
    per_token = df.withColumn("_z", z).select(
        *keys, F.size("_z").alias("k"), fold(lambda x: x["d"]).alias("d"), fold(lambda x: x["d"] * x["d"]).alias("d2"),
        fold(lambda x: F.abs(x["d"])).alias("ad"), fold(lambda x: pos(x, F.lit(1.0))).alias("np"),
        fold(lambda x: x["r"]).alias("r"), fold(lambda x: F.abs(x["r"])).alias("ar"),
        fold(lambda x: pos(x, x["r"])).alias("rp"), fold(lambda x: x["p"]).alias("p"),
        fold(lambda x: pos(x, x["p"])).alias("pp"),
        F.array_min(F.transform("_z", lambda x: x["d"])).alias("dmin"),
        F.array_max(F.transform("_z", lambda x: x["d"])).alias("dmax"),
        F.array_min(F.transform("_z", lambda x: x["r"])).alias("rmin"),
        F.array_max(F.transform("_z", lambda x: x["r"])).alias("rmax"),
    )
    n, mean = F.sum("k"), F.sum("d") / F.sum("k")
    return per_token.groupBy(*keys).agg(
        mean.alias("shift_mean"), F.sqrt(F.greatest(F.sum("d2") / n - mean * mean, F.lit(0.0))).alias("shift_std"),
        (F.sum("np") / n).alias("shift_pos_frac"), (F.sum("ad") / n).alias("shift_abs_mean"),
        F.min("dmin").alias("shift_min"), F.max("dmax").alias("shift_max"),
        (F.sum("r") / n).alias("reward_mean"), F.min("rmin").alias("reward_min"), F.max("rmax").alias("reward_max"),
        F.avg("r").alias("reward_token_mean"),
        F.coalesce(F.try_divide(F.sum("rp"), F.sum("ar")), F.lit(0.0)).alias("weighted_pos_frac"),
        F.coalesce(F.try_divide(F.sum("pp"), F.sum("p")), F.lit(0.0)).alias("prob_weighted_pos_frac"),
    )


def teacher_logprob_metrics(
    df: DataFrame, student: str, teacher: str, teacher_ref: str, overlap: Column, keys: Sequence[str] = ()
) -> DataFrame:
    """Student-weighted teacher log-probs, their gap, and the reference overlap mass."""
    p = F.transform(student, lambda x: F.exp(x))
    weighted = lambda t: array_sum(F.zip_with(p, F.col(t), lambda a, b: a * b))
    ref_p = F.transform(teacher_ref, lambda x: F.exp(x))
    per_token = df.select(
        *keys, weighted(teacher).alias("t"), weighted(teacher_ref).alias("u"), array_sum(p).alias("mass"),
        array_sum(F.zip_with(ref_p, overlap, lambda a, o: F.when(o, a).otherwise(0.0))).alias("op"),
        array_sum(ref_p).alias("rp"), F.size(F.filter(overlap, lambda o: o)).alias("oc"), F.size(overlap).alias("k"))
    return per_token.groupBy(*keys).agg(
        F.avg("t").alias("teacher_logprob"), F.avg("u").alias("ref_logprob"),
        F.avg(F.col("t") - F.col("u")).alias("logprob_gap"), F.avg("mass").alias("prob_mass"),
        (F.sum("oc") / F.sum("k")).alias("overlap_ratio"), F.avg("op").alias("overlap_sum_p"),
        F.avg("rp").alias("ref_sum_p"))
