"""Multi-teacher routing and the domain budget."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollstat.operators.distill import array_sum
from rollstat.operators.ranking import cumulative_counts, exact_quantiles, join_null_safe, scalar_struct, with_group_stats
from rollstat.operators.scans import discounted_return
from rollstat.session import materialize


def domain_weights(domain: str, order: Sequence[str]) -> Column:
    """One-hot array over the teachers, uniform for an unknown domain."""
    n = len(order)
    hot = F.array(*[F.when(F.col(domain).cast("string") == d, 1.0).otherwise(0.0) for d in order])
    flat = F.array(*[F.lit(1.0 / n)] * n)
    return F.when(F.col(domain).cast("string").isin(list(order)), hot).otherwise(flat)


def route_teachers(df: DataFrame, domain: str, teachers: Mapping[str, str], name: str = "routed") -> DataFrame:
    """Weighted sum over teacher arrays; ``teachers`` maps a domain to its teacher column."""
    order = list(teachers)
    rows = df.withColumn("_w", domain_weights(domain, order))
    out: Column | None = None
    for i, d in enumerate(order):
        weight = F.element_at("_w", i + 1)
        part = F.transform(F.col(teachers[d]), lambda x: x * weight)
        out = part if out is None else F.zip_with(out, part, lambda a, b: a + b)
    return rows.withColumn(name, out).drop("_w")


def domain_shares(df: DataFrame, domain: str, seq: str, mask: str, reward: str) -> DataFrame:
    """Per domain prompt and token share, count, mean length, mean absolute reward per token."""
    per_seq = df.groupBy(domain, seq).agg(
        F.sum(mask).alias("_t"), F.sum(F.abs(reward) * F.col(mask)).alias("_r"))
    by = materialize(per_seq.groupBy(domain).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_t").alias("t"), F.sum("_r").alias("r")), "domain-totals")
    total = scalar_struct(by, n=F.sum("n"), t=F.sum("t"))
    return by.withColumn("_a", total).select(
        domain, F.col("n").alias("prompt_count"), (F.col("n") / F.col("_a.n")).alias("prompt_share"),
        (F.col("t") / F.greatest(F.col("_a.t"), F.lit(1))).alias("token_share"),
        (F.col("t") / F.col("n")).alias("mean_length"),
        (F.col("r") / F.greatest(F.col("t"), F.lit(1))).alias("reward_abs_mean"))


def _magnitudes(df: DataFrame, domain: str, mask: str, reward: str, stat: str) -> DataFrame:
    valid = df.filter(F.col(mask) > 0).select(domain, F.abs(reward).alias("_a"))
    if stat == "mean":
        return valid.groupBy(domain).agg(F.avg("_a").alias("magnitude"))
    nonzero = valid.filter("_a > 0")
    if stat in ("q75", "q90"):
        return exact_quantiles(nonzero, "_a", {"magnitude": {"q75": 0.75, "q90": 0.9}[stat]}, [domain])
    if stat != "top10":
        raise ValueError(f"unknown statistic {stat!r}")
    cums = cumulative_counts(nonzero, "_a", [domain])
    sizes = cums.groupBy(domain).agg(F.sum("n").alias("_total"))
    k = F.greatest(F.lit(1), F.floor(F.col("_total") / 10))
    # rows of a value that fall into the last k places
    take = F.greatest(F.lit(0), F.least(F.col("n"), F.col("cum") - (F.col("_total") - k)))
    return join_null_safe(cums, sizes, [domain]).withColumn("_k", take).groupBy(domain).agg(
        (F.sum(F.col("_a") * F.col("_k")) / F.sum("_k")).alias("magnitude"))


def domain_loss_weights(
    df: DataFrame, domain: str, mask: str, *, targets: Mapping[str, float] | None, reward: str | None = None,
    alpha: float = 0.0, stat: str = "mean", direction: str = "divide", anchor: Mapping[str, float] | None = None,
) -> DataFrame:
    """Loss weight per domain: target share / token share, optionally scaled by reward magnitude.

    The token-weighted mean of the weights is 1.
    """
    # one row per domain, used by every later total: written once
    by = materialize(df.groupBy(domain).agg(F.sum(mask).cast("double").alias("tokens")), "domain-tokens")
    wanted = F.lit(0.0)
    for d, share in (targets or {}).items():
        wanted = F.when(F.col(domain).cast("string") == d, float(share)).otherwise(wanted)
    by = by.withColumn("_raw", wanted)
    sums = scalar_struct(by, t=F.sum("tokens"), r=F.sum("_raw"), n=F.count(F.lit(1)))
    by = by.withColumn("_s", sums)
    target = F.when(F.col("_s.r") > 0, F.col("_raw") / F.col("_s.r")).otherwise(1.0 / F.col("_s.n"))
    share = F.col("tokens") / F.greatest(F.col("_s.t"), F.lit(1.0))
    by = by.select(domain, "tokens", share.alias("token_share"), target.alias("target_share"),
                   F.try_divide(target, share).alias("_scale"))
    if alpha > 0:
        by = join_null_safe(by, materialize(_magnitudes(df, domain, mask, reward, stat), "magnitudes"), [domain], "left")
        mag = F.col("magnitude")
        if direction == "divide":
            by = by.withColumn("_scale", F.when(mag > 1e-8, F.col("_scale") / F.pow(mag, F.lit(alpha))).otherwise(F.col("_scale")))
        elif direction == "multiply":
            if anchor is not None:
                ref = F.lit(None).cast("double")
                for d, v in anchor.items():
                    ref = F.when(F.col(domain).cast("string") == d, float(v)).otherwise(ref)
            else:
                known = by.filter("magnitude is not null")
                ref = scalar_struct(known, v=F.sum(F.col("_scale") * mag), b=F.sum("_scale"))
                by = by.withColumn("_b", ref)
                ref = F.greatest(F.col("_b.v") / F.greatest(F.col("_b.b"), F.lit(1e-12)), F.lit(1e-12))
            factor = F.pow(F.greatest(mag, F.lit(1e-12)) / F.greatest(ref, F.lit(1e-12)), F.lit(alpha))
            factor = F.greatest(F.lit(0.05), F.least(F.lit(20.0), factor))
            by = by.withColumn("_scale", F.when(mag.isNotNull(), F.col("_scale") * factor).otherwise(F.col("_scale")))
        else:
            raise ValueError(f"unknown direction {direction!r}")
    by = by.withColumn("_scale", F.when(F.col("tokens") > 0, F.col("_scale")).otherwise(1.0))
    norm = scalar_struct(by, t=F.sum("tokens"), w=F.sum(F.col("_scale") * F.col("tokens")))
    return by.withColumn("_n", norm).select(
        domain, "token_share", "target_share",
        (F.col("_scale") * F.greatest(F.col("_n.t"), F.lit(1.0)) / F.greatest(F.col("_n.w"), F.lit(1e-6))).alias("weight"))


def teacher_spread(teachers: Sequence[str]) -> Column:
    """max - min over teachers of the first candidate's log-prob."""
    first = F.array(*[F.element_at(t, 1) for t in teachers])
    return F.array_max(first) - F.array_min(first)


def teacher_conflict(df: DataFrame, teachers: Sequence[str], mask: Column, domain: str, *, nats: float = 1.0) -> DataFrame:
    """Spread mean, max and contested share; the row with a null domain is the total."""
    rows = df.select(F.col(domain).cast("string").alias("domain"), teacher_spread(teachers).alias("s"), mask.cast("double").alias("m"))
    n = F.greatest(F.sum("m"), F.lit(1.0))
    return rows.rollup("domain").agg(
        (F.sum(F.col("s") * F.col("m")) / n).alias("spread_mean"), F.max(F.col("s") * F.col("m")).alias("spread_max"),
        (F.sum(F.when(F.col("s") > nats, F.col("m")).otherwise(0.0)) / n).alias("contested_frac"))


def teacher_conflict_policy(
    df: DataFrame, teachers: Sequence[str], routed: str, mask: Column, *, policy: str,
    nats: float = 1.0, quantile: float | None = None,
) -> DataFrame:
    """``none``, ``mask`` (weight 0 on disagreement, rescaled) or ``consensus`` (teacher mean where they agree).

    Adds ``target`` (array) and ``token_weight``.
    """
    rows = df.withColumn("_s", teacher_spread(teachers)).withColumn("_m", mask.cast("double"))
    if policy == "none":
        return rows.withColumn("target", F.col(routed)).withColumn("token_weight", F.lit(1.0)).drop("_s", "_m")
    if quantile is None:
        limit = F.lit(float(nats))
    else:
        limit = exact_quantiles(rows.filter("_m > 0"), "_s", {"q": quantile}).scalar()
    rows = rows.withColumn("_ok", F.col("_s") <= limit)
    if policy == "mask":
        kept = scalar_struct(rows, n=F.sum("_m"), k=F.sum(F.col("_ok").cast("double") * F.col("_m")))
        rows = rows.withColumn("_k", kept)
        scale = F.greatest(F.col("_k.n"), F.lit(1.0)) / F.greatest(F.col("_k.k"), F.lit(1.0))
        return rows.withColumn("target", F.col(routed)).withColumn(
            "token_weight", F.when(F.col("_ok"), scale).otherwise(0.0)).drop("_s", "_m", "_ok", "_k")
    if policy != "consensus":
        raise ValueError(f"unknown policy {policy!r}")
    mean: Column = F.col(teachers[0])
    for t in teachers[1:]:
        mean = F.zip_with(mean, F.col(t), lambda a, b: a + b)
    mean = F.transform(mean, lambda x: x / len(teachers))
    return rows.withColumn("target", F.when(F.col("_ok"), mean).otherwise(F.col(routed))).withColumn(
        "token_weight", F.lit(1.0)).drop("_s", "_m", "_ok")


# ---- mixture schedule -------------------------------------------------------------

def step_divergence(df: DataFrame, step: str, domain: str, reward: Column, mask: Column) -> DataFrame:
    """Per step and domain: max(0, mean of -reward over valid tokens)."""
    n = F.sum(mask)
    return df.groupBy(step, domain).agg(
        F.greatest(F.lit(0.0), F.try_divide(F.sum(-reward * mask), n)).alias("raw"))


def with_due_mixture(rows: DataFrame, step: str, *, update_interval: int, floor: float, temperature: float) -> DataFrame:
    """``_due``: the mixture over the domains of a step (t, signal, _ready) if the step updates it; ``_k``: their number."""
    at = Window.partitionBy(step)
    k = F.count(F.lit(1)).over(at)
    top = F.max("signal").over(at)
    norm = F.when(top > 0, F.col("signal") / top).otherwise(0.0)
    rows = rows.withColumn("_norm", norm).withColumn("_k", k).withColumn("_all", F.min(F.col("_ready").cast("int")).over(at))
    weight = F.exp((F.col("_norm") - F.max("_norm").over(at)) / temperature)
    mix = floor + (1 - F.col("_k") * floor) * weight / F.sum(weight).over(at)
    due = F.when(F.col("_all") == 1, mix).otherwise(1.0 / F.col("_k"))
    return rows.withColumn("_due", F.when(F.col("t") % update_interval == 0, due)).drop("_norm", "_all")


def mixture_schedule(
    steps: DataFrame, step: str, domain: str, raw: str, *, ema_window: int, initial_steps: int,
    velocity_window: int, velocity_windows: int, update_interval: int, floor: float, temperature: float,
    kl_floor: float = 1e-6,
) -> DataFrame:
    """Mixture per (step, domain) from the gap and velocity of the smoothed divergence.

    The input has one row per training step and domain.  The moving average is a discounted sum
    that looks back; a step without a value has none and the next one starts anew.
    """
    alpha = 2.0 / (ema_window + 1.0)
    per = Window.partitionBy(domain).orderBy(step)
    rows = steps.select(domain, step, F.col(raw).cast("double").alias("raw")).withColumn("t", F.row_number().over(per))
    known = F.col("raw").isNotNull()
    fresh = ~F.coalesce(F.lag(known.cast("boolean")).over(per), F.lit(False))
    rows = rows.withColumn("_in", F.when(fresh, F.col("raw")).otherwise(alpha * F.col("raw"))).withColumn("_known", known.cast("int"))
    rows = rows.withColumn("_in", F.coalesce("_in", F.lit(0.0))).withColumn("_back", -F.col("t"))
    if alpha < 1:
        rows = discounted_return(rows, domain, "_back", F.col("_in"), "_known", gamma=1 - alpha, name="ema")
    else:
        rows = rows.withColumn("ema", F.col("raw"))
    early = F.col("t") <= initial_steps
    rows = with_group_stats(
        rows, [domain], _sum=F.sum(F.when(early, F.col("raw"))), _seen=F.count(F.when(early, F.col("raw"))))
    initial = F.when((F.col("_seen") == initial_steps) & (F.col("t") >= initial_steps), F.col("_sum") / initial_steps)
    rows = rows.withColumn("ema", F.when(F.col("raw").isNotNull(), F.col("ema"))).withColumn("initial", initial).drop("_in", "_known", "_back", "_sum", "_seen")
    avail = F.least(F.lit(velocity_windows), F.floor(F.col("t") / velocity_window) - 1)
    changes, used = F.lit(0.0), F.greatest(avail, F.lit(1))
    for k in range(velocity_windows):
        newer = F.lag("ema", k * velocity_window).over(per)
        older = F.lag("ema", (k + 1) * velocity_window).over(per)
        change = (newer - older) / F.greatest(older, F.lit(kl_floor))
        changes = changes + F.when(F.lit(k) < avail, change).otherwise(0.0)
    ready = (F.col("t") >= 2 * velocity_window) & F.col("initial").isNotNull() & (avail > 0)
    rows = rows.withColumn("_ready", ready).withColumn(
        "velocity", F.when(ready, F.greatest(F.lit(0.0), -changes / used)).otherwise(0.0)).withColumn(
        "gap", F.when(ready, F.greatest(F.lit(0.0), F.col("ema") / F.greatest("initial", F.lit(kl_floor)))).otherwise(0.0))
    rows = rows.withColumn("signal", F.col("gap") * F.col("velocity"))
    rows = with_due_mixture(rows, step, update_interval=update_interval, floor=floor, temperature=temperature)
    held = F.last("_due", ignorenulls=True).over(per.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select(step, domain, "t", "raw", "ema", "gap", "velocity", "signal",
                       F.coalesce(held, 1.0 / F.col("_k")).alias("mixture"))
