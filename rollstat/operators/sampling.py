"""Dedup, seeded sampling, mixing and batch composition."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollstat.functions.columns import col, collapse_ws, hash_unit, sha
from rollstat.operators.ranking import (
    cumulate, first_per_key, hash_position, join_null_safe, position, scalar_struct, with_group_stats, with_range_bucket,
)
from rollstat.session import materialize


def informative_groups(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Groups whose metric varies (population std above zero); single-row groups are kept."""
    keep = df.groupBy(group).agg(F.stddev_pop(metric).alias("s"), F.count(F.lit(1)).alias("n"))
    return join_null_safe(df, keep.filter("s > 0 or n = 1").select(group), [group], "left_semi")


def chosen_of_pair(df: DataFrame, pair: str, pos: str, score: str) -> DataFrame:
    """Complete pairs with ``chosen`` = 1 for the higher score; a tie goes to the first row."""
    best = df.groupBy(pair).agg(
        F.max_by(pos, F.struct(F.col(score), -F.col(pos))).alias("_b"), F.count(F.lit(1)).alias("_n"))
    return join_null_safe(df, best.filter("_n = 2"), [pair]).withColumn(
        "chosen", (F.col(pos) == F.col("_b")).cast("int")).drop("_b", "_n")


def group_outcome_report(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Groups in total, kept, all right, all wrong and mixed (metric is 0/1)."""
    g = df.groupBy(group).agg(F.avg(metric).alias("m"), F.stddev_pop(metric).alias("s"), F.count(F.lit(1)).alias("n"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return g.agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if((F.col("s") > 0) | (F.col("n") == 1)).alias("kept_groups"),
        share(F.col("m") == 1).alias("all_right"), share(F.col("m") == 0).alias("all_wrong"),
        share((F.col("m") > 0) & (F.col("m") < 1)).alias("mixed"))


# ---- funnels and dedup ------------------------------------------------------------

def govern_rows(
    df: DataFrame, *, question: Column, difficulty: Column, answer: Column, tokens: Column, source_row: str,
    seed: int, min_difficulty: int, max_difficulty: int, max_tokens: int, target_rows: int,
) -> tuple[DataFrame, DataFrame]:
    """Rejection funnel, exact dedup on the collapsed question, seeded selection.

    Returns the selected rows (``index`` 0..n-1) and one row of counters.
    """
    level = difficulty.cast("int")
    reason = (
        F.when(F.coalesce(question, F.lit("")) == "", "prompt_schema")
        .when(level.isNull() | ~level.between(min_difficulty, max_difficulty), "difficulty")
        .when(answer.isNull(), "answer").when(tokens > max_tokens, "prompt_too_long").otherwise("ok"))
    # one pass over the texts: (row id, reason, hash) gives the funnel, the dedup and the ranking
    hashed = F.when(F.col("reject_reason") == "ok", F.sha2(collapse_ws(question), 256))
    rows = materialize(df.withColumn("reject_reason", reason).select(source_row, "reject_reason", hashed.alias("prompt_sha256")), "funnel")
    unique = rows.filter("reject_reason = 'ok'").groupBy("prompt_sha256").agg(F.min(source_row).alias(source_row)).withColumn(
        "sample_key", sha(F.lit(seed), "prompt_sha256"))
    picked = hash_position(unique, "sample_key", keep=target_rows, name="index").withColumn(
        "index", F.col("index") - 1)
    chosen = df.join(picked, source_row)
    hit = lambda r: F.count_if(F.col("reject_reason") == r).alias(f"rejected_{r}")
    stats = rows.agg(
        F.count(F.lit(1)).alias("raw_rows"), hit("prompt_schema"), hit("difficulty"), hit("answer"), hit("prompt_too_long"),
        F.count_if(F.col("reject_reason") == "ok").alias("eligible"))
    distinct = rows.agg(F.countDistinct("prompt_sha256").alias("u")).scalar()
    counters = stats.withColumn("unique_rows", distinct).withColumn(
        "deduplicated", F.col("eligible") - F.col("unique_rows")).withColumn(
        "selected", F.when(F.col("unique_rows") < target_rows, F.raise_error(F.concat(
            F.lit("too few eligible rows: "), F.col("unique_rows").cast("string"))).cast("bigint")
        ).otherwise(F.lit(target_rows).cast("bigint")))
    return chosen, counters


def dedup_first(df: DataFrame, key: Column, pos: str) -> DataFrame:
    """First row per key in source order."""
    firsts = df.groupBy(F.sha2(key.cast("string"), 256).alias("_key")).agg(F.min(pos).alias(pos))
    return df.join(firsts.select(pos), pos, "left_semi")


def latest_success_per_prompt(
    df: DataFrame, *, prompt: str, response: str, step: str, score: str, min_score: float, extra_ok: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Best successful response per prompt: highest step, highest score, smallest output hash."""
    good = F.col(score) >= min_score
    if extra_ok is not None:
        good = good & extra_ok
    good = F.coalesce(good, F.lit(False)) & (F.coalesce(F.col(prompt), F.lit("")) != "") & (
        F.coalesce(F.col(response), F.lit("")) != "")
    rows = df.withColumn("_ok", good)
    hashed = rows.filter("_ok").drop("_ok").withColumn("prompt_sha256", F.sha2(prompt, 256)).withColumn(
        "output_sha256", F.sha2(response, 256))
    best = first_per_key(hashed, ["prompt_sha256"], [-F.col(step), -F.col(score), F.col("output_sha256")])
    counters = rows.agg(F.count(F.lit(1)).alias("input_rows"), F.count_if("_ok").alias("eligible_rows")).withColumn(
        "selected_prompts", hashed.agg(F.countDistinct("prompt_sha256").alias("n")).scalar())
    return best, counters


def last_turn_best_score(df: DataFrame, conv: str, turn: str, score: str) -> DataFrame:
    """Per conversation the highest turn, then the highest score."""
    return first_per_key(df, [conv], [-F.col(turn), -F.col(score)])


# ---- seeded samples ---------------------------------------------------------------

def bottom_k_hash_sample(
    df: DataFrame, domain: str, pos: str, k: int, seed: int, *, source: str | None = None,
    excluded: Sequence[str] = (), strict: bool = True,
) -> DataFrame:
    """k rows per domain with the smallest hash of seed:domain:position; ``mix_index`` 0..k-1."""
    rows = exclude_sources(df, source, excluded) if source else df
    if strict:
        short = rows.groupBy(domain).count().filter(F.col("count") < k).limit(1).collect()
        if short:
            raise ValueError(f"{short[0][0]}: fewer than {k} rows")
    keyed = rows.withColumn("priority", F.substring(sha(F.lit(seed), domain, pos), 1, 16))
    out = hash_position(keyed, "priority", [domain], tie=[pos], keep=k, name="mix_index")
    return out.withColumn("mix_index", F.col("mix_index") - 1).withColumn(
        "index", F.concat_ws("-", domain, "mix_index"))


def full_union(parts: Mapping[str, DataFrame], pos: str, *, source: str, excluded: Sequence[str] = ()) -> DataFrame:
    """All rows of every domain that are not excluded, numbered per domain in source order."""
    union: DataFrame | None = None
    for domain, df in parts.items():
        one = exclude_sources(df, source, excluded).withColumn("domain", F.lit(domain))
        union = one if union is None else union.unionByName(one, allowMissingColumns=True)
    return position(union, [pos], ["domain"], name="mix_index").withColumn("mix_index", F.col("mix_index") - 1)


def balanced_domain_sample(df: DataFrame, domain: str, key: str, seed: int, n: int | None = None) -> DataFrame:
    """The same number of rows per domain (default: the smallest domain), by hash of seed:domain:key."""
    smallest = df.groupBy(domain).count().agg(F.min("count")).first()[0]
    target = smallest if n is None else n
    if not target or target > smallest:
        raise ValueError(f"requested {target} rows per domain, the smallest has {smallest}")
    keyed = df.withColumn("sample_key", sha(F.lit(seed), domain, key))
    return hash_position(keyed, "sample_key", [domain], keep=target)


def allocate(total: int, weights: Mapping[str, int]) -> dict[str, int]:
    """floor(total*w/sum) rows per source; the last source takes the rest."""
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    names, out = list(weights), {}
    for name in names:
        out[name] = total * weights[name] // sum(weights.values())
    out[names[-1]] = total - sum(out[n] for n in names[:-1])
    return out


def weighted_allocation(
    df: DataFrame, source: str, key: str, seed: int, *, total: int | None = None,
    weights: Mapping[str, int] | None = None, targets: Mapping[str, int] | None = None,
) -> DataFrame:
    """A seeded sample without replacement of each source's share."""
    rows = dict(targets) if targets else allocate(total, weights)
    have = {r[0]: r[1] for r in df.filter(F.col(source).isin(list(rows))).groupBy(source).count().collect()}
    short = {s: n for s, n in rows.items() if have.get(s, 0) < n}
    if short:
        raise ValueError(f"requested {short} but have {have}")
    keyed = df.filter(F.col(source).isin(list(rows))).withColumn("sample_key", sha(F.lit(seed), source, key))
    ranked = hash_position(keyed, "sample_key", [source], keep=max(rows.values()))
    return ranked.filter(F.col("position") <= _by_name(source, rows))


def _by_name(column: str, values: Mapping[str, int | float]) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(F.col(column).cast("string") == name, F.lit(value)).otherwise(out)
    return out


def seeded_split(df: DataFrame, key: str, seed: int, val_size: int | float) -> DataFrame:
    """``split`` = validation for the first rows in hash order, train for the rest.

    ``val_size`` is a number of rows, or a fraction below 1 of all rows (rounded up).
    """
    if isinstance(val_size, float):
        if not 0 <= val_size < 1:
            raise ValueError("a fraction must be in [0, 1)")
        val_size = math.ceil(val_size * df.count() - 1e-9)
    ranked = hash_position(df.withColumn("_key", sha(F.lit(seed), key)), "_key", name="_rank")
    return ranked.withColumn("split", F.when(F.col("_rank") <= val_size, "validation").otherwise("train")).drop("_key", "_rank")


def max_samples(df: DataFrame, pos: str, n: int, *, seed: int | None = None) -> DataFrame:
    """The first n rows, or n seeded rows without replacement."""
    if seed is None:
        return position(df, [pos], name="_p", keep=n).drop("_p")
    return hash_position(df.withColumn("_key", sha(F.lit(seed), pos)), "_key", name="_p", keep=n).drop("_key", "_p")


# ---- quotas, mixes and batch plans ------------------------------------------------

def largest_remainder_quota(
    df: DataFrame, weight: str, ordinal: str, total: Column | int, within: Sequence[str] = ()
) -> DataFrame:
    """Integer quotas: floor, then the leftover to the largest fractions (ties by ordinal).

    One row per domain, optionally per batch (``within``): the windows are that small.
    """
    all_ = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    total_ = F.lit(total) if isinstance(total, int) else total
    checked = F.when((F.col(weight) > 0) & (F.col(weight) < float("inf")), F.col(weight).cast("double")).otherwise(
        F.raise_error(F.lit("weights must be finite and positive")).cast("double"))
    raw = df.withColumn("_w", checked).withColumn("_raw", total_ * F.col("_w") / F.sum("_w").over(all_))
    raw = raw.withColumn("_floor", F.floor("_raw"))
    rank = F.row_number().over(all_.orderBy((F.col("_raw") - F.col("_floor")).desc(), F.col(ordinal).asc()))
    left = total_ - F.sum("_floor").over(all_)
    return raw.withColumn("quota", (F.col("_floor") + (rank <= left).cast("bigint")).cast("bigint")).drop("_w", "_raw", "_floor")


def quotas(total: int, weights: Mapping[str, float]) -> dict[str, int]:
    """The same rule for a handful of configured weights."""
    if any(not 0 < w < float("inf") for w in weights.values()):
        raise ValueError("weights must be finite and positive")
    raw = {d: total * w / sum(weights.values()) for d, w in weights.items()}
    out = {d: int(v // 1) for d, v in raw.items()}
    order = sorted(raw, key=lambda d: out[d] - raw[d])  # stable: ties keep the given order
    for d in order[: total - sum(out.values())]:
        out[d] += 1
    return out


def round_robin_mix(df: DataFrame, pool: str, pools: Sequence[str], key: str) -> DataFrame:
    """Interleave pools one row at a time from each pool's end; used-up pools are skipped.

    The place of a row follows from its rank and the pool sizes, so nothing is sorted globally.
    """
    known = df.filter(F.col(pool).isin(list(pools)))
    if not df.filter(~F.coalesce(F.col(pool).isin(list(pools)), F.lit(False))).isEmpty():
        raise ValueError(f"rows of other pools than {list(pools)}; filter them first")
    sizes = {r[0]: r[1] for r in known.groupBy(pool).count().collect()}  # one row per listed pool
    ranked = hash_position(known, key, [pool], name="_up").withColumn(
        "_r", _by_name(pool, sizes) - F.col("_up") + 1)
    ordinal = F.array_position(F.array(*[F.lit(p) for p in pools]), F.col(pool))
    place = F.lit(1)
    for i, p in enumerate(pools, start=1):
        n = F.lit(sizes.get(p, 0))
        place = place + F.least(n, F.col("_r") - 1) + F.when((F.lit(i) < ordinal) & (n >= F.col("_r")), 1).otherwise(0)
    return ranked.withColumn("mix_position", place.cast("bigint")).drop("_up", "_r")


def strict_interleave_check(
    df: DataFrame, pos: str, domain: str, order: Sequence[str], *, truth: str | None = None, batch: int = 192
) -> DataFrame:
    """Per batch: rows, rows per domain, rows out of the a,b,c order, empty truths, and a verdict."""
    k = len(order)
    expected = F.element_at(F.array(*[F.lit(d) for d in order]), (F.col(pos) % k + 1).cast("int"))
    empty = F.count_if(F.coalesce(F.col(truth), F.lit("")) == "") if truth else F.lit(0).cast("bigint")
    by = df.groupBy(F.floor(F.col(pos) / batch).alias("batch")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(domain) == d).alias(f"n_{i}") for i, d in enumerate(order)],
        F.count_if(F.col(domain) != expected).alias("out_of_order"), empty.alias("empty_truth"))
    even = F.lit(True)
    for i in range(k):
        even = even & (F.col(f"n_{i}") == batch // k)
    return by.withColumn("ok", ((F.col("n_rows") < batch) | even) & (F.col("out_of_order") == 0) & (F.col("empty_truth") == 0))


def _cycled_pools(df: DataFrame, domain: str, key: str, seed: int, sizes: Mapping[str, int], needed: Mapping[str, int]) -> DataFrame:
    """Every pool row once per cycle it is needed in, with its global slot number in the domain."""
    cycles = {d: -(-needed[d] // sizes[d]) for d in needed}
    rows = df.filter(F.col(domain).isin(list(needed))).withColumn(
        "cycle", F.explode(F.sequence(F.lit(0), (_by_name(domain, cycles) - 1).cast("int"))))
    rows = rows.withColumn("_key", sha(F.lit(seed), "cycle", domain, key))
    ranked = hash_position(rows, "_key", [domain, "cycle"], name="_r")
    return ranked.withColumn("slot", (F.col("cycle") * _by_name(domain, sizes) + F.col("_r") - 1).cast("bigint")).drop("_key", "_r")


def _pool_sizes(df: DataFrame, domain: str, weights: Mapping[str, float]) -> dict[str, int]:
    sizes = {str(r[0]): r[1] for r in df.filter(F.col(domain).cast("string").isin(list(weights))).groupBy(domain).count().collect()}
    missing = [d for d in weights if not sizes.get(d)]
    if missing:
        raise ValueError(f"empty domain pools: {missing}")
    return sizes


def _place_in_batch(df: DataFrame, seed: int, domain: str) -> DataFrame:
    """Seeded order inside each batch (a window of one batch)."""
    keyed = df.withColumn("_k", sha(F.lit(seed), "batch", domain, "slot"))
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("_k"))).drop("_k")


def weighted_batch_plan(
    df: DataFrame, domain: str, key: str, *, batch_size: int, weights: Mapping[str, float], seed: int
) -> DataFrame:
    """Epoch plan with an exact quota per domain in every batch; small pools are cycled.

    On odd batches a one-row lead of the first of two equal-weight domains goes to the second.
    """
    sizes = _pool_sizes(df, domain, weights)
    batches = sum(sizes.values()) // batch_size
    if batches == 0:
        raise ValueError("fewer rows than one batch")
    even = quotas(batch_size, weights)
    odd, names = dict(even), list(weights)
    if len(names) > 1:
        first, second = names[0], names[1]
        if weights[first] == weights[second] and even[first] == even[second] + 1:
            odd[first], odd[second] = even[second], even[first]
    needed = {d: even[d] * ((batches + 1) // 2) + odd[d] * (batches // 2) for d in names}
    pool = _cycled_pools(df, domain, key, seed, sizes, {d: n for d, n in needed.items() if n})
    pair = _by_name(domain, {d: even[d] + odd[d] for d in names})
    rest = F.col("slot") % pair
    batch = 2 * F.floor(F.col("slot") / pair) + (rest >= _by_name(domain, even)).cast("bigint")
    plan = pool.withColumn("batch", batch.cast("bigint")).filter(F.col("batch") < batches)
    return _place_in_batch(plan, seed, domain)


def jittered_quotas(spark, batches: int, mixture: Mapping[str, float], *, batch_size: int, jitter: float, seed: int) -> DataFrame:
    """Quota per (batch, domain) from the mixture times 1 + U(-jitter, jitter), renormalised."""
    names = list(mixture)
    b = spark.range(batches).withColumnRenamed("id", "batch")
    rows = b.select("batch", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("ordinal", "domain"))
    u = hash_unit(sha(F.lit(seed), "batch", "domain"))
    w = _by_name("domain", mixture) * (1 + (2 * u - 1) * jitter)
    return largest_remainder_quota(rows.withColumn("weight", w), "weight", "ordinal", batch_size, ["batch"])


def jittered_batch_plan(
    df: DataFrame, domain: str, key: str, *, batch_size: int, mixture: Mapping[str, float], jitter: float, seed: int
) -> DataFrame:
    """Batch plan with quotas that vary per batch; pools are cycled when used up."""
    sizes = _pool_sizes(df, domain, mixture)
    batches = sum(sizes.values()) // batch_size
    plan = jittered_quotas(df.sparkSession, batches, mixture, batch_size=batch_size, jitter=jitter, seed=seed)
    plan = plan.withColumn("_bucket", F.floor(F.col("batch") / 4096))
    runs = cumulate(plan, [F.col("batch")], ["domain"], "_until", weight=F.col("quota"))
    needed = {r[0]: r[1] for r in plan.groupBy("domain").agg(F.sum("quota")).collect()}
    slots = runs.filter("quota > 0").select(
        "batch", F.col("domain").alias(domain),
        F.explode(F.sequence(F.col("_until") - F.col("quota"), F.col("_until") - 1)).alias("slot"))
    pool = _cycled_pools(df, domain, key, seed, sizes, {d: n for d, n in needed.items() if n})
    return _place_in_batch(pool.join(slots, [domain, "slot"]), seed, domain)


# ---- filters by id and source -----------------------------------------------------

def json_question_id(meta: str) -> Column:
    """question_id, questionId or id of a JSON text."""
    return F.coalesce(*[F.get_json_object(meta, f"$.{k}") for k in ("question_id", "questionId", "id")])


def subset_by_ids(df: DataFrame, row_id: Column, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is in the table of wanted ids, and one report row. No ids: all rows are kept."""
    wanted = ids.select(F.col(id_col).cast("string").alias("_id")).filter("_id is not null").distinct()
    before = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    if wanted.isEmpty():
        return df, df.agg(F.count(F.lit(1)).alias("rows_before")).select(
            "rows_before", F.col("rows_before").alias("rows_after"), F.lit(0).cast("bigint").alias("n_ids"),
            F.lit("no_subset_ids_found").alias("note"))
    kept = df.withColumn("_id", row_id).join(wanted, "_id", "left_semi").drop("_id")
    report = wanted.agg(F.count(F.lit(1)).alias("n_ids")).select(
        before.alias("rows_before"), kept.agg(F.count(F.lit(1)).alias("n")).scalar().alias("rows_after"),
        "n_ids", F.lit("").alias("note"))
    return kept, report


def exclude_sources(df: DataFrame, source: str, excluded: Sequence[str]) -> DataFrame:
    """Rows whose source is not in the excluded set; a null source is kept."""
    if not excluded:
        return df
    return df.filter(~F.coalesce(F.col(source).isin(list(excluded)), F.lit(False)))


def exclusion_report(df: DataFrame, keys: Sequence[str], source: str, excluded: Sequence[str]) -> DataFrame:
    gone = F.coalesce(F.col(source).isin(list(excluded)), F.lit(False))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(gone).alias("excluded"),
                                 F.count_if(~gone).alias("selected"))


# ---- repetition, padding, slicing -------------------------------------------------

def repeat_plan(df: DataFrame, source: str, default: Mapping[str, object], profiles: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Request rows: each row n times with its source's sampling profile (exact source, else *, over defaults)."""
    fields = ("temperature", "top_p", "top_k", "max_tokens")
    def profile(over):
        p = {**default, **over}
        if int(p.get("n", 1)) <= 0:
            raise ValueError("repeat count must be positive")
        if not p.get("do_sample", True):
            p["temperature"] = 0.0
        return F.struct(F.lit(int(p.get("n", 1))).alias("n"), *[
            F.lit(p.get(f)).cast("double").alias(f) for f in fields])
    chosen = profile(profiles.get("*", {}))
    for name, over in profiles.items():
        if name != "*":
            chosen = F.when(F.col(source) == name, profile(over)).otherwise(chosen)
    rows = df.withColumn("_p", chosen).withColumn("repeat_idx", F.explode(F.sequence(F.lit(0), F.col("_p.n") - 1)))
    return rows.select(*df.columns, "repeat_idx", *[F.col(f"_p.{f}").alias(f) for f in fields])


def repeat_rows(df: DataFrame, times: Column | int, pos: str, *, interleave: bool = True, total: int | None = None) -> DataFrame:
    """Each row ``times`` times; ``out_position`` is 0-based, interleaved (a,a,b,b) or tiled (a,b,a,b).

    ``pos`` is the 0-based position of the row; a per-row count has no closed position and gets ``rep`` only.
    """
    n = F.lit(times) if isinstance(times, int) else times
    rows = df.withColumn("rep", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))) if isinstance(times, int) else
                         F.explode(F.filter(F.sequence(F.lit(0), n.cast("int")), lambda i: i < n)))
    if not isinstance(times, int):
        return rows
    if interleave:
        return rows.withColumn("out_position", F.col(pos) * times + F.col("rep"))
    size = F.lit(total) if total is not None else df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.withColumn("out_position", F.col("rep") * size + F.col(pos))


def take_complete_groups(
    df: DataFrame, group: str, pos: str, k: int | None = None, *, domain: str | None = None,
    domain_quotas: Mapping[str, int] | None = None,
) -> DataFrame:
    """All rows of the first k groups, or of the first quota groups of each domain."""
    if domain_quotas is None:
        heads = df.groupBy(group).agg(F.min(pos).alias("_first"))
        keep = position(heads, ["_first"], keep=k, name="_g")
    else:
        first = F.struct(F.col(pos).alias("p"), F.col(domain).alias("d"))
        heads = df.groupBy(group).agg(F.min(first).alias("_f")).select(
            group, F.col("_f.p").alias("_first"), F.col("_f.d").alias("_dom"))
        quota = _by_name("_dom", domain_quotas)
        keep = position(heads.filter(F.col("_dom").isin(list(domain_quotas))), ["_first"], ["_dom"],
                        keep=max(domain_quotas.values()), name="_g").filter(F.col("_g") <= quota)
        got = {r[0]: r[1] for r in keep.groupBy("_dom").count().collect()}
        short = {d: n for d, n in domain_quotas.items() if got.get(d, 0) < n}
        if short:
            raise ValueError(f"domain quota unavailable: required {short}, available {got}")
    return join_null_safe(df, keep.select(group), [group], "left_semi")


def band_filter_downsample(
    df: DataFrame, group: str, pos: str, acc: str, length: str, *, low: float, high: float, max_length: int, oversample: float
) -> DataFrame:
    """Rows of groups inside the accuracy band (and below the length cap) first, then 1/oversample of all rows.

    ``out_position`` is 1-based.
    """
    groups = df.groupBy(group).agg(
        F.avg(acc).alias("_a"), F.max(length).alias("_l"), F.min(pos).alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = groups.withColumn("_pass", F.col("_a").between(low, high) & (F.col("_l") < max_length - 1))
    runs = cumulate(with_range_bucket(groups, "_first"), [F.col("_first")], ["_pass"], "_until", weight=F.col("_n"))
    totals = scalar_struct(groups, all=F.sum("_n"), ok=F.sum(F.when(F.col("_pass"), F.col("_n")).otherwise(0)))
    runs = runs.withColumn("_t", totals).withColumn(
        "_start", F.col("_until") - F.col("_n") + F.when(F.col("_pass"), 0).otherwise(F.col("_t.ok")))
    runs = runs.withColumn("_limit", F.floor(F.col("_t.all") / oversample)).filter("_start < _limit")
    rows = join_null_safe(df, runs.select(group, "_start", "_limit", "_pass"), [group])
    inside = position(rows, [pos], [group], name="_i")
    return inside.withColumn("out_position", F.col("_start") + F.col("_i")).filter(
        "out_position <= _limit").withColumnRenamed("_pass", "passed").drop("_start", "_limit", "_i")


def resample_weights(df: DataFrame, score: str, method: str, power: float = 2.0) -> DataFrame:
    """``weight``: |s|^p, or 1 for the extremes, or 0.4 for the maximum and 0.1 else; plus 1e-8."""
    if method == "pow":
        w = F.pow(F.abs(score), F.lit(power))
        rows = df
    else:
        rows = df.withColumn("_e", scalar_struct(df, hi=F.max(score), lo=F.min(score)))
        top = F.col(score) == F.col("_e.hi")
        if method == "max_min":
            w = F.when(top | (F.col(score) == F.col("_e.lo")), 1.0).otherwise(0.0)
        elif method == "max_random":
            w = F.when(top, 0.4).otherwise(0.1)
        else:
            raise ValueError(f"unknown method {method!r}")
    return rows.withColumn("weight", F.greatest(w + 1e-8, F.lit(1e-8))).drop("_e")


def importance_resample(df: DataFrame, key: str, weight: str, draws: int, seed: int) -> DataFrame:
    """Draw rows with replacement in proportion to weight; ``copies`` says how often a row is drawn.

    Seeded uniform draws and the rows' cumulative weight ends are put on one axis; the
    number of draws up to each end is a running count, so no draw is ever compared with
    a range of rows.  Weights are whole numbers, 2**40 for the largest, and so are their sums and the
    draws: where ranges are cut changes nothing.
    """
    slim = materialize(df.select(key, F.col(weight).cast("double").alias("_w")), "weights")
    top = slim.agg(F.max("_w")).first()[0]
    whole = F.floor(F.col("_w") / F.lit(top) * F.lit(float(1 << 40)) + 0.5).cast("decimal(20,0)")
    slim = slim.select(key, whole.alias("_w"))
    ends = cumulate(with_range_bucket(slim, key), [F.col(key)], [], "_end", weight=F.col("_w")).withColumn("_end", F.col("_end").cast("decimal(38,0)"))
    total = F.lit(slim.agg(F.sum("_w")).first()[0]).cast("decimal(23,0)")
    place = F.expr("_h * _total div 281474976710656").cast("decimal(38,0)")
    hits = df.sparkSession.range(draws).select(
        F.floor(hash_unit(sha(F.lit(seed), "id")) * F.lit(float(1 << 48))).cast("decimal(15,0)").alias("_h"), total.alias("_total")).select(
        place.alias("_x"), F.lit(1).alias("_d"), F.lit(None).cast(df.schema[key].dataType).alias(key))
    marks = ends.select(F.col("_end").alias("_x"), F.lit(0).alias("_d"), key)
    axis = with_range_bucket(hits.unionByName(marks), "_x").withColumn("_part", F.col("_bucket"))
    # a draw equal to an end belongs to the next row: ends sort first
    seen = cumulate(axis, [F.col("_x"), F.col("_d"), F.col(key)], [], "_seen", weight=F.col("_d")).filter(F.col(key).isNotNull())
    seen = materialize(seen.select(key, "_x", "_part", "_seen"), "draws")
    # draws up to this end less those up to the end before; the last end of the ranges before, one row each, stands before a range's first
    before = Window.partitionBy("_part").orderBy("_x", key)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edge = seen.groupBy("_part").agg(F.max("_seen").alias("_m")).select("_part", F.coalesce(F.max("_m").over(earlier), F.lit(0)).alias("_p"))
    copies = seen.join(edge, "_part").withColumn("copies", F.col("_seen") - F.coalesce(F.lag("_seen").over(before), F.col("_p")))
    return df.join(copies.filter("copies > 0").select(key, F.col("copies").cast("bigint").alias("copies")), key)


def pad_to_divisor(df: DataFrame, pos: str, k: int) -> DataFrame:
    """Repeat head rows until the row count divides k; ``is_pad`` marks them."""
    n = df.count()
    if n == 0:
        raise ValueError("cannot pad an empty table")
    pad = -n % k
    rounds = -(-pad // n) if pad else 0
    out = df.withColumn("is_pad", F.lit(False))
    for r in range(rounds):
        head = position(df, [pos], name="_p", keep=min(n, pad - r * n)).drop("_p")
        out = out.unionByName(head.withColumn("is_pad", F.lit(True)))
    return out


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_pad")).drop("is_pad")


def range_slice_ranks(df: DataFrame, pos: str, *, base: int, offset: int | None, ranks: int) -> DataFrame:
    """Rows [base, base+offset) in order of ``pos``, split over ranks; the first ranks take one more."""
    total = df.count()
    end = total if offset is None else min(base + offset, total)
    n = max(0, end - base)
    small, more = divmod(n, ranks)
    ranked = position(df, [pos], name="_p").withColumn("_i", F.col("_p") - 1 - base).filter(F.col("_i").between(0, n - 1))
    head = more * (small + 1)
    rank = F.when(F.col("_i") < head, F.floor(F.col("_i") / (small + 1))).otherwise(
        more + F.floor((F.col("_i") - head) / max(small, 1)))
    return ranked.withColumn("rank", rank.cast("int")).drop("_p", "_i")


# ---- cost-balanced shards and packs -----------------------------------------------

def row_cost(tokens: Column) -> Column:
    """Work of a sequence: 24576 * length + length squared."""
    t = tokens.cast("bigint")
    return F.lit(24576) * t + t * t


def balanced_sharding(
    df: DataFrame, batch: str, pos: str, tokens: str, shards: int, *, equal_size: bool = True, partial: bool = False,
) -> DataFrame:
    """Equal-size shards of nearly equal cost per batch, dealt in snake order of falling cost.

    ``shard`` and ``shard_place``: inside a shard the order is small - large - small.  Raises for a batch with fewer
    rows than shards, or (``equal_size``) one that does not divide.  With ``partial`` such a batch, like the last one
    of a table, is dealt as far as it goes: its shards differ by one row.
    """
    if not partial:
        n = F.col("_rows")
        odd = (n < shards) | (F.lit(equal_size) & (n % shards != 0))
        checked = F.when(odd, F.raise_error(F.lit(f"a batch has too few rows for {shards} shards, or does not divide")).cast("bigint")).otherwise(n)
        df = with_group_stats(df, [batch], _rows=F.count(F.lit(1))).filter(checked > 0).drop("_rows")
    by_cost = Window.partitionBy(batch).orderBy(F.col("_c").desc(), F.col(pos).asc())
    ranked = df.withColumn("_c", row_cost(F.col(tokens))).withColumn("_r", F.row_number().over(by_cost) - 1)
    turn = F.col("_r") % (2 * shards)
    shard = F.when(turn < shards, turn).otherwise(2 * shards - 1 - turn)
    dealt = ranked.withColumn("shard", shard.cast("int")).withColumn("_k", F.floor(F.col("_r") / shards))
    # smallest first: even places go up on the left, odd places come down on the right
    rank_up = F.row_number().over(Window.partitionBy(batch, "shard").orderBy(F.col("_c").asc(), F.col(pos).asc())) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(batch, "shard"))
    dealt = dealt.withColumn("_u", rank_up).withColumn("_n", n)
    place = F.when(F.col("_u") % 2 == 0, F.floor(F.col("_u") / 2)).otherwise(F.col("_n") - 1 - F.floor(F.col("_u") / 2))
    return dealt.withColumn("cost", F.col("_c")).withColumn("shard_place", place.cast("int")).drop("_c", "_r", "_k", "_u", "_n")


def sharding_report(sharded: DataFrame, batch: str, pos: str, shards: int, rows_per_batch: int) -> DataFrame:
    """Cost minimum, maximum, spread and mean per batch before (in row order) and after balancing."""
    size = -(-rows_per_batch // shards)
    before = sharded.groupBy(batch, F.floor((F.col(pos) % rows_per_batch) / size).alias("_g")).agg(F.sum("cost").alias("c"))
    after = sharded.groupBy(batch, "shard").agg(F.sum("cost").alias("c"))
    stats = lambda d, p: d.groupBy(batch).agg(F.min("c").alias(f"{p}min"), F.max("c").alias(f"{p}max"), F.sum("c").alias(f"{p}sum"))
    both = join_null_safe(stats(before, ""), stats(after, "balanced_"), [batch])
    return both.select(batch, "min", "max", (F.col("max") - F.col("min")).alias("spread"), "balanced_min", "balanced_max",
                       (F.col("balanced_max") - F.col("balanced_min")).alias("balanced_spread"),
                       (F.col("sum") / shards).alias("mean"))


def pack_micro_batches(
    df: DataFrame, batch: str, pos: str, tokens: str, budget: int, *, min_packs: int = 1, multiple: int = 1
) -> DataFrame:
    """Packs per batch = ceil(tokens / budget); rows are dealt by cost, ``row_index`` restores the order."""
    sums = df.groupBy(batch).agg(F.sum(tokens).alias("_t"), F.count(F.lit(1)).alias("_n"))
    packs = F.greatest(F.least(F.col("_n"), F.ceil(F.col("_t") / budget)), F.lit(min_packs))
    packs = F.ceil(packs / multiple) * multiple
    rows = join_null_safe(df, sums.select(batch, packs.cast("bigint").alias("n_packs")), [batch])
    by_cost = Window.partitionBy(batch).orderBy(F.col("_c").desc(), F.col(pos).asc())
    rows = rows.withColumn("_c", row_cost(F.col(tokens))).withColumn("_r", F.row_number().over(by_cost) - 1)
    turn = F.col("_r") % (2 * F.col("n_packs"))
    pack = F.when(turn < F.col("n_packs"), turn).otherwise(2 * F.col("n_packs") - 1 - turn)
    index = F.row_number().over(Window.partitionBy(batch).orderBy(pos)) - 1
    return rows.withColumn("pack", pack.cast("int")).withColumn("cost", F.col("_c")).withColumn("row_index", index).drop("_c", "_r")


def pack_report(packed: DataFrame, batch: str, tokens: str, budget: int) -> DataFrame:
    """Tokens and cost per pack, its run order (small packs at both ends) and whether it is over budget."""
    by = packed.groupBy(batch, "pack").agg(
        F.sum(tokens).alias("tokens"), F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n_rows"), F.max("n_packs").alias("_n"))
    down = F.row_number().over(Window.partitionBy(batch).orderBy(F.col("cost").desc(), F.col("pack").asc())) - 1
    by = by.withColumn("_d", down)
    left = F.ceil(F.col("_n") / 2)
    order = F.when(F.col("_d") % 2 == 0, left - 1 - F.floor(F.col("_d") / 2)).otherwise(left + F.floor(F.col("_d") / 2))
    return by.withColumn("run_order", order.cast("int")).withColumn("over_budget", F.col("tokens") > budget).drop("_n", "_d")


# ---- column unions and reshaping --------------------------------------------------

def positional_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Add the columns of another table with the same rows; shared columns must agree."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    renamed = right.select(key, *[F.col(c).alias(f"_{c}" if c in shared else c) for c in right.columns if c != key])
    joined = left.join(renamed, key, "inner")
    clash = F.lit(False)
    for c in shared:
        clash = clash | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return joined.withColumn("conflict", clash).drop(*[f"_{c}" for c in shared])


def slice_rows(df: DataFrame, pos: str, start: int, stop: int, step: int = 1) -> DataFrame:
    return df.filter((F.col(pos) >= start) & (F.col(pos) < stop) & ((F.col(pos) - start) % step == 0))


def chunk_rows(df: DataFrame, pos: str, rows_per_chunk: int) -> DataFrame:
    """``chunk`` and the place inside it, from the 0-based position."""
    return df.withColumn("chunk", F.floor(F.col(pos) / rows_per_chunk)).withColumn("chunk_place", F.col(pos) % rows_per_chunk)


def reorder_rows(df: DataFrame, indices: DataFrame, pos: str) -> DataFrame:
    """Rows in the order of an index table (index, out_position); an index may repeat."""
    return df.join(indices.withColumnRenamed("index", pos), pos)


def fold_rows(df: DataFrame, pos: str, width: int, columns: Sequence[str]) -> DataFrame:
    """``width`` consecutive rows to one row of arrays (width is fixed, so arrays are small)."""
    items = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("_p"), *columns)))
    folded = df.groupBy(F.floor(F.col(pos) / width).alias("row")).agg(items.alias("_i"))
    return folded.select("row", *[F.col(f"_i.{c}").alias(c) for c in columns])


def unfold_rows(df: DataFrame, columns: Sequence[str], width: int) -> DataFrame:
    """Inverse of ``fold_rows``: one row per array element with its position."""
    z = F.arrays_zip(*columns)
    return df.select("row", F.posexplode(z).alias("_j", "_z")).select(
        (F.col("row") * width + F.col("_j")).alias("position"), *[F.col(f"_z.{c}").alias(c) for c in columns])


def append_generated(base: DataFrame, generated: DataFrame, length: Column, max_length: int) -> DataFrame:
    """The dataset plus the generated rows that pass the same length filter."""
    return base.filter(length <= max_length).unionByName(generated.filter(length <= max_length), allowMissingColumns=True)
