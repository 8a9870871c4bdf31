"""Evaluation aggregates and behaviour metrics of completions."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollstat.functions.columns import col, let, sha, strip, text_or_empty
from rollstat.operators.ranking import cumulate, join_null_safe, with_range_bucket

# Rows of the published evaluation sets.
DATASET_TOTALS = {
    "aime24": 960, "aime25": 960, "humaneval_plus": 1640, "mbpp_plus": 3780, "livecodebench_v5": 167, "livecodebench_v6": 175,
    "livecodebench_full": 1055, "ifeval": 541, "ifbench_test": 300, "ifbench_mt_ifbench": 1387, "ifbench_mt_ifeval": 1774,
}


def eval_scorecard(
    df: DataFrame, dataset: str, score: str, totals: DataFrame, known: Sequence[str] | None = None,
    constants: Mapping[str, int] = DATASET_TOTALS, extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per dataset: graded rows, correct, official (over the set's size) and live (over graded rows) accuracy.

    ``totals`` has (dataset, official_total); missing sets take the constant. Datasets
    outside ``known`` are listed unscored with a note.
    """
    by = df.groupBy(dataset).agg(
        F.count(score).alias("scored_rows"), F.sum(F.when(F.col(score) > 0, 1).otherwise(0)).alias("correct"),
        *[a.alias(n) for n, a in (extra or {}).items()])
    fixed = F.lit(None).cast("bigint")
    for name, n in constants.items():
        fixed = F.when(F.col(dataset) == name, F.lit(n).cast("bigint")).otherwise(fixed)
    rows = by.join(totals, dataset, "left").withColumn("official_total", F.coalesce("official_total", fixed))
    ok = F.col(dataset).isin(list(known)) if known is not None else F.lit(True)
    when = lambda c: F.when(ok, c)
    return rows.select(
        dataset, F.when(ok, F.col("scored_rows")).otherwise(0).alias("scored_rows"), when(F.col("correct")).alias("correct"), "official_total",
        when(F.try_divide("correct", "official_total")).alias("official"), when(F.try_divide("correct", "scored_rows")).alias("live"),
        F.when(ok, "").otherwise("unknown_dataset").alias("note"), *(extra or {}))


def macro_means(scorecard: DataFrame) -> DataFrame:
    """Plain means over the datasets that have a value."""
    return scorecard.agg(F.avg("official").alias("macro_official"), F.avg("live").alias("macro_live"))


def avg_at_k(df: DataFrame, keys: Sequence[str], score: Column, sample: str, tokens: str, cap: int) -> DataFrame:
    """Percent of passing rows over graded rows (NaN or null is ungraded), truncation, distinct samples."""
    graded = score.isNotNull() & ~F.isnan(score)
    n = F.count_if(graded)
    cut = F.count_if(F.col(tokens) >= cap)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), n.alias("scored_rows"), F.count_if(graded & (score != 0)).alias("correct"),
        (100.0 * F.count_if(graded & (score != 0)) / F.greatest(n, F.lit(1))).alias("pct"), cut.alias("truncated"),
        (100.0 * cut / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("truncation_rate"), F.countDistinct(sample).alias("unique_samples"))


def pass_at_1(df: DataFrame, keys: Sequence[str], problem: str, passed: str) -> DataFrame:
    """Mean over problems of the mean pass of their completions."""
    per = df.groupBy(*keys, problem).agg(F.avg(passed).alias("p"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(
        F.avg("p").alias("pass_at_1"), F.count(F.lit(1)).alias("problems"), F.avg("n").alias("completions_per_problem"))


def model_scorecard(df: DataFrame, model: str, version: str, versions: Sequence[str], correct: str, scored: str, shard: str) -> DataFrame:
    """Percent per model and version from shard sums, their mean (or the one present), distinct shards."""
    pct = 100 * F.sum(correct) / F.sum(scored)
    wide = df.groupBy(model).pivot(version, list(versions)).agg(
        F.sum(correct).alias("correct"), F.sum(scored).alias("scored"), F.coalesce(pct, F.lit(0.0)).alias("pct"), F.countDistinct(shard).alias("shards"))
    has = [F.coalesce(F.col(f"{v}_scored") > 0, F.lit(False)).cast("int") for v in versions]
    value = [F.coalesce(f"{v}_pct", F.lit(0.0)) for v in versions]
    total = sum(value[1:], value[0])
    return wide.withColumn("average", F.coalesce(F.try_divide(total, sum(has[1:], has[0])), F.lit(0.0)))


# ---- repetition -----------------------------------------------------------------------

# Stock phrases of a looping completion.
STOCK_PHRASES = ("let me denote", "wait,", "let me think", "let me write", "first, let me", "okay, let me")


def _repeated(items: Column) -> Column:
    """How many items occur more than once: in sorted order they equal a neighbour."""
    return let(F.array_sort(items), lambda s: F.size(F.filter(
        s, lambda x, i: (x == F.get(s, i - 1)) | (x == F.get(s, i + 1)))))


def repeated_ngram_ratio(text: Column, n: int = 6) -> Column:
    """Share of word n-grams that occur more than once; 0 below 2n words."""
    def ratio(tokens: Column) -> Column:
        count = F.size(tokens) - (n - 1)
        # compared by a 64-bit hash
        grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(tokens, i, n)))
        return F.when(F.size(tokens) < 2 * n, 0.0).otherwise(_repeated(grams) / count)

    return let(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), 0), ratio)


def trailing_repeat_ratio(text: Column, tail: int = 40) -> Column:
    """Share of repeated lines among the last non-blank lines; 0 below six lines."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda x: x != "")

    def ratio(ls: Column) -> Column:
        last = F.slice(ls, F.greatest(F.size(ls) - tail + 1, F.lit(1)), tail)
        return F.when(F.size(ls) < 6, 0.0).otherwise(let(last, lambda x: _repeated(x) / F.size(x)))

    return let(lines, ratio)


def phrase_score(text: Column) -> Column:
    low = F.lower(text)
    return F.greatest(*[F.regexp_count(low, F.lit(r"\Q" + p + r"\E")) for p in STOCK_PHRASES])


def repetition_metrics(df: DataFrame, text: str) -> DataFrame:
    """Append the three measures and ``repetitive``. Every text is read whole."""
    t = text_or_empty(text)
    rows = df.withColumn("phrase_score", phrase_score(t)).withColumn("ngram_ratio", repeated_ngram_ratio(t)).withColumn(
        "line_ratio", trailing_repeat_ratio(t))
    return rows.withColumn("repetitive", (t != "") & (
        (F.col("phrase_score") >= 8) | (F.col("ngram_ratio") >= 0.18) | (F.col("line_ratio") >= 0.25)))


def behavior_rates(df: DataFrame, keys: Sequence[str], truncated: Column, repetitive: Column) -> DataFrame:
    """Rows and rates of truncated, repetitive and both."""
    both = {"trunc": truncated, "repeat": repetitive, "trunc_repeat": truncated & repetitive}
    return df.groupBy(*keys).agg(
        *[F.count_if(c).alias(f"{n}_rows") for n, c in both.items()],
        *[F.avg(F.when(c, 1.0).otherwise(0.0)).alias(f"{n}_rate") for n, c in both.items()])


# ---- validation metrics -----------------------------------------------------------------

def _sizes(n: Column) -> Column:
    """2, 4, 8, .. below N, then N."""
    powers = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.pow(F.lit(2.0), i).cast("bigint"))
    return F.when(n > 1, F.array_append(F.filter(powers, lambda p: p < n), n.cast("bigint"))).otherwise(
        F.array().cast("array<bigint>"))


def validation_metrics(df: DataFrame, source: str, uid: str, variables: Sequence[str]) -> DataFrame:
    """Mean over prompts of mean@N, std@N, best@n and worst@n, as (source, variable, metric, value).

    best@n and worst@n are the exact mean and deviation over n draws with replacement,
    from the distinct values of a prompt: P(max <= v) = (rows at or below v / N)^n.
    """
    long = df.select(source, uid, F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("v")) for v in variables])).alias("_z")).select(
        source, uid, "_z.variable", "_z.v")
    group = [source, uid, "variable"]
    # everything follows from the distinct values of a prompt with their counts: written once, so rows are read once
    values = with_range_bucket(long.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("_c")), "v")
    v, c = F.col("v"), F.col("_c")
    mean, square = F.sum(v * c) / F.sum(F.when(v.isNotNull(), c)), F.sum(v * v * c) / F.sum(F.when(v.isNotNull(), c))
    stats = values.groupBy(*group).agg(
        mean.alias("m"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("s"), F.sum("_c").alias("N"))
    basic = stats.select(*group, F.explode(F.filter(F.array(
        F.struct(F.concat(F.lit("mean@"), "N").alias("metric"), F.col("m").alias("value"), F.lit(True).alias("ok")),
        F.struct(F.concat(F.lit("std@"), "N").alias("metric"), F.col("s").alias("value"), (F.col("N") > 1).alias("ok"))), lambda x: x["ok"])).alias("_e"))
    basic = basic.select(*group, "_e.metric", "_e.value")
    cums = join_null_safe(cumulate(values, [v], group, "cum", weight=c), stats.select(*group, "N"), group)
    drawn = cums.select("*", F.explode(_sizes(F.col("N"))).alias("k"))
    p = lambda c: F.pow(c / F.col("N"), F.col("k"))
    best = p(F.col("cum")) - p(F.col("cum") - F.col("_c"))
    worst = p(F.col("N") - F.col("cum") + F.col("_c")) - p(F.col("N") - F.col("cum"))
    moments = drawn.groupBy(*group, "k").agg(
        F.sum(v * best).alias("b1"), F.sum(v * v * best).alias("b2"), F.sum(v * worst).alias("w1"), F.sum(v * v * worst).alias("w2"))
    sd = lambda a, b: F.sqrt(F.greatest(F.col(b) - F.col(a) * F.col(a), F.lit(0.0)))
    name = lambda w, s: F.concat(F.lit(f"{w}@"), F.col("k"), F.lit(f"/{s}"))
    draws = moments.select(*group, F.explode(F.array(
        F.struct(name("best", "mean").alias("metric"), F.col("b1").alias("value")), F.struct(name("best", "std").alias("metric"), sd("b1", "b2").alias("value")),
        F.struct(name("worst", "mean").alias("metric"), F.col("w1").alias("value")), F.struct(name("worst", "std").alias("metric"), sd("w1", "w2").alias("value")))).alias("_e"))
    both = basic.unionByName(draws.select(*group, "_e.metric", "_e.value"))
    return both.groupBy(source, "variable", "metric").agg(F.avg("value").alias("value"))


def win_chances(counts: Sequence[int], copies: Sequence[int], n: int) -> list[float]:
    """Chance of one answer to be the most frequent of ``n`` draws with replacement; equals share it.

    Class i has ``copies[i]`` answers of ``counts[i]`` rows each.  Draw counts are independent Poisson
    numbers that add up to n.  An answer wins with t draws if every other has fewer, or as many: then
    each of these is the first drawn equally often.  With y marking the others that tie, 1 / (ties + 1)
    is the integral of y ** ties from 0 to 1, so a Gauss rule over y replaces the sum over ties.  What remains is one
    coefficient of a product of powers of one polynomial per class, read off at the roots of
    unity.  Numbers of draws t whose chance is below 1e-20 add nothing to a double and are left out.
    """
    import numpy as np

    counts, copies = np.asarray(counts, float), np.asarray(copies, np.int64)
    if copies.sum() == 1:
        return [1.0]
    mean = n * counts / (counts * copies).sum()
    steps = np.arange(n + 1)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    mass = np.exp(steps[None, :] * np.log(mean)[:, None] - mean[:, None] - log_factorial[None, :])
    total = math.exp(n * math.log(n) - n - log_factorial[n])
    # sums beyond n by this much have no weight, so the coefficient does not wrap
    points = n + 64 + int(40 * math.sqrt(n))
    roots = np.exp(-2j * np.pi * np.arange(points // 2 + 1) / points)
    twice = np.full(len(roots), 2.0)
    twice[0] = 1.0
    if points % 2 == 0:
        twice[-1] = 1.0
    up_to = np.cumsum(mass, axis=1)
    with np.errstate(divide="ignore"):
        all_below = np.exp((copies[:, None] * np.log(np.minimum(up_to, 1.0))).sum(axis=0))  # all have t at most
    some_at = (copies[:, None] * mass).sum(axis=0)
    chances = np.zeros(len(counts))
    for t in range(1, n + 1):
        if min(all_below[t], some_at[t]) / total < 1e-20:
            continue
        less = np.fft.rfft(mass[:, :t], points, axis=1)
        as_many = mass[:, t, None] * roots[None, :] ** t
        read = twice * np.conj(roots ** (n - t)) / points
        ties = (n - t) // t
        spots, weights = np.polynomial.legendre.leggauss(min(ties // 2 + 1, 32 + int(some_at[t])))
        for spot, weight in zip((spots + 1) / 2, weights / 2, strict=True):
            one = less + spot * as_many
            fewer = one ** (copies - 1)[:, None]
            whole = fewer * one
            # the product over the other classes, from both sides
            ahead = np.cumprod(np.vstack([np.ones_like(whole[:1]), whole[:-1]]), axis=0)
            behind = np.cumprod(np.vstack([np.ones_like(whole[:1]), whole[:0:-1]]), axis=0)[::-1]
            chances += weight * mass[:, t] / total * ((fewer * ahead * behind) @ read).real
    return chances.tolist()


def majority_metrics(df: DataFrame, source: str, uid: str, pred: str, value: str) -> DataFrame:
    """maj@n: exact mean and deviation of the value that the most frequent of n drawn predictions has, then the mean over prompts.

    Draws are with replacement; of equally frequent predictions the one drawn first wins, and its
    first drawn row counts, which is any of its rows equally often.  Predictions of a prompt that
    occur equally often have the same chance, so a prompt is its distinct frequencies: at most the square root
    of twice its rows.
    """
    v = F.col(value).cast("double")
    votes = df.groupBy(source, uid, pred).agg(F.count(F.lit(1)).alias("c"), F.avg(v).alias("m"), F.avg(v * v).alias("q"))
    classes = votes.groupBy(source, uid, "c").agg(F.count(F.lit(1)).alias("r"), F.sum("m").alias("m"), F.sum("q").alias("q"))
    prompts = classes.groupBy(source, uid).agg(
        F.sum(F.col("c") * F.col("r")).alias("N"), F.array_sort(F.collect_list(F.struct("c", "r", "m", "q"))).alias("answers"))
    drawn = prompts.select(source, "answers", F.explode(_sizes(F.col("N"))).alias("k"))

    @F.pandas_udf("array<double>")
    def chances(counts: pd.Series, copies: pd.Series, sizes: pd.Series) -> pd.Series:
        known: dict[tuple, list[float]] = {}
        out = []
        for c, r, k in zip(counts, copies, sizes, strict=True):
            key = (tuple(int(x) for x in c), tuple(int(x) for x in r), int(k))
            if key not in known:
                known[key] = win_chances(*key)
            out.append(known[key])
        return pd.Series(out)

    won = drawn.withColumn("w", chances(F.col("answers.c"), F.col("answers.r"), F.col("k")))
    expected = lambda field: F.aggregate(F.zip_with("answers", "w", lambda a, w: a[field] * w), F.lit(0.0), lambda s, x: s + x)
    spread = expected("q") - expected("m") * expected("m")
    per = won.select(source, "k", expected("m").alias("m"), F.when(spread > 1e-12, F.sqrt(spread)).otherwise(0.0).alias("s"))
    return per.groupBy(source, "k").agg(F.avg("m").alias("maj_mean"), F.avg("s").alias("maj_std"))


def core_aux_labels(metrics: DataFrame, source: str) -> DataFrame:
    """``section``: val-core for mean/maj/best at the largest n of the main variable (acc, else reward), else val-aux."""
    n = F.regexp_extract("metric", r"@(\d+)", 1).cast("int")
    main = metrics.groupBy(source).agg(F.max(F.when(F.col("variable") == "acc", 1).otherwise(0)).alias("_acc"))
    top = metrics.groupBy(source, "variable").agg(F.max(n).alias("_n"))
    rows = join_null_safe(join_null_safe(metrics, main, [source]), top, [source, "variable"])
    core = (F.col("variable") == F.when(F.col("_acc") == 1, "acc").otherwise("reward")) & F.rlike("metric", F.lit("^(mean|maj|best)")) & (n == F.col("_n"))
    section = F.when(core, "val-core").otherwise("val-aux")
    return rows.withColumn("section", section).withColumn("name", F.concat_ws("/", section, source, "variable", "metric")).drop("_acc", "_n")


def benchmark_averages(labelled: DataFrame, source: str, members: Mapping[str, Sequence[str]], sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Mean of core mean@n over benchmark sets, where every member is present. ``members`` maps a benchmark to its source prefixes."""
    low = F.lower(F.col(source))
    bench = F.lit(None).cast("string")
    for name, prefixes in members.items():
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.startswith(low, F.lit(p))
        bench = F.when(hit, name).otherwise(bench)
    rows = labelled.filter((F.col("section") == "val-core") & (F.col("variable") == "acc") & F.startswith("metric", F.lit("mean@"))).withColumn("_b", bench)
    wide = rows.groupBy(F.regexp_extract("metric", r"@(\d+)", 1).cast("int").alias("n")).pivot("_b", list(members)).agg(F.avg("value"))
    out = F.array(*[F.struct(F.lit(s).alias("set"), sum([F.col(m) for m in ms[1:]], F.col(ms[0])).alias("t"), F.lit(len(ms)).alias("k")) for s, ms in sets.items()])
    return wide.select("n", F.explode(out).alias("e")).select("n", "e.set", (F.col("e.t") / F.col("e.k")).alias("value")).filter("value is not null")


def score_by_source(df: DataFrame, source: str, prompt: str, score: str) -> DataFrame:
    """Mean over prompts of the mean score of their responses."""
    per = df.groupBy(source, prompt).agg(F.avg(score).alias("_m"))
    return per.groupBy(source).agg(F.avg("_m").alias("test_score"), F.count(F.lit(1)).alias("prompts"))


def domain_macro_recovery(df: DataFrame, method: str, domain: str, benchmark: str, score: str, *, base: str, reference: str) -> DataFrame:
    """Benchmark means to domain to total per method, and the share of the base-reference gap recovered."""
    bench = df.groupBy(method, domain, benchmark).agg(F.avg(score).alias("b"))
    dom = bench.groupBy(method, domain).agg(F.avg("b").alias("d"))
    total = dom.groupBy(method).agg(F.avg("d").alias("total"))
    ends = total.agg(F.struct(F.max(F.when(F.col(method) == base, F.col("total"))).alias("b"),
                              F.max(F.when(F.col(method) == reference, F.col("total"))).alias("r")).alias("e")).scalar()
    rec = total.withColumn("_e", ends).withColumn("recovery", F.when(F.col(method) != base, F.try_divide(
        F.col("total") - F.col("_e.b"), F.col("_e.r") - F.col("_e.b")))).drop("_e")
    return join_null_safe(dom, rec, [method])


def special_token_counts(tokens: Column, special: Sequence) -> Column:
    """Counts of the special ids that occur, as JSON with sorted keys."""
    ids = F.array_sort(F.array_intersect(tokens, F.array(*[F.lit(s) for s in special])))
    pairs = F.transform(ids, lambda i: F.concat(F.lit('"'), i.cast("string"), F.lit('": '), F.size(F.filter(tokens, lambda t: t == i)).cast("string")))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def flatten_completions(df: DataFrame, keys: Sequence[str], outputs: str) -> DataFrame:
    """One row per completion of an array of (text, tokens, finish_reason, stop_reason); none still gives one empty row."""
    rows = df.select(*keys, F.posexplode_outer(outputs).alias("_i", "_o"))
    return rows.select(*keys, F.coalesce("_i", F.lit(0)).alias("completion_index"), F.coalesce("_o.text", F.lit("")).alias("completion"),
                       F.coalesce("_o.tokens", F.lit(0)).cast("int").alias("completion_tokens"), "_o.finish_reason", "_o.stop_reason")


def sample_browser(df: DataFrame, fields: Sequence[str], text: str, keyword: str, order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """Rows that contain the keyword with its number of hits; ``limit`` gives the first ones in order."""
    hit = df.filter(F.contains(F.col(text), F.lit(keyword)))
    out = hit.select(*fields, F.regexp_count(F.col(text), F.lit(r"\Q" + keyword + r"\E")).alias("hits"))
    # ranges of the order, and of these only as many as hold the first rows
    return out if limit is None else cumulate(with_range_bucket(out, list(order)), list(order), [], "_p", keep=limit).drop("_p")


def distributions(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Value counts of several columns as (field, value, n), optionally the most frequent per field."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_z"))
    counts = long.groupBy("_z.field", "_z.value").agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return counts
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.col("n").desc(), F.col("value")))
    return counts.withColumn("_r", rank).filter(F.col("_r") <= top).drop("_r")


def _overlap_share(text: str) -> float:
    """2 * sum of common prefixes of neighbouring suffixes / (n * (n + 1))."""
    import numpy as np

    n = len(text)
    if n <= 1:
        return 0.0
    rank = np.unique(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), return_inverse=True)[1].astype(np.int64)
    levels, width = [rank], 1
    while rank.max() < n - 1 and width < n:
        nxt = np.full(n, -1, dtype=np.int64)
        nxt[: n - width] = rank[width:]
        rank = np.unique(rank * (n + 1) + nxt + 1, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        width *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, dtype=bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = (1 << k) * same
        # equal ranks at this level mean equal windows only when both fit into the text
        fits = (a + (1 << k) <= n) & (b + (1 << k) <= n)
        step = np.where(fits, step, 0)
        a, b, common = a + step, b + step, common + step
    return 2.0 * float(common.sum()) / (n * (n + 1))


def self_overlap_flag(df: DataFrame, text: str, threshold: float = 0.2) -> DataFrame:
    """Append ``overlap`` and ``overlapping``: how much of a text repeats inside itself."""
    overlap = F.pandas_udf(lambda texts: texts.map(lambda t: _overlap_share(t or "")), "double")
    return df.withColumn("overlap", overlap(F.col(text))).withColumn("overlapping", F.col("overlap") > threshold)
