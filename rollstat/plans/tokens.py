"""Token-log statistics: masks, advantages, divergences, ratios."""
from __future__ import annotations

from pyspark.sql import functions as F

from rollstat.operators import advantages as A
from rollstat.plans.registry import query
from rollstat.plans.views import TOK, q8, q8s, rounded, table, v_roll, v_tok, with_ctes

# masked moments of an expression over valid tokens, as SQL
MOMENTS = """mom AS (SELECT sum(mask) AS m, sum(x * mask) / (sum(mask) + 1e-8) AS mean FROM src),
var AS (SELECT any_value(m) AS m, any_value(mean) AS mean, sum((x - mean) * (x - mean) * mask) / (any_value(m) + 1e-8)
        * (any_value(m) / (any_value(m) - 1)) AS v FROM src, mom)"""
WHITE = "(x - (SELECT mean FROM var)) / sqrt((SELECT v FROM var) + 1e-8)"


@query("masked_stats", with_ctes(TOK, "src AS (SELECT reward AS x, mask FROM v_tok)", MOMENTS) + f"""
SELECT m::DOUBLE AS n_valid, {q8("(SELECT sum(x * mask) FROM src)", "masked_sum")}, {q8("mean", "masked_mean")}, {q8("v", "masked_var")} FROM var""")
def masked_stats(spark, sf):
    return rounded(A.masked_stats(v_tok(spark, sf), "reward", "mask"), "masked_sum", "masked_mean", "masked_var")


@query("masked_stats_by_domain", with_ctes(TOK) + f"""
, s AS (SELECT domain, sum(mask) AS m, sum(reward * mask) / (sum(mask) + 1e-8) AS mean FROM v_tok GROUP BY domain)
SELECT domain, any_value(m)::DOUBLE AS n_valid, {q8("sum(reward * mask)", "masked_sum")}, {q8("any_value(mean)", "masked_mean")},
 {q8("sum((reward - mean) * (reward - mean) * mask) / (any_value(m) + 1e-8) * (any_value(m) / (any_value(m) - 1))", "masked_var")}
FROM v_tok JOIN s USING (domain) GROUP BY domain""".replace("\n, s AS", ", s AS"))
def masked_stats_by_domain(spark, sf):
    return rounded(A.masked_stats(v_tok(spark, sf), "reward", "mask", ["domain"]), "masked_sum", "masked_mean", "masked_var")


@query("whiten", with_ctes(TOK, "src AS (SELECT sample_id, pos, value AS x, mask FROM v_tok)", MOMENTS) + f"""
SELECT sample_id, pos::INTEGER AS pos, {q8(WHITE, "whitened")}, {q8(WHITE + " + (SELECT mean FROM var)", "whitened_kept_mean")} FROM src""")
def whiten(spark, sf):
    rows = A.whiten(v_tok(spark, sf), "value", "mask", "whitened")
    rows = A.whiten(rows, "value", "mask", "whitened_kept_mean", shift_mean=False)
    return rounded(rows.select("sample_id", "pos", "whitened", "whitened_kept_mean"), "whitened", "whitened_kept_mean")


@query("response_mask", with_ctes(TOK) + """SELECT sample_id, pos::INTEGER AS pos, CAST(sum(is_end) OVER (PARTITION BY sample_id ORDER BY pos) - is_end = 0 AS INTEGER) AS response_mask FROM v_tok""")
def response_mask(spark, sf):
    return A.response_mask(v_tok(spark, sf, "sample_id", "pos", "is_end"), "sample_id", "pos", "is_end").select("sample_id", "pos", "response_mask")


@query("adv_process", with_ctes(TOK) + f"""
, g AS (SELECT uid, count(*) FILTER (mask = 1) AS n, avg(reward) FILTER (mask = 1) AS m, stddev_samp(reward) FILTER (mask = 1) AS sd FROM v_tok GROUP BY uid),
z AS (SELECT t.sample_id, t.pos, t.mask, CASE WHEN t.mask = 0 THEN 0 WHEN g.n <= 1 THEN t.reward / (1 + 1e-6) ELSE (t.reward - g.m) / (g.sd + 1e-6) END AS r FROM v_tok t JOIN g USING (uid))
SELECT sample_id, pos::INTEGER AS pos, {q8("mask * sum(r) OVER (PARTITION BY sample_id ORDER BY pos DESC)", "advantage")} FROM z""".replace("\n, g AS", ", g AS"))
def adv_process(spark, sf):
    out = A.adv_process(v_tok(spark, sf, "uid", "sample_id", "pos", "reward", "mask"), "uid", "sample_id", "pos", "reward", "mask")
    return rounded(out.select("sample_id", "pos", "advantage"), "advantage")


@query("adv_group_baseline_whitened", with_ctes(TOK) + f"""
, s AS (SELECT uid, sample_id, sum(reward) AS sc FROM v_tok GROUP BY ALL),
b AS (SELECT sample_id, sc - CASE WHEN count(*) OVER (PARTITION BY uid) = 1 THEN 0 ELSE avg(sc) OVER (PARTITION BY uid) END AS adv FROM s),
src AS (SELECT t.sample_id, t.pos, t.mask, b.adv * t.mask AS x FROM v_tok t JOIN b USING (sample_id)),
{MOMENTS}
SELECT sample_id, pos::INTEGER AS pos, {q8(f"mask * {WHITE}", "advantage")} FROM src""".replace("\n, s AS", ", s AS"))
def adv_group_baseline_whitened(spark, sf):
    out = A.adv_group_baseline_whitened(v_tok(spark, sf), "uid", "sample_id", "reward", "mask")
    return rounded(out.select("sample_id", "pos", "advantage"), "advantage")


@query("adv_discounted_return", with_ctes(TOK) + f"""
, last AS (SELECT sample_id, max(pos) AS mp FROM v_tok GROUP BY 1),
tt AS MATERIALIZED (SELECT sample_id, pos, mask, reward FROM v_tok),
go(sample_id, pos, mask, ret) AS (SELECT t.sample_id, t.pos, t.mask, t.reward FROM tt t JOIN last l ON t.sample_id = l.sample_id AND t.pos = l.mp
 UNION ALL SELECT t.sample_id, t.pos, t.mask, t.reward + 0.9 * g.ret * g.mask FROM go g JOIN tt t ON t.sample_id = g.sample_id AND t.pos = g.pos - 1),
src AS (SELECT sample_id, pos, mask, ret AS x FROM go), {MOMENTS}
SELECT sample_id, pos::INTEGER AS pos, {q8("x", "returns")}, {q8(f"mask * {WHITE}", "advantage")} FROM src""".replace("\n, last AS", ", last AS"))
def adv_discounted_return(spark, sf):
    out = A.adv_discounted_return(v_tok(spark, sf, "sample_id", "pos", "reward", "mask"), "sample_id", "pos", "reward", "mask", gamma=0.9)
    return rounded(out.select("sample_id", "pos", "returns", "advantage"), "returns", "advantage")


@query("adv_greedy_baseline", with_ctes(TOK) + f"""
, r AS (SELECT sample_id, pos, mask, sum(reward * mask) OVER (PARTITION BY sample_id ORDER BY pos DESC) AS ret FROM v_tok)
SELECT sample_id, pos::INTEGER AS pos, {q8("ret", "returns")}, {q8("ret - o_totalprice / 100000 * mask", "advantage")}
FROM r JOIN orders ON sample_id = o_orderkey""".replace("\n, r AS", ", r AS"))
def adv_greedy_baseline(spark, sf):
    base = v_roll(spark, sf).select("sample_id", F.col("score").alias("baseline"))
    out = A.adv_greedy_baseline(v_tok(spark, sf, "sample_id", "pos", "reward", "mask"), base, "sample_id", "pos", "reward", "mask")
    return rounded(out.select("sample_id", "pos", "returns", "advantage"), "returns", "advantage")


@query("adv_gae", with_ctes(TOK) + f"""
, last AS (SELECT sample_id, max(pos) AS mp FROM v_tok GROUP BY 1),
tt AS MATERIALIZED (SELECT sample_id, pos, mask, reward, value FROM v_tok),
go(sample_id, pos, mask, value, nv, adv) AS (
 SELECT t.sample_id, t.pos, t.mask, t.value, t.value * t.mask, (t.reward - t.value) * t.mask FROM tt t JOIN last l ON t.sample_id = l.sample_id AND t.pos = l.mp
 UNION ALL SELECT t.sample_id, t.pos, t.mask, t.value, t.value * t.mask + (1 - t.mask) * g.nv,
  (t.reward + 0.99 * g.nv - t.value + 0.99 * 0.95 * g.adv) * t.mask + (1 - t.mask) * g.adv
 FROM go g JOIN tt t ON t.sample_id = g.sample_id AND t.pos = g.pos - 1),
src AS (SELECT sample_id, pos, mask, value, adv AS x FROM go), {MOMENTS}
SELECT sample_id, pos::INTEGER AS pos, {q8("x + value", "returns")}, {q8(WHITE, "advantage")} FROM src""".replace("\n, last AS", ", last AS"))
def adv_gae(spark, sf):
    out = A.adv_gae(v_tok(spark, sf, "sample_id", "pos", "reward", "value", "mask"), "sample_id", "pos", "reward", "value", "mask", gamma=0.99, lam=0.95)
    return rounded(out.select("sample_id", "pos", "returns", "advantage"), "returns", "advantage")


@query("adv_process_loo", with_ctes(TOK) + f"""
, s AS (SELECT uid, sample_id, avg(reward) FILTER (mask = 1) AS sm, max(pos) FILTER (mask = 1) AS lp FROM v_tok GROUP BY ALL),
q AS (SELECT s.*, CAST(o_orderstatus = 'F' AS INTEGER)::DOUBLE AS acc FROM s JOIN orders ON sample_id = o_orderkey WHERE lp IS NOT NULL),
b AS (SELECT sample_id, lp, acc, count(*) OVER w AS n, sum(sm) OVER w AS ps, sum(acc) OVER w AS sa FROM q WINDOW w AS (PARTITION BY uid)),
r AS (SELECT t.sample_id, t.pos, t.mask, t.mask * (
   coalesce(CASE WHEN t.mask = 0 THEN 0 WHEN n > 1 THEN t.reward * n / (n - 1) - ps / (n - 1) ELSE t.reward END, 0)
   + 0.5 * CASE WHEN t.pos = lp THEN CASE WHEN n > 1 THEN acc * n / (n - 1) - sa / (n - 1) ELSE acc END ELSE 0 END) AS r
   FROM v_tok t LEFT JOIN b USING (sample_id)),
src AS (SELECT sample_id, pos, mask, sum(r) OVER (PARTITION BY sample_id ORDER BY pos DESC) AS x FROM r), {MOMENTS}
SELECT sample_id, pos::INTEGER AS pos, {q8("x", "returns")}, {q8(WHITE, "advantage")} FROM src""".replace("\n, s AS", ", s AS"))
def adv_process_loo(spark, sf):
    outcomes = v_roll(spark, sf).select("sample_id", "acc")
    out = A.adv_process_loo(v_tok(spark, sf, "uid", "sample_id", "pos", "reward", "mask"), outcomes, "uid", "sample_id", "pos", "reward", "mask", outcome_coef=0.5)
    return rounded(out.select("sample_id", "pos", "returns", "advantage"), "returns", "advantage")


@query("adv_token_direct", with_ctes(TOK) + f"SELECT sample_id, pos::INTEGER AS pos, {q8('reward * mask', 'advantage')} FROM v_tok")
def adv_token_direct(spark, sf):
    out = A.adv_token_direct(v_tok(spark, sf), "reward", "mask")
    return rounded(out.select("sample_id", "pos", "advantage"), "advantage")


@query("adv_direct_plus_outcome", with_ctes(TOK) + f"""
, s AS (SELECT uid, sample_id, sum(reward) AS sc FROM v_tok GROUP BY ALL),
g AS (SELECT sample_id, CASE WHEN count(*) OVER w = 1 THEN sc / (1 + 1e-6) ELSE (sc - avg(sc) OVER w) / (stddev_samp(sc) OVER w + 1e-6) END AS o FROM s WINDOW w AS (PARTITION BY uid))
SELECT sample_id, pos::INTEGER AS pos, {q8("reward * mask + CASE WHEN token_id % 3 = 0 THEN 2 * o * mask ELSE 0 END", "adv_first")},
 {q8("value * mask + CASE WHEN token_id % 3 = 1 THEN 2 * o * mask ELSE 0 END", "adv_second")},
 CAST(CASE WHEN token_id % 3 < 2 THEN mask ELSE 0 END AS INTEGER) AS sampled_hit FROM v_tok JOIN g USING (sample_id)""".replace("\n, s AS", ", s AS"))
def adv_direct_plus_outcome(spark, sf):
    tok = v_tok(spark, sf)
    scores = tok.groupBy("uid", "sample_id").agg(F.sum("reward").alias("score"))
    outcome = A.adv_group_relative(scores, "uid", "score", name="outcome").select("sample_id", "outcome")
    rows = tok.join(outcome, "sample_id").withColumn("ids", F.array(F.lit(0), F.lit(1))).withColumn(
        "cand", F.array("reward", "value")).withColumn("sampled", (F.col("token_id") % 3).cast("int"))
    out = A.adv_direct_plus_outcome(rows, "ids", "sampled", "cand", "outcome", "mask", weight=2.0)
    out = out.select("sample_id", "pos", F.col("advantage")[0].alias("adv_first"), F.col("advantage")[1].alias("adv_second"), "sampled_hit")
    return rounded(out, "adv_first", "adv_second")


@query("sampled_coverage", with_ctes(TOK) + f"""SELECT sample_id, {q8("sum(CASE WHEN token_id % 3 < 2 THEN mask ELSE 0 END) / greatest(sum(mask), 1)", "coverage")} FROM v_tok GROUP BY 1""")
def sampled_coverage(spark, sf):
    hit = v_tok(spark, sf).withColumn("sampled_hit", F.when(F.col("token_id") % 3 < 2, F.col("mask")).otherwise(0))
    return rounded(A.sampled_coverage(hit, "sample_id", "mask"), "coverage")


@query("kl_estimates", with_ctes(TOK) + f"""SELECT sample_id, pos::INTEGER AS pos, {q8("logp_old - logp_ref", "k1")}, {q8("abs(logp_old - logp_ref)", "abs")},
 {q8("0.5 * pow(logp_old - logp_ref, 2)", "k2")}, {q8("least(10, greatest(-10, exp(logp_ref - logp_old) - (logp_ref - logp_old) - 1))", "k3")} FROM v_tok""")
def kl_estimates(spark, sf):
    a, b = F.col("logp_old"), F.col("logp_ref")
    out = v_tok(spark, sf).select("sample_id", "pos", *[A.kl_estimate(a, b, k).alias(k) for k in ("k1", "abs", "k2", "k3")])
    return rounded(out, "k1", "abs", "k2", "k3")


KL_PATH = """ks AS (SELECT step, sample_id, sum((logp_old - logp_ref) * mask) / (sum(mask) + 1e-8) AS k FROM v_tok GROUP BY ALL),
st AS (SELECT step, avg(k) AS kl, count(*) AS n, row_number() OVER (ORDER BY step) AS i FROM ks GROUP BY step),
path(i, step, kl, n, beta, nb) AS (
 SELECT i, step, kl, n, 0.2::DOUBLE, 0.2 * (1 + greatest(-0.2, least(0.2, kl / 0.1 - 1)) * n / 1000.0::DOUBLE) FROM st WHERE i = 1
 UNION ALL SELECT s.i, s.step, s.kl, s.n, p.nb, p.nb * (1 + greatest(-0.2, least(0.2, s.kl / 0.1 - 1)) * s.n / 1000.0::DOUBLE) FROM path p JOIN st s ON s.i = p.i + 1)"""


@query("kl_coefficient_path", with_ctes(TOK, KL_PATH) + f"SELECT step, n::BIGINT AS n, {q8('kl', 'kl')}, {q8('beta', 'beta')}, {q8('nb', 'next_beta')} FROM path")
def kl_coefficient_path(spark, sf):
    out = A.kl_path(v_tok(spark, sf), "step", "sample_id", A.kl_estimate(F.col("logp_old"), F.col("logp_ref"), "k1"), "mask",
                    beta=0.2, target=0.1, horizon=1000.0)
    return rounded(out, "kl", "beta", "next_beta")


@query("kl_penalised_reward", with_ctes(TOK, KL_PATH) + f"""SELECT sample_id, pos::INTEGER AS pos, {q8("reward - beta * (logp_old - logp_ref) * mask", "penalised")}
FROM v_tok JOIN path USING (step)""")
def kl_penalised_reward(spark, sf):
    out = A.kl_penalised_reward(v_tok(spark, sf), "step", "sample_id", "reward", "logp_old", "logp_ref", "mask",
                                beta=0.2, target=0.1, horizon=1000.0)
    return rounded(out.select("sample_id", "pos", "penalised"), "penalised")


@query("aggregate_token_values", with_ctes(TOK) + f"""
, s AS (SELECT sample_id, sum(reward * mask) AS sm, sum(mask) AS m FROM v_tok GROUP BY 1)
SELECT 'token-mean' AS mode, {q8("sum(sm) / (sum(m) + 1e-8)", "value")} FROM s UNION ALL
SELECT 'seq-mean-token-sum', {q8("sum(CASE WHEN m > 0 THEN sm ELSE 0 END) / (count(*) FILTER (m > 0) + 1e-8)", "value")} FROM s UNION ALL
SELECT 'seq-mean-token-mean', {q8("sum(CASE WHEN m > 0 THEN sm / (m + 1e-8) ELSE 0 END) / (count(*) FILTER (m > 0) + 1e-8)", "value")} FROM s UNION ALL
SELECT 'seq-sum-norm', {q8("sum(sm) / 16", "value")} FROM s""".replace("\n, s AS", ", s AS"))
def aggregate_token_values(spark, sf):
    out = None
    for mode in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-sum-norm"):
        one = A.aggregate_token_values(v_tok(spark, sf), "sample_id", "reward", "mask", mode, length=16)
        one = one.select(F.lit(mode).alias("mode"), "value")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "value")


@query("entropy_by_step", with_ctes(TOK) + f"""
, s AS (SELECT step, sample_id, sum(-logp_old * mask) AS sm, sum(mask) AS m FROM v_tok GROUP BY ALL)
SELECT step, {q8("sum(CASE WHEN m > 0 THEN sm / (m + 1e-8) ELSE 0 END) / (count(*) FILTER (m > 0) + 1e-8)", "entropy")} FROM s GROUP BY step""".replace("\n, s AS", ", s AS"))
def entropy_by_step(spark, sf):
    rows = v_tok(spark, sf).withColumn("ent", -F.col("logp_old"))
    out = A.aggregate_token_values(rows, "sample_id", "ent", "mask", "seq-mean-token-mean", ["step"])
    return rounded(out.withColumnRenamed("value", "entropy"), "entropy")


RATIO_COLS = ("token_loss", "token_kl", "clip_high", "clip_low", "seq_loss", "seq_clip", "geo_loss", "geo_clip_high", "geo_clip_low")


@query("ratio_diagnostics", with_ctes(TOK) + f"""
, t AS (SELECT sample_id, mask, reward - 0.5 AS a, logp_old - logp_rollout AS d FROM v_tok),
u AS (SELECT *, exp(d) AS r, sum(d * mask) OVER w / greatest(sum(mask) OVER w, 1) AS sl FROM t WINDOW w AS (PARTITION BY sample_id)),
l AS (SELECT *, -a * r AS l1, -a * greatest(0.8, least(1.2, r)) AS l2, -a * 3 AS l3, exp(least(sl, 10)) AS sr,
   sign(a) * least(sign(a) * d, sign(a) * greatest(-0.2, least(0.2, d))) AS gd, greatest(-0.2, least(0.2, d)) AS dc FROM u),
k AS (SELECT *, CASE WHEN a < 0 THEN least(l3, greatest(l1, l2)) ELSE greatest(l1, l2) END AS ls,
   -a * sr AS s1, -a * greatest(0.8, least(1.2, sr)) AS s2 FROM l),
q AS (SELECT sample_id, sum(mask) AS m, sum(greatest(s1, s2) * mask) AS sl, sum(gd * mask) AS g, sum(a * mask) AS sa FROM k GROUP BY 1)
SELECT (SELECT sum(mask) FROM k)::BIGINT AS n_tokens,
 {q8("(SELECT sum(ls * mask) / (sum(mask) + 1e-8) FROM k)", "token_loss")}, {q8("(SELECT sum(-d * mask) / (sum(mask) + 1e-8) FROM k)", "token_kl")},
 {q8("(SELECT sum(CASE WHEN l2 > l1 THEN mask ELSE 0 END) / (sum(mask) + 1e-8) FROM k)", "clip_high")},
 {q8("(SELECT sum(CASE WHEN greatest(l1, l2) > l3 AND a < 0 THEN mask ELSE 0 END) / (sum(mask) + 1e-8) FROM k)", "clip_low")},
 {q8("(SELECT sum(CASE WHEN m > 0 THEN sl / (m + 1e-8) ELSE 0 END) / (count(*) FILTER (m > 0) + 1e-8) FROM q)", "seq_loss")},
 {q8("(SELECT sum(CASE WHEN s2 > s1 THEN mask ELSE 0 END) / (sum(mask) + 1e-8) FROM k)", "seq_clip")},
 {q8("(SELECT avg(-(sa / (m + 1e-8)) * exp(g / (m + 1e-8))) FROM q)", "geo_loss")},
 {q8("(SELECT sum(CASE WHEN d <> dc AND a > 0 THEN mask ELSE 0 END) / (sum(mask) + 1e-8) FROM k)", "geo_clip_high")},
 {q8("(SELECT sum(CASE WHEN d <> dc AND a < 0 THEN mask ELSE 0 END) / (sum(mask) + 1e-8) FROM k)", "geo_clip_low")}""".replace("\n, t AS", ", t AS"))
def ratio_diagnostics(spark, sf):
    rows = v_tok(spark, sf).withColumn("adv", F.col("reward") - 0.5)
    return rounded(A.ratio_diagnostics(rows, "sample_id", "logp_old", "logp_rollout", "adv", "mask"), *RATIO_COLS)


@query("covariance_outliers", with_ctes(TOK) + f"""
, v AS (SELECT sample_id, pos, reward - 0.5 AS a, logp_old AS l, logp_rollout AS o FROM v_tok WHERE mask = 1),
c AS (SELECT *, round((a - (SELECT avg(a) FROM v)) * (l - (SELECT avg(l) FROM v)), 9) AS cov FROM v),
r AS (SELECT *, row_number() OVER (ORDER BY cov DESC, sample_id, pos) AS rn, count(*) OVER () AS n FROM c)
SELECT any_value(n)::BIGINT AS n_valid, count(*) FILTER (cov > 0.1 AND cov < 0.15)::BIGINT AS in_band,
 greatest(1, floor(any_value(n) * 0.002))::BIGINT AS band_budget, count(*) FILTER (rn <= greatest(1, floor(n * 0.002)))::BIGINT AS top_n,
 {q8("sum(abs(l - o)) FILTER (rn <= greatest(1, floor(n * 0.002)))", "top_abs_ratio")}, {q8("min(cov) FILTER (rn <= greatest(1, floor(n * 0.002)))", "top_cov_min")}
FROM r""".replace("\n, v AS", ", v AS"))
def covariance_outliers(spark, sf):
    rows = v_tok(spark, sf).withColumn("adv", F.col("reward") - 0.5)
    out = A.covariance_outliers(rows, "logp_old", "logp_rollout", "adv", "mask", ["sample_id", "pos"], share=0.002, low=0.1, high=0.15)
    return rounded(out, "top_abs_ratio", "top_cov_min")


@query("value_clip_diagnostics", with_ctes(TOK) + f"""
, e AS (SELECT mask, pow(reward * 2 - value, 2) AS e1, pow(greatest(reward - 0.5, least(reward + 0.5, reward * 2)) - value, 2) AS e2 FROM v_tok)
SELECT {q8("0.5 * sum(greatest(e1, e2) * mask) / (sum(mask) + 1e-8)", "value_loss")},
 {q8("sum(CASE WHEN e2 > e1 THEN mask ELSE 0 END) / (sum(mask) + 1e-8)", "value_clip")} FROM e""".replace("\n, e AS", ", e AS"))
def value_clip_diagnostics(spark, sf):
    rows = v_tok(spark, sf).withColumn("pred", F.col("reward") * 2)
    return rounded(A.value_clip_diagnostics(rows, "pred", "reward", "value", "mask"), "value_loss", "value_clip")
