"""Statistics over prompt groups of the rollout table."""
from __future__ import annotations

from pyspark.sql import functions as F

from rollstat.operators import advantages as A
from rollstat.operators import sampling as S
from rollstat.plans.registry import query
from rollstat.plans.views import ROLL, TOK, q8, q8s, rounded, table, v_roll, v_tok, with_ctes

GROUP_ADV = """
g AS (SELECT uid, count(*) AS n, avg(score) AS m, stddev_samp(score) AS sd, var_samp(score) AS v FROM v_roll GROUP BY uid),
a AS (SELECT r.*, g.n, CASE WHEN g.n = 1 THEN r.score / (1 + 1e-6) ELSE (r.score - g.m) / (g.sd + 1e-6) END AS advantage
      FROM v_roll r JOIN g ON r.uid = g.uid)"""


@query("group_mean_std", with_ctes(ROLL) + f"""SELECT uid, count(*)::BIGINT AS n,
 {q8("CASE WHEN count(*) = 1 THEN 0 ELSE avg(score) END", "mean")},
 {q8("CASE WHEN count(*) = 1 THEN 1 ELSE sqrt(greatest(var_samp(score), 1e-6)) END", "std")}
 FROM v_roll GROUP BY uid""")
def group_mean_std(spark, sf):
    return rounded(A.group_mean_std(v_roll(spark, sf), "uid", "score"), "mean", "std")


@query("adv_group_relative", with_ctes(ROLL + "," + GROUP_ADV) + f"SELECT uid, sample_id, {q8('advantage', 'advantage')} FROM a")
def adv_group_relative(spark, sf):
    out = A.adv_group_relative(v_roll(spark, sf), "uid", "score")
    return rounded(out.select("uid", "sample_id", "advantage"), "advantage")


@query("adv_group_centered", with_ctes(ROLL) + f"""SELECT r.sample_id, {q8("CASE WHEN g.n = 1 THEN score ELSE score - m END", "advantage")}
 FROM v_roll r JOIN (SELECT uid, count(*) n, avg(score) m FROM v_roll GROUP BY uid) g USING (uid)""")
def adv_group_centered(spark, sf):
    out = A.adv_group_relative(v_roll(spark, sf), "uid", "score", by_std=False)
    return rounded(out.select("sample_id", "advantage"), "advantage")


@query("adv_group_vectorized", with_ctes(ROLL) + f"""SELECT r.sample_id,
 {q8("CASE WHEN g.n = 1 THEN score / (1 + 1e-6) ELSE (score - m) / (sqrt(greatest(v, 1e-6)) + 1e-6) END", "advantage")}
 FROM v_roll r JOIN (SELECT uid, count(*) n, avg(score) m, var_samp(score) v FROM v_roll GROUP BY uid) g USING (uid)""")
def adv_group_vectorized(spark, sf):
    out = A.adv_group_relative(v_roll(spark, sf), "uid", "score", floor_variance=True)
    return rounded(out.select("sample_id", "advantage"), "advantage")


@query("adv_group_overlong_excluded", with_ctes(ROLL) + f"""
, x AS (SELECT r.*, l.n_tok FROM v_roll r JOIN (SELECT l_orderkey, count(*) AS n_tok FROM lineitem GROUP BY 1) l ON r.sample_id = l.l_orderkey),
g AS (SELECT uid, count(*) FILTER (n_tok < 6) AS n, avg(score) FILTER (n_tok < 6) AS m, stddev_samp(score) FILTER (n_tok < 6) AS sd FROM x GROUP BY uid)
SELECT sample_id, {q8("CASE WHEN n_tok >= 6 THEN 0 WHEN n <= 1 THEN score / (1 + 1e-6) ELSE (score - m) / (sd + 1e-6) END", "advantage")}
FROM x JOIN g USING (uid)""".replace("\n, x AS", ", x AS"))
def adv_group_overlong_excluded(spark, sf):
    lengths = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.count(F.lit(1)).alias("n_tok"))
    rows = v_roll(spark, sf).join(lengths, "sample_id")
    out = A.adv_group_relative(rows, "uid", "score", excluded=A.truncated_rows("score", "n_tok", 6))
    return rounded(out.select("sample_id", "advantage"), "advantage")


@query("advantage_by_domain", with_ctes(ROLL + "," + GROUP_ADV) + f"""
, k AS (SELECT uid FROM v_roll GROUP BY uid HAVING stddev_pop(acc) > 0 OR count(*) = 1)
SELECT domain, count(*)::BIGINT AS n_rows, count(DISTINCT uid)::BIGINT AS n_groups, {q8('avg(abs(advantage))', 'mean_abs_advantage')},
 {q8('avg(CASE WHEN advantage > 0 THEN 1.0 ELSE 0.0 END)', 'positive_share')}
FROM a WHERE uid IN (SELECT uid FROM k) GROUP BY domain""".replace("\n, k AS", ", k AS"))
def advantage_by_domain(spark, sf):
    adv = A.adv_group_relative(v_roll(spark, sf), "uid", "score")
    kept = S.informative_groups(adv, "uid", "acc")
    out = kept.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("uid").alias("n_groups"),
        F.avg(F.abs("advantage")).alias("mean_abs_advantage"),
        F.avg(F.when(F.col("advantage") > 0, 1.0).otherwise(0.0)).alias("positive_share"))
    return rounded(out, "mean_abs_advantage", "positive_share")


@query("adv_pass_k", with_ctes(ROLL) + f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, sample_id) AS rn,
        lead(score) OVER (PARTITION BY uid ORDER BY score DESC, sample_id) AS second,
        stddev_samp(score) OVER (PARTITION BY uid) AS sd, count(*) OVER (PARTITION BY uid) AS n FROM v_roll)
SELECT uid, sample_id, {q8("CASE WHEN rn = 1 THEN (score - second) / (sd + 1e-6) ELSE 0 END", "advantage")} FROM r WHERE n >= 2""".replace("\n, r AS", ", r AS"))
def adv_pass_k(spark, sf):
    rows = v_roll(spark, sf)
    many = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("uid")
    out = A.adv_pass_k(rows.join(many, "uid", "left_semi"), "uid", "score", "sample_id")
    return rounded(out.select("uid", "sample_id", "advantage"), "advantage")


LOO = with_ctes(ROLL) + """SELECT sample_id, {expr}
 FROM v_roll JOIN (SELECT uid, count(*) n, avg(score) m FROM v_roll GROUP BY uid) g USING (uid)"""


@query("adv_leave_one_out", LOO.format(expr=q8("CASE WHEN n = 1 THEN score ELSE n / (n - 1) * (score - m) END", "advantage")))
def adv_leave_one_out(spark, sf):
    out = A.adv_leave_one_out(v_roll(spark, sf), "uid", "score", singleton_keeps_score=True)
    return rounded(out.select("sample_id", "advantage"), "advantage")


@query("adv_leave_one_out_vectorized", LOO.format(expr=q8("CASE WHEN n = 1 THEN 0 ELSE n / (n - 1) * (score - m) END", "advantage")))
def adv_leave_one_out_vectorized(spark, sf):
    out = A.adv_leave_one_out(v_roll(spark, sf), "uid", "score", singleton_keeps_score=False)
    return rounded(out.select("sample_id", "advantage"), "advantage")


@query("adv_length_weighted", with_ctes(ROLL) + f"""
, x AS (SELECT r.*, l.n_tok FROM v_roll r JOIN (SELECT l_orderkey, count(*) AS n_tok FROM lineitem GROUP BY 1) l ON r.sample_id = l.l_orderkey),
g AS (SELECT uid, count(*) AS n, sum(n_tok * score) / sum(n_tok) AS b FROM x GROUP BY uid)
SELECT sample_id, {q8("CASE WHEN n = 1 THEN score ELSE score - b END", "advantage")} FROM x JOIN g USING (uid)""".replace("\n, x AS", ", x AS"))
def adv_length_weighted(spark, sf):
    lengths = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.count(F.lit(1)).alias("n_tok"))
    out = A.adv_length_weighted(v_roll(spark, sf).join(lengths, "sample_id"), "uid", "score", "n_tok")
    return rounded(out.select("sample_id", "advantage"), "advantage")


@query("adv_scaled_centered", with_ctes(ROLL) + f"""
, t AS (SELECT count(*) AS n, count(*) FILTER (acc <> 0) AS nz FROM v_roll)
SELECT sample_id, {q8("(SELECT n FROM t) / greatest((SELECT nz FROM t), 1) * (acc - CASE WHEN g.n = 1 THEN 0 ELSE m END) / 2.0", "advantage")}
FROM v_roll JOIN (SELECT uid, count(*) n, avg(acc) m FROM v_roll GROUP BY uid) g USING (uid)""".replace("\n, t AS", ", t AS"))
def adv_scaled_centered(spark, sf):
    out = A.adv_scaled_centered(v_roll(spark, sf), "uid", "acc", f_norm=2.0)
    return rounded(out.select("sample_id", "advantage"), "advantage")


@query("soft_mean_center", with_ctes(ROLL) + f"""SELECT sample_id, {q8("score - (mx + ln(me)) / 0.5", "centered")}
 FROM v_roll JOIN (SELECT uid, mx, avg(exp(score * 0.5 - mx)) AS me FROM v_roll JOIN
   (SELECT uid, max(score * 0.5) AS mx FROM v_roll GROUP BY uid) x USING (uid) GROUP BY uid, mx) g USING (uid)""")
def soft_mean_center(spark, sf):
    out = A.soft_mean_center(v_roll(spark, sf), ["uid"], "score", beta=0.5)
    return rounded(out.select("sample_id", "centered"), "centered")


@query("pairwise_ranking_accuracy", with_ctes(ROLL) + f"""
, p AS (SELECT a.uid, abs(a.acc - b.acc) AS w, (a.score > b.score) = (a.acc > b.acc) AS ok
        FROM v_roll a JOIN v_roll b ON a.uid = b.uid AND a.sample_id < b.sample_id),
s AS (SELECT uid, sum(w) AS t, sum(CASE WHEN ok THEN w ELSE 0 END) AS g FROM p GROUP BY uid)
SELECT u.uid, {q8("CASE WHEN coalesce(t, 0) = 0 THEN 0.5 ELSE g / t END", "pair_accuracy")}
FROM (SELECT DISTINCT uid FROM v_roll) u LEFT JOIN s ON u.uid = s.uid""".replace("\n, p AS", ", p AS"))
def pairwise_ranking_accuracy(spark, sf):
    out = A.pairwise_ranking_accuracy(v_roll(spark, sf), "uid", "score", "acc", "sample_id")
    return rounded(out, "pair_accuracy")


@query("pairwise_ranking_accuracy_graded", """WITH e AS (SELECT user_id, event_id, value, event_id % 4 / 3.0::DOUBLE AS acc FROM events),
p AS (SELECT a.user_id, abs(a.acc - b.acc) AS w, (a.value > b.value) = (a.acc > b.acc) AS ok
      FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id),
s AS (SELECT user_id, sum(w) AS t, sum(CASE WHEN ok THEN w ELSE 0 END) AS g FROM p GROUP BY 1)
""" + f"""SELECT u.user_id, {q8("CASE WHEN coalesce(t, 0) = 0 THEN 0.5 ELSE g / t END", "pair_accuracy")}
FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN s ON u.user_id = s.user_id""")
def pairwise_ranking_accuracy_graded(spark, sf):
    e = table(spark, sf, "events").withColumn("acc", (F.col("event_id") % 4) / 3.0)
    return rounded(A.pairwise_ranking_accuracy(e, "user_id", "value", "acc", "event_id"), "pair_accuracy")


@query("sign_accuracy", with_ctes(ROLL) + f"""SELECT {q8("avg(CASE WHEN sign(score - 2.5) = sign(acc * 2 - 1) THEN 1.0 ELSE 0.0 END)", "sign_accuracy")} FROM v_roll""")
def sign_accuracy(spark, sf):
    return rounded(A.sign_accuracy(v_roll(spark, sf).withColumn("score", F.col("score") - 2.5), "score", "acc"), "sign_accuracy")


@query("best_of_n_weights", with_ctes(ROLL) + f"""SELECT sample_id, {q8("n * pow(cd, n - 1)", "weight")} FROM (
 SELECT sample_id, count(*) OVER (PARTITION BY uid) AS n, cume_dist() OVER (PARTITION BY uid ORDER BY score) AS cd FROM v_roll)""")
def best_of_n_weights(spark, sf):
    out = A.best_of_n_weights(v_roll(spark, sf), "uid", "score")
    return rounded(out.select("sample_id", "weight"), "weight")


SEQ_LOGP = """seqs AS (SELECT sample_id, sum(logp_old * mask) AS lp, sum(logp_ref * mask) AS lr, sum(reward * mask) AS sc FROM v_tok GROUP BY 1),
pairs AS (SELECT *, sample_id // 2 AS pair, row_number() OVER (PARTITION BY sample_id // 2 ORDER BY sc DESC, sample_id) AS rn,
          count(*) OVER (PARTITION BY sample_id // 2) AS n FROM (SELECT * REPLACE (round(sc, 6) AS sc) FROM seqs))"""


def _pairs(spark, sf):
    m = F.col("mask")
    seqs = v_tok(spark, sf).groupBy("sample_id").agg(
        F.sum(F.col("logp_old") * m).alias("lp"), F.sum(F.col("logp_ref") * m).alias("lr"),
        F.round(F.sum(F.col("reward") * m), 6).alias("sc")).withColumn("pair", F.floor(F.col("sample_id") / 2))
    return S.chosen_of_pair(seqs, "pair", "sample_id", "sc")


@query("chosen_of_pair", with_ctes(TOK, SEQ_LOGP) + "SELECT pair, sample_id, CAST(rn = 1 AS INTEGER) AS chosen FROM pairs WHERE n = 2")
def chosen_of_pair(spark, sf):
    return _pairs(spark, sf).select("pair", "sample_id", "chosen")


LS = lambda x: f"(least({x}, 0) - ln(1 + exp(-abs({x}))))"


@query("pair_preference_loss", with_ctes(TOK, SEQ_LOGP) + f"""
, w AS (SELECT c.pair, (c.lp - r.lp) - (c.lr - r.lr) AS x FROM pairs c JOIN pairs r ON c.pair = r.pair AND c.rn = 1 AND r.rn = 2)
SELECT count(*)::BIGINT AS n_pairs, {q8(f"avg(-{LS('0.1 * x')} * 0.9 - {LS('-0.1 * x')} * 0.1)", "sigmoid_loss")},
 {q8("avg(pow(x - 5.0, 2))", "squared_loss")}, {q8("avg(x)", "mean_logits")} FROM w""".replace("\n, w AS", ", w AS"))
def pair_preference_loss(spark, sf):
    by = _pairs(spark, sf).groupBy("pair").agg(*[
        F.max(F.when(F.col("chosen") == c, F.col(v))).alias(f"{v}{c}") for v in ("lp", "lr") for c in (0, 1)])
    kw = dict(beta=0.1)
    sig = A.pair_preference_loss(by, "lp1", "lp0", "lr1", "lr0", smoothing=0.1, **kw).withColumnRenamed("loss", "l1")
    both = A.pair_preference_loss(sig.drop("logits"), "lp1", "lp0", "lr1", "lr0", kind="squared", **kw)
    out = both.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("l1").alias("sigmoid_loss"),
                   F.avg("loss").alias("squared_loss"), F.avg("logits").alias("mean_logits"))
    return rounded(out, "sigmoid_loss", "squared_loss", "mean_logits")
