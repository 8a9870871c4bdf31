"""Off-policy correction, teacher routing and the domain budget."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from rollstat.functions.columns import sha
from rollstat.operators import distill as D
from rollstat.operators import domains as H
from rollstat.operators import offpolicy as G
from rollstat.plans.registry import query
from rollstat.plans.views import ROLL, TOK, TOPK, q8, q8s, rounded, table, v_roll, v_tok, v_topk, with_ctes

LR = lambda: F.col("logp_old") - F.col("logp_rollout")
LEVELS = ("token", "sequence", "geometric")
W_SQL = {
    "token": "d", "sequence": "sum(d * mask) OVER (PARTITION BY sample_id)",
    "geometric": "sum(d * mask) OVER (PARTITION BY sample_id) / (sum(mask) OVER (PARTITION BY sample_id) + 1e-8)",
}


def w_cte(level: str) -> str:
    return f"""d AS (SELECT sample_id, pos, mask, logp_old, logp_rollout, logp_old - logp_rollout AS d FROM v_tok),
lr AS (SELECT *, {W_SQL[level]} AS lr FROM d), w AS (SELECT *, exp(greatest(-20, least(20, lr))) AS w FROM lr)"""


for _level in LEVELS[:2]:
    @query(f"importance_weights_{_level}", with_ctes(TOK, w_cte(_level)) + f"SELECT sample_id, pos::INTEGER AS pos, {q8('least(w * mask, 2.0)', 'weight')} FROM w")
    def importance_weights(spark, sf, level=_level):
        out = G.importance_weights(v_tok(spark, sf), "sample_id", LR(), "mask", level=level, threshold=2.0)
        return rounded(out.select("sample_id", "pos", "weight"), "weight")

for _level in LEVELS:
    @query(f"rejection_mask_{_level}", with_ctes(TOK, w_cte(_level)) + "SELECT sample_id, pos::INTEGER AS pos, CAST(CASE WHEN w BETWEEN 1 / 1.7 AND 1.7 THEN mask ELSE 0 END AS INTEGER) AS kept FROM w")
    def rejection_mask(spark, sf, level=_level):
        out = G.rejection_mask(v_tok(spark, sf), "sample_id", LR(), "mask", level=level, upper=1.7)
        return out.select("sample_id", "pos", "kept")

    @query(f"weight_metrics_{_level}", with_ctes(TOK, w_cte(_level)) + f"""
, s AS (SELECT sample_id, sum(w * mask) / (sum(mask) + 1e-8) AS sm, any_value(lr) AS lr FROM w GROUP BY 1),
c AS (SELECT *, greatest(1 / 1.7, least(1.7, w)) AS c FROM w)
SELECT {q8("(SELECT sum(w * mask) / (sum(mask) + 1e-8) FROM w)", "w_mean")},
{q8("(SELECT max(w) FILTER (mask = 1) FROM w)" if _level == "token" else "exp(least((SELECT max(lr) FROM w), 20))", "w_max")},
{q8("(SELECT min(w) FILTER (mask = 1) FROM w)" if _level == "token" else "exp((SELECT min(lr) FROM w))", "w_min")},
{q8("(SELECT sum(CASE WHEN w > 1.7 THEN mask ELSE 0 END) / (sum(mask) + 1e-8) FROM w)" if _level == "token" else f"(SELECT avg(CASE WHEN lr > {math.log(1.7)}::DOUBLE THEN 1.0 ELSE 0.0 END) FROM s)", "frac_high")},
{q8("(SELECT sum(CASE WHEN w < 1 / 1.7 THEN mask ELSE 0 END) / (sum(mask) + 1e-8) FROM w)" if _level == "token" else f"(SELECT avg(CASE WHEN lr < {math.log(1 / 1.7)}::DOUBLE THEN 1.0 ELSE 0.0 END) FROM s)", "frac_low")},
{q8("(SELECT sqrt(greatest(0, sum(c * c * mask) / (sum(mask) + 1e-8) - pow(sum(c * mask) / (sum(mask) + 1e-8), 2))) FROM c)", "w_std")},
{q8("(SELECT 1 / (sum(c * c * mask) / pow(sum(c * mask) / (sum(mask) + 1e-8) + 1e-8, 2) / (sum(mask) + 1e-8)) FROM c)", "eff_sample_size")},
{q8("(SELECT avg(sm) FROM s)", "seq_mean")}, {q8("(SELECT stddev_samp(sm) FROM s)", "seq_std")}, {q8("(SELECT max(sm) FROM s)", "seq_max")},
{q8("(SELECT min(sm) FROM s)", "seq_min")}, {q8("(SELECT max(abs(sm - 1)) FROM s)", "seq_max_deviation")},
{q8("(SELECT avg(CASE WHEN sm > 1.7 THEN 1.0 ELSE 0.0 END) FROM s)", "seq_frac_high")}, {q8("(SELECT avg(CASE WHEN sm < 1 / 1.7 THEN 1.0 ELSE 0.0 END) FROM s)", "seq_frac_low")}""".replace("\n, s AS", ", s AS"))
    def weight_metrics(spark, sf, level=_level):
        out = G.weight_metrics(v_tok(spark, sf), "sample_id", LR(), "mask", level=level, upper=1.7)
        return rounded(out, *out.columns)


@query("veto_mask", with_ctes(TOK, w_cte("token")) + """SELECT sample_id, pos::INTEGER AS pos, CAST(d < ln(0.5) AND mask = 1 AS INTEGER) AS catastrophic,
 CAST(CASE WHEN max(CASE WHEN d < ln(0.5) AND mask = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id) = 1 THEN 0 ELSE mask END AS INTEGER) AS kept FROM w""")
def veto_mask(spark, sf):
    return G.veto_mask(v_tok(spark, sf), "sample_id", LR(), "mask", threshold=0.5).select("sample_id", "pos", "catastrophic", "kept")


@query("veto_fractions", with_ctes(TOK, w_cte("token")) + f"""
, s AS (SELECT sample_id, max(b) AS v, sum(b) AS b, sum(mask) AS m FROM (SELECT *, CASE WHEN d < ln(0.5) AND mask = 1 THEN 1 ELSE 0 END AS b FROM w) GROUP BY 1)
SELECT {q8("avg(v)", "veto_fraction")}, {q8("sum(b) / (sum(m) + 1e-8)", "catastrophic_fraction")} FROM s""".replace("\n, s AS", ", s AS"))
def veto_fractions(spark, sf):
    out = G.veto_fractions(v_tok(spark, sf), "sample_id", LR(), "mask", threshold=0.5)
    return rounded(out, *out.columns)


@query("offpolicy_metrics", with_ctes(TOK, w_cte("token")) + f"""
, s AS (SELECT sample_id, sum(logp_old * mask) / (sum(mask) + 1e-8) AS a, sum(logp_rollout * mask) / (sum(mask) + 1e-8) AS b, sum(d * mask) AS ds FROM w GROUP BY 1),
t AS (SELECT sum(-d * mask) / (sum(mask) + 1e-8) AS kl, sum((exp(d) - d - 1) * mask) / (sum(mask) + 1e-8) AS k3, sum(w * w * mask) / (sum(mask) + 1e-8) - 1 AS c2 FROM w)
SELECT {q8("avg(exp(-a))", "training_ppl")}, {q8("avg(-a)", "training_log_ppl")}, {q8("(SELECT kl FROM t)", "kl")}, {q8("(SELECT k3 FROM t)", "k3_kl")},
{q8("avg(exp(-b))", "rollout_ppl")}, {q8("avg(-b)", "rollout_log_ppl")}, {q8("avg(b - a)", "log_ppl_diff")}, {q8("avg(abs(b - a))", "log_ppl_abs_diff")},
{q8("max(b - a)", "log_ppl_diff_max")}, {q8("min(b - a)", "log_ppl_diff_min")}, {q8("avg(exp(b - a))", "ppl_ratio")}, {q8("(SELECT c2 FROM t)", "chi2_token")},
{q8("avg(exp(2 * greatest(-20, least(20, ds)))) - 1", "chi2_seq")} FROM s""".replace("\n, s AS", ", s AS"))
def offpolicy_metrics(spark, sf):
    out = G.offpolicy_metrics(v_tok(spark, sf), "sample_id", "logp_old", "logp_rollout", "mask")
    return rounded(out, *out.columns)


@query("probability_agreement", with_ctes(TOK) + f"""
, p AS (SELECT exp(logp_old) AS a, exp(logp_rollout) AS b FROM v_tok WHERE mask = 1)
SELECT {q8("max(abs(a - b))", "diff_max")}, {q8("avg(abs(a - b))", "diff_mean")}, {q8("stddev_samp(abs(a - b))", "diff_std")}, {q8("corr(a, b)", "pearson")} FROM p""".replace("\n, p AS", ", p AS"))
def probability_agreement(spark, sf):
    out = G.probability_agreement(v_tok(spark, sf), "logp_old", "logp_rollout", "mask")
    return rounded(out, *out.columns)


@query("token_differences", with_ctes(TOK) + "SELECT sample_id, count(*) FILTER (token_id % 5 <> is_end AND mask = 1)::BIGINT AS n_diff FROM v_tok GROUP BY 1")
def token_differences(spark, sf):
    return G.token_differences(v_tok(spark, sf), "sample_id", F.col("token_id") % 5, F.col("is_end"), "mask")


# ---- distillation rewards ---------------------------------------------------------

# candidate ids: student proposes 0..7, the teacher 4..11 (t2 holds the teacher's own
# log-probs, t3 the student's log-probs on the teacher's candidates)
def _candidates(spark, sf):
    return v_topk(spark, sf).withColumn("s_ids", F.array(*[F.lit(i) for i in range(8)])).withColumn(
        "t_ids", F.array(*[F.lit(i) for i in range(4, 12)]))


def cand_sql(strategy: str, weight: str) -> str:
    log_w = {"student": "s", "teacher": "t", "none": "0"}[weight]
    stu = "SELECT token, unnest(range(8)) AS i, unnest(student) AS s, unnest(t1) AS t FROM v_topk"
    tch = "SELECT token, unnest(range(8)) + 4 AS i, unnest(t3) AS s, unnest(t2) AS t FROM v_topk"
    rows = {
        "only_stu": f"SELECT *, i AS slot, true AS ok FROM ({stu})",
        "only_tch": f"SELECT *, i - 4 AS slot, true AS ok FROM ({tch})",
        "intersection": f"SELECT *, i AS slot, i >= 4 AS ok FROM ({stu})",
        "union": f"SELECT *, i AS slot, true AS ok FROM ({stu}) UNION ALL SELECT *, i + 4, i >= 8 FROM ({tch})",
        "union-intersection": f"SELECT *, i AS slot, i < 4 AS ok FROM ({stu}) UNION ALL SELECT *, i + 4, i >= 8 FROM ({tch})",
    }[strategy]
    total = "1" if strategy == "union-intersection" else f"sum(CASE WHEN ok THEN exp({log_w}) ELSE 0 END) OVER (PARTITION BY token)"
    return with_ctes(TOPK, f"c AS ({rows})") + f"""SELECT token, slot::INTEGER AS slot, i::INTEGER AS cand_id,
 {q8(f"CASE WHEN ok THEN -(s - t) * exp({log_w}) / {total} ELSE 0 END", "reward")} FROM c"""


for _strategy, _weight in (("only_stu", "student"), ("only_stu", "none"), ("only_tch", "teacher"), ("intersection", "student"),
                           ("union", "student"), ("union", "teacher"), ("union-intersection", "student")):
    @query(f"distill_reward_{_strategy.replace('-', '_')}_{_weight}", cand_sql(_strategy, _weight))
    def distill_reward(spark, sf, strategy=_strategy, weight=_weight):
        out = D.distill_reward_topk(_candidates(spark, sf), strategy, s_ids="s_ids", s_logp="student", t_on_s="t1",
                                    t_ids="t_ids", t_logp="t2", s_on_t="t3", weight=weight)
        flat = out.select("token", F.posexplode(F.arrays_zip("cand_ids", "reward")).alias("slot", "z"))
        return rounded(flat.select("token", "slot", F.col("z.cand_ids").alias("cand_id"), F.col("z.reward").alias("reward")), "reward")


CAND = "c AS (SELECT token, unnest(range(8)) AS slot, unnest(student) AS s, unnest(t1) AS t, unnest(t2) AS u FROM v_topk)"
DELTA = CAND + """,
e AS (SELECT *, t - u AS d, exp(s) / sum(exp(s)) OVER (PARTITION BY token) * (t - u) AS r, token // 100 AS chunk FROM c)"""


@query("distill_reward_delta", with_ctes(TOPK, DELTA) + f"""SELECT token, slot::INTEGER AS slot, {q8("r", "delta_reward")},
 {q8("-(s - t) * exp(s) / sum(exp(s)) OVER (PARTITION BY token) + 0.25 * r", "extrapolated")} FROM e""")
def distill_reward_delta(spark, sf):
    delta = D.delta_reward("student", "t1", "t2")
    both = v_topk(spark, sf).select("token", F.posexplode(F.arrays_zip(
        delta.alias("d"), D.extrapolated_reward(D.distill_reward("student", "t1"), delta, 1.25).alias("x"))).alias("slot", "z"))
    return rounded(both.select("token", "slot", F.col("z.d").alias("delta_reward"), F.col("z.x").alias("extrapolated")),
                   "delta_reward", "extrapolated")


DELTA_COLS = f"""{q8("avg(d)", "shift_mean")}, {q8("stddev_pop(d)", "shift_std")}, {q8("avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END)", "shift_pos_frac")},
 {q8("avg(abs(d))", "shift_abs_mean")}, {q8("min(d)", "shift_min")}, {q8("max(d)", "shift_max")}, {q8("avg(r)", "reward_mean")},
 {q8("min(r)", "reward_min")}, {q8("max(r)", "reward_max")}, {q8("sum(r) / count(DISTINCT token)", "reward_token_mean")},
 {q8("sum(CASE WHEN d > 0 THEN r ELSE 0 END) / sum(abs(r))", "weighted_pos_frac")}, {q8("sum(CASE WHEN d > 0 THEN exp(s) ELSE 0 END) / sum(exp(s))", "prob_weighted_pos_frac")}"""


@query("delta_metrics", with_ctes(TOPK, DELTA) + f"SELECT {DELTA_COLS} FROM e")
def delta_metrics(spark, sf):
    out = D.delta_metrics(v_topk(spark, sf), "student", "t1", "t2")
    return rounded(out, *out.columns)


@query("delta_metrics_by_chunk", with_ctes(TOPK, DELTA) + f"SELECT chunk::BIGINT AS chunk, {DELTA_COLS} FROM e GROUP BY chunk")
def delta_metrics_by_chunk(spark, sf):
    rows = v_topk(spark, sf).withColumn("chunk", F.floor(F.col("token") / 100))
    out = D.delta_metrics(rows, "student", "t1", "t2", ["chunk"])
    return rounded(out, *[c for c in out.columns if c != "chunk"])


@query("teacher_logprob_metrics", with_ctes(TOPK, CAND) + f"""
, t AS (SELECT token, sum(exp(s) * t) AS a, sum(exp(s) * u) AS b, sum(exp(s)) AS p, sum(CASE WHEN slot >= 4 THEN exp(u) ELSE 0 END) AS op, sum(exp(u)) AS rp FROM c GROUP BY 1)
SELECT {q8("avg(a)", "teacher_logprob")}, {q8("avg(b)", "ref_logprob")}, {q8("avg(a - b)", "logprob_gap")}, {q8("avg(p)", "prob_mass")},
 {q8("0.5", "overlap_ratio")}, {q8("avg(op)", "overlap_sum_p")}, {q8("avg(rp)", "ref_sum_p")} FROM t""".replace("\n, t AS", ", t AS"))
def teacher_logprob_metrics(spark, sf):
    rows = _candidates(spark, sf)
    overlap = F.transform("s_ids", lambda i: F.array_contains(F.col("t_ids"), i))
    out = D.teacher_logprob_metrics(rows, "student", "t1", "t2", overlap)
    return rounded(out, *out.columns)


# ---- teachers and domains ---------------------------------------------------------

TEACHERS = {"0": "t1", "1": "t2", "2": "t3"}


@query("route_teachers", with_ctes(TOPK, "c AS (SELECT token, domain, unnest(range(8)) AS slot, unnest(t1) AS a, unnest(t2) AS b, unnest(t3) AS d FROM v_topk)") + f"""
SELECT token, slot::INTEGER AS slot, {q8("CASE domain WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN d ELSE (a + b + d) / 3 END", "routed")} FROM c""")
def route_teachers(spark, sf):
    out = H.route_teachers(v_topk(spark, sf), "domain", TEACHERS)
    return rounded(out.select("token", F.posexplode("routed").alias("slot", "routed")), "routed")


@query("domain_shares", with_ctes(TOK) + f"""
SELECT domain, count(DISTINCT sample_id)::BIGINT AS prompt_count, {q8("count(DISTINCT sample_id) / (SELECT count(DISTINCT sample_id) FROM v_tok)", "prompt_share")},
 {q8("sum(mask) / (SELECT sum(mask) FROM v_tok)", "token_share")}, {q8("sum(mask) / count(DISTINCT sample_id)", "mean_length")},
 {q8("sum(abs(reward) * mask) / sum(mask)", "reward_abs_mean")} FROM v_tok GROUP BY domain""")
def domain_shares(spark, sf):
    out = H.domain_shares(v_tok(spark, sf), "domain", "sample_id", "mask", "reward")
    return rounded(out, "prompt_share", "token_share", "mean_length", "reward_abs_mean")


TARGETS = {"1-URGENT": 4.0, "2-HIGH": 3.0, "3-MEDIUM": 2.0, "5-LOW": 1.0}
TARGET_SQL = """CASE domain WHEN '1-URGENT' THEN 0.4 WHEN '2-HIGH' THEN 0.3 WHEN '3-MEDIUM' THEN 0.2 WHEN '5-LOW' THEN 0.1 ELSE 0 END"""
MAG_SQL = {
    "mean": "avg(a) FILTER (mask = 1)", "q75": "quantile_cont(a, 0.75) FILTER (mask = 1 AND a > 0)",
    "q90": "quantile_cont(a, 0.9) FILTER (mask = 1 AND a > 0)",
    "top10": "avg(a) FILTER (mask = 1 AND a > 0 AND rn <= greatest(1, nn // 10))",
}


def loss_weight_sql(alpha, stat, direction):
    scale = "base"
    if alpha and direction == "divide":
        scale = f"base / pow(mag, {alpha})"
    elif alpha:
        scale = f"base * least(20, greatest(0.05, pow(mag / ((SELECT sum(base * mag) / sum(base) FROM b)), {alpha})))"
    return with_ctes(TOK) + f""", t AS (SELECT domain, mask, abs(value) AS a,
  row_number() OVER (PARTITION BY domain, mask ORDER BY abs(value) DESC) AS rn, sum(mask) OVER (PARTITION BY domain) AS nn FROM v_tok),
g AS (SELECT domain, sum(mask)::DOUBLE AS tokens, {TARGET_SQL} AS target, {MAG_SQL[stat]} AS mag FROM t GROUP BY domain),
b AS (SELECT *, tokens / (SELECT sum(tokens) FROM g) AS share, target / (tokens / (SELECT sum(tokens) FROM g)) AS base FROM g),
s AS (SELECT *, {scale} AS sc FROM b)
SELECT domain, {q8("share", "token_share")}, {q8("target", "target_share")}, {q8("sc * (SELECT sum(tokens) FROM s) / (SELECT sum(sc * tokens) FROM s)", "weight")} FROM s"""


for _name, _kw in {
    "domain_loss_weights": dict(alpha=0.0, stat="mean", direction="divide"),
    "domain_loss_weights_mean": dict(alpha=0.5, stat="mean", direction="divide"),
    "domain_loss_weights_q75": dict(alpha=1.0, stat="q75", direction="divide"),
    "domain_loss_weights_q90": dict(alpha=1.0, stat="q90", direction="multiply"),
    "domain_loss_weights_top10": dict(alpha=1.0, stat="top10", direction="multiply"),
}.items():
    @query(_name, loss_weight_sql(**_kw))
    def domain_loss_weights(spark, sf, kw=_kw):
        out = H.domain_loss_weights(v_tok(spark, sf), "domain", "mask", targets=TARGETS, reward="value", **kw)
        return rounded(out, "token_share", "target_share", "weight")


SPREAD = "sp AS (SELECT *, greatest(t1[1], t2[1], t3[1]) - least(t1[1], t2[1], t3[1]) AS s, CASE WHEN token % 4 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS m FROM v_topk)"
M4 = lambda: F.when(F.col("token") % 4 == 0, 0).otherwise(1)
T3 = ["t1", "t2", "t3"]


@query("teacher_conflict", with_ctes(TOPK, SPREAD) + f"""SELECT CAST(domain AS VARCHAR) AS domain, {q8("sum(s * m) / sum(m)", "spread_mean")}, {q8("max(s * m)", "spread_max")},
 {q8("sum(CASE WHEN s > 0.2 THEN m ELSE 0 END) / sum(m)", "contested_frac")} FROM sp GROUP BY GROUPING SETS ((), (domain))""")
def teacher_conflict(spark, sf):
    out = H.teacher_conflict(v_topk(spark, sf), T3, M4(), "domain", nats=0.2)
    return rounded(out, "spread_mean", "spread_max", "contested_frac")


@query("teacher_conflict_mask", with_ctes(TOPK, SPREAD) + f"""SELECT token, {q8("CASE WHEN s <= 0.2 THEN (SELECT sum(m) / sum(CASE WHEN s <= 0.2 THEN m ELSE 0 END) FROM sp) ELSE 0 END", "token_weight")} FROM sp""")
def teacher_conflict_mask(spark, sf):
    out = H.teacher_conflict_policy(v_topk(spark, sf), T3, "t1", M4(), policy="mask", nats=0.2)
    return rounded(out.select("token", "token_weight"), "token_weight")


@query("teacher_conflict_consensus", with_ctes(TOPK, SPREAD, "c AS (SELECT token, s, unnest(range(8)) AS slot, unnest(t1) AS a, unnest(t2) AS b, unnest(t3) AS d FROM sp)") + f"""
SELECT token, slot::INTEGER AS slot, {q8("CASE WHEN s <= (SELECT quantile_cont(s, 0.6) FROM sp WHERE m = 1) THEN (a + b + d) / 3 ELSE a END", "target")} FROM c""")
def teacher_conflict_consensus(spark, sf):
    out = H.teacher_conflict_policy(v_topk(spark, sf), T3, "t1", M4(), policy="consensus", quantile=0.6)
    return rounded(out.select("token", F.posexplode("target").alias("slot", "target")), "target")


MIX = dict(ema_window=5, initial_steps=3, velocity_window=3, velocity_windows=2, update_interval=2, floor=0.05, temperature=0.5)
STEPS_SQL = """st AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, greatest(0, avg(value / 100)) AS raw FROM events GROUP BY ALL),
nu AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS t FROM st),
em(day, event_type, raw, t, ema) AS (SELECT day, event_type, raw, t, raw FROM nu WHERE t = 1
 UNION ALL SELECT n.day, n.event_type, n.raw, n.t, n.raw / 3.0::DOUBLE + (1 - 1 / 3.0::DOUBLE) * e.ema FROM em e JOIN nu n ON n.event_type = e.event_type AND n.t = e.t + 1),
ini AS (SELECT event_type, avg(raw) AS initial FROM nu WHERE t <= 3 GROUP BY 1),
lg AS (SELECT e.*, initial, least(2, t // 3 - 1) AS av, lag(ema, 3) OVER w AS l3, lag(ema, 6) OVER w AS l6 FROM em e JOIN ini USING (event_type) WINDOW w AS (PARTITION BY event_type ORDER BY t)),
ve AS (SELECT *, t >= 6 AND av > 0 AS ready, CASE WHEN t >= 6 AND av > 0 THEN greatest(0, -(
  (ema - l3) / greatest(l3, 1e-6) + CASE WHEN av > 1 THEN (l3 - l6) / greatest(l6, 1e-6) ELSE 0 END) / av) ELSE 0 END AS velocity,
  CASE WHEN t >= 6 AND av > 0 THEN ema / greatest(initial, 1e-6) ELSE 0 END AS gap FROM lg),
sg AS (SELECT *, gap * velocity AS signal, max(gap * velocity) OVER (PARTITION BY day) AS top, count(*) OVER (PARTITION BY day) AS k FROM ve),
no AS (SELECT *, CASE WHEN top > 0 THEN signal / top ELSE 0 END AS nrm FROM sg),
mx AS (SELECT *, 0.05 + (1 - k * 0.05) * exp(nrm / 0.5) / sum(exp(nrm / 0.5)) OVER (PARTITION BY day) AS mix FROM no),
du AS (SELECT *, CASE WHEN t % 2 = 0 THEN CASE WHEN ready THEN mix ELSE 1.0::DOUBLE / k END END AS due FROM mx),
fin AS (SELECT *, coalesce(last_value(due IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0::DOUBLE / k) AS mixture FROM du)"""


def daily_steps(events):
    rows = events.select(F.to_date("ts").alias("day"), "event_type", (-F.col("value") / 100).alias("reward"))
    return H.step_divergence(rows, "day", "event_type", F.col("reward"), F.lit(1))


@query("mixture_schedule", with_ctes(STEPS_SQL) + f"SELECT day, event_type, t::INTEGER AS t, {q8s('raw', 'ema', 'gap', 'velocity', 'signal', 'mixture')} FROM fin")
def mixture_schedule(spark, sf):
    out = H.mixture_schedule(daily_steps(table(spark, sf, "events")), "day", "event_type", "raw", **MIX)
    return rounded(out, "raw", "ema", "gap", "velocity", "signal", "mixture")
