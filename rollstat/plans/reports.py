"""Evaluation reports and run-log metrics over the tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from rollstat.operators import evals as E
from rollstat.operators import runlog as R
from rollstat.plans.registry import query
from rollstat.plans.views import DOC, MSG, ROLL, TOK, documents, q8, q8s, rounded, table, v_doc, v_msg, v_roll, v_tok, with_ctes

KNOWN = [f"src{i}" for i in range(19)]
CARD = with_ctes(DOC) + """, t AS (SELECT source, count(*) AS n FROM documents WHERE source <> 'src0' GROUP BY 1),
b AS (SELECT dataset, count(acc) AS s, sum(CASE WHEN acc > 0 THEN 1 ELSE 0 END) AS c, count(*) FILTER (truncated = 1) AS tr FROM v_doc GROUP BY 1),
j AS (SELECT b.*, CASE WHEN dataset = 'src0' THEN 77 ELSE n END AS n, dataset <> 'src19' AS ok FROM b LEFT JOIN t ON dataset = source),
card AS (SELECT dataset, CASE WHEN ok THEN s ELSE 0 END AS scored_rows, CASE WHEN ok THEN c END AS correct, n AS official_total, CASE WHEN ok AND n > 0 THEN c / n END AS official,
 CASE WHEN ok AND s > 0 THEN c / s END AS live, CASE WHEN ok THEN '' ELSE 'unknown_dataset' END AS note, tr AS trunc_rows FROM j)
"""


def _card(spark, sf):
    docs = v_doc(spark, sf)
    totals = table(spark, sf, "documents").filter(F.col("source") != "src0").groupBy(F.col("source").alias("dataset")).agg(F.count(F.lit(1)).alias("official_total"))
    return E.eval_scorecard(docs, "dataset", "acc", totals, KNOWN, {"src0": 77}, {"trunc_rows": F.count_if(F.col("truncated") == 1)})


@query("eval_scorecard", CARD + f"SELECT dataset, scored_rows::BIGINT AS scored_rows, correct::BIGINT AS correct, official_total::BIGINT AS official_total, {q8s('official', 'live')}, note, trunc_rows::BIGINT AS trunc_rows FROM card")
def eval_scorecard(spark, sf):
    return rounded(_card(spark, sf), "official", "live")


@query("macro_means", CARD + f"SELECT {q8('avg(official)', 'macro_official')}, {q8('avg(live)', 'macro_live')} FROM card")
def macro_means(spark, sf):
    return rounded(E.macro_means(_card(spark, sf)), "macro_official", "macro_live")


@query("avg_at_k", with_ctes(DOC) + f"""SELECT domain, count(*)::BIGINT AS total, count(acc)::BIGINT AS scored_rows, count(*) FILTER (acc <> 0)::BIGINT AS correct,
 {q8("100.0::DOUBLE * count(*) FILTER (acc <> 0) / greatest(count(acc), 1)", "pct")}, count(*) FILTER (n_chars >= 8000)::BIGINT AS truncated, {q8("100.0::DOUBLE * count(*) FILTER (n_chars >= 8000) / count(*)", "truncation_rate")},
 count(DISTINCT doc_id)::BIGINT AS unique_samples FROM v_doc GROUP BY 1""")
def avg_at_k(spark, sf):
    score = F.coalesce(F.col("acc").cast("double"), F.lit(float("nan")))
    return rounded(E.avg_at_k(v_doc(spark, sf), ["domain"], score, "doc_id", "n_chars", 8000), "pct", "truncation_rate")


@query("pass_at_1", with_ctes(ROLL) + f"""SELECT domain, {q8("avg(p)", "pass_at_1")}, count(*)::BIGINT AS problems, {q8("avg(n)", "completions_per_problem")} FROM (
 SELECT domain, uid, avg(acc) AS p, count(*) AS n FROM v_roll GROUP BY ALL) GROUP BY 1""")
def pass_at_1(spark, sf):
    return rounded(E.pass_at_1(v_roll(spark, sf), ["domain"], "uid", "acc"), "pass_at_1", "completions_per_problem")


@query("model_scorecard", f"""WITH e AS (SELECT user_id, event_type, CASE WHEN value > 40 THEN 1 ELSE 0 END AS c, CAST(ts AS DATE) AS d FROM events WHERE event_type IN ('click', 'view')),
g AS (SELECT user_id, sum(c) FILTER (event_type = 'click') AS cc, count(*) FILTER (event_type = 'click') AS cn, count(DISTINCT d) FILTER (event_type = 'click') AS cs,
 sum(c) FILTER (event_type = 'view') AS vc, count(*) FILTER (event_type = 'view') AS vn, count(DISTINCT d) FILTER (event_type = 'view') AS vs FROM e GROUP BY 1)
SELECT user_id, cc::BIGINT AS click_correct, nullif(cn, 0)::BIGINT AS click_scored, {q8("coalesce(100 * cc / nullif(cn, 0), 0)", "click_pct")}, nullif(cs, 0)::BIGINT AS click_shards,
 vc::BIGINT AS view_correct, nullif(vn, 0)::BIGINT AS view_scored, {q8("coalesce(100 * vc / nullif(vn, 0), 0)", "view_pct")}, nullif(vs, 0)::BIGINT AS view_shards,
 {q8("(coalesce(100 * cc / nullif(cn, 0), 0) + coalesce(100 * vc / nullif(vn, 0), 0)) / ((cn > 0)::INTEGER + (vn > 0)::INTEGER)", "average")} FROM g""")
def model_scorecard(spark, sf):
    e = table(spark, sf, "events").filter(F.col("event_type").isin("click", "view")).select(
        "user_id", "event_type", F.when(F.col("value") > 40, 1).otherwise(0).alias("c"), F.lit(1).alias("n"), F.to_date("ts").alias("d"))
    out = E.model_scorecard(e, "user_id", "event_type", ["click", "view"], "c", "n", "d")
    out = out.select("user_id", *[F.when(F.col(f"{v}_scored") > 0, F.col(f"{v}_{c}")).alias(f"{v}_{c}") if c != "pct" else F.coalesce(f"{v}_pct", F.lit(0.0)).alias(f"{v}_pct")
                                  for v in ("click", "view") for c in ("correct", "scored", "pct", "shards")], "average")
    return rounded(out, "click_pct", "view_pct", "average")


STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
REPEAT = f"""tk AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS w, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP('x')}), lambda x: x <> '') AS ls FROM documents),
gr AS (SELECT doc_id, array_to_string(w[i:i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM tk WHERE len(w) >= 12)),
gc AS (SELECT doc_id, sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c) AS r FROM (SELECT doc_id, g, count(*) AS c FROM gr GROUP BY ALL) GROUP BY 1),
lc AS (SELECT doc_id, sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c) AS r FROM (SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, unnest(ls[greatest(len(ls) - 39, 1):]) AS l FROM tk WHERE len(ls) >= 6) GROUP BY ALL) GROUP BY 1),
ph AS (SELECT doc_id, greatest({', '.join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in E.STOCK_PHRASES)}) AS p FROM documents),
rp AS (SELECT t.doc_id, p AS phrase_score, coalesce(gc.r, 0) AS ngram_ratio, coalesce(lc.r, 0) AS line_ratio, t.text <> '' AND (p >= 8 OR coalesce(gc.r, 0) >= 0.18 OR coalesce(lc.r, 0) >= 0.25) AS repetitive
 FROM tk t JOIN ph USING (doc_id) LEFT JOIN gc USING (doc_id) LEFT JOIN lc USING (doc_id))"""


@query("repetition_metrics", f"WITH {REPEAT} SELECT doc_id, phrase_score::INTEGER AS phrase_score, {q8s('ngram_ratio', 'line_ratio')}, repetitive FROM rp")
def repetition_metrics(spark, sf):
    out = E.repetition_metrics(documents(spark, sf), "text")
    return rounded(out.select("doc_id", "phrase_score", "ngram_ratio", "line_ratio", "repetitive"), "ngram_ratio", "line_ratio")


@query("behavior_rates", f"""WITH {REPEAT}, b AS (SELECT source, n_chars >= 8000 AS t, repetitive AS r FROM documents JOIN rp USING (doc_id))
SELECT source, count(*) FILTER (t)::BIGINT AS trunc_rows, count(*) FILTER (r)::BIGINT AS repeat_rows, count(*) FILTER (t AND r)::BIGINT AS trunc_repeat_rows,
 {q8("count(*) FILTER (t) / count(*)", "trunc_rate")}, {q8("count(*) FILTER (r) / count(*)", "repeat_rate")}, {q8("count(*) FILTER (t AND r) / count(*)", "trunc_repeat_rate")} FROM b GROUP BY 1""")
def behavior_rates(spark, sf):
    rows = E.repetition_metrics(documents(spark, sf), "text")
    out = E.behavior_rates(rows, ["source"], F.col("n_chars") >= 8000, F.col("repetitive"))
    return rounded(out, "trunc_rate", "repeat_rate", "trunc_repeat_rate")


VALID = with_ctes(ROLL) + """, l AS (SELECT domain, uid, 'acc' AS variable, acc AS v FROM v_roll UNION ALL SELECT domain, uid, 'score', score FROM v_roll),
g AS (SELECT domain, uid, variable, v, row_number() OVER w AS i, count(*) OVER (PARTITION BY domain, uid, variable) AS n FROM l WINDOW w AS (PARTITION BY domain, uid, variable ORDER BY v)),
st AS (SELECT domain, uid, variable, avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM l GROUP BY ALL),
ks AS (SELECT DISTINCT n, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64, 128], lambda x: x < n), n)) AS k FROM st WHERE n > 1),
mo AS (SELECT g.domain, g.uid, g.variable, ks.k, sum(v * (pow(i / g.n, k) - pow((i - 1) / g.n, k))) AS b1, sum(v * v * (pow(i / g.n, k) - pow((i - 1) / g.n, k))) AS b2,
 sum(v * (pow((g.n - i + 1) / g.n, k) - pow((g.n - i) / g.n, k))) AS w1, sum(v * v * (pow((g.n - i + 1) / g.n, k) - pow((g.n - i) / g.n, k))) AS w2 FROM g JOIN ks ON g.n = ks.n GROUP BY ALL),
al AS (SELECT domain, uid, variable, 'mean@' || n AS metric, m AS value FROM st UNION ALL SELECT domain, uid, variable, 'std@' || n, s FROM st WHERE n > 1
 UNION ALL SELECT domain, uid, variable, 'best@' || k || '/mean', b1 FROM mo UNION ALL SELECT domain, uid, variable, 'best@' || k || '/std', sqrt(greatest(b2 - b1 * b1, 0)) FROM mo
 UNION ALL SELECT domain, uid, variable, 'worst@' || k || '/mean', w1 FROM mo UNION ALL SELECT domain, uid, variable, 'worst@' || k || '/std', sqrt(greatest(w2 - w1 * w1, 0)) FROM mo),
vm AS (SELECT domain, variable, metric, avg(value) AS value FROM al GROUP BY ALL)
"""


def _valid(spark, sf):
    return E.validation_metrics(v_roll(spark, sf), "domain", "uid", ["acc", "score"])


# deviations are square roots of small differences: six digits are meaningful
SIX = "round(CAST(value AS DOUBLE) + 3e-9, 6) + 0.0 AS value"


def _six(df):
    return df.withColumn("value", F.round(F.col("value") + F.lit(3e-9), 6) + F.lit(0.0))


@query("validation_metrics", VALID + f"SELECT domain, variable, metric, {SIX} FROM vm")
def validation_metrics(spark, sf):
    return _six(_valid(spark, sf))


@query("majority_metrics", with_ctes(ROLL) + f""", r AS (SELECT uid, count(*) AS n, count(*) FILTER (pred = 'F') AS f, count(*) FILTER (pred = 'O') AS o, count(*) FILTER (pred = 'P') AS p FROM v_roll GROUP BY 1),
ks AS (SELECT *, unnest(CASE WHEN n > 1 THEN list_append(list_filter([2, 4, 8, 16, 32, 64, 128], lambda x: x < n), n) ELSE [] END) AS k FROM r),
a AS (SELECT *, unnest(range(k + 1)) AS i FROM ks), b AS (SELECT *, unnest(range(k - i + 1)) AS j FROM a), c AS (SELECT *, k - i - j AS l, greatest(i, j, k - i - j) AS top FROM b),
e AS (SELECT uid, k, exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(j + 1) - lgamma(l + 1)) * pow(f / n, i) * pow(o / n, j) * pow(p / n, l) AS chance, (i = top)::INTEGER / ((i = top)::INTEGER + (j = top)::INTEGER + (l = top)::INTEGER) AS v FROM c),
m AS (SELECT uid, k, sum(chance * v) AS m FROM e GROUP BY ALL)
SELECT 'all' AS source, k::BIGINT AS k, {q8("avg(m)", "maj_mean")}, {q8("avg(CASE WHEN m - m * m > 1e-12 THEN sqrt(m - m * m) ELSE 0 END)", "maj_std")} FROM m GROUP BY k""")
def majority_metrics(spark, sf):
    # the value is 1 for one of the three predictions
    rows = v_roll(spark, sf).withColumn("source", F.lit("all"))
    return rounded(E.majority_metrics(rows, "source", "uid", "pred", "acc"), "maj_mean", "maj_std")


LABELLED = VALID + """, tn AS (SELECT domain, variable, max(regexp_extract(metric, '@(\\d+)', 1)::INTEGER) AS n FROM vm GROUP BY ALL),
lb AS (SELECT vm.*, CASE WHEN variable = 'acc' AND regexp_matches(metric, '^(mean|maj|best)') AND regexp_extract(metric, '@(\\d+)', 1)::INTEGER = tn.n THEN 'val-core' ELSE 'val-aux' END AS section FROM vm JOIN tn USING (domain, variable))
"""


@query("core_aux_labels", LABELLED + f"SELECT domain, variable, metric, {SIX}, section, section || '/' || domain || '/' || variable || '/' || metric AS name FROM lb")
def core_aux_labels(spark, sf):
    return _six(E.core_aux_labels(_valid(spark, sf), "domain")).select("domain", "variable", "metric", "value", "section", "name")


@query("benchmark_averages", f"""WITH v AS (SELECT (o_orderkey // 4) % 3 AS k, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS v FROM orders GROUP BY 1),
w AS (SELECT max(v) FILTER (k = 0) AS a, max(v) FILTER (k = 1) AS b, max(v) FILTER (k = 2) AS c FROM v)
SELECT 4::INTEGER AS n, 'aime24_aime25' AS "set", {q8('(a + b) / 2', 'value')} FROM w UNION ALL SELECT 4, 'aime24_aime25_hmmt_feb', {q8('(a + b + c) / 3', 'value')} FROM w""")
def benchmark_averages(spark, sf):
    uid = F.floor(F.col("o_orderkey") / 4)
    rows = table(spark, sf, "orders").select(uid.alias("uid"), F.element_at(F.array(F.lit("AIME24_a"), F.lit("aime25"), F.lit("hmmt_feb_25")), (uid % 3 + 1).cast("int")).alias("source"),
                                             F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("acc"))
    labelled = E.core_aux_labels(E.validation_metrics(rows, "source", "uid", ["acc"]), "source")
    members = {"aime24": ["aime24"], "aime25": ["aime25"], "hmmt_feb": ["hmmt_feb", "hmtt_feb"]}
    sets = {"aime24_aime25": ["aime24", "aime25"], "aime24_aime25_hmmt_feb": ["aime24", "aime25", "hmmt_feb"]}
    return rounded(E.benchmark_averages(labelled, "source", members, sets), "value")


@query("score_by_source", with_ctes(ROLL) + f"SELECT domain, {q8('avg(m)', 'test_score')}, count(*)::BIGINT AS prompts FROM (SELECT domain, uid, avg(score) AS m FROM v_roll GROUP BY ALL) GROUP BY 1")
def score_by_source(spark, sf):
    return rounded(E.score_by_source(v_roll(spark, sf), "domain", "uid", "score"), "test_score")


@query("domain_macro_recovery", with_ctes(DOC) + f""", b AS (SELECT dataset AS method, domain, truncated AS bench, avg(acc) AS b FROM v_doc WHERE acc IS NOT NULL GROUP BY ALL), d AS (SELECT method, domain, avg(b) AS d FROM b GROUP BY ALL),
t AS (SELECT method, avg(d) AS total FROM d GROUP BY 1), e AS (SELECT max(total) FILTER (method = 'src1') AS b, max(total) FILTER (method = 'src2') AS r FROM t)
SELECT method, domain, {q8('d', 'd')}, {q8('total', 'total')}, {q8("CASE WHEN method <> 'src1' AND r <> e.b THEN (total - e.b) / (r - e.b) END", 'recovery')} FROM d JOIN t USING (method), e""")
def domain_macro_recovery(spark, sf):
    rows = v_doc(spark, sf).filter("acc is not null").withColumnRenamed("dataset", "method")
    out = E.domain_macro_recovery(rows, "method", "domain", "truncated", "acc", base="src1", reference="src2")
    return rounded(out.select("method", "domain", "d", "total", "recovery"), "d", "total", "recovery")


@query("special_token_counts", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS t FROM documents),
c AS (SELECT doc_id, t, count(*) AS n FROM w WHERE t IN ('the', 'and', 'der', 'la', 'el') GROUP BY ALL), j AS (SELECT doc_id, string_agg('"' || t || '": ' || n, ', ' ORDER BY t) AS s FROM c GROUP BY 1)
SELECT doc_id, '{' || coalesce(s, '') || '}' AS counts FROM documents LEFT JOIN j USING (doc_id)""")
def special_token_counts(spark, sf):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\S+"), 0)
    rows = table(spark, sf, "documents").select("doc_id", tokens.alias("t"))
    return rows.select("doc_id", E.special_token_counts(F.col("t"), ["the", "and", "der", "la", "el"]).alias("counts"))


@query("flatten_completions", with_ctes(MSG) + """SELECT conv_id, (i - 1)::INTEGER AS completion_index, sha256(m.content) AS completion, len(regexp_extract_all(m.content, '\\S+'))::INTEGER AS completion_tokens, 'stop' AS finish_reason
 FROM (SELECT conv_id, unnest(list_filter(messages, lambda x: x.role = 'assistant')) AS m, generate_subscripts(list_filter(messages, lambda x: x.role = 'assistant'), 1) AS i FROM v_msg) UNION ALL
 SELECT conv_id, 0, sha256(''), 0, NULL FROM v_msg WHERE len(list_filter(messages, lambda x: x.role = 'assistant')) = 0""")
def flatten_completions(spark, sf):
    out = F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: F.struct(
        m["content"].alias("text"), F.regexp_count(m["content"], F.lit(r"(?U)\S+")).alias("tokens"), F.lit("stop").alias("finish_reason"), F.lit(None).cast("string").alias("stop_reason")))
    rows = E.flatten_completions(v_msg(spark, sf).withColumn("outputs", out), ["conv_id"], "outputs")
    return rows.select("conv_id", "completion_index", F.sha2("completion", 256).alias("completion"), "completion_tokens", "finish_reason")


@query("sample_browser", "SELECT doc_id, source, len(regexp_extract_all(text, 'and'))::INTEGER AS hits FROM documents WHERE contains(text, 'and')")
def sample_browser(spark, sf):
    return E.sample_browser(table(spark, sf, "documents"), ["doc_id", "source"], "text", "and", [])


@query("sample_browser_top", "SELECT doc_id, n_chars, len(regexp_extract_all(text, 'the'))::INTEGER AS hits FROM documents WHERE contains(text, 'the') ORDER BY n_chars DESC, doc_id LIMIT 25")
def sample_browser_top(spark, sf):
    return E.sample_browser(table(spark, sf, "documents"), ["doc_id", "n_chars"], "text", "the", [F.col("n_chars").desc(), F.col("doc_id")], 25)


@query("self_overlap_flag")
def self_overlap_flag(spark, sf):
    return E.self_overlap_flag(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "overlap", "overlapping")


@query("distributions", """SELECT 'lang' AS field, lang AS value, count(*)::BIGINT AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2""")
def distributions(spark, sf):
    return E.distributions(table(spark, sf, "documents"), ["lang", "source"])


@query("distributions_top", """SELECT field, value, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM (
 SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2)) WHERE r <= 3""")
def distributions_top(spark, sf):
    return E.distributions(table(spark, sf, "documents"), ["lang", "source"], 3)


# ---- run log ------------------------------------------------------------------------

TRI = lambda c, n, w="": ", ".join(q8(f"{f}({c}){w}", f"{n}_{k}") for k, f in (("mean", "avg"), ("max", "max"), ("min", "min")))
AL = " FILTER (ln > 0)"


@query("batch_data_metrics", with_ctes(TOK, ROLL) + f"""
, x AS (SELECT *, reward - 0.5 AS adv, value * 2 AS ret FROM v_tok), ln AS (SELECT step, sample_id, sum(mask) AS ln FROM x GROUP BY ALL),
s AS (SELECT r.step, r.sample_id, score, acc, coalesce(ln, 0) AS ln, uid % 50 AS pl, sample_id % 7 AS tu FROM v_roll r LEFT JOIN ln USING (step, sample_id)),
sm AS (SELECT step, {TRI('score', 'score', AL)}, {TRI('acc', 'reward', AL)}, {TRI('ln', 'length')}, {TRI('ln', 'length_alive', AL)}, {q8("avg(CASE WHEN ln = 8 THEN 1.0 ELSE 0.0 END)", "length_clip")},
 {q8("avg(CASE WHEN ln = 0 THEN 1.0 ELSE 0.0 END)", "aborted_share")}, {TRI('pl', 'prompt')}, {q8("avg(CASE WHEN pl = 49 THEN 1.0 ELSE 0.0 END)", "prompt_clip")}, {TRI('tu', 'turns')} FROM s GROUP BY step),
tk AS (SELECT step, {q8("avg(adv) FILTER (mask = 1 AND adv <> 0)", "adv_mean")}, {q8("stddev_samp(adv) FILTER (mask = 1 AND adv <> 0)", "adv_std")}, {q8("avg(abs(adv)) FILTER (mask = 1 AND adv <> 0)", "adv_abs_mean")},
 count(*) FILTER (mask = 1 AND abs(adv) > 5)::BIGINT AS adv_extreme, {q8("max(abs(adv)) FILTER (mask = 1)", "adv_abs_max")}, {q8("max(adv) FILTER (mask = 1)", "adv_max")}, {q8("min(adv) FILTER (mask = 1)", "adv_min")},
 {q8("avg(ret) FILTER (mask = 1 AND ret <> 0)", "return_mean")}, {q8("max(ret) FILTER (mask = 1)", "return_max")}, {q8("min(ret) FILTER (mask = 1)", "return_min")},
 {q8("avg(value) FILTER (mask = 1)", "value_mean")}, {q8("max(value) FILTER (mask = 1)", "value_max")}, {q8("min(value) FILTER (mask = 1)", "value_min")},
 {q8("1 - var_samp(ret - value) FILTER (mask = 1) / (var_samp(ret) FILTER (mask = 1) + 1e-5)", "explained_var")}, {q8("avg(adv) FILTER (mask = 1 AND pos <= 2)", "adv_mean_first_2")}, {q8("avg(adv) FILTER (mask = 1 AND pos <= 4)", "adv_mean_first_4")} FROM x GROUP BY step)
SELECT * FROM sm LEFT JOIN tk USING (step)""".replace("\n, x AS", ", x AS"))
def batch_data_metrics(spark, sf):
    tok = v_tok(spark, sf).withColumn("adv", F.col("reward") - 0.5).withColumn("ret", F.col("value") * 2)
    smp = v_roll(spark, sf).withColumn("pl", F.col("uid") % 50).withColumn("tu", F.col("sample_id") % 7)
    out = R.batch_data_metrics(tok, smp, "step", "sample_id", adv="adv", ret="ret", value="value", mask="mask", pos="pos", score="score", reward="acc",
                               prompt_length="pl", turns="tu", max_response=8, max_prompt=49, cutoffs=(2, 4))
    return rounded(out, *[c for c in out.columns if c not in ("step", "adv_extreme")])


STAGES = """tm AS (SELECT CAST(ts AS DATE) AS day, CASE event_type WHEN 'click' THEN 'gen' WHEN 'view' THEN 'step' ELSE 'update_actor' END AS stage, sum(value) AS seconds FROM events GROUP BY ALL),
tt AS (SELECT CAST(ts AS DATE) AS day, sum(user_id) AS p, sum(json_extract_string(props, '$.k')::BIGINT) AS r FROM events GROUP BY 1)"""


@query("timing_throughput", f"""WITH {STAGES} SELECT day, stage, {q8('seconds', 'seconds')}, {q8("seconds * 1000 / CASE WHEN stage = 'gen' THEN r ELSE p + r END", 'ms_per_token')},
 {q8("CASE WHEN stage = 'step' THEN (p + r) / (seconds * 8) END", 'tokens_per_second')} FROM tm JOIN tt USING (day)""")
def timing_throughput(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    stage = F.when(F.col("event_type") == "click", "gen").when(F.col("event_type") == "view", "step").otherwise("update_actor")
    totals = e.groupBy("day").agg(F.sum("user_id").alias("prompt_tokens"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("response_tokens"))
    out = R.timing_throughput(e.withColumn("stage", stage), totals, "day", "stage", "value", 8)
    return rounded(out, "seconds", "ms_per_token", "tokens_per_second")


LOG = """lg AS (SELECT user_id % 4 AS run, event_id AS step, CASE event_id % 10 WHEN 0 THEN 'global_seqlen/max' WHEN 1 THEN 'global_seqlen/min' WHEN 2 THEN 'perf/total_num_tokens' WHEN 3 THEN 'perf/time_per_step'
 WHEN 4 THEN 'perf/throughput' WHEN 5 THEN 'timing_s/gen' WHEN 6 THEN 'timing_s/step' WHEN 7 THEN 'training/global_step' WHEN 8 THEN 'reward/max_mean' ELSE 'loss' END AS metric, value FROM events)"""


def _log(spark, sf):
    return table(spark, sf, "events").select((F.col("user_id") % 4).alias("run"), F.col("event_id").alias("step"), F.element_at(F.array(*[F.lit(x) for x in (
        "global_seqlen/max", "global_seqlen/min", "perf/total_num_tokens", "perf/time_per_step", "perf/throughput", "timing_s/gen", "timing_s/step", "training/global_step", "reward/max_mean", "loss")]),
        (F.col("event_id") % 10 + 1).cast("int")).alias("metric"), "value")


@query("reduce_by_name", f"WITH {LOG} SELECT run, metric, {q8("CASE WHEN contains(metric, 'max') THEN max(value) WHEN contains(metric, 'min') THEN min(value) ELSE avg(value) END", 'value')} FROM lg GROUP BY run, metric")
def reduce_by_name(spark, sf):
    return rounded(R.reduce_metrics(_log(spark, sf), "metric", "value", ["run"]), "value")


@query("reduce_run", f"""WITH {LOG}, b AS (SELECT run, metric, CASE WHEN metric IN ('perf/time_per_step', 'timing_s/gen', 'timing_s/step', 'perf/total_num_tokens') THEN sum(value) WHEN metric = 'training/global_step' THEN arg_max(value, step)
 WHEN metric = 'reward/max_mean' THEN avg(value) WHEN metric = 'global_seqlen/max' THEN max(value) WHEN metric = 'global_seqlen/min' THEN min(value) ELSE avg(value) END AS v FROM lg GROUP BY run, metric),
w AS (SELECT run, max(v) FILTER (metric = 'perf/total_num_tokens') AS tok, max(v) FILTER (metric = 'perf/time_per_step') AS sec, max(v) FILTER (metric = 'timing_s/gen') AS g, max(v) FILTER (metric = 'timing_s/step') AS s FROM b GROUP BY 1)
SELECT run, metric, {q8("CASE WHEN metric = 'perf/throughput' THEN tok / (sec * 8) ELSE v END", 'value')} FROM b JOIN w USING (run) UNION ALL SELECT run, 'trainer/idle_ratio', {q8('g / s', 'value')} FROM w""")
def reduce_run(spark, sf):
    return rounded(R.reduce_run(_log(spark, sf), "run", "step", "metric", "value", devices=8), "value")


STALE = "sv AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS vs, json_extract_string(props, '$.k')::BIGINT + user_id % 3 AS ve FROM events)"


@query("staleness_metrics", f"""WITH {STALE} SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (90 - vs >= 1)::BIGINT AS stale_samples, count(*) FILTER (90 - ve >= 1)::BIGINT AS stale_trajectories,
 count(*) FILTER (ve <> vs)::BIGINT AS partial, {q8("avg(CASE WHEN ve <> vs THEN 1.0 ELSE 0.0 END)", "partial_ratio")}, max(abs(ve - vs))::BIGINT AS max_span, {q8("avg(value)", "time_avg")}, {q8("max(value)", "time_max")}, {q8("min(value)", "time_min")},
 count(DISTINCT vs)::BIGINT AS version_diversity, {q8("quantile_cont(value, 0.5)", "time_p50")}, {q8("quantile_cont(value, 0.95)", "time_p95")}, {q8("quantile_cont(value, 0.99)", "time_p99")} FROM sv GROUP BY 1""")
def staleness_metrics(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = table(spark, sf, "events").withColumn("vs", k).withColumn("ve", k + F.col("user_id") % 3)
    out = R.staleness_metrics(e, current=90, version_start="vs", version_end="ve", seconds="value", keys=["event_type"])
    return rounded(out, "partial_ratio", "time_avg", "time_max", "time_min", "time_p50", "time_p95", "time_p99")


@query("dynamic_sampling_metrics", with_ctes(ROLL) + f""", r AS (SELECT v.*, l.n_tok FROM v_roll v JOIN (SELECT l_orderkey, count(*) AS n_tok FROM lineitem GROUP BY 1) l ON sample_id = l_orderkey),
g AS (SELECT uid, avg(acc) AS m, stddev_pop(acc) AS s, count(*) AS n FROM r GROUP BY 1), k AS (SELECT * FROM r WHERE uid IN (SELECT uid FROM g WHERE s > 0 OR n = 1))
SELECT (SELECT count(*) FROM g)::BIGINT AS n_groups, (SELECT count(*) FROM g WHERE s > 0 OR n = 1)::BIGINT AS kept_groups, {q8("(SELECT avg(CASE WHEN m = 1 THEN 1.0 ELSE 0.0 END) FROM g)", "all_right")},
 {q8("(SELECT avg(CASE WHEN m = 0 THEN 1.0 ELSE 0.0 END) FROM g)", "all_wrong")}, {q8("(SELECT avg(CASE WHEN m > 0 AND m < 1 THEN 1.0 ELSE 0.0 END) FROM g)", "mixed")}, {q8("(SELECT avg(acc) FROM r)", "acc_full")},
 (SELECT quantile_disc(n_tok, 0.5) FROM k)::BIGINT AS length_p50, {q8("(SELECT quantile_cont(n_tok, 0.95) FROM k)", "length_p95")}, {q8("(SELECT avg(acc) FROM k)", "acc_kept")}, {q8("(SELECT avg(CASE WHEN n_tok >= 6 THEN 1.0 ELSE 0.0 END) FROM k)", "trunc_rate")},
 {q8("(SELECT avg(acc) FROM k WHERE n_tok >= 6)", "acc_truncated")}, {q8("(SELECT avg(acc) FROM k WHERE n_tok < 6)", "acc_others")}""")
def dynamic_sampling_metrics(spark, sf):
    lengths = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.count(F.lit(1)).alias("n_tok"))
    out = R.dynamic_sampling_metrics(v_roll(spark, sf).join(lengths, "sample_id"), "uid", "acc", "n_tok", 6)
    return rounded(out, *[c for c in out.columns if c not in ("n_groups", "kept_groups", "length_p50")])


@query("subspace_energy")
def subspace_energy(spark, sf):
    return R.subspace_energy(table(spark, sf, "embeddings"), "embedding", ["label"], [1, 4, 16, 64])


@query("subspace_energy_total", """SELECT label, 64::INTEGER AS rank, 1.0::DOUBLE AS energy FROM embeddings GROUP BY label""")
def subspace_energy_total(spark, sf):
    out = R.subspace_energy(table(spark, sf, "embeddings"), "embedding", ["label"], [64])
    return rounded(out.select("label", "rank", "energy"), "energy")
