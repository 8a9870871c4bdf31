"""Dedup, sampling, mixing and batch composition over the tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from rollstat.functions.columns import collapse_ws, word_count
from rollstat.operators import sampling as S
from rollstat.operators.ranking import position
from rollstat.plans.registry import query
from rollstat.plans.views import DOC, ROLL, q8, rounded, table, v_doc, v_roll, with_ctes

WS = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
FUNNEL = f"""f AS (SELECT d.doc_id, {WS} AS q, CAST(floor(d.n_chars / 200) AS INTEGER) AS diff, l.quality AS ans,
  len(regexp_extract_all(d.text, '\\S+')) AS toks FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
r AS (SELECT *, sha256(q) AS h, CASE WHEN q = '' THEN 'prompt_schema' WHEN diff NOT BETWEEN 1 AND 40 THEN 'difficulty'
  WHEN ans IS NULL THEN 'answer' WHEN toks > 1000 THEN 'prompt_too_long' ELSE 'ok' END AS reason FROM f)"""


def _govern(spark, sf):
    rows = v_doc(spark, sf)
    return S.govern_rows(
        rows, question=collapse_ws("completion"), difficulty=F.floor(F.col("n_chars") / 200), answer=F.col("acc"),
        tokens=word_count("completion"), source_row="doc_id", seed=42, min_difficulty=1, max_difficulty=40,
        max_tokens=1000, target_rows=20)


@query("govern_rows", with_ctes(FUNNEL) + """, u AS (SELECT h, min(doc_id) AS doc_id FROM r WHERE reason = 'ok' GROUP BY h),
k AS (SELECT *, sha256('42:' || h) AS sample_key, row_number() OVER (ORDER BY sha256('42:' || h)) - 1 AS i FROM u)
SELECT doc_id, h AS prompt_sha256, sample_key, i::BIGINT AS "index" FROM k WHERE i < 20""")
def govern_rows(spark, sf):
    return _govern(spark, sf)[0].select("doc_id", "prompt_sha256", "sample_key", F.col("index").cast("bigint").alias("index"))


@query("govern_counters", with_ctes(FUNNEL) + """SELECT count(*)::BIGINT AS raw_rows, count(*) FILTER (reason = 'prompt_schema')::BIGINT AS rejected_prompt_schema,
 count(*) FILTER (reason = 'difficulty')::BIGINT AS rejected_difficulty, count(*) FILTER (reason = 'answer')::BIGINT AS rejected_answer,
 count(*) FILTER (reason = 'prompt_too_long')::BIGINT AS rejected_prompt_too_long, count(*) FILTER (reason = 'ok')::BIGINT AS eligible,
 count(DISTINCT h) FILTER (reason = 'ok')::BIGINT AS unique_rows, (count(*) FILTER (reason = 'ok') - count(DISTINCT h) FILTER (reason = 'ok'))::BIGINT AS deduplicated,
 20::BIGINT AS selected FROM r""")
def govern_counters(spark, sf):
    return _govern(spark, sf)[1]


@query("dedup_first_prompt", "SELECT min(doc_id)::BIGINT AS doc_id, sha256(text) AS h, any_value(lang ORDER BY doc_id) AS lang FROM documents GROUP BY text")
def dedup_first_prompt(spark, sf):
    out = S.dedup_first(table(spark, sf, "documents"), F.col("text"), "doc_id")
    return out.select("doc_id", F.sha2("text", 256).alias("h"), "lang")


SUCCESS = """e AS (SELECT *, 'user ' || user_id AS prompt, (epoch(date_trunc('day', ts))::BIGINT // 86400) AS step FROM events),
g AS (SELECT * FROM e WHERE value >= 50 AND event_type <> 'error')"""


def _success(spark, sf):
    e = table(spark, sf, "events").withColumn("prompt", F.concat(F.lit("user "), F.col("user_id"))).withColumn(
        "step", F.unix_date(F.to_date("ts")))
    return S.latest_success_per_prompt(e, prompt="prompt", response="props", step="step", score="value", min_score=50,
                                       extra_ok=F.col("event_type") != "error")


@query("latest_success_per_prompt", with_ctes(SUCCESS) + """SELECT prompt, step::INTEGER AS step, value, o AS output_sha256, event_id FROM (
 SELECT *, sha256(props) AS o, row_number() OVER (PARTITION BY prompt ORDER BY step DESC, value DESC, sha256(props)) AS rn FROM g) WHERE rn = 1""")
def latest_success_per_prompt(spark, sf):
    return _success(spark, sf)[0].select("prompt", "step", "value", "output_sha256", "event_id")


@query("latest_success_counters", with_ctes(SUCCESS) + """SELECT (SELECT count(*) FROM e)::BIGINT AS input_rows, (SELECT count(*) FROM g)::BIGINT AS eligible_rows,
 (SELECT count(DISTINCT prompt) FROM g)::BIGINT AS selected_prompts""")
def latest_success_counters(spark, sf):
    return _success(spark, sf)[1]


@query("last_turn_best_score", """SELECT conv_id, turn, role, sha256(text) AS h FROM (
 SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, length(text) DESC) AS rn FROM conversations) WHERE rn = 1""")
def last_turn_best_score(spark, sf):
    c = table(spark, sf, "conversations").withColumn("score", F.length("text"))
    return S.last_turn_best_score(c, "conv_id", "turn", "score").select("conv_id", "turn", "role", F.sha2("text", 256).alias("h"))


EXCLUDED = ["src3", "src7", "src11"]
EX_SQL = "('src3', 'src7', 'src11')"


@query("bottom_k_hash_sample", f"""SELECT doc_id, lang, (rn - 1)::BIGINT AS mix_index, lang || '-' || (rn - 1) AS "index" FROM (
 SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY substr(sha256('7:' || lang || ':' || doc_id), 1, 16), doc_id) AS rn
 FROM documents WHERE source NOT IN {EX_SQL}) WHERE rn <= 8""")
def bottom_k_hash_sample(spark, sf):
    out = S.bottom_k_hash_sample(table(spark, sf, "documents"), "lang", "doc_id", 8, 7, source="source", excluded=EXCLUDED)
    return out.select("doc_id", "lang", F.col("mix_index").cast("bigint").alias("mix_index"), "index")


@query("full_union", f"""SELECT doc_id, lang AS domain, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::BIGINT AS mix_index
 FROM documents WHERE source NOT IN {EX_SQL}""")
def full_union(spark, sf):
    d = table(spark, sf, "documents")
    parts = {x: d.filter(F.col("lang") == x) for x in ("en", "fr", "de", "es")}
    return S.full_union(parts, "doc_id", source="source", excluded=EXCLUDED).select(
        "doc_id", "domain", F.col("mix_index").cast("bigint").alias("mix_index"))


@query("balanced_domain_sample", """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('5:' || lang || ':' || doc_id)) AS rn FROM documents)
 WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))""")
def balanced_domain_sample(spark, sf):
    return S.balanced_domain_sample(table(spark, sf, "documents"), "lang", "doc_id", 5).select("doc_id", "lang")


# 60 rows over weights 5:2:2:1
@query("weighted_allocation", """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('9:' || lang || ':' || doc_id)) AS rn FROM documents)
 WHERE rn <= CASE lang WHEN 'en' THEN 30 WHEN 'fr' THEN 12 WHEN 'de' THEN 12 ELSE 6 END""")
def weighted_allocation(spark, sf):
    return S.weighted_allocation(table(spark, sf, "documents"), "lang", "doc_id", 9, total=60,
                                 weights={"en": 5, "fr": 2, "de": 2, "es": 1}).select("doc_id", "lang")


@query("largest_remainder_quota", """WITH w AS (SELECT c_mktsegment, count(*) AS w FROM customer GROUP BY 1),
r AS (SELECT *, 128 * w / sum(w) OVER () AS raw, row_number() OVER (ORDER BY c_mktsegment) AS o FROM w),
f AS (SELECT *, row_number() OVER (ORDER BY raw - floor(raw) DESC, o) AS rk, 128 - sum(floor(raw)) OVER () AS l FROM r)
SELECT c_mktsegment, w::BIGINT AS w, (floor(raw) + CASE WHEN rk <= l THEN 1 ELSE 0 END)::BIGINT AS quota FROM f""")
def largest_remainder_quota(spark, sf):
    w = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("w"))
    return S.largest_remainder_quota(w, "w", "c_mktsegment", 128)


@query("round_robin_mix", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('3:' || doc_id) DESC) AS r,
 CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS o FROM documents)
SELECT doc_id, lang, row_number() OVER (ORDER BY r, o)::BIGINT AS mix_position FROM r""")
def round_robin_mix(spark, sf):
    d = table(spark, sf, "documents").withColumn("key", F.sha2(F.concat(F.lit("3:"), F.col("doc_id")), 256))
    return S.round_robin_mix(d, "lang", ["en", "fr", "de", "es"], "key").select("doc_id", "lang", "mix_position")


@query("strict_interleave_check", """WITH b AS (SELECT o_orderkey // 192 AS batch, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b,
 count(*) FILTER (o_orderstatus = 'P') AS c, count(*) FILTER (o_orderstatus <> CASE o_orderkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END) AS x FROM orders GROUP BY 1)
SELECT batch, n::BIGINT AS n_rows, a::BIGINT AS n_0, b::BIGINT AS n_1, c::BIGINT AS n_2, x::BIGINT AS out_of_order, 0::BIGINT AS empty_truth,
 (n < 192 OR (a = 64 AND b = 64 AND c = 64)) AND x = 0 AS ok FROM b""")
def strict_interleave_check(spark, sf):
    return S.strict_interleave_check(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus", ["F", "O", "P"], truth="o_orderpriority")


PLAN_W = {"en": 2.0, "fr": 2.0, "de": 1.0, "es": 2.0}  # 64 rows: 19, 18, 9, 18 and 18, 19 on odd batches
CYCLED = """sz AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
cy AS (SELECT d.doc_id, d.lang, s.n, unnest(range(need.c)) AS cycle FROM documents d JOIN sz s USING (lang) JOIN need USING (lang)),
po AS (SELECT *, cycle * n + row_number() OVER (PARTITION BY lang, cycle ORDER BY sha256('11:' || cycle || ':' || lang || ':' || doc_id)) - 1 AS slot FROM cy)"""


@query("weighted_batch_plan", """WITH nb AS (SELECT count(*) // 64 AS b FROM documents),
q AS (SELECT * FROM (VALUES ('en', 19, 18), ('fr', 18, 19), ('de', 9, 9), ('es', 18, 18)) t(lang, e, o)),
need AS (SELECT lang, CAST(ceil((e * ((b + 1) // 2) + o * (b // 2)) / (SELECT count(*) FROM documents x WHERE x.lang = q.lang)) AS BIGINT) AS c FROM q, nb),
""" + CYCLED + """, p AS (SELECT po.*, 2 * (slot // (e + o)) + CASE WHEN slot % (e + o) >= e THEN 1 ELSE 0 END AS batch FROM po JOIN q USING (lang))
SELECT batch::BIGINT AS batch, lang, slot::BIGINT AS slot, doc_id,
 row_number() OVER (PARTITION BY batch ORDER BY sha256('11:' || batch || ':' || lang || ':' || slot))::INTEGER AS place FROM p WHERE batch < (SELECT b FROM nb)""")
def weighted_batch_plan(spark, sf):
    return S.weighted_batch_plan(table(spark, sf, "documents"), "lang", "doc_id", batch_size=64, weights=PLAN_W, seed=11).select(
        "batch", "lang", "slot", "doc_id", "place")


MIXTURE = {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}
JIT = """nb AS (SELECT count(*) // 64 AS b FROM documents),
bd AS (SELECT unnest(range(b)) AS batch, b FROM nb),
jw AS (SELECT batch, lang, o, w * (1 + (2 * (CAST('0x' || substr(sha256('11:' || batch || ':' || lang), 1, 12) AS BIGINT)::DOUBLE / 281474976710656::DOUBLE) - 1) * 0.2) AS w
 FROM bd, (VALUES ('en', 0, 0.4::DOUBLE), ('fr', 1, 0.3::DOUBLE), ('de', 2, 0.2::DOUBLE), ('es', 3, 0.1::DOUBLE)) t(lang, o, w)),
jr AS (SELECT *, 64 * w / sum(w) OVER (PARTITION BY batch) AS raw FROM jw),
jq AS (SELECT batch, lang, floor(raw) + CASE WHEN row_number() OVER (PARTITION BY batch ORDER BY raw - floor(raw) DESC, o) <= 64 - sum(floor(raw)) OVER (PARTITION BY batch) THEN 1 ELSE 0 END AS quota FROM jr)"""


@query("jittered_quotas", f"WITH {JIT} SELECT batch::BIGINT AS batch, lang AS domain, quota::BIGINT AS quota FROM jq")
def jittered_quotas(spark, sf):
    n = table(spark, sf, "documents").count() // 64
    return S.jittered_quotas(spark, n, MIXTURE, batch_size=64, jitter=0.2, seed=11).select("batch", "domain", "quota")


@query("jittered_batch_plan", f"""WITH {JIT}, ru AS (SELECT *, sum(quota) OVER (PARTITION BY lang ORDER BY batch) AS u FROM jq),
need AS (SELECT lang, CAST(ceil(sum(quota) / (SELECT count(*) FROM documents x WHERE x.lang = jq.lang)) AS BIGINT) AS c FROM jq GROUP BY lang), {CYCLED},
p AS (SELECT po.doc_id, po.lang, po.slot, ru.batch FROM po JOIN ru ON po.lang = ru.lang AND po.slot >= ru.u - ru.quota AND po.slot < ru.u)
SELECT batch::BIGINT AS batch, lang, slot::BIGINT AS slot, doc_id, row_number() OVER (PARTITION BY batch ORDER BY sha256('11:' || batch || ':' || lang || ':' || slot))::INTEGER AS place FROM p""")
def jittered_batch_plan(spark, sf):
    return S.jittered_batch_plan(table(spark, sf, "documents"), "lang", "doc_id", batch_size=64, mixture=MIXTURE, jitter=0.2, seed=11).select(
        "batch", "lang", "slot", "doc_id", "place")


@query("seeded_split", """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('13:' || doc_id)) <= 100 THEN 'validation' ELSE 'train' END AS split FROM documents""")
def seeded_split(spark, sf):
    return S.seeded_split(table(spark, sf, "documents"), "doc_id", 13, 100).select("doc_id", "split")


SUBSET = "w AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS id FROM part WHERE p_brand IN ('Brand#1', 'Brand#2'))"


def _subset(spark, sf):
    ids = table(spark, sf, "part").filter(F.col("p_brand").isin("Brand#1", "Brand#2"))
    e = table(spark, sf, "events").withColumn("meta", F.concat(F.lit('{"question_id": '), F.get_json_object("props", "$.k"), F.lit("}")))
    return S.subset_by_ids(e, S.json_question_id("meta"), ids, "p_size")


@query("subset_by_ids", f"WITH {SUBSET} SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') IN (SELECT id FROM w)")
def subset_by_ids(spark, sf):
    return _subset(spark, sf)[0].select("event_id", "user_id")


@query("subset_report", f"""WITH {SUBSET} SELECT (SELECT count(*) FROM events)::BIGINT AS rows_before,
 (SELECT count(*) FROM events WHERE json_extract_string(props, '$.k') IN (SELECT id FROM w))::BIGINT AS rows_after, (SELECT count(*) FROM w)::BIGINT AS n_ids, '' AS note""")
def subset_report(spark, sf):
    return _subset(spark, sf)[1]


@query("exclude_sources", f"SELECT doc_id, source FROM documents WHERE source NOT IN {EX_SQL}")
def exclude_sources(spark, sf):
    return S.exclude_sources(table(spark, sf, "documents"), "source", EXCLUDED).select("doc_id", "source")


@query("exclusion_report", f"""SELECT lang, count(*)::BIGINT AS scanned, count(*) FILTER (source IN {EX_SQL})::BIGINT AS excluded,
 count(*) FILTER (source NOT IN {EX_SQL})::BIGINT AS selected FROM documents GROUP BY lang""")
def exclusion_report(spark, sf):
    return S.exclusion_report(table(spark, sf, "documents"), ["lang"], "source", EXCLUDED)


@query("repeat_plan", """SELECT doc_id, source, unnest(range(CASE source WHEN 'src1' THEN 4 WHEN 'src2' THEN 1 ELSE 2 END))::INTEGER AS repeat_idx,
 CASE source WHEN 'src2' THEN 0.0 WHEN 'src1' THEN 0.7 ELSE 1.0 END::DOUBLE AS temperature, 0.95::DOUBLE AS top_p,
 CASE source WHEN 'src1' THEN 50 END::DOUBLE AS top_k, 8192::DOUBLE AS max_tokens FROM documents""")
def repeat_plan(spark, sf):
    out = S.repeat_plan(table(spark, sf, "documents").select("doc_id", "source"), "source",
                        {"n": 1, "temperature": 1.0, "top_p": 0.95, "max_tokens": 8192},
                        {"*": {"n": 2}, "src1": {"n": 4, "temperature": 0.7, "top_k": 50}, "src2": {"do_sample": False}})
    return out


@query("repeat_rows", """SELECT o_orderkey, i::INTEGER AS rep, (o_orderkey * 3 + i)::BIGINT AS interleaved, (i * (SELECT count(*) FROM orders) + o_orderkey)::BIGINT AS tiled
 FROM (SELECT o_orderkey, unnest(range(3)) AS i FROM orders)""")
def repeat_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    a = S.repeat_rows(o, 3, "o_orderkey").withColumnRenamed("out_position", "interleaved")
    b = S.repeat_rows(o, 3, "o_orderkey", interleave=False).withColumnRenamed("out_position", "tiled")
    return a.join(b, ["o_orderkey", "rep"])


@query("repeat_rows_per_row", "SELECT o_orderkey, unnest(range(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END))::INTEGER AS rep FROM orders")
def repeat_rows_per_row(spark, sf):
    o = table(spark, sf, "orders")
    times = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return S.repeat_rows(o, times, "o_orderkey").select("o_orderkey", "rep")


@query("informative_groups", with_ctes(ROLL) + """SELECT uid, sample_id, acc FROM v_roll WHERE uid IN (
 SELECT uid FROM v_roll GROUP BY uid HAVING stddev_pop(acc) > 0 OR count(*) = 1)""")
def informative_groups(spark, sf):
    return S.informative_groups(v_roll(spark, sf), "uid", "acc").select("uid", "sample_id", "acc")


@query("group_outcome_report", with_ctes(ROLL) + f"""SELECT count(*)::BIGINT AS n_groups, count(*) FILTER (s > 0 OR n = 1)::BIGINT AS kept_groups,
 {q8("avg(CASE WHEN m = 1 THEN 1.0 ELSE 0.0 END)", "all_right")}, {q8("avg(CASE WHEN m = 0 THEN 1.0 ELSE 0.0 END)", "all_wrong")},
 {q8("avg(CASE WHEN m > 0 AND m < 1 THEN 1.0 ELSE 0.0 END)", "mixed")} FROM (SELECT uid, avg(acc) AS m, stddev_pop(acc) AS s, count(*) AS n FROM v_roll GROUP BY uid)""")
def group_outcome_report(spark, sf):
    return rounded(S.group_outcome_report(v_roll(spark, sf), "uid", "acc"), "all_right", "all_wrong", "mixed")


@query("take_complete_groups", with_ctes(ROLL) + """SELECT uid, sample_id FROM v_roll WHERE uid IN (
 SELECT uid FROM (SELECT uid, min(sample_id) AS f FROM v_roll GROUP BY uid) ORDER BY f LIMIT 100)""")
def take_complete_groups(spark, sf):
    return S.take_complete_groups(v_roll(spark, sf), "uid", "sample_id", 100).select("uid", "sample_id")


@query("take_complete_groups_by_domain", with_ctes(ROLL) + """, h AS (SELECT uid, min(sample_id) AS f, arg_min(domain, sample_id) AS d FROM v_roll GROUP BY uid),
r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY f) AS rn FROM h)
SELECT uid, sample_id FROM v_roll WHERE uid IN (SELECT uid FROM r WHERE (d = '1-URGENT' AND rn <= 10) OR (d = '5-LOW' AND rn <= 5))""")
def take_complete_groups_by_domain(spark, sf):
    return S.take_complete_groups(v_roll(spark, sf), "uid", "sample_id", domain="domain",
                                  domain_quotas={"1-URGENT": 10, "5-LOW": 5}).select("uid", "sample_id")


@query("band_filter_downsample", with_ctes(ROLL) + """, x AS (SELECT *, o_totalprice AS len FROM v_roll JOIN orders ON sample_id = o_orderkey),
g AS (SELECT uid, avg(acc) BETWEEN 0.2 AND 0.8 AND max(len) < 499999 AS p, min(sample_id) AS f FROM x GROUP BY uid),
r AS (SELECT x.uid, x.sample_id, g.p, row_number() OVER (ORDER BY g.p DESC, g.f, x.sample_id) AS rn, count(*) OVER () AS n FROM x JOIN g USING (uid))
SELECT uid, sample_id, p AS passed, rn::BIGINT AS out_position FROM r WHERE rn <= floor(n / 4)""")
def band_filter_downsample(spark, sf):
    rows = v_roll(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_totalprice").alias("len")), "sample_id")
    out = S.band_filter_downsample(rows, "uid", "sample_id", "acc", "len", low=0.2, high=0.8, max_length=500000, oversample=4)
    return out.select("uid", "sample_id", "passed", "out_position")


@query("resample_weights", with_ctes(ROLL) + f"""SELECT sample_id, {q8("pow(abs(score), 2) + 1e-8", "w_pow")},
 {q8("CASE WHEN score IN ((SELECT max(score) FROM v_roll), (SELECT min(score) FROM v_roll)) THEN 1.0 ELSE 0.0 END + 1e-8", "w_max_min")},
 {q8("CASE WHEN score = (SELECT max(score) FROM v_roll) THEN 0.4 ELSE 0.1 END + 1e-8", "w_max_random")} FROM v_roll""")
def resample_weights(spark, sf):
    rows = v_roll(spark, sf).select("sample_id", "score")
    for m in ("pow", "max_min", "max_random"):
        rows = S.resample_weights(rows, "score", m).withColumnRenamed("weight", f"w_{m}")
    return rounded(rows.drop("score"), "w_pow", "w_max_min", "w_max_random")


@query("importance_resample", with_ctes(ROLL) + """, w AS (SELECT sample_id, score * score + 1e-8 AS w FROM v_roll),
c AS (SELECT sample_id, sum(w) OVER (ORDER BY sample_id) AS hi, sum(w) OVER (ORDER BY sample_id) - w AS lo FROM w),
d AS (SELECT CAST('0x' || substr(sha256('21:' || i), 1, 12) AS BIGINT)::DOUBLE / 281474976710656::DOUBLE * (SELECT sum(w) FROM w) AS x FROM range((SELECT count(*) FROM w)) t(i))
SELECT sample_id, count(*)::BIGINT AS copies FROM c JOIN d ON d.x >= c.lo AND d.x < c.hi GROUP BY sample_id""")
def importance_resample(spark, sf):
    rows = S.resample_weights(v_roll(spark, sf), "score", "pow")
    return S.importance_resample(rows, "sample_id", "weight", rows.count(), 21).select("sample_id", "copies")


@query("pad_to_divisor", """SELECT o_orderkey, false AS is_pad FROM orders UNION ALL
 SELECT o_orderkey, true FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders) WHERE rn <= (1024 - n % 1024) % 1024""")
def pad_to_divisor(spark, sf):
    return S.pad_to_divisor(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1024)


@query("range_slice_ranks", """WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 101 AS i FROM orders),
t AS (SELECT *, count(*) OVER () AS n FROM s WHERE i BETWEEN 0 AND 999)
SELECT o_orderkey, CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END::INTEGER AS rank FROM t""")
def range_slice_ranks(spark, sf):
    return S.range_slice_ranks(table(spark, sf, "orders"), "o_orderkey", base=100, offset=1000, ranks=7).select("o_orderkey", "rank")


SNAKE = """b AS (SELECT doc_id // 256 AS batch, doc_id, n_chars // 4 AS tokens, 24576 * (n_chars // 4) + (n_chars // 4) * (n_chars // 4) AS cost FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY cost DESC, doc_id) - 1 AS r FROM b),
s AS (SELECT *, CASE WHEN r % 16 < 8 THEN r % 16 ELSE 15 - r % 16 END AS shard FROM r),
u AS (SELECT *, row_number() OVER (PARTITION BY batch, shard ORDER BY cost, doc_id) - 1 AS u, count(*) OVER (PARTITION BY batch, shard) AS n FROM s)"""


def _batched(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 256).alias("batch"), F.floor(F.col("n_chars") / 4).alias("tokens"))


@query("balanced_sharding", f"""WITH {SNAKE} SELECT batch, doc_id, cost::BIGINT AS cost, shard::INTEGER AS shard,
 CASE WHEN u % 2 = 0 THEN u // 2 ELSE n - 1 - u // 2 END::INTEGER AS shard_place FROM u""")
def balanced_sharding(spark, sf):
    return S.balanced_sharding(_batched(spark, sf), "batch", "doc_id", "tokens", 8, partial=True).select("batch", "doc_id", "cost", "shard", "shard_place")


@query("sharding_report", f"""WITH {SNAKE}, x AS (SELECT batch, (doc_id % 256) // 32 AS g, sum(cost) AS c FROM u GROUP BY ALL), y AS (SELECT batch, shard, sum(cost) AS c FROM u GROUP BY ALL),
m AS (SELECT batch, min(c) AS lo, max(c) AS hi, sum(c) AS t FROM x GROUP BY 1), n AS (SELECT batch, min(c) AS lo, max(c) AS hi FROM y GROUP BY 1)
SELECT batch, m.lo::BIGINT AS "min", m.hi::BIGINT AS "max", (m.hi - m.lo)::BIGINT AS spread, n.lo::BIGINT AS balanced_min, n.hi::BIGINT AS balanced_max,
 (n.hi - n.lo)::BIGINT AS balanced_spread, {q8("m.t / 8", "mean")} FROM m JOIN n USING (batch)""")
def sharding_report(spark, sf):
    sharded = S.balanced_sharding(_batched(spark, sf), "batch", "doc_id", "tokens", 8, partial=True)
    return rounded(S.sharding_report(sharded, "batch", "doc_id", 8, 256), "mean")


PACKS = """b AS (SELECT doc_id // 256 AS batch, doc_id, n_chars // 4 AS tokens, 24576 * (n_chars // 4) + (n_chars // 4) * (n_chars // 4) AS cost FROM documents),
k AS (SELECT batch, CAST(ceil(greatest(least(count(*), ceil(sum(tokens) / 16384)), 2) / 2) * 2 AS BIGINT) AS n_packs FROM b GROUP BY 1),
r AS (SELECT b.*, n_packs, row_number() OVER (PARTITION BY batch ORDER BY cost DESC, doc_id) - 1 AS r, row_number() OVER (PARTITION BY batch ORDER BY doc_id) - 1 AS row_index FROM b JOIN k USING (batch)),
p AS (SELECT *, CASE WHEN r % (2 * n_packs) < n_packs THEN r % (2 * n_packs) ELSE 2 * n_packs - 1 - r % (2 * n_packs) END AS pack FROM r)"""


@query("pack_micro_batches", f"WITH {PACKS} SELECT batch, doc_id, n_packs, pack::INTEGER AS pack, row_index::INTEGER AS row_index FROM p")
def pack_micro_batches(spark, sf):
    return S.pack_micro_batches(_batched(spark, sf), "batch", "doc_id", "tokens", 16384, min_packs=2, multiple=2).select(
        "batch", "doc_id", "n_packs", "pack", "row_index")


@query("pack_report", f"""WITH {PACKS}, g AS (SELECT batch, pack, sum(tokens) AS tokens, sum(cost) AS cost, count(*) AS n, any_value(n_packs) AS k FROM p GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY cost DESC, pack) - 1 AS d FROM g)
SELECT batch, pack::INTEGER AS pack, tokens::BIGINT AS tokens, cost::BIGINT AS cost, n::BIGINT AS n_rows,
 CASE WHEN d % 2 = 0 THEN ceil(k / 2) - 1 - d // 2 ELSE ceil(k / 2) + d // 2 END::INTEGER AS run_order, tokens > 16384 AS over_budget FROM d""")
def pack_report(spark, sf):
    packed = S.pack_micro_batches(_batched(spark, sf), "batch", "doc_id", "tokens", 16384, min_packs=2, multiple=2)
    return S.pack_report(packed, "batch", "tokens", 16384)


@query("max_samples", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 200")
def max_samples(spark, sf):
    return S.max_samples(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 200)


@query("max_samples_seeded", "SELECT o_orderkey FROM orders ORDER BY sha256('4:' || o_orderkey) LIMIT 200")
def max_samples_seeded(spark, sf):
    return S.max_samples(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 200, seed=4)


@query("positional_union", f"""SELECT o_orderkey, o_orderstatus, n_lines::BIGINT AS n_lines, {q8("total", "total")}, o_orderstatus <> st AS conflict FROM orders JOIN (
 SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS total, max(l_linestatus) AS st FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def positional_union(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    right = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("total"), F.max("l_linestatus").alias("o_orderstatus"))
    return rounded(S.positional_union(left, right, "o_orderkey"), "total")


@query("batch_reshape", """SELECT o_orderkey AS position, o_custkey AS customer, (o_orderkey // 64)::BIGINT AS chunk, (o_orderkey % 64)::BIGINT AS chunk_place
 FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 5000 AND (o_orderkey - 10) % 3 = 0""")
def batch_reshape(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"))
    out = S.chunk_rows(S.slice_rows(o, "o_orderkey", 10, 5000, 3), "o_orderkey", 64)
    return out.withColumnRenamed("o_orderkey", "position")


@query("fold_unfold_rows", "SELECT o_orderkey AS position, o_custkey, o_orderstatus FROM orders")
def fold_unfold_rows(spark, sf):
    cols = ["o_custkey", "o_orderstatus"]
    return S.unfold_rows(S.fold_rows(table(spark, sf, "orders"), "o_orderkey", 16, cols), cols, 16)


@query("reorder_rows", "SELECT o_orderkey, o_custkey, ((SELECT count(*) FROM orders) - 1 - o_orderkey)::BIGINT AS out_position FROM orders")
def reorder_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    n = o.agg(F.count(F.lit(1)).alias("n")).scalar()
    index = o.select(F.col("o_orderkey").alias("index"), (n - 1 - F.col("o_orderkey")).alias("out_position"))
    return S.reorder_rows(o, index, "o_orderkey")


@query("append_generated", """SELECT doc_id, false AS generated FROM documents WHERE n_chars <= 4000 UNION ALL SELECT 1000000 + item_id, true FROM benchmark WHERE length(text) <= 4000""")
def append_generated(spark, sf):
    base = table(spark, sf, "documents").select("doc_id", "n_chars", F.lit(False).alias("generated"))
    new = table(spark, sf, "benchmark").select((F.col("item_id") + 1000000).alias("doc_id"), F.length("text").cast("bigint").alias("n_chars"), F.lit(True).alias("generated"))
    return S.append_generated(base, new, F.col("n_chars"), 4000).select("doc_id", "generated")


@query("balanced_sharding_exact")
def balanced_sharding_exact(spark, sf):
    from rollstat.operators.differencing import balanced_sharding_exact as exact

    rows = _batched(spark, sf).withColumn("cost", S.row_cost(F.col("tokens")))
    return exact(rows, "batch", "doc_id", "cost", 8, partial=True)


# the selection is the last copy of every labelled document, in order; copies share a key
RESTORE = """src AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS p, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id DESC) AS back, count(*) OVER (PARTITION BY lang, text) AS n FROM documents),
sel AS (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM src WHERE back = 1 AND doc_id IN (SELECT doc_id FROM labels)),
go(lang, i, p) AS (SELECT lang, i, (SELECT min(s.p) FROM src s WHERE s.lang = sel.lang AND s.text = sel.text) FROM sel WHERE i = 0
 UNION ALL SELECT sel.lang, sel.i, (SELECT min(s.p) FROM src s WHERE s.lang = sel.lang AND s.text = sel.text AND s.p > go.p) FROM go JOIN sel ON sel.lang = go.lang AND sel.i = go.i + 1)"""


@query("ordered_subset_restore", f'WITH RECURSIVE {RESTORE} SELECT lang, i::BIGINT AS "index", p::BIGINT AS source_pos FROM go')
def ordered_subset_restore(spark, sf):
    from rollstat.operators.restore import ordered_subset_restore as restore

    d = table(spark, sf, "documents").select("lang", "doc_id", "text")
    source = position(d, ["doc_id"], ["lang"], name="p")
    lasts = d.groupBy("lang", "text").agg(F.max("doc_id").alias("doc_id"))
    picked = source.join(lasts.select("doc_id"), "doc_id", "left_semi").join(table(spark, sf, "labels"), "doc_id", "left_semi")
    selection = position(picked, ["doc_id"], ["lang"], name="i").withColumn("index", F.col("i") - 1)
    return restore(selection, source, domain="lang", index="index", pos="p", key=F.col("text"))
