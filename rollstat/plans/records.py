"""Record normalisation over conversations, documents, events and parts."""
from __future__ import annotations

from pyspark.sql import functions as F

from rollstat.functions.columns import word_count
from rollstat.operators import normalize as N
from rollstat.plans.registry import query
from rollstat.plans.views import MSG, ROLL, documents, q8, rounded, table, v_msg, v_roll, with_ctes

FLAT = lambda m: F.sha2(F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit("|"), x["content"])), "\n"), 256)
FLAT_SQL = lambda m: f"sha256(array_to_string(list_transform({m}, lambda x: x.role || '|' || x.content), chr(10)))"
STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _msg_rows(spark, sf):
    return v_msg(spark, sf).withColumn("id", F.when(F.col("conv_id") % 2 == 0, F.col("conv_id"))).withColumn(
        "sample_id", F.when(F.col("conv_id") % 3 == 0, F.col("conv_id") + 1000)).withColumn("key", F.concat(F.lit("k"), F.col("conv_id"))).withColumn(
        "source", F.when(F.col("conv_id") % 5 > 0, "chat"))


@query("normalize_sft_record", with_ctes(MSG) + f"""SELECT {FLAT_SQL('messages')} AS messages, 'chat_domain' AS domain, CASE WHEN conv_id % 5 > 0 THEN 'chat' ELSE '' END AS source,
 'chat_domain' AS dataset, '' AS split, '' AS difficulty, CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id AS VARCHAR) ELSE 'k' || conv_id END AS sample_id FROM v_msg""")
def normalize_sft_record(spark, sf):
    rows = _msg_rows(spark, sf).withColumn("messages", F.to_json("messages"))
    out = N.normalize_sft_record(rows, "chat_domain")
    return out.withColumn("messages", FLAT(F.col("messages")))


@query("normalize_shard_record", with_ctes(MSG) + f"""SELECT {FLAT_SQL('messages')} AS messages, 'chat_domain' AS domain, CASE WHEN conv_id % 5 > 0 THEN 'chat' ELSE '' END AS source,
 'chat_domain' AS dataset, 'train' AS split, '' AS difficulty,
 CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id AS VARCHAR) WHEN conv_id % 3 = 0 THEN CAST(conv_id + 1000 AS VARCHAR) ELSE 'k' || conv_id END AS sample_id FROM v_msg""")
def normalize_shard_record(spark, sf):
    rows = _msg_rows(spark, sf).withColumn("ocr_split", F.lit("train"))
    out = N.normalize_sft_record(rows, "chat_domain", N.SHARD_ID_ORDER)
    return out.withColumn("messages", FLAT(F.col("messages")))


PAIRS = """p AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id, turn, text AS u, nt AS a FROM p WHERE role = 'user' AND nr = 'assistant')"""


def _pairs(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", "role", F.col("text").alias("u"), F.lead("role").over(w).alias("nr"), F.lead("text").over(w).alias("a")).filter(
        "role = 'user' and nr = 'assistant'")


@query("pair_to_messages", f"""WITH {PAIRS} SELECT conv_id, turn, sha256('user|' || u || chr(10) || 'assistant|' || a) AS messages FROM q
 WHERE {STRIP('u')} <> '' AND {STRIP('a')} <> '' ORDER BY conv_id, turn LIMIT 100""")
def pair_to_messages(spark, sf):
    out = N.pair_to_messages(_pairs(spark, sf), "u", "a", ["conv_id", "turn"], 100)
    return out.select("conv_id", "turn", FLAT(F.col("messages")).alias("messages"))


SYSTEM = "You are an expert mathematical problem solver. Solve the problem carefully, show the necessary reasoning, and make the final answer easy to verify."
TAIL = "\n\n" + N.MATH_SUFFIX
FIRST_USER = """fu AS (SELECT m.conv_id, m.messages, CASE m.conv_id % 3 WHEN 0 THEN c.text || ' Please reason step by step, and put your final answer within \\boxed{}.'
  WHEN 1 THEN c.text || chr(10) || 'Remember to put your answer on its own line after "Answer:".'
  ELSE 'Solve the following math problem step by step. The last line of your response should be of the form Answer: $Answer (without quotes) where $Answer is the answer to the problem. ' || c.text END AS raw, c.text
 FROM v_msg m JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1) c USING (conv_id))"""


def _math_rows(spark, sf):
    k = F.col("conv_id") % 3
    dress = lambda t: (F.when(k == 0, F.concat(t, F.lit(" Please reason step by step, and put your final answer within \\boxed{}.")))
                       .when(k == 1, F.concat(t, F.lit('\nRemember to put your answer on its own line after "Answer:".')))
                       .otherwise(F.concat(F.lit("Solve the following math problem step by step. The last line of your response should be of the form Answer: $Answer (without quotes) where $Answer is the answer to the problem. "), t)))
    m = v_msg(spark, sf)
    return m.withColumn("messages", F.transform("messages", lambda x: F.struct(
        x["role"].alias("role"), F.when(x["role"] == "user", dress(x["content"])).otherwise(x["content"]).alias("content"))))


@query("normalize_math_sft", with_ctes(MSG, FIRST_USER) + f"""SELECT conv_id, sha256('system|{SYSTEM}' || chr(10) || 'user|' || {STRIP('text')} || '{TAIL}' ||
 coalesce(chr(10) || nullif(array_to_string(list_transform(list_filter(messages, lambda x: x.role = 'assistant'), lambda x: 'assistant|' || x.content), chr(10)), ''), '')) AS prompt FROM fu""")
def normalize_math_sft(spark, sf):
    rows = _math_rows(spark, sf)
    return rows.select("conv_id", FLAT(N.normalize_math_prompt(rows, "messages", "sft", SYSTEM)).alias("prompt"))


@query("normalize_math_rl", with_ctes(MSG, FIRST_USER) + f"""SELECT conv_id, sha256('system|{SYSTEM}' || chr(10) || 'user|' || {STRIP('text')} || '{TAIL}') AS prompt FROM fu""")
def normalize_math_rl(spark, sf):
    rows = _math_rows(spark, sf)
    return rows.select("conv_id", FLAT(N.normalize_math_prompt(rows, "messages", "rl", SYSTEM)).alias("prompt"))


@query("normalize_math_eval", f"""SELECT 'bench' AS dataset, 'math' AS domain, CAST(item_id AS VARCHAR) AS sample_id,
 sha256('system|{SYSTEM}' || chr(10) || 'user|' || {STRIP('text')} || '{TAIL}') AS prompt, sha256(text) AS original_prompt, CAST(item_id * 7 AS VARCHAR) AS answer,
 '' AS metadata, 4096::BIGINT AS max_tokens, NULL::DOUBLE AS temperature, NULL::DOUBLE AS top_p, NULL::BIGINT AS top_k, '' AS evaluator, NULL::BIGINT AS repeat_idx,
 '' AS request_id, 'bench' AS data_source, 'rule-lighteval/MATH_v2' AS style, CAST(item_id * 7 AS VARCHAR) AS ground_truth, CAST(item_id AS VARCHAR) AS "index" FROM benchmark""")
def normalize_math_eval(spark, sf):
    b = table(spark, sf, "benchmark").select(F.lit("bench").alias("dataset"), F.col("item_id").alias("sample_id"), F.col("text").alias("prompt"),
                                             (F.col("item_id") * 7).alias("answer"), F.lit(4096).alias("max_tokens"))
    out = N.normalize_math_eval(b, SYSTEM)
    return out.withColumn("prompt", FLAT(F.col("prompt"))).withColumn("original_prompt", F.sha2("original_prompt", 256)).select(
        "*", "reward_model.style", "reward_model.ground_truth", "extra_info.index").drop("reward_model", "extra_info")


def _if_rows(spark, sf):
    d = documents(spark, sf)
    ids = ["punctuation:no_comma", "length_constraints:number_words", "count:count_increment_word"]
    return d.select("doc_id", "source", F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("text")).alias("text"),
                    F.when(F.col("doc_id") % 10 == 1, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(i) for i in ids])).alias("ids"),
                    F.when(F.col("doc_id") % 10 == 2, F.array(F.lit("{}"))).when(F.col("doc_id") % 10 == 1, F.array().cast("array<string>")).otherwise(
                        F.array(F.lit("null"), F.lit('{"num_words": 100, "relation": "at least"}'), F.lit('{"keyword2": ["b"], "keyword1": ["a"]}'))).alias("kwargs"))


def _if_records(spark, sf):
    return N.build_if_record(_if_rows(spark, sf), prompt="text", ids="ids", kwargs="kwargs", sample_id="doc_id", dataset="source", system="Follow every instruction.")


FAMILY_SQL = lambda t: f"""CASE WHEN contains({t}, 'entire response should be in') OR contains({t}, 'no other language is allowed') THEN 'language' WHEN contains({t}, 'keyword') THEN 'keywords'
 WHEN contains({t}, 'stop word') OR contains({t}, 'no two consecutive words') OR contains({t}, 'consecutive words can share') OR contains({t}, 'consecutive words should') OR contains({t}, 'word repeats')
  OR contains({t}, 'words repeat') OR contains({t}, 'repeat words') THEN 'lexical_constraints'
 WHEN contains({t}, 'wrapped in double angular brackets') OR contains({t}, 'markdown divider') OR contains({t}, 'contain a title') OR contains({t}, 'numbered list') OR contains({t}, 'bullet list') THEN 'detectable_format'
 WHEN contains({t}, 'less than') OR contains({t}, 'at least') THEN 'length_constraints'
 WHEN contains({t}, 'there should be') OR contains({t}, 'should appear') OR regexp_matches({t}, '\\bexactly \\d+ numbers?\\b|\\b\\d+ numbers? in the response\\b') THEN 'count_or_pattern' ELSE 'other' END"""
LOWER = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query("build_if_record", f"""SELECT doc_id AS sample_id, CASE doc_id % 10 WHEN 0 THEN 'empty_prompt' WHEN 1 THEN 'no_instructions' WHEN 2 THEN 'kwargs_not_aligned' END AS reject_reason,
 source AS dataset, CASE WHEN doc_id % 10 = 0 THEN 'other' ELSE {FAMILY_SQL(LOWER)} END AS family, CASE WHEN doc_id % 10 = 1 THEN 0 ELSE 3 END::INTEGER AS n_instructions,
 CASE doc_id % 10 WHEN 1 THEN NULL WHEN 2 THEN '{{}}' ELSE 'null' END AS kwargs_first, CASE WHEN doc_id % 10 IN (1, 2) THEN NULL ELSE '{{"keyword1": "a", "keyword2": "b"}}' END AS kwargs_third FROM documents""")
def build_if_record(spark, sf):
    e = F.col("extra_info")
    out = _if_records(spark, sf).withColumn("_third", F.get(e["instruction_kwargs_json"], 2))
    return out.select(e["sample_id"].alias("sample_id"), "reject_reason", e["dataset"].alias("dataset"), e["family"].alias("family"),
                      F.size(e["instruction_id_list"]).alias("n_instructions"), F.get(e["instruction_kwargs_json"], 0).alias("kwargs_first"),
                      F.when(F.col("reject_reason") == "kwargs_not_aligned", F.lit(None)).otherwise(F.col("_third")).alias("kwargs_third"))


@query("if_record_report", f"""WITH d AS (SELECT *, CASE doc_id % 10 WHEN 0 THEN 'empty_prompt' WHEN 1 THEN 'no_instructions' WHEN 2 THEN 'kwargs_not_aligned' END AS r, {FAMILY_SQL(LOWER)} AS fam FROM documents),
ok AS (SELECT * FROM d WHERE r IS NULL)
SELECT 'rejected' AS kind, r AS name, count(*)::BIGINT AS n FROM d WHERE r IS NOT NULL GROUP BY r UNION ALL
SELECT 'instruction', i, count(*) FROM ok, (VALUES ('punctuation:no_comma'), ('length_constraints:number_words'), ('count:count_increment_word')) t(i) GROUP BY i UNION ALL
SELECT 'dataset', source, count(*) FROM ok GROUP BY source UNION ALL SELECT 'family', fam, count(*) FROM ok GROUP BY fam UNION ALL
SELECT 'instructions_per_prompt', '3', count(*) FROM ok""")
def if_record_report(spark, sf):
    return N.if_record_report(_if_records(spark, sf))


KW_IN = """'{"n": 3.0, "keyword1": ["' || event_type || '"], "k": ' || json_extract_string(props, '$.k') || ', "a": null}'"""


def _kw(spark, sf):
    e = table(spark, sf, "events")
    return e.withColumn("kw", F.concat(F.lit('{"n": 3.0, "keyword1": ["'), F.col("event_type"), F.lit('"], "k": '), F.get_json_object("props", "$.k"), F.lit(', "a": null}')))


@query("canonical_kwargs", """SELECT event_id, '{"a": null, "k": ' || json_extract_string(props, '$.k') || ', "keyword1": "' || event_type || '", "n": 3}' AS kwargs,
 '{"k": ' || json_extract_string(props, '$.k') || ', "n": 3}' AS eval_kwargs FROM events""")
def canonical_kwargs(spark, sf):
    return _kw(spark, sf).select("event_id", N.canonical_kwargs(F.col("kw"), F.lit(N.COUNT_WORD_INSTRUCTION)).alias("kwargs"),
                                 N.evaluation_kwargs(F.col("kw"), F.array(F.lit("a"), F.lit("k"), F.lit("n"))).alias("eval_kwargs"))


MARKED = """concat(text, CASE doc_id % 8 WHEN 0 THEN ' Your ENTIRE response should   be in French.' WHEN 1 THEN ' Use the keywords.' WHEN 2 THEN ' No stop word allowed.' WHEN 3 THEN ' Give a numbered list.'
 WHEN 4 THEN ' Use at least ten.' WHEN 5 THEN ' Exactly 3 numbers please.' WHEN 6 THEN ' The letter q should appear.' ELSE '' END)"""


@query("classify_family", f"SELECT doc_id, {FAMILY_SQL('t')} AS family FROM (SELECT doc_id, lower(trim(regexp_replace({MARKED}, '\\s+', ' ', 'g'))) AS t FROM documents)")
def classify_family(spark, sf):
    d = documents(spark, sf).withColumn("m", F.expr(MARKED))
    return d.select("doc_id", N.classify_family(F.col("m")).alias("family"))


@query("format_code_prompt", f"""SELECT p_partkey, '### Question:' || chr(10) || p_name || chr(10) || chr(10) || '### Format: ' || CASE WHEN p_size % 2 = 0 THEN '{N.CODE_WITH_STARTER}' || chr(10) || '```python' || chr(10) || 'def ' || p_type || '():'
 ELSE '{N.CODE_WITHOUT_STARTER}' || chr(10) || '```python' || chr(10) || '# YOUR CODE HERE' END || chr(10) || '```' || chr(10) || chr(10) || '### Answer: (use the provided format with backticks)' || chr(10) || chr(10) AS prompt FROM part""")
def format_code_prompt(spark, sf):
    p = table(spark, sf, "part")
    starter = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" def "), F.col("p_type"), F.lit("():\n"))).otherwise(F.lit("  "))
    return p.select("p_partkey", N.format_code_prompt(F.col("p_name"), starter).alias("prompt"))


@query("merge_testcases", """SELECT l_orderkey, l_linenumber, l_partkey, i::INTEGER AS ordinal, CASE i WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN CAST(l_suppkey AS VARCHAR) ELSE 'z' END AS input,
 CASE i WHEN 0 THEN CAST(l_linenumber AS VARCHAR) WHEN 1 THEN l_returnflag ELSE l_linestatus END AS output, l_returnflag AS func_name FROM lineitem, range(3) t(i)""")
def merge_testcases(spark, sf):
    l = table(spark, sf, "lineitem")
    public = F.concat(F.lit('[{"input": "'), F.col("l_partkey"), F.lit('", "output": "'), F.col("l_linenumber"), F.lit('"}]'))
    private = F.concat(F.lit('{"inputs": ["'), F.col("l_suppkey"), F.lit('", "z"], "outputs": ["'), F.col("l_returnflag"), F.lit('", "'), F.col("l_linestatus"), F.lit('"]}'))
    cases = N.merge_testcases(N.parse_testcases(public), N.parse_testcases(private), F.struct(F.col("l_returnflag").alias("func_name")))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.posexplode(cases).alias("ordinal", "c")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "ordinal", "c.input", "c.output", "c.metadata.func_name")


WORDS = "len(regexp_extract_all(text, '\\S+'))"


@query("filter_overlong", f"SELECT doc_id, {WORDS}::INTEGER AS prompt_tokens FROM documents WHERE {WORDS} <= 300")
def filter_overlong(spark, sf):
    return N.filter_overlong(documents(spark, sf), word_count("text"), 300)[0].select("doc_id", "prompt_tokens")


@query("filter_overlong_report", f"""SELECT count(*) FILTER (n <= 300)::BIGINT AS kept, count(*) FILTER (n > 300)::BIGINT AS dropped, 0::BIGINT AS errors, min(n)::INTEGER AS "min", max(n)::INTEGER AS "max",
 {q8("avg(n)", "mean")}, {q8("quantile_cont(n, 0.5)", "p50")}, {q8("quantile_cont(n, 0.9)", "p90")}, {q8("quantile_cont(n, 0.99)", "p99")} FROM (SELECT {WORDS} AS n FROM documents)""")
def filter_overlong_report(spark, sf):
    return rounded(N.filter_overlong(documents(spark, sf), word_count("text"), 300)[1], "mean", "p50", "p90", "p99")


@query("shuffle_choices", """WITH o AS (SELECT p_partkey, unnest([{'i': 0, 'o': p_type}, {'i': 1, 'o': p_brand}, {'i': 2, 'o': p_name}, {'i': 3, 'o': CAST(p_size AS VARCHAR)}]) AS x FROM part),
r AS (SELECT p_partkey, x.i AS i, x.o AS o, row_number() OVER (PARTITION BY p_partkey ORDER BY sha256('17:' || p_partkey || ':' || x.o || ':' || x.i)) AS rn FROM o)
SELECT p_partkey, string_agg(o, '|' ORDER BY rn) AS options, chr(CAST(64 + max(CASE WHEN i = 0 THEN rn END) AS INTEGER)) AS answer FROM r GROUP BY 1""")
def shuffle_choices(spark, sf):
    out = N.shuffle_choices(table(spark, sf, "part"), "p_partkey", F.col("p_type"), [F.col("p_brand"), F.col("p_name"), F.col("p_size")], 17)
    return out.select("p_partkey", F.array_join("options", "|").alias("options"), "answer")


@query("date_and_type_filter", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus = 'F'")
def date_and_type_filter(spark, sf):
    return N.date_and_type_filter(table(spark, sf, "orders"), "o_orderdate", "1996-01-01", "1997-01-01", "o_orderstatus", "F").select("o_orderkey")


@query("flat_prompt_to_messages", f"""WITH {PAIRS} SELECT conv_id, turn, sha256(CASE WHEN conv_id % 2 = 0 THEN 'system|be brief' || chr(10) ELSE '' END || 'user|' || u || chr(10) || 'assistant|' || a) AS messages FROM q""")
def flat_prompt_to_messages(spark, sf):
    flat = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("system\nbe brief\nuser\n"), F.col("u"), F.lit("\nassistant\n"))).otherwise(F.concat(F.col("u"), F.lit("\nassistant\n")))
    return _pairs(spark, sf).select("conv_id", "turn", FLAT(N.flat_prompt_to_messages(flat, F.col("a"))).alias("messages"))


THINK = "CASE WHEN role = 'assistant' THEN CASE (conv_id + turn) % 5 WHEN 0 THEN '<think>why</think>' || text WHEN 1 THEN '<think> </think>' || text WHEN 2 THEN '<think>' || text WHEN 3 THEN '<think>x</think><|im_end|>' ELSE text END ELSE text END"


@query("validate_conversation", f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, {THINK} AS c, CASE WHEN role = 'assistant' THEN (conv_id + turn) % 5 ELSE 4 END AS k FROM conversations),
b AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role NOT IN ('system', 'user', 'assistant', 'tool')) AS u, count(*) FILTER (role = 'system' AND i > 1) AS ls,
 max(role) FILTER (i = 1) AS r1, max(role) FILTER (i = 2) AS r2, max(role) FILTER (i = 3) AS r3, count(*) FILTER ({STRIP('c')} = '' OR k IN (1, 2, 3)) AS bad,
 count(*) FILTER (role = 'assistant' AND {STRIP('c')} <> '') AS tr FROM t GROUP BY 1),
g AS (SELECT *, coalesce(CASE WHEN r1 = 'system' THEN r2 = 'user' AND r3 = 'assistant' ELSE r1 = 'user' AND r2 = 'assistant' END, false) AS gs FROM b)
SELECT conv_id, n::BIGINT AS n_turns, u::BIGINT AS unknown_roles, ls::BIGINT AS late_system, gs AS good_start, bad::BIGINT AS bad_messages, tr::BIGINT AS trainable_turns,
 u = 0 AND ls = 0 AND gs AND bad = 0 AND tr > 0 AS valid FROM g""")
def validate_conversation(spark, sf):
    c = table(spark, sf, "conversations").withColumn("text", F.expr(THINK))
    return N.validate_conversation(c, "conv_id", "turn", "role", "text")


@query("split_tool_transcript", """SELECT p_partkey, i::INTEGER AS step, CASE i WHEN 1 THEN 'tool' ELSE 'assistant' END AS role,
 CASE i WHEN 0 THEN 'try ' || p_name WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE 'so it is ' || p_brand END AS content, CASE WHEN i = 0 THEN 'print(' || p_size || ')' END AS code FROM part, range(3) t(i)""")
def split_tool_transcript(spark, sf):
    p = table(spark, sf, "part").withColumn("text", F.concat(
        F.lit("try "), F.col("p_name"), F.lit("\n<code>\n```python\nprint("), F.col("p_size"), F.lit(")\n```\n</code>\n<interpreter>\n"), F.col("p_size"),
        F.lit("\n</interpreter>\nso <answer>it is "), F.col("p_brand"), F.lit("</answer>")))
    return N.split_tool_transcript(p, "p_partkey", "text")


@query("split_tool_transcript_rest", """SELECT p_partkey, i::INTEGER AS step, 'assistant' AS role, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN i = 0 THEN 'so ' || p_brand ELSE 'more ' || p_name END AS content
 FROM part, range(2) t(i) WHERE i = 0 OR p_partkey % 2 = 1""")
def split_tool_transcript_rest(spark, sf):
    tagged = F.concat(F.lit("so <answer>"), F.col("p_brand"), F.lit("</answer>\n more "), F.col("p_name"), F.lit(" \n"))
    p = table(spark, sf, "part").withColumn("text", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(tagged))
    return N.split_tool_transcript(p, "p_partkey", "text").drop("code")


def _calls(spark, sf):
    p = table(spark, sf, "part").withColumn("text", F.concat(
        F.lit("look up "), F.col("p_name"), F.lit(' <tool_call>{"name": "find", "arguments": {"size": '), F.col("p_size"),
        F.lit('}}</tool_call> and <tool_call>{broken</tool_call>'), F.when(F.col("p_size") % 2 == 0, F.lit('<tool_call>{"name": "stop", "arguments": []}</tool_call>')).otherwise("")))
    return N.extract_tool_calls(p, "p_partkey", "text")


@query("extract_tool_calls", """SELECT p_partkey, 0::INTEGER AS ordinal, 'find' AS name, '{"size":' || p_size || '}' AS arguments FROM part UNION ALL
 SELECT p_partkey, 2, 'stop', '[]' FROM part WHERE p_size % 2 = 0""")
def extract_tool_calls(spark, sf):
    return _calls(spark, sf)[0]


@query("tool_call_content", "SELECT p_partkey, 'look up ' || p_name || '  and ' AS content FROM part")
def tool_call_content(spark, sf):
    return _calls(spark, sf)[1]


@query("coalesce_ground_truth", with_ctes(MSG) + f"""SELECT m.conv_id, {FLAT_SQL("list_prepend({'role': 'system', 'content': 'Help the user.'}, messages)")} AS prompt,
 CASE WHEN conv_id % 3 = 0 THEN 'gt' || conv_id WHEN conv_id % 3 = 1 THEN 'single' ELSE '' END AS ground_truth, CASE WHEN conv_id % 2 = 0 THEN 'kept' ELSE 'fresh' END AS note, 'single' AS has_single FROM v_msg m""")
def coalesce_ground_truth(spark, sf):
    k = F.col("conv_id")
    rows = v_msg(spark, sf).withColumn("ground_truth", F.when(k % 3 == 0, F.concat(F.lit("gt"), k))).withColumn(
        "single_turn_completion", F.when(k % 3 == 1, "single").otherwise("")).withColumn("note", F.lit("fresh")).withColumn(
        "extra_info", F.when(k % 2 == 0, F.create_map(F.lit("note"), F.lit("kept"))))
    out = N.coalesce_ground_truth(rows, ["ground_truth", "single_turn_completion"], ["conv_id"], "Help the user.", "messages")
    return out.select("conv_id", FLAT(F.col("prompt")).alias("prompt"), "ground_truth", F.col("extra_info")["note"].alias("note"),
                      F.lit("single").alias("has_single"))


@query("repair_data_source", """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN source ELSE lang END AS data_source FROM documents""")
def repair_data_source(spark, sf):
    d = table(spark, sf, "documents").withColumn("ds", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, "  ").otherwise(F.col("source")))
    return d.select("doc_id", N.repair_data_source("ds", "lang").alias("data_source"))


@query("infer_domain", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'math' WHEN 1 THEN 'code' WHEN 2 THEN 'if' WHEN 3 THEN 'math' WHEN 4 THEN 'code' END AS domain FROM documents""")
def infer_domain(spark, sf):
    k = F.col("doc_id") % 6
    d = table(spark, sf, "documents")
    ds = F.when(k == 0, F.concat(F.lit("AIME_"), F.col("source"))).when(k == 1, "LiveCodeBench_v6").when(k == 2, "my_ifeval_set").otherwise(F.col("source"))
    return d.select("doc_id", N.infer_domain(ds, F.when(k == 3, " Math "), F.when(k == 4, "Programming"), strict=False).alias("domain"))


PAD_SQL = lambda i: f"""list_transform(range(48), lambda i: {i})"""


@query("truncate_pad_tokens", f"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(lang || ' ' || source || ' x', '\\S+'), lambda t: length(t)) AS p, list_transform(regexp_extract_all(text, '\\S+'), lambda t: length(t)) AS r FROM documents),
a AS (SELECT doc_id, len(p) AS np, len(p) + len(r) AS n, list_concat(p, r) AS ids, least(len(p) + len(r), 48) AS k FROM w),
x AS (SELECT doc_id, np, n, k, {PAD_SQL("CASE WHEN i < k THEN ids[i + 1 + n - k] ELSE 0 END")} AS l, {PAD_SQL("CASE WHEN i < k THEN ids[i + 1] ELSE 0 END")} AS r,
 {PAD_SQL("CASE WHEN i < k THEN 1 ELSE 0 END")} AS m, {PAD_SQL("greatest(least(i + 1, k) - 1, 0)")} AS ps, {PAD_SQL("CASE WHEN (np > 1 AND i < least(np, 48) - 1) OR i = least(n, 48) - 1 OR i >= k THEN 0 ELSE 1 END")} AS lm FROM a)
SELECT doc_id, array_to_string(l, ' ') AS left_ids, array_to_string(r, ' ') AS right_ids, array_to_string(m, '') AS mask, array_to_string(ps, ' ') AS positions, array_to_string(lm, '') AS loss_mask FROM x""")
def truncate_pad_tokens(spark, sf):
    size = lambda c: F.transform(F.filter(F.split(c, r"\s+"), lambda t: t != ""), lambda t: F.length(t))
    d = documents(spark, sf).select("doc_id", size(F.concat_ws(" ", "lang", "source", F.lit("x"))).alias("p"), size(F.col("text")).alias("r"))
    right = N.truncate_pad_tokens(d, "p", "r", 48)
    left = N.truncate_pad_tokens(d, "p", "r", 48, truncation="left").select("doc_id", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("left_ids"))
    text = lambda c, s: F.array_join(F.col(c).cast("array<string>"), s)
    return right.select("doc_id", text("input_ids", " ").alias("right_ids"), text("attention_mask", "").alias("mask"),
                        text("position_ids", " ").alias("positions"), text("loss_mask", "").alias("loss_mask")).join(left, "doc_id")


@query("preference_rows", with_ctes(ROLL) + """SELECT uid, 'chosen' AS kind, arg_max(sample_id, score)::BIGINT AS response FROM v_roll GROUP BY uid UNION ALL
 SELECT uid, 'rejected', arg_min(sample_id, score) FROM v_roll GROUP BY uid""")
def preference_rows(spark, sf):
    best = v_roll(spark, sf).groupBy("uid").agg(F.max_by("sample_id", "score").alias("best"), F.min_by("sample_id", "score").alias("worst"))
    return N.preference_rows(best, ["uid"], "best", "worst")


@query("message_placeholders", """WITH x AS (SELECT p_partkey, unnest([{'i': 0, 't': 'image', 'c': NULL}, {'i': 1, 't': 'text', 'c': p_name}, {'i': 2, 't': 'image', 'c': NULL}, {'i': 3, 't': 'video', 'c': NULL}, {'i': 4, 't': 'text', 'c': ' ' || p_type}]) AS s FROM part)
SELECT p_partkey, s.i::INTEGER AS segment, s.t AS type, s.c AS text FROM x""")
def message_placeholders(spark, sf):
    p = table(spark, sf, "part").withColumn("c", F.concat(F.lit("<image>"), F.col("p_name"), F.lit("<image><video> "), F.col("p_type")))
    return N.message_placeholders(p, ["p_partkey"], "c")


@query("build_judge_requests", with_ctes(MSG) + f"""SELECT conv_id, sha256(array_to_string(list_append(list_transform(list_filter(messages, lambda x: x.role <> 'system'),
 lambda x: CASE x.role WHEN 'assistant' THEN '[Assistant]' ELSE '[User]' END || chr(10) || {STRIP('x.content')}), '{N.TO_BE_JUDGED}' || chr(10) || 'answer ' || conv_id), chr(10) || chr(10))) AS request FROM v_msg""")
def build_judge_requests(spark, sf):
    m = v_msg(spark, sf).withColumn("as_text", F.to_json("messages"))
    answer = F.concat(F.lit(" answer "), F.col("conv_id"), F.lit("\n"))
    return m.select("conv_id", F.sha2(N.judge_transcript(N.coerce_prompt(F.col("as_text")), answer), 256).alias("request"))


@query("judge_template", f"""WITH {PAIRS} SELECT conv_id, turn, sha256('Problem: ' || u || ' Truth: ' || conv_id || ' Solution: ' || a || '.') AS request FROM q""")
def judge_template(spark, sf):
    filled = N.fill_template("Problem: {problem} Truth: {truth} Solution: {solution}.", problem=F.col("u"), truth=F.col("conv_id"), solution=F.col("a"))
    return _pairs(spark, sf).select("conv_id", "turn", F.sha2(filled, 256).alias("request"))


@query("format_passages", with_ctes(MSG) + f"""SELECT conv_id, sha256({STRIP("array_to_string(list_transform(messages, lambda x, i: 'Doc ' || i || ' (Title: ' || split_part(x.content, chr(10), 1) || ')' || chr(10) || CASE WHEN contains(x.content, chr(10)) THEN substr(x.content, strpos(x.content, chr(10)) + 1) ELSE '' END), chr(10) || chr(10))")}) AS passages FROM v_msg""")
def format_passages(spark, sf):
    m = v_msg(spark, sf)
    return m.select("conv_id", F.sha2(N.format_passages(F.transform("messages", lambda x: x["content"])), 256).alias("passages"))
