"""Scoring jobs. Completions are composed from table columns, the same way in both engines."""
from __future__ import annotations

from pyspark.sql import functions as F

from rollstat.operators import instructions as I
from rollstat.operators import normalize as N
from rollstat.operators import scoring as D
from rollstat.plans.registry import query
from rollstat.plans.views import TOK, documents, q8, rounded, table, v_tok, with_ctes

STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
f_ = F.col
K = lambda n: F.col("p_partkey") % n


def _cat(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


@query("score_integer_answer", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN '1' || lpad(CAST(p_size AS VARCHAR), 3, '0') WHEN 4 THEN 'alpha' ELSE 'none at all' END AS pred,
 p_partkey % 6 < 2 OR (p_partkey % 6 = 2) AS correct FROM part""")
def score_integer_answer(spark, sf):
    p, n = table(spark, sf, "part"), f_("p_size").cast("string")
    text = (F.when(K(6) == 0, _cat("work 12 ", f_("p_name"), " so \\boxed{", n, "}")).when(K(6) == 1, _cat("sum of 900 and 3\n ", n, " \n"))
            .when(K(6) == 2, _cat("7 and 8\nthe total is ", n, ".\nthank you")).when(K(6) == 3, _cat("from 55 to 1,", F.lpad(n, 3, "0"), " and done 1,", F.lpad(n, 3, "0")))
            .when(K(6) == 4, F.lit("it is \\boxed{ alpha }")).otherwise(F.lit("none at all")))
    got = p.withColumn("t", text)
    return got.select("p_partkey", D.integer_answer(f_("t")).alias("pred"), D.score_integer_answer(f_("t"), _cat("\\boxed{0", n, "}")).alias("correct"))


@query("extract_boxed", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '\\boxed{\\frac{' || p_size || '}{2}}' WHEN 1 THEN '\\boxed ' || p_size || ' ' WHEN 2 THEN '\\fbox{' || p_size || '}' END AS expr,
 CASE p_partkey % 5 WHEN 0 THEN '\\frac{' || p_size || '}{2}' WHEN 1 THEN p_size || ' ' END AS content, CASE p_partkey % 5 WHEN 0 THEN '\\frac{' || p_size || '}{2}' END AS strict_content FROM part""")
def extract_boxed(spark, sf):
    n = f_("p_size").cast("string")
    text = (F.when(K(5) == 0, _cat("first \\boxed{1} then \\boxed{\\frac{", n, "}{2}} end")).when(K(5) == 1, _cat("so \\boxed ", n, " $ done"))
            .when(K(5) == 2, _cat("so \\fbox{", n, "} done")).when(K(5) == 3, _cat("so \\boxed{", n)).otherwise(f_("p_name")))
    p = table(spark, sf, "part").withColumn("t", text)
    return p.select("p_partkey", D.last_boxed(f_("t")).alias("expr"), D.boxed_content(f_("t")).alias("content"), D.strict_boxed(f_("t")).alias("strict_content"))


@query("score_latex_equal", """SELECT p_partkey, CASE WHEN p_partkey % 8 = 7 THEN 0.0 ELSE 1.0 END::DOUBLE AS score,
 CASE p_partkey % 8 WHEN 0 THEN '\\frac{' || p_size || '}{7}' WHEN 1 THEN '\\frac{1}{' || p_size % 9 + 1 || '}' WHEN 2 THEN '\\sqrt{' || p_size % 9 || '}' WHEN 3 THEN CASE WHEN p_size = 5 THEN '\\frac{1}{2}' ELSE '0.' || p_size END
 WHEN 4 THEN CAST(p_size AS VARCHAR) WHEN 5 THEN CAST(p_size AS VARCHAR) WHEN 6 THEN '\\frac{' || p_size || '}{7}' ELSE CAST(p_size AS VARCHAR) END AS normal FROM part""")
def score_latex_equal(spark, sf):
    n, d = f_("p_size").cast("string"), (f_("p_size") % 9).cast("string")
    d1 = (f_("p_size") % 9 + 1).cast("string")
    answer = (F.when(K(8) == 0, _cat("\\frac{", n, "}{7}")).when(K(8) == 1, _cat("\\frac{1}{", d1, "}")).when(K(8) == 2, _cat("\\sqrt{", d, "}"))
              .when(K(8) == 3, _cat("0.", n)).when(K(8) == 4, n).when(K(8) == 5, n).when(K(8) == 6, _cat("\\frac{", n, "}{7}")).otherwise(_cat(n, "1")))
    written = (F.when(K(8) == 0, _cat("\\dfrac{", n, "}{7}")).when(K(8) == 1, _cat("\\tfrac1", d1)).when(K(8) == 2, _cat("x = \\sqrt", d))
               .when(K(8) == 3, _cat(".", n)).when(K(8) == 4, _cat(n, "^\\circ")).when(K(8) == 5, _cat("\\left", n, "\\text{ cm}")).when(K(8) == 6, _cat(n, "/7")).otherwise(n))
    p = table(spark, sf, "part").withColumn("w", written).withColumn("a", answer)
    return p.select("p_partkey", D.score_latex_equal(_cat("so \\boxed{", f_("w"), "}"), f_("a")).alias("score"), D.normalize_latex(f_("w")).alias("normal"))


@query("score_answer_line", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN -1.0 ELSE 1.0 END::DOUBLE AS score, p_partkey % 4 <> 3 AS acc,
 CASE p_partkey % 4 WHEN 3 THEN '[INVALID]' WHEN 1 THEN '\\frac{' || p_size % 9 || '}{5}' WHEN 2 THEN '1' || lpad(CAST(p_size AS VARCHAR), 3, '0') ELSE CAST(p_size AS VARCHAR) END AS pred FROM part""")
def score_answer_line(spark, sf):
    n, d = f_("p_size").cast("string"), (f_("p_size") % 9).cast("string")
    text = (F.when(K(4) == 0, _cat("Answer: 3\nwork\nanswer : x = $", n, "$ units")).when(K(4) == 1, _cat("Answer: \\frac", d, "5")).when(K(4) == 2, _cat("Answer: \\text{1,", F.lpad(n, 3, "0"), "} dollars"))
            .otherwise(_cat("no line ", n)))
    answer = F.when(K(4) == 1, _cat("\\frac{", d, "}{5}")).when(K(4) == 2, _cat("1", F.lpad(n, 3, "0"))).otherwise(n)
    p = table(spark, sf, "part").withColumn("t", text).withColumn("a", answer)
    return p.select("p_partkey", D.score_answer_line(f_("t"), f_("a")).alias("s")).select("p_partkey", "s.*")


@query("score_strict_box", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS score, p_partkey % 3 = 0 AS acc, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || '.0' END AS pred FROM part""")
def score_strict_box(spark, sf):
    n = f_("p_size").cast("string")
    text = F.when(K(3) == 0, _cat("so \\boxed{", n, "}")).when(K(3) == 1, _cat("so \\boxed{", n, ".0}")).otherwise(_cat("\\boxed{", n, "}", F.lit(" filler" * 20)))
    p = table(spark, sf, "part").withColumn("t", text)
    return p.select("p_partkey", D.score_strict_box(f_("t"), n).alias("s")).select("p_partkey", "s.*")


@query("score_hash_answer", f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '1' || lpad(CAST(p_size AS VARCHAR), 3, '0') END AS strict_answer,
 CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '1,' || lpad(CAST(p_size AS VARCHAR), 3, '0') WHEN 2 THEN CAST(p_size AS VARCHAR) END AS flexible_answer,
 CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.1 ELSE 0.0 END::DOUBLE AS strict_score, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS flexible_score FROM part""")
def score_hash_answer(spark, sf):
    n = f_("p_size").cast("string")
    text = (F.when(K(4) == 0, _cat("#### 5\nso\n#### ", n)).when(K(4) == 1, _cat("#### 1,", F.lpad(n, 3, "0"))).when(K(4) == 2, _cat("the total is ", n, " apples . ok")).otherwise(F.lit("none")))
    p = table(spark, sf, "part").withColumn("t", text)
    t = f_("t")
    return p.select("p_partkey", D.hash_answer(t).alias("strict_answer"), D.hash_answer(t, "flexible").alias("flexible_answer"),
                    D.score_hash_answer(t, n, format_score=0.1).alias("strict_score"), D.score_hash_answer(t, n, "flexible").alias("flexible_score"))


@query("score_choice_letter", "SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 AND p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM part")
def score_choice_letter(spark, sf):
    letter = F.substring(F.lit("ABCD"), (K(5) % 4 + 1).cast("int"), F.lit(1))
    text = F.when(K(5) < 4, _cat("so ANSWER : $", letter, "$ not Answer: D")).otherwise(F.lit("Answer - A"))
    truth = F.when(K(2) == 0, letter).otherwise("E")
    return table(spark, sf, "part").select("p_partkey", D.score_choice_letter(text, truth).alias("score"))


@query("score_exact_match", f"""WITH x AS (SELECT item_id, regexp_replace(lower(text), '[^a-z0-9àâäçéèêëîïôöùûüßñáíóúœæ \\n]', '', 'g') AS t FROM benchmark)
SELECT item_id, CASE item_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.0 ELSE 0.0 END::DOUBLE AS score, CASE item_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS contained FROM x""")
def score_exact_match(spark, sf):
    b = table(spark, sf, "benchmark")
    k = f_("item_id") % 4
    text = (F.when(k == 0, _cat("<answer>no</answer><answer> The ", f_("text"), "!</answer>")).when(k == 1, _cat(F.lit("<answer>x</answer>" * 11), "<answer>", F.upper("text"), "</answer>"))
            .when(k == 2, _cat("<answer>it is ", f_("text"), " indeed</answer>")).otherwise(f_("text")))
    # upper-casing may change the length of some letters, so that variant keeps to the text as it is
    text = F.when(k == 1, _cat(F.lit("<answer>x</answer>" * 11), "<answer>", f_("text"), ".</answer>")).otherwise(text)
    golden = F.array(F.lit("other"), f_("text"))
    rows = b.withColumn("t", text)
    return rows.select("item_id", D.score_exact_match(f_("t"), golden).alias("score"), D.score_exact_match(f_("t"), golden, contained=True).alias("contained"))


@query("think_answer_composite", f"""SELECT p_partkey, {q8("CASE WHEN p_partkey % 3 = 0 THEN 0.2 ELSE 0 END + 0.8 * (p_size % 2)", "score")}, {q8("CASE WHEN p_partkey % 3 = 0 THEN 0.2 ELSE 0 END", "think_score")},
 {q8("0.8 * (p_size % 2)", "answer_score")}, {q8("0.9 * (p_size % 2) + CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN 0.1 ELSE 0 END", "format_accuracy")} FROM part""")
def think_answer_composite(spark, sf):
    start = F.when(K(3) == 0, "<think>a\nb</think>").when(K(3) == 1, "<think>open ").otherwise("x <think>late</think>")
    text = _cat(start, f_("p_name"), F.when(f_("p_size") % 2 == 0, "\\boxed{1}").otherwise(""))
    acc = (f_("p_size") % 2).cast("double")
    rows = table(spark, sf, "part").withColumn("t", text)
    out = rows.select("p_partkey", D.think_answer(f_("t"), acc).alias("s"), D.format_accuracy(f_("t"), acc).alias("format_accuracy")).select("p_partkey", "s.*", "format_accuracy")
    return rounded(out, "score", "think_score", "answer_score", "format_accuracy")


# ---- instructions -------------------------------------------------------------------

DECOR = """CASE doc_id % 12 WHEN 0 THEN concat(text, ' [name] [place]') WHEN 1 THEN concat(text, chr(10), '* one', chr(10), '- two') WHEN 2 THEN concat('*bold* ', text, ' **strong**')
 WHEN 3 THEN concat(text, chr(10), 'P.S. bye') WHEN 4 THEN concat('<<Title>>', chr(10), text) WHEN 5 THEN concat(text, ' *** ', lang) WHEN 6 THEN concat(text, '******', source) WHEN 7 THEN concat('"', text, '"')
 WHEN 8 THEN concat('{"a": ', CAST(n_chars AS STRING), '}') WHEN 9 THEN CASE WHEN lang = 'en' THEN upper(text) ELSE text END WHEN 10 THEN CASE WHEN lang = 'en' THEN lower(text) ELSE text END
 ELSE concat('SECTION 1 ', text, ' SECTION 2 My answer is yes.') END"""
INSTRUCTIONS = {
    "language:response_language": '{"language": "en"}', "length_constraints:number_sentences": '{"num_sentences": 10, "relation": "at least"}',
    "detectable_content:number_placeholders": '{"num_placeholders": 2}', "detectable_format:number_bullet_lists": '{"num_bullets": 2}',
    "detectable_format:constrained_response": "{}", "detectable_format:number_highlighted_sections": '{"num_highlights": 2}',
    "detectable_format:multiple_sections": '{"section_spliter": "SECTION", "num_sections": 2}', "length_constraints:number_paragraphs": '{"num_paragraphs": 2}',
    "detectable_content:postscript": '{"postscript_marker": "P.S."}', "keywords:existence": '{"keywords": ["the", "and"]}',
    "keywords:frequency": '{"keyword": "un", "frequency": 3, "relation": "less than"}', "length_constraints:number_words": '{"num_words": 100, "relation": "at least"}',
    "detectable_format:json_format": "{}", "length_constraints:nth_paragraph_first_word": '{"num_paragraphs": 1, "nth_paragraph": 1, "first_word": "section"}',
    "keywords:forbidden_words": '{"forbidden_words": ["the", "de"]}', "combination:two_responses": "{}", "combination:repeat_prompt": '{"prompt_to_repeat": "<<title>>"}',
    "startend:end_checker": '{"end_phrase": "BYE"}', "detectable_format:title": "{}", "keywords:letter_frequency": '{"letter": "e", "let_frequency": 50, "let_relation": "at least"}',
    "change_case:english_capital": "{}", "change_case:english_lowercase": "{}", "punctuation:no_comma": "{}",
    "change_case:capital_word_frequency": '{"capital_frequency": 2, "capital_relation": "at least"}', "startend:quotation": "{}",
}
CNT = lambda p: f"len(regexp_extract_all(t, '{p}'))"
WORD = "[\\p{L}\\p{N}_]+"
LANG_SQL = "CASE WHEN regexp_matches(t, '\\p{L}') THEN [" + ", ".join(
    f"[len(list_filter(regexp_extract_all(lower(t), '{WORD}'), lambda w: w IN ({', '.join(repr(m) for m in marks)}))), {-i}]" for i, marks in enumerate(I.LANGUAGE_WORDS.values())
) + "] END"
# the language as the place of the best (count, order) pair
LANG = f"(list_reduce({LANG_SQL}, lambda a, b: CASE WHEN a[1] > b[1] OR (a[1] = b[1] AND a[2] > b[2]) THEN a ELSE b END))[2]"
ENGLISH = f"coalesce({LANG} = 0, true)"
PARTS = "regexp_split_to_array(t, '\\s?\\*\\*\\*\\s?')"
BLANK = lambda x: f"regexp_replace({x}, '\\s+', '', 'g') = ''"
INNER = lambda l: f"len(list_filter({l}[2:len({l}) - 1], lambda x: {BLANK('x')})) = 0"
NB = lambda l: f"list_filter({l}, lambda x: NOT {BLANK('x')})"
CHECK_SQL = {
    "language:response_language": ENGLISH, "length_constraints:number_sentences": f"CASE WHEN {BLANK('t')} THEN 0 ELSE len(regexp_extract_all({STRIP('t')}, '[.!?]\\s+')) + 1 END >= 10",
    "detectable_content:number_placeholders": CNT("\\[.*?\\]") + " >= 2", "detectable_format:number_bullet_lists": CNT("(?m)^\\s*\\*[^\\*].*$") + " + " + CNT("(?m)^\\s*-.*$") + " = 2",
    "detectable_format:constrained_response": "contains(t, 'My answer is yes.') OR contains(t, 'My answer is no.') OR contains(t, 'My answer is maybe.')",
    "detectable_format:number_highlighted_sections": f"len(list_filter(regexp_extract_all(t, '\\*[^\\n\\*]*\\*'), lambda x: NOT {BLANK('''replace(x, '*', '')''')})) + len(list_filter(regexp_extract_all(t, '\\*\\*[^\\n\\*]*\\*\\*'), lambda x: NOT {BLANK('''replace(x, '*', '')''')})) >= 2",
    "detectable_format:multiple_sections": CNT("\\s?SECTION\\s?\\d+\\s?") + " >= 2", "length_constraints:number_paragraphs": f"{INNER(PARTS)} AND len({NB(PARTS)}) = 2",
    "detectable_content:postscript": "regexp_matches(lower(t), '(?m)\\s*p\\.\\s?s\\..*$')", "keywords:existence": "regexp_matches(t, '(?i)the') AND regexp_matches(t, '(?i)and')",
    "keywords:frequency": CNT("(?i)un") + " < 3", "length_constraints:number_words": CNT(WORD) + " >= 100",
    "detectable_format:json_format": f"json_valid({STRIP('t')})",
    "length_constraints:nth_paragraph_first_word": f"len({NB('string_split(t, chr(10) || chr(10))')}) = 1 AND NOT {BLANK('string_split(t, chr(10) || chr(10))[1]')} AND lower(regexp_extract(regexp_replace(regexp_extract({STRIP('string_split(t, chr(10) || chr(10))[1]')}, '^(\\S+)', 1), '^''*\"*', ''), '^([^.,?!''\"]*)', 1)) = 'section'",
    "keywords:forbidden_words": f"len(list_filter(regexp_extract_all(lower(t), '{WORD}'), lambda w: w IN ('the', 'de'))) = 0",
    "combination:two_responses": f"{INNER('string_split(t, $$******$$)')} AND len({NB('string_split(t, $$******$$)')}) = 2 AND {STRIP(NB('string_split(t, $$******$$)') + '[1]')} <> {STRIP(NB('string_split(t, $$******$$)') + '[2]')}",
    "combination:repeat_prompt": f"starts_with(lower({STRIP('t')}), '<<title>>')", "startend:end_checker": f"""ends_with(lower(trim({STRIP('t')}, '"')), 'bye')""",
    "detectable_format:title": f"len(list_filter(regexp_extract_all(t, '<<[^\\n]+>>'), lambda x: NOT {BLANK('''trim(x, '<>')''')})) > 0",
    "keywords:letter_frequency": "length(lower(t)) - length(replace(lower(t), 'e', '')) >= 50", "change_case:english_capital": f"upper(t) = t AND lower(t) <> t AND {ENGLISH}",
    "change_case:english_lowercase": f"lower(t) = t AND upper(t) <> t AND {ENGLISH}", "punctuation:no_comma": "NOT contains(t, ',')",
    "change_case:capital_word_frequency": f"len(list_filter(regexp_extract_all(t, '{WORD}'), lambda w: upper(w) = w AND lower(w) <> w)) >= 2",
    "startend:quotation": f"""length({STRIP('t')}) > 1 AND starts_with({STRIP('t')}, '"') AND ends_with({STRIP('t')}, '"')""",
}
STRICT_SQL = f"""base AS MATERIALIZED (SELECT doc_id, {STRIP(DECOR.replace('STRING', 'VARCHAR'))} AS t FROM documents)"""
UNION_CHECKS = lambda src: " UNION ALL ".join(
    f"SELECT doc_id, {i}::INTEGER AS ordinal, '{name}' AS instruction_id, NOT {BLANK('t')} AND ({CHECK_SQL[name]}) AS ok FROM {src}" for i, name in enumerate(INSTRUCTIONS))
LOOSE_SQL = f"""vars AS MATERIALIZED (SELECT doc_id, unnest(list_distinct([t, replace(t, '*', ''), a, b, c, replace(a, '*', ''), replace(b, '*', ''), replace(c, '*', '')])) AS t FROM (
 SELECT doc_id, t, {STRIP("array_to_string(l[2:], chr(10))")} AS a, {STRIP("array_to_string(l[1:len(l) - 1], chr(10))")} AS b, {STRIP("array_to_string(l[2:len(l) - 1], chr(10))")} AS c
 FROM (SELECT doc_id, t, string_split(t, chr(10)) AS l FROM base)))"""
CHECKED_SQL = f"""{STRICT_SQL}, {LOOSE_SQL}, st AS ({UNION_CHECKS('base')}), lo AS (SELECT doc_id, ordinal, max(ok) AS loose FROM ({UNION_CHECKS('vars')}) GROUP BY ALL),
ck AS (SELECT st.doc_id, st.ordinal, st.instruction_id, st.ok AS strict, lo.loose FROM st JOIN lo USING (doc_id, ordinal))"""


def _checked(spark, sf, only=None, loose=True):
    names = only or list(INSTRUCTIONS)
    arr = F.array(*[F.struct(F.lit(n).alias("id"), F.lit(INSTRUCTIONS[n]).alias("kwargs")) for n in names])
    d = documents(spark, sf).withColumn("response", F.expr(DECOR)).withColumn("instructions", arr)
    return I.check_instructions(d, "doc_id", "response", "lang", "instructions", only=names, loose=loose)


@query("check_instructions_strict", f"WITH {STRICT_SQL}, st AS ({UNION_CHECKS('base')}) SELECT doc_id, ordinal, instruction_id, ok AS strict FROM st")
def check_instructions_strict(spark, sf):
    return _checked(spark, sf, loose=False).drop("error")


@query("check_instructions", f"WITH {CHECKED_SQL} SELECT doc_id, ordinal, instruction_id, strict, loose FROM ck")
def check_instructions(spark, sf):
    return _checked(spark, sf).drop("error")


REPORT_SQL = CHECKED_SQL.removesuffix("ck AS (SELECT st.doc_id, st.ordinal, st.instruction_id, st.ok AS strict, lo.loose FROM st JOIN lo USING (doc_id, ordinal))") + (
    "ck AS (SELECT st.doc_id, st.instruction_id, st.ok AS strict, lo.loose, split_part(st.instruction_id, ':', 1) AS family FROM st JOIN lo USING (doc_id, ordinal))")
SHARE = lambda c: f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)"


@query("instruction_accuracy", f"""WITH {REPORT_SQL} SELECT family, instruction_id, count(*)::BIGINT AS n, {q8(SHARE('strict'), 'strict')}, {q8(SHARE('loose'), 'loose')}
 FROM ck GROUP BY GROUPING SETS ((), (family), (family, instruction_id))""")
def instruction_accuracy(spark, sf):
    return rounded(I.instruction_accuracy(_checked(spark, sf), "doc_id"), "strict", "loose")


@query("prompt_accuracy", f"""WITH {REPORT_SQL}, b AS (SELECT doc_id, min(strict) AS s, min(loose) AS l, count(*) AS n, count(*) FILTER (strict) AS ns, count(*) FILTER (loose) AS nl FROM ck GROUP BY 1)
SELECT count(*)::BIGINT AS prompt_total, count(*) FILTER (s)::BIGINT AS prompt_correct, sum(n)::BIGINT AS instruction_total, sum(ns)::BIGINT AS instruction_correct,
 {q8(SHARE('s'), 'strict_prompt')}, {q8(SHARE('l'), 'loose_prompt')}, {q8('sum(ns) / sum(n)', 'strict_instruction')}, {q8('sum(nl) / sum(n)', 'loose_instruction')} FROM b""")
def prompt_accuracy(spark, sf):
    out = I.prompt_accuracy(_checked(spark, sf), "doc_id")
    return rounded(out, "strict_prompt", "loose_prompt", "strict_instruction", "loose_instruction")


# patterns as users write them, unreadable ones among them, and languages with and without marker words
ODD_INSTRUCTIONS = (
    ("keywords:existence", '{"keywords": ["f("]}', "NULL"),
    ("keywords:frequency", '{"keyword": "th.", "frequency": 3, "relation": "at least"}', "len(regexp_extract_all(t, '(?i)th.')) >= 3"),
    ("keywords:forbidden_words", '{"forbidden_words": ["de", "["]}', "NULL"),
    ("keywords:forbidden_words", '{"forbidden_words": ["an+d"]}', "NOT regexp_matches(lower(t), '(^|[^\\p{L}\\p{N}_])an+d($|[^\\p{L}\\p{N}_])')"),
    ("detectable_format:multiple_sections", '{"section_spliter": "*part", "num_sections": 1}', "NULL"),
    ("no:such_check", "{}", "NULL"),
    ("keywords:frequency", "{}", "NULL"),
    *[("language:response_language", f'{{"language": "{code}"}}', f"coalesce({LANG} = {-i}, true)") for i, code in ((0, "en"), (1, "fr"), (4, "it"), (5, "pt"), (7, "fi"))],
    *[("language:response_language", f'{{"language": "{code}"}}', "NOT regexp_matches(t, '\\p{L}')") for code in ("hi", "ru", "ar", "ja")],
    ("language:response_language", '{"language": "sv"}', "true"),
)
ODD_SQL = " UNION ALL ".join(f"SELECT doc_id, {i}::INTEGER AS ordinal, NOT {BLANK('t')} AND coalesce({sql}, false) AS strict, ({sql}) IS NULL AS error FROM base"
                             for i, (_, _, sql) in enumerate(ODD_INSTRUCTIONS))


def _odd_checks(spark, sf):
    arr = F.array(*[F.struct(F.lit(n).alias("id"), F.lit(k).alias("kwargs")) for n, k, _ in ODD_INSTRUCTIONS])
    return I.check_instructions(documents(spark, sf).withColumn("instructions", arr), "doc_id", "text", "lang", "instructions", loose=False)


ODD_BASE = f"base AS MATERIALIZED (SELECT doc_id, {STRIP('text')} AS t FROM documents)"


@query("check_odd_instructions", f"WITH {ODD_BASE} {ODD_SQL}")
def check_odd_instructions(spark, sf):
    return _odd_checks(spark, sf).select("doc_id", "ordinal", "strict", "error")


# a line in one of eleven languages that share a script with others, several times, behind some of the text; Cyrillic ones stand before the text in Cyrillic letters
LINES = {
    "ru": "Это было давно, и он не помнит, как мы жили.", "uk": "Це було давно, і він не знає, як ми жили.", "bg": "Това беше отдавна и той не помни как сме живели.",
    "ar": "كان ذلك منذ زمن بعيد في هذه المدينة على ضفاف النهر.", "fa": "این شهر در کنار رودخانه است و مردم آن را دوست دارند.", "ur": "یہ شہر دریا کے کنارے ہے اور لوگ اس کو پسند کرتے ہیں۔",
    "hi": "यह शहर नदी के किनारे है और लोग इस को पसंद करते हैं।", "mr": "हे शहर नदीच्या काठी आहे आणि लोकांना ते आवडते.", "ne": "यो शहर नदीको किनारमा छ र मानिसहरू यसलाई मन पराउँछन्।",
    "zh": "这座城市在河边，人们非常喜欢它。", "ja": "この町は川のそばにあり、人々はそれが大好きです。",
}
LINED = ("concat(repeat(CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{line} '" for i, line in enumerate(LINES.values()))
         + " END, CAST(1 + doc_id % 5 AS INT)), CASE WHEN doc_id % 11 < 3 THEN translate(lower(text), 'abcdefghijklmnoprstuvz', 'абцдефгхийклмнопрстувз') ELSE substr(text, 1, CAST(doc_id % 150 AS INT)) END)")
LINE_WORDS = "regexp_extract_all(lower(t), '[\\p{L}\\p{M}\\p{N}_]+')"


def _line_sql(code: str) -> str:
    scripts = {"zh": "\\p{Han}", "ja": "[\\p{Hiragana}\\p{Katakana}\\p{Han}]"}
    both, kana = (f"len(regexp_extract_all(t, '{p}'))" for p in ("[\\p{Hiragana}\\p{Katakana}\\p{Han}]", "[\\p{Hiragana}\\p{Katakana}]"))
    told = {"ja": f"{kana} * 20 >= {both}", "zh": f"{kana} * 20 < {both}"}
    for script, languages in I.SHARED_SCRIPTS.items():
        if code in languages:
            scripts[code] = f"\\p{{{script}}}"
            score = {c: f"(len(list_filter({LINE_WORDS}, lambda w: w IN ({', '.join(repr(m) for m in marks)}))) + " + (
                f"2 * len(regexp_extract_all(lower(t), '[{letters}]')))" if letters else "0)") for c, (letters, marks) in languages.items()}
            told[code] = f"{score[code]} >= greatest({', '.join(score.values())})"
    return f"2 * len(regexp_extract_all(t, '{scripts[code]}')) > length(regexp_replace(t, '\\P{{L}}+', '', 'g')) AND {told[code]}"


@query("check_script_languages", f"WITH base AS MATERIALIZED (SELECT doc_id, {STRIP(LINED)} AS t FROM documents) " + " UNION ALL ".join(
    f"SELECT doc_id, '{code}' AS language, {_line_sql(code)} AS strict FROM base" for code in LINES))
def check_script_languages(spark, sf):
    name = "language:response_language"
    arr = F.array(*[F.struct(F.lit(name).alias("id"), F.lit(f'{{"language": "{code}"}}').alias("kwargs")) for code in LINES])
    d = documents(spark, sf).withColumn("response", F.expr(LINED)).withColumn("instructions", arr)
    out = I.check_instructions(d, "doc_id", "response", "lang", "instructions", only=[name], loose=False)
    return out.select("doc_id", F.element_at(F.array(*[F.lit(c) for c in LINES]), F.col("ordinal") + 1).alias("language"), "strict")


@query("instruction_errors", f"WITH {ODD_BASE}, c AS ({ODD_SQL}) SELECT doc_id, count(*) FILTER (strict)::INTEGER AS passed, count(*) FILTER (error)::INTEGER AS errors FROM c GROUP BY 1")
def instruction_errors(spark, sf):
    inputs = I.reward_inputs(_odd_checks(spark, sf), "doc_id")
    return inputs.select("doc_id", F.size(F.filter("checks", lambda c: c)).alias("passed"), "errors")


REWARD_IDS = ("punctuation:no_comma", "startend:quotation", "keywords:existence")
REWARD_SQL = f"""WITH {STRICT_SQL}, {LOOSE_SQL}, st AS ({" UNION ALL ".join(f"SELECT doc_id, NOT {BLANK('t')} AND ({CHECK_SQL[n]}) AS ok, '{n}' AS id FROM base" for n in REWARD_IDS)}),
lo AS (SELECT doc_id, id, max(ok) AS ok FROM ({" UNION ALL ".join(f"SELECT doc_id, NOT {BLANK('t')} AND ({CHECK_SQL[n]}) AS ok, '{n}' AS id FROM vars" for n in REWARD_IDS)}) GROUP BY ALL),
b AS (SELECT doc_id, count(*) FILTER (st.ok) AS ns, count(*) FILTER (lo.ok) AS nl FROM st JOIN lo USING (doc_id, id) GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR ns = 3 THEN CASE WHEN ns = 3 THEN CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.8 END ELSE 0.0 END ELSE 0.0 END::DOUBLE AS score,
 {q8('ns / 3', 'base_score')}, 3::INTEGER AS num_constraints, (3 - ns)::INTEGER AS num_failed_constraints, 0::INTEGER AS num_checker_errors, CASE WHEN doc_id % 3 = 0 THEN 'official_eval_auto' ELSE 'tiered_think_format' END AS scoring_mode FROM b"""


@query("instruction_reward", REWARD_SQL)
def instruction_reward(spark, sf):
    arr = F.array(*[F.struct(F.lit(n).alias("id"), F.lit(INSTRUCTIONS[n]).alias("kwargs")) for n in REWARD_IDS])
    d = documents(spark, sf).withColumn("response", F.expr(DECOR)).withColumn("instructions", arr).withColumn("family", F.lit("other"))
    evaluator = F.when(f_("doc_id") % 3 == 0, " IFEval").otherwise("other")
    none = F.lit(None).cast("string")
    official = I.official_eval(none, evaluator, none, f_("source"))
    return rounded(I.instruction_reward(d, "doc_id", "response", "lang", "instructions", family="family", official=official, only=REWARD_IDS), "base_score")


# short and empty answers among the documents, with a think prefix on every other row
RESPONSE = """concat(CASE WHEN doc_id % 2 = 0 THEN concat('<think>', chr(10), '</think>') ELSE '' END, CASE doc_id % 9 WHEN 0 THEN '7' WHEN 1 THEN '12, 13; 14' WHEN 2 THEN 'ok' WHEN 3 THEN 'single' WHEN 4 THEN 'q'
 WHEN 5 THEN 'a short one here' WHEN 6 THEN concat(lang, ' is what I would say here, roughly') ELSE text END)"""
FAMILY = """CASE doc_id % 5 WHEN 0 THEN 'keywords' WHEN 1 THEN 'length_constraints' WHEN 2 THEN 'lexical_constraints' WHEN 3 THEN 'language' ELSE 'other' END"""
OPTIONS = dict(short_penalty=True, band_penalty=True, weak_families=("language",), guard=True, active_guard=True,
               cap_reasons=("digit_only", "semantically_empty"), soft_reasons=("single_tokenish",), cap_by_reason={"digit_only": 0.3}, active_constraint_max_len=120)
DIGITS = lambda x: f"(regexp_matches({x}, '^[\\d\\s,.;:/+\\-_]+$') AND regexp_matches({x}, '\\d'))"
TIERED = f"""i AS (SELECT doc_id, {FAMILY} AS fam, {RESPONSE} AS r, lang = 'en' AS prompt_short FROM documents),
a AS (SELECT *, starts_with(r, '<think>' || chr(10) || '</think>') AS th, {STRIP("CASE WHEN starts_with(r, '<think>' || chr(10) || '</think>') THEN substr(r, 17) ELSE r END")} AS x FROM i),
b AS (SELECT *, length(x) AS n, doc_id % 4 <> 3 AS ok, CASE WHEN doc_id % 4 <> 3 THEN 1.0 ELSE 0.5 END::DOUBLE AS base FROM a),
c AS (SELECT *, CASE WHEN ok AND th THEN 1.0 WHEN ok THEN 0.8 WHEN th THEN 0.2 ELSE 0.0 END::DOUBLE AS s0 FROM b),
d AS (SELECT *, CASE WHEN s0 = 1 AND fam <> 'length_constraints' THEN CASE WHEN n < 8 THEN 0.5 WHEN n < 16 THEN 0.25 ELSE 0 END ELSE 0 END::DOUBLE AS p1 FROM c),
e AS (SELECT *, s0 - p1 AS s1, CASE WHEN base = 1 AND fam <> 'length_constraints' AND NOT prompt_short AND n < 400 THEN CASE WHEN n < 120 THEN 'lt_120' WHEN n < 200 THEN 'lt_200' ELSE 'lt_400' END ELSE '' END AS bucket FROM d),
f AS (SELECT *, least(s1, CASE bucket WHEN 'lt_120' THEN CASE WHEN fam = 'language' THEN 0.2 ELSE 0.45 END WHEN 'lt_200' THEN CASE WHEN fam = 'language' THEN 0.1 ELSE 0.3 END
  WHEN 'lt_400' THEN CASE WHEN fam = 'language' THEN 0 ELSE 0.15 END ELSE 0 END)::DOUBLE AS p2 FROM e),
g AS (SELECT *, s1 - p2 AS s2, n > 0 AND n <= 50 AND NOT regexp_matches(x, '\\s') AND NOT contains(x, '<<') AS one, x = '' OR {DIGITS('x')} OR lower(x) IN ('?', '!', 'ok', 'yes', 'no', 'maybe', 'n/a', 'null', 'none') AS nothing FROM f),
h AS (SELECT *, CASE WHEN s2 = 1 AND fam <> 'length_constraints' AND n <= 50 AND (one OR nothing) THEN 0.5 ELSE 0 END::DOUBLE AS p3 FROM g),
k AS (SELECT *, s2 - p3 AS s3, CASE WHEN base <> 1 OR fam = 'length_constraints' THEN '' WHEN n <= 50 AND {DIGITS('x')} THEN 'digit_only' WHEN n <= 50 AND nothing THEN 'semantically_empty'
  WHEN n <= 20 AND regexp_matches(x, '^[A-Za-z0-9]$') THEN 'trivial_tiny_output' WHEN n <= 50 AND one THEN 'single_tokenish' WHEN n <= 120 AND fam = 'lexical_constraints' THEN 'constraint_only_short_answer' ELSE '' END AS why FROM h),
m AS (SELECT *, CASE why WHEN 'digit_only' THEN least(s3, 0.3) WHEN 'semantically_empty' THEN least(s3, 0.5) WHEN 'single_tokenish' THEN greatest(0, s3 - 0.1) ELSE s3 END::DOUBLE AS s4,
  CASE WHEN why = '' THEN '' WHEN why IN ('digit_only', 'semantically_empty') THEN 'cap' WHEN why = 'single_tokenish' THEN 'soft' ELSE 'observe' END AS act FROM k)"""


def _tiered(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr(RESPONSE).alias("r"), F.expr(FAMILY).alias("family"), F.when(f_("lang") == "en", "Yes or no, in one word?").otherwise("Tell a story.").alias("prompt"),
                                             F.array(F.lit("punctuation:no_comma"), F.lit("startend:quotation")).alias("ids"), F.array(F.lit(True), f_("doc_id") % 4 != 3).alias("checks"), F.lit(0).alias("errors"))
    return I.tiered_instruction_reward(d, "r", checks="checks", errors="errors", ids="ids", family="family", prompt="prompt", options=OPTIONS)


@query("tiered_instruction_reward", f"""WITH {TIERED} SELECT doc_id, {q8('s4', 'score')}, {q8('base', 'base_score')}, {q8('s0', 'tiered_score')}, th::INTEGER::DOUBLE AS think_format_ok, ok::INTEGER::DOUBLE AS content_ok,
 CASE WHEN ok THEN '' ELSE 'startend:quotation' END AS failed_constraints_text, n::INTEGER AS response_char_len, one::INTEGER::DOUBLE AS is_single_tokenish, nothing::INTEGER::DOUBLE AS looks_semantically_empty,
 {q8('p1', 'short_fullscore_penalty')}, {q8('p2', 'short_fullscore_band_penalty')}, bucket AS short_fullscore_band_bucket, CASE WHEN bucket = '' THEN '' WHEN fam = 'language' THEN 'weak' ELSE 'standard' END AS short_fullscore_band_mode,
 {q8('p3', 'semantic_guard_penalty')}, {q8('s3 - s4', 'semantic_guard_active_penalty')}, why AS semantic_guard_active_reason, act AS semantic_guard_active_action FROM m""")
def tiered_instruction_reward(spark, sf):
    out = _tiered(spark, sf).select(
        "doc_id", "score", "base_score", "tiered_score", "think_format_ok", "content_ok", "failed_constraints_text", "response_char_len", "is_single_tokenish", "looks_semantically_empty",
        "short_fullscore_penalty", "short_fullscore_band_penalty", "short_fullscore_band_bucket", "short_fullscore_band_mode", "semantic_guard_penalty", "semantic_guard_active_penalty",
        "semantic_guard_active_reason", "semantic_guard_active_action")
    return rounded(out, "score", "base_score", "tiered_score", "short_fullscore_penalty", "short_fullscore_band_penalty", "semantic_guard_penalty", "semantic_guard_active_penalty")


VERDICT = """CASE doc_id % 8 WHEN 0 THEN '<reason>x</reason><verdict> YES </verdict>' WHEN 1 THEN '<verdict>no</verdict>' WHEN 2 THEN concat('so ', chr(92), 'boxed{ True }') WHEN 3 THEN concat('yes or no?', chr(10), 'No.') WHEN 4 THEN 'yes and no'
 WHEN 5 THEN '' WHEN 6 THEN concat('It is a yes.', chr(10), 'thanks') ELSE NULL END"""


@query("apply_judge_verdicts", f"""WITH x AS (SELECT doc_id, (doc_id % 3 <> 0)::INTEGER AS content_ok, doc_id % 2 AS think, doc_id % 7 = 0 AS is_eval, {FAMILY} AS family,
 CASE doc_id % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 6 THEN true END AS v FROM documents),
y AS (SELECT *, content_ok = 1 AND NOT is_eval AND family IN ('keywords', 'other') AS called FROM x), z AS (SELECT *, called AND coalesce(NOT v, true) AS cap FROM y)
SELECT doc_id, {q8("CASE WHEN cap THEN least(0.9, 0.2 * think) ELSE 0.9 END", "score")}, called::INTEGER::DOUBLE AS judge_called, (called AND coalesce(v, false))::INTEGER::DOUBLE AS judge_pass, (called AND v IS NULL)::INTEGER::DOUBLE AS judge_error,
 cap::INTEGER::DOUBLE AS judge_capped, {q8("CASE WHEN cap THEN 0.9 - 0.2 * think ELSE 0 END", "judge_penalty")} FROM z""")
def apply_judge_verdicts(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select("doc_id", F.lit(0.9).alias("score"), (f_("doc_id") % 3 != 0).cast("int").alias("content_ok"), (f_("doc_id") % 2).alias("think_format_ok"), F.expr(FAMILY).alias("family"), (f_("doc_id") % 7 == 0).alias("is_eval"))
    verdicts = d.select("doc_id", F.expr(VERDICT).alias("verdict_text"))
    out = D.apply_judge_verdicts(rows, verdicts, "doc_id", families=["keywords", "other"], fail_mode="closed")
    return rounded(out.select("doc_id", "score", "judge_called", "judge_pass", "judge_error", "judge_capped", "judge_penalty"), "score", "judge_penalty")


@query("score_testcases", """WITH r AS (SELECT l_orderkey, l_returnflag <> 'R' AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS rn FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS t, count(*) FILTER (ok) AS p FROM r WHERE rn <= 3 GROUP BY 1)
SELECT o_orderkey, coalesce(t, 0)::BIGINT AS total_tests, coalesce(p, 0)::BIGINT AS passed_tests, CASE WHEN o_orderstatus <> 'P' AND t > 0 AND t = p THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM orders LEFT JOIN g ON o_orderkey = l_orderkey""")
def score_testcases(spark, sf):
    results = table(spark, sf, "lineitem").select(f_("l_orderkey").alias("o_orderkey"), (f_("l_returnflag") != "R").alias("ok"), "l_extendedprice", "l_partkey")
    owners = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    out = D.score_testcases(owners, results, "o_orderkey", has_code=f_("o_orderstatus") != "P", passed="ok", size="l_extendedprice", ordinal="l_partkey", max_tests=3)
    return out.select("o_orderkey", "total_tests", "passed_tests", "score")


@query("extract_code_block", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'print(' || p_size || ')' WHEN 1 THEN 'x = 2' END AS last_block,
 CASE p_partkey % 3 WHEN 0 THEN 'def solve(n):' || chr(10) || '    return ' || p_size WHEN 1 THEN 'x = 2' ELSE p_name END AS entry_block, 'a = 1' || chr(10) || 'b = ' || p_size || chr(10) AS cleaned FROM part""")
def extract_code_block(spark, sf):
    n = f_("p_size").cast("string")
    text = (F.when(K(3) == 0, _cat("use\n```python\ndef solve(n):\n    return ", n, "\n```\nthen\n```python\nprint(", n, ")\n```")).when(K(3) == 1, F.lit("```py\nx = 1\n```\n```\nx = 2\n```")).otherwise(f_("p_name")))
    guard = _cat("a = 1\nif __name__ == \"__main__\":\n    main()\n\n    more()\nb = ", n, "\n")
    p = table(spark, sf, "part").withColumn("t", text)
    return p.select("p_partkey", D.last_code_block(f_("t")).alias("last_block"), D.last_code_block(f_("t"), F.lit("solve")).alias("entry_block"), D.drop_main_guard(guard).alias("cleaned"))


@query("overlong_penalty", f"""SELECT doc_id, {q8("least(-(n_chars - (8000 - 2000)) / 2000.0::DOUBLE * 0.5, 0)", "penalty")}, n_chars > 6000 AS overlong FROM documents""")
def overlong_penalty(spark, sf):
    p = D.overlong_penalty(f_("n_chars"), 8000, 2000, 0.5)
    return rounded(table(spark, sf, "documents").select("doc_id", p.alias("penalty"), (p < 0).alias("overlong")), "penalty")


@query("length_cap", f"""WITH r AS (SELECT doc_id, 16384.0::DOUBLE - n_chars AS room FROM documents), c AS (SELECT *, CASE WHEN room >= 12288 THEN 0.8 WHEN room BETWEEN 8192 AND 12288 THEN 0.65 + (room - 8192) * 0.15 / 4096 WHEN room BETWEEN 4096 AND 8192 THEN 0.4 + (room - 4096) * 0.25 / 4096
 WHEN room BETWEEN 0 AND 4096 THEN room * 0.4 / 4096 ELSE 0 END AS cap FROM r) SELECT doc_id, {q8("cap", "cap")}, {q8("0.2 + least(0.8, cap)", "reward")} FROM c""")
def length_cap(spark, sf):
    cap = D.length_cap(f_("n_chars"), 16384)
    return rounded(table(spark, sf, "documents").select("doc_id", cap.alias("cap"), (0.2 + F.least(F.lit(0.8), cap)).alias("reward")), "cap", "reward")


@query("uniform_score", f"""SELECT event_id, {q8("CASE event_id % 5 WHEN 4 THEN 0 WHEN 3 THEN 1 ELSE value END", "score")}, {q8("CASE event_id % 5 WHEN 0 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE value END", "acc")} FROM events""")
def uniform_score(spark, sf):
    k, v = f_("event_id") % 5, f_("value").cast("string")
    text = (F.when(k == 0, _cat('{"score": ', v, ', "acc": 1}')).when(k == 1, _cat('{"acc": ', v, "}")).when(k == 2, _cat("[", v, ", 5]")).when(k == 3, F.lit("true")).otherwise('{"x": 1}'))
    out = table(spark, sf, "events").select("event_id", D.uniform_score(text).alias("s")).select("event_id", "s.*")
    return rounded(out, "score", "acc")


@query("common_extras", """SELECT event_id, 'k|type' AS kept, json_extract_string(props, '$.k') || '|' || event_type AS vals FROM events""")
def common_extras(spark, sf):
    e = table(spark, sf, "events")
    extras = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), f_("event_type"))
    rare = F.when(f_("event_type") == "error", F.map_concat(extras, F.create_map(F.lit("rare"), F.lit("1")))).otherwise(extras)
    out = D.common_extras(e.select("event_id", rare.alias("extras")), "extras")
    return out.select("event_id", F.array_join(F.array_sort(F.map_keys("extras")), "|").alias("kept"), _cat(f_("extras")["k"], "|", f_("extras")["type"]).alias("vals"))


@query("dispatch_scorer", """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'hash_answer' WHEN 1 THEN 'latex' WHEN 2 THEN 'answer_line' WHEN 3 THEN 'choice' WHEN 4 THEN 'exact_match' WHEN 5 THEN 'instructions' END AS route,
 CASE p_partkey % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 WHEN 4 THEN 1.0 END::DOUBLE AS score FROM part""")
def dispatch_scorer(spark, sf):
    n = f_("p_size").cast("string")
    src = (F.when(K(7) == 0, "openai/gsm8k").when(K(7) == 1, "lighteval/MATH").when(K(7) == 2, "aime_2024").when(K(7) == 3, "Idavidrein/gpqa").when(K(7) == 4, "searchR1_nq").when(K(7) == 5, "my_ifeval").otherwise("mystery"))
    text = _cat("#### ", n, " \\boxed{", n, "} <answer>", n, "</answer>\nAnswer: ", n)
    p = table(spark, sf, "part").select("p_partkey", src.alias("ds"), text.alias("t"), n.alias("a"))
    # the strict form of the first scorer stops at the blank, so every route sees its own marker
    return D.dispatch_scorer(p, "ds", "t", "a", strict=False).select("p_partkey", "route", "score")


@query("dispatch_scorer_given", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'hash_answer' WHEN 1 THEN 'instructions' ELSE 'testcases' END AS route,
 CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE (p_size % 2) END::DOUBLE AS score FROM part""")
def dispatch_scorer_given(spark, sf):
    src = F.when(K(3) == 0, "openai/gsm8k").when(K(3) == 1, "my_ifeval").otherwise("codecontests")
    p = table(spark, sf, "part").select("p_partkey", src.alias("ds"), _cat("#### ", f_("p_size").cast("string")).alias("t"), f_("p_size").cast("string").alias("a"),
                                        F.lit(0.5).alias("followed"), (f_("p_size") % 2).alias("passed"))
    return D.dispatch_scorer(p, "ds", "t", "a", given={"instructions": "followed", "testcases": "passed"}).select("p_partkey", "route", "score")


@query("adjusted_scores", f"""SELECT o_orderkey, {q8("CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 3 <> 0 THEN 0 ELSE 1 END ELSE -1 END", "flawed_score")},
 o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_custkey % 3 <> 0 AS is_flawed_positive, {q8("CASE WHEN o_orderstatus = 'F' THEN 1 ELSE least(-0.6, -1 + (o_custkey % 10 - 2) / 2.0::DOUBLE * 0.1) END", "tool_score")},
 (o_custkey % 2 = 0)::INTEGER AS boxed_score FROM orders""")
def adjusted_scores(spark, sf):
    ok = f_("o_orderstatus") == "F"
    flawed = D.flawed_positive_score(ok, F.when(f_("o_orderkey") % 2 == 0, "train").otherwise("test"), F.when(f_("o_custkey") % 3 == 0, "-1").otherwise("2"))
    tool = D.tool_turn_score(F.when(ok, 1.0).otherwise(-1.0), f_("o_custkey") % 10)
    boxed = D.boxed_equal_score(_cat("\\boxed{", f_("o_custkey").cast("string"), "}"), F.when(f_("o_custkey") % 2 == 0, f_("o_custkey").cast("string")).otherwise("x"))
    out = table(spark, sf, "orders").select("o_orderkey", flawed.alias("f"), tool.alias("tool_score"), boxed.alias("boxed_score"))
    return rounded(out.select("o_orderkey", f_("f.score").alias("flawed_score"), "f.is_flawed_positive", "tool_score", "boxed_score"), "flawed_score", "tool_score")


POINTS = """pt AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, round(l_discount * 100) AS x, round(l_tax * 100) + l_linenumber * l_linenumber * 10 AS y FROM lineitem),
li AS (SELECT a.k, max(CASE WHEN (b.y - a.y) * (c.x - a.x) = (c.y - a.y) * (b.x - a.x) THEN 1 ELSE 0 END) AS line FROM pt a JOIN pt b ON a.k = b.k AND a.i < b.i JOIN pt c ON b.k = c.k AND b.i < c.i GROUP BY 1),
h AS (SELECT k, count(*) AS n, min(i) FILTER (x BETWEEN 2 AND 6 AND y BETWEEN 10 AND 100) AS r FROM pt GROUP BY 1)"""


@query("ranked_hit_reward", f"""WITH {POINTS}, s AS (SELECT h.k, n, r, coalesce(line, 0) AS line FROM h LEFT JOIN li USING (k)), t AS (SELECT *, CASE WHEN line = 1 THEN -1 WHEN r IS NOT NULL THEN 1 / sqrt(n * r) ELSE -1.0::DOUBLE / n END AS acc FROM s)
SELECT k AS o_orderkey, {q8("CASE WHEN line = 1 THEN -1 ELSE 1 + acc END", "score")}, {q8("acc", "accuracy")}, line::INTEGER AS is_collinear, (line = 0 AND coalesce(r, 0) = 1)::INTEGER AS first_correct FROM t""")
def ranked_hit_reward(spark, sf):
    l = table(spark, sf, "lineitem")
    y = F.round(f_("l_tax") * 100) + f_("l_linenumber") * f_("l_linenumber") * 10
    pts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(f_("l_discount") * 100).alias("x"), y.alias("y"))))
    by = l.groupBy(f_("l_orderkey").alias("o_orderkey")).agg(pts.alias("pts"))
    out = by.select("o_orderkey", D.ranked_hit_reward(f_("pts"), {"x1": 2, "x2": 6, "y1": 10, "y2": 100}).alias("s")).select("o_orderkey", "s.*")
    return rounded(out, "score", "accuracy")


@query("weighted_conversation_score", f"""WITH m AS (SELECT conv_id, role AS metric, avg(coalesce(CASE WHEN turn % 4 <> 3 THEN length(text) END, 0) * CASE role WHEN 'user' THEN 0.01 WHEN 'assistant' THEN -0.002 ELSE 0 END) AS v FROM conversations GROUP BY ALL)
SELECT conv_id, {q8("sum(greatest(-1, least(1, v)))", "score")} FROM m GROUP BY 1""")
def weighted_conversation_score(spark, sf):
    c = table(spark, sf, "conversations").withColumn("v", F.when(f_("turn") % 4 != 3, F.length("text").cast("double")))
    return rounded(D.weighted_conversation_score(c, "conv_id", "role", "v", {"user": 0.01, "assistant": -0.002}), "score")


@query("tool_use_composite", f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'it is ' || p_name WHEN 2 THEN 'so ' || p_name WHEN 3 THEN p_name || ' only' ELSE '<think>open ' || p_name END AS answer,
 {q8("0.8 * (p_size % 2) + CASE p_partkey % 5 WHEN 0 THEN 0 ELSE -0.2 END + CASE WHEN p_partkey % 5 IN (0, 1, 2) THEN 1.2 * (p_size % 2) ELSE 0 END", "score")} FROM part""")
def tool_use_composite(spark, sf):
    n = f_("p_name")
    text = (F.when(K(5) == 0, _cat("<think>a</think><tool_call>{}</tool_call><answer> ", n, " </answer>")).when(K(5) == 1, _cat("<think>a</think><tool_response>r</tool_response>\nassistant\nit is ", n))
            .when(K(5) == 2, _cat("<think>a</think>so <tool_call>x</tool_call>", n)).when(K(5) == 3, _cat(n, " only")).otherwise(_cat("<think>open ", n)))
    verdict = F.when(f_("p_size") % 2 == 1, "Correct").otherwise("INCORRECT")
    p = table(spark, sf, "part").withColumn("t", text)
    out = p.select("p_partkey", D.tool_use_answer(f_("t"))["answer"].alias("answer"), D.tool_use_composite(f_("t"), verdict).alias("score"))
    return rounded(out, "score")
