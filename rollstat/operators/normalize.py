"""Record normalisation: raw rows to training, evaluation and judge records."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollstat.functions.columns import any_contains, blank_to_null, collapse_ws, last, let, sha, strip, text_or_empty
from rollstat.operators.ranking import cumulate, position, with_range_bucket
from rollstat.session import materialize

MESSAGES = "array<struct<role:string,content:string>>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def as_messages(df: DataFrame, column: str) -> Column:
    """Messages as an array of (role, content); JSON text is parsed."""
    kind = df.schema[column].dataType
    value = F.from_json(column, MESSAGES) if isinstance(kind, T.StringType) else F.col(column)
    return F.transform(value, lambda m: F.struct(
        text_or_empty(m["role"]).alias("role"), text_or_empty(m["content"]).alias("content")))


def _optional(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.col(n).cast("string") for n in names if n in df.columns]


# B1, B2 differ only in the order in which ids are tried
SFT_ID_ORDER = ("id", "source_row_index", "key")
SHARD_ID_ORDER = ("id", "sample_id", "source_row_index", "key")


def normalize_sft_record(df: DataFrame, domain: str, id_order: Sequence[str] = SFT_ID_ORDER) -> DataFrame:
    """The fixed seven text columns; a column that is missing takes its default, a null becomes empty."""
    first = lambda names: (_optional(df, names) or [F.lit("")])[0]
    ids = _optional(df, id_order)
    dataset = F.col("dataset").cast("string") if "dataset" in df.columns else F.lit(domain)
    return df.select(
        F.coalesce(as_messages(df, "messages"), F.array().cast(MESSAGES)).alias("messages"),
        F.lit(domain).alias("domain"), text_or_empty(first(["source"])).alias("source"),
        text_or_empty(dataset).alias("dataset"), text_or_empty(first(["split", "ocr_split"])).alias("split"),
        text_or_empty(first(["difficulty"])).alias("difficulty"), F.coalesce(*ids, F.lit("")).alias("sample_id"))


def pair_to_messages(df: DataFrame, user: str, assistant: str, pos: Sequence[str], max_samples: int | None = None) -> DataFrame:
    """(input, response) to a two-message conversation; blank sides are dropped."""
    both = df.filter((strip(text_or_empty(user)) != "") & (strip(text_or_empty(assistant)) != ""))
    out = both.withColumn("messages", F.array(
        message("user", text_or_empty(user)), message("assistant", text_or_empty(assistant))))
    return out if max_samples is None else position(out, pos, name="_p", keep=max_samples).drop("_p")


# Instruction wordings to remove, and the wording to add.
MATH_PREFIX = (r"(?i)^\s*Solve the following math problem step by step\. The last line of your response should be of the form "
               r"Answer: \$Answer \(without quotes\) where \$Answer is the answer to the problem\.\s*")
MATH_ANSWER_LINE = r"(?i)\s*Remember to put your answer on its own line after \"Answer:\"\.?\s*$"
MATH_BOXED_LINE = r"(?i)\s*Please reason step by step, and put your final answer (?:within|in) \\+boxed\{\}\.?\s*$"
MATH_SUFFIX = "Please reason step by step, and put your final answer in \\boxed{}."


def strip_math_instruction(text: Column) -> Column:
    for pattern in (MATH_PREFIX, MATH_ANSWER_LINE, MATH_BOXED_LINE):
        text = strip(F.regexp_replace(text, pattern, ""))
    return text


def math_messages(problem: Column, system: str, suffix: str = MATH_SUFFIX) -> Column:
    return F.array(message("system", F.lit(system)), message("user", F.concat(
        strip_math_instruction(text_or_empty(problem)), F.lit("\n\n" + suffix))))


def normalize_math_prompt(df: DataFrame, messages: str, mode: str, system: str) -> Column:
    """``sft``: first user plus all assistant turns; ``rl``: first user, else the last message."""
    m = as_messages(df, messages)
    users = F.filter(m, lambda x: (x["role"] == "user") & (x["content"] != ""))
    if mode == "sft":
        head = F.coalesce(F.get(users, 0)["content"], F.get(m, 0)["content"])
        return F.concat(math_messages(head, system), F.filter(m, lambda x: x["role"] == "assistant"))
    if mode != "rl":
        raise ValueError(f"unknown mode {mode!r}")
    any_user = F.get(F.filter(m, lambda x: x["role"] == "user"), 0)["content"]
    return math_messages(F.coalesce(F.when(any_user != "", any_user), last(m)["content"]), system)


def normalize_math_eval(df: DataFrame, system: str) -> DataFrame:
    """The 17-column evaluation record."""
    text = lambda c: text_or_empty(c) if c in df.columns else F.lit("")
    keep = lambda c, t: (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
    sample = F.coalesce(F.when(text("sample_id") != "", text("sample_id")), text("request_id"))
    return df.select(
        text("dataset").alias("dataset"), F.lit("math").alias("domain"), sample.alias("sample_id"),
        math_messages(text("prompt"), system).alias("prompt"), text("prompt").alias("original_prompt"),
        text("answer").alias("answer"), text("metadata").alias("metadata"), keep("max_tokens", "bigint"),
        keep("temperature", "double"), keep("top_p", "double"), keep("top_k", "bigint"), text("evaluator").alias("evaluator"),
        keep("repeat_idx", "bigint"), text("request_id").alias("request_id"), text("dataset").alias("data_source"),
        F.struct(F.lit("rule-lighteval/MATH_v2").alias("style"), text("answer").alias("ground_truth")).alias("reward_model"),
        F.struct(sample.alias("index")).alias("extra_info"))


# Families in order of precedence with the phrases that select them.
FAMILY_PHRASES = {
    "language": ("entire response should be in", "no other language is allowed"),
    "keywords": ("keyword",),
    "lexical_constraints": ("stop word", "no two consecutive words", "consecutive words can share", "consecutive words should",
                            "word repeats", "words repeat", "repeat words"),
    "detectable_format": ("wrapped in double angular brackets", "markdown divider", "contain a title", "numbered list", "bullet list"),
    "length_constraints": ("less than", "at least"),
    "count_or_pattern": ("there should be", "should appear"),
}
FAMILY_PATTERN = r"\b(include )?exactly \d+ numbers?\b|\b\d+ numbers? in the response\b"


def classify_family(prompt: Column) -> Column:
    """First family whose phrase occurs in the collapsed lower-case prompt."""
    return let(F.lower(collapse_ws(text_or_empty(prompt))), _family)


def _family(text: Column) -> Column:
    out = F.lit("other")
    for family, phrases in reversed(FAMILY_PHRASES.items()):
        hit = any_contains(text, phrases)
        if family == "count_or_pattern":
            hit = hit | F.rlike(text, F.lit(FAMILY_PATTERN))
        out = F.when(hit, family).otherwise(out)
    return out


def build_if_record(df: DataFrame, *, prompt: str, ids: str, kwargs: str, sample_id: str, dataset: str, system: str) -> DataFrame:
    """Instruction record with ``reject_reason`` (null when valid). ``kwargs`` is an array of JSON texts."""
    text = strip(text_or_empty(prompt))
    reason = (F.when(text == "", "empty_prompt").when(F.coalesce(F.size(ids), F.lit(0)) <= 0, "no_instructions")
              .when(F.coalesce(F.size(kwargs), F.lit(-1)) != F.size(ids), "kwargs_not_aligned"))
    return df.select(
        F.lit("instruction_following").alias("ability"), F.array(message("system", F.lit(system)), message("user", text)).alias("prompt"),
        F.struct(F.lit("rule").alias("style"), F.lit("").alias("ground_truth")).alias("reward_model"),
        F.struct(
            F.col(sample_id).cast("bigint").alias("sample_id"), text.alias("raw_prompt"), F.col(ids).alias("instruction_id_list"),
            F.transform(F.arrays_zip(F.col(ids).alias("i"), F.col(kwargs).alias("k")), lambda z: canonical_kwargs(z["k"], z["i"])).alias(
                "instruction_kwargs_json"),
            text_or_empty(dataset).alias("dataset"), classify_family(text).alias("family")).alias("extra_info"),
        reason.alias("reject_reason"))


def if_record_report(records: DataFrame, top_instructions: int = 48, top_datasets: int = 20) -> DataFrame:
    """Counts by reject reason, instruction, dataset, family and instructions per prompt (kind, name, n)."""
    ok = records.filter("reject_reason is null").select("extra_info.*")
    count = lambda d, kind, c: d.groupBy(c.cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    top = lambda d, k: d.orderBy(F.col("n").desc(), F.col("name")).limit(k)
    parts = [
        count(records.filter("reject_reason is not null"), "rejected", F.col("reject_reason")),
        top(count(ok.select(F.explode("instruction_id_list").alias("i")), "instruction", F.col("i")), top_instructions),
        top(count(ok, "dataset", F.col("dataset")), top_datasets),
        count(ok, "family", F.col("family")), count(ok, "instructions_per_prompt", F.size("instruction_id_list")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


COUNT_WORD_INSTRUCTION = "count:count_increment_word"


def _json_object(entries: Column) -> Column:
    """Entries (key, JSON text) as one JSON object with sorted keys."""
    pairs = F.transform(F.array_sort(entries), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def _entries(json_text: Column) -> Column:
    parsed = F.try_parse_json(json_text).cast("map<string,variant>")
    return F.transform(F.map_entries(parsed), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")))


def canonical_kwargs(kwargs: Column, instruction_id: Column) -> Column:
    """Sorted-key JSON; one-element keyword lists of the count-word instruction become their element."""
    single = F.transform(_entries(kwargs), lambda e: F.struct(e["key"].alias("key"), F.when(
        (instruction_id == COUNT_WORD_INSTRUCTION) & e["key"].isin("keyword1", "keyword2")
        & F.rlike(e["value"], F.lit(r'^\[(\"(?:[^\"\\]|\\.)*\"|[^\[\]{},\"]+)\]$')),
        F.regexp_extract(e["value"], r"^\[(.*)\]$", 1)).otherwise(e["value"]).alias("value")))
    return F.coalesce(_json_object(single), F.lit("null"))


def evaluation_kwargs(kwargs: Column, allowed: Column) -> Column:
    """Null values dropped, integral numbers written as integers, only allowed keys kept."""
    kept = F.filter(_entries(kwargs), lambda e: (e["value"] != "null") & F.array_contains(allowed, e["key"]))
    return F.coalesce(_json_object(F.transform(kept, lambda e: F.struct(
        e["key"].alias("key"), F.regexp_replace(e["value"], r"^(-?\d+)\.0+$", "$1").alias("value")))), F.lit("{}"))


# Wording of the code prompt.
CODE_WITH_STARTER = ("You will use the following starter code to write the solution to the problem and enclose "
                     "your code within delimiters.")
CODE_WITHOUT_STARTER = ("Read the inputs from stdin solve the problem and write the answer to stdout (do not directly "
                        "test on the sample inputs). Enclose your code within delimiters as follows. Ensure that when "
                        "the python program runs, it reads the inputs, runs the algorithm and writes output to STDOUT.")


def format_code_prompt(problem: Column, starter: Column) -> Column:
    code = blank_to_null(starter)
    section = F.when(code.isNotNull(), F.concat(F.lit(f"{CODE_WITH_STARTER}\n```python\n"), code)).otherwise(
        F.lit(f"{CODE_WITHOUT_STARTER}\n```python\n# YOUR CODE HERE"))
    return F.concat(F.lit("### Question:\n"), problem, F.lit("\n\n### Format: "), section,
                    F.lit("\n```\n\n### Answer: (use the provided format with backticks)\n\n"))


TESTS_LIST = "array<struct<input:string,output:string>>"
TESTS_DICT = "struct<inputs:array<string>,outputs:array<string>>"


def parse_testcases(json_text: Column) -> Column:
    """A list of {input, output} or a pair of arrays, both as a list of (input, output)."""
    both = F.from_json(json_text, TESTS_DICT)
    zipped = F.transform(F.arrays_zip(both["inputs"].alias("i"), both["outputs"].alias("o")),
                         lambda z: F.struct(z["i"].alias("input"), z["o"].alias("output")))
    return F.when(F.rlike(F.trim(json_text), F.lit(r"^\[")), F.from_json(json_text, TESTS_LIST)).otherwise(zipped)


def merge_testcases(public: Column, private: Column, metadata: Column) -> Column:
    """Public then private cases, each with the metadata attached."""
    empty = F.array().cast(TESTS_LIST)
    cases = F.concat(F.coalesce(public, empty), F.coalesce(private, empty))
    return F.transform(cases, lambda c: F.struct(c["input"].alias("input"), c["output"].alias("output"), metadata.alias("metadata")))


def filter_overlong(df: DataFrame, tokens: Column, max_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Rows within the limit, and a one-row length report. A null count is an error row and is dropped."""
    rows = df.withColumn("prompt_tokens", tokens)
    # everything in the report follows from the histogram of lengths, so the texts are read once
    hist = materialize(rows.groupBy("prompt_tokens").agg(F.count(F.lit(1)).alias("c")), "lengths")
    n, c = F.col("prompt_tokens"), F.col("c")
    known = hist.filter("prompt_tokens is not null")
    cums = cumulate(with_range_bucket(known, "prompt_tokens"), [n], [], "cum", weight=c).withColumn(
        "_all", known.agg(F.sum("c").alias("t")).scalar())

    def quantile(q: float) -> Column:
        h = F.lit(q) * (F.col("_all") - 1)
        low = F.min(F.when(F.col("cum") >= F.floor(h) + 1, n))
        high = F.min(F.when(F.col("cum") >= F.ceil(h) + 1, n))
        return low + (high - low) * F.max(h - F.floor(h))

    count = lambda cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0)).cast("bigint")
    quant = cums.agg(F.struct(*[quantile(q).alias(k) for k, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))]).alias("q")).scalar()
    report = hist.agg(
        count(n <= max_tokens).alias("kept"), count(n > max_tokens).alias("dropped"), count(n.isNull()).alias("errors"),
        F.min(n).alias("min"), F.max(n).alias("max"), (F.sum(n * c) / F.sum(F.when(n.isNotNull(), c))).alias("mean")).withColumn(
        "_q", quant).select("*", "_q.p50", "_q.p90", "_q.p99").drop("_q")
    return rows.filter(n <= max_tokens), report


def shuffle_choices(df: DataFrame, key: str, correct: Column, wrong: Sequence[Column], seed: int) -> DataFrame:
    """Options in seeded order with the letter of the right one; the same for every run and partitioning."""
    tagged = F.array(*[F.struct(sha(F.lit(seed), key, o, F.lit(i)).alias("h"), o.cast("string").alias("o"), F.lit(i == 0).alias("right"))
                       for i, o in enumerate([correct, *wrong])])
    rows = df.withColumn("_o", F.array_sort(tagged))
    spot = F.array_position(F.transform("_o", lambda x: x["right"]), F.lit(True))
    return rows.withColumn("options", F.transform("_o", lambda x: x["o"])).withColumn(
        "answer", F.substring(F.lit("ABCDEFGHIJ"), spot.cast("int"), F.lit(1))).drop("_o")


def date_and_type_filter(df: DataFrame, date: str, low: str, high: str, kind: str | None = None, wanted: str | None = None) -> DataFrame:
    """Dates in [low, high) and one type: plain comparisons, pushed into the scan."""
    out = df.filter((F.col(date) >= F.lit(low).cast(df.schema[date].dataType)) & (F.col(date) < F.lit(high).cast(df.schema[date].dataType)))
    return out if kind is None else out.filter(F.col(kind) == wanted)


def flat_prompt_to_messages(prompt: Column, response: Column) -> Column:
    """``system\\n..\\nuser\\n..`` to messages; one trailing assistant marker is cut, then the response is added."""
    pattern = r"(?s)^system\n(.*?)\nuser\n(.*)$"
    has = F.rlike(prompt, F.lit(pattern))
    system = F.when(has, F.regexp_extract(prompt, pattern, 1)).otherwise("")
    user = F.when(has, F.regexp_extract(prompt, pattern, 2)).otherwise(prompt)
    user = F.regexp_replace(user, r"\n?assistant\n\z", "")
    turns = F.array(message("user", user), message("assistant", response))
    return F.when(system != "", F.concat(F.array(message("system", system)), turns)).otherwise(turns)


END_MARK = "<|im_end|>"


def message_problem(content: Column) -> Column:
    """Why a message is not usable, or null."""
    opened, closed = F.regexp_count(content, F.lit("<think>")), F.regexp_count(content, F.lit("</think>"))
    inside = strip(F.regexp_extract(content, r"(?s)<think>(.*?)</think>", 1))
    visible = strip(F.regexp_replace(content, r"(?s)<think>.*?</think>", ""))
    bare = strip(F.regexp_replace(visible, r"\Q" + END_MARK + r"\E\z", ""))
    return (F.when(strip(content) == "", "blank").when(opened != closed, "unpaired_think").when(opened > 1, "many_think")
            .when((opened == 1) & (inside == ""), "empty_think").when(bare == "", "empty_outside"))


def validate_conversation(df: DataFrame, conv: str, turn: str, role: str, content: str, trainable: Column | None = None) -> DataFrame:
    """One verdict row per conversation: order of roles, message problems, trainable content."""
    order = Window.partitionBy(conv).orderBy(turn)
    rows = df.select(conv, turn, F.col(role).alias("_role"), F.col(content).alias("_c"),
                     (F.coalesce(trainable, F.col(role) == "assistant") if trainable is not None else F.col(role) == "assistant").alias("_train"),
                     F.row_number().over(order).alias("_i"))
    first = lambda i: F.max(F.when(F.col("_i") == i, F.col("_role")))
    known = F.col("_role").isin("system", "user", "assistant", "tool")
    by = rows.groupBy(conv).agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_if(~known).alias("unknown_roles"),
        F.count_if((F.col("_role") == "system") & (F.col("_i") > 1)).alias("late_system"),
        first(1).alias("_1"), first(2).alias("_2"), first(3).alias("_3"),
        F.count_if(message_problem(F.col("_c")).isNotNull()).alias("bad_messages"),
        F.count_if(F.col("_train") & (strip("_c") != "")).alias("trainable_turns"))
    starts = F.when(F.col("_1") == "system", (F.col("_2") == "user") & (F.col("_3") == "assistant")).otherwise(
        (F.col("_1") == "user") & (F.col("_2") == "assistant"))
    by = by.withColumn("good_start", F.coalesce(starts, F.lit(False)))
    return by.select(conv, "n_turns", "unknown_roles", "late_system", "good_start", "bad_messages", "trainable_turns", (
        (F.col("unknown_roles") == 0) & (F.col("late_system") == 0) & F.col("good_start") & (F.col("bad_messages") == 0)
        & (F.col("trainable_turns") > 0)).alias("valid"))


def split_tool_transcript(df: DataFrame, key: str, text: str) -> DataFrame:
    """One assistant text to rows (key, step, role, content, code) at its code / interpreter / answer tags.

    Text behind the last tag, or without any, is a last assistant row.
    """
    tags = r"(?s)(.*?(?:<code>.*?</code>|<interpreter>.*?</interpreter>|<answer>.*?</answer>))"
    found = F.regexp_extract_all(text, F.lit(tags), 1)
    # the pieces follow each other without gaps, so the rest starts behind their joint length
    rest = F.substring(F.col(text), F.length(F.array_join(found, "")) + 1, F.length(text))
    pieces = F.concat(found, F.when(strip(rest) != "", F.array(rest)).otherwise(F.array().cast("array<string>")))
    rows = df.select(key, F.posexplode(pieces).alias("step", "_p"))
    grab = lambda tag: F.regexp_extract("_p", rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    before = lambda tag: F.regexp_extract("_p", rf"(?s)^(.*?)<{tag}>", 1)
    is_ = lambda tag: F.contains(F.col("_p"), F.lit(f"<{tag}>"))
    fenced = F.regexp_extract(grab("code"), r"(?s)```python(.*?)```", 1)
    return rows.select(
        key, "step", F.when(is_("interpreter"), "tool").otherwise("assistant").alias("role"),
        F.when(is_("code"), strip(before("code"))).when(is_("interpreter"), strip(grab("interpreter"))).when(
            is_("answer"), strip(F.concat(before("answer"), grab("answer")))).otherwise(strip("_p")).alias("content"),
        F.when(is_("code"), F.when(fenced != "", strip(fenced)).otherwise(grab("code"))).alias("code"))


def extract_tool_calls(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, ordinal, name, arguments) per readable tool call, and (key, content) without the calls."""
    pattern = r"(?s)<tool_call>(.*?)</tool_call>"
    bodies = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("ordinal", "_b"))
    parsed = bodies.withColumn("_v", F.try_parse_json("_b"))
    name, args = F.try_variant_get("_v", "$.name", "string"), F.try_variant_get("_v", "$.arguments", "variant")
    calls = parsed.select(key, "ordinal", name.alias("name"), F.to_json(args).alias("arguments")).filter(
        "name is not null and arguments is not null")
    return calls, df.select(key, F.regexp_replace(text, pattern, "").alias("content"))


def coalesce_ground_truth(df: DataFrame, fields: Sequence[str], keep: Sequence[str], system: str, prompt: str) -> DataFrame:
    """Ground truth from the first non-empty field; the other columns go to ``extra_info`` without overwriting it."""
    truth = F.coalesce(*[F.when(F.col(f) != "", F.col(f)) for f in fields], F.lit(""))
    rest = [c for c in df.columns if c not in (*keep, prompt, "extra_info", "ground_truth")]
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(c).cast("string") for c in rest]))
    if "extra_info" in df.columns:
        old = F.coalesce("extra_info", F.create_map().cast("map<string,string>"))
        pairs = F.map_concat(old, F.map_filter(pairs, lambda k, v: ~F.map_contains_key(old, k)))
    return df.select(*keep, F.concat(F.array(message("system", F.lit(system))), F.col(prompt)).alias("prompt"),
                     truth.alias("ground_truth"), pairs.alias("extra_info"))


def repair_data_source(data_source: str, dataset: str) -> Column:
    """Row by row: a null or blank data source takes the dataset."""
    return F.when(blank_to_null(data_source).isNotNull(), F.col(data_source)).otherwise(F.col(dataset))


def infer_domain(data_source: Column, explicit: Column | None = None, ability: Column | None = None, *, strict: bool = True) -> Column:
    """Explicit domain, then ability, then data source; unknown raises (or is null when not strict)."""
    low = lambda c: F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))
    d = low(explicit) if explicit is not None else F.lit("")
    a = low(ability) if ability is not None else F.lit("")
    s = low(data_source)
    # Names that decide the domain.
    unknown = F.raise_error(F.concat(F.lit("cannot infer the domain of "), s)) if strict else F.lit(None)
    return (
        F.when(d.isin("math", "code", "if"), d)
        .when(a.isin("math", "mathematics"), "math").when(a.isin("code", "coding", "programming"), "code")
        .when(a.isin("if", "instruction_following", "instruction-following"), "if")
        .when(F.startswith(s, F.lit("aime")) | F.contains(s, F.lit("math")), "math")
        .when(s.isin("primeintellect", "taco", "codecontests_lcb", "livecodebench") | F.startswith(s, F.lit("livecodebench")), "code")
        .when((s == "nemotron_if_rl") | F.contains(s, F.lit("ifeval")) | F.startswith(s, F.lit("ifbench")), "if")
        .otherwise(unknown.cast("string")))


def truncate_pad_tokens(df: DataFrame, prompt: str, response: str, max_length: int, *, truncation: str = "right", pad_id: int = 0) -> DataFrame:
    """Fixed-length ``input_ids``, ``attention_mask``, ``position_ids`` and ``loss_mask`` from two token arrays."""
    ids = F.concat(prompt, response)
    n, p = F.size(ids), F.size(prompt)
    over = n > max_length
    if truncation == "error":
        kept = F.when(over, F.raise_error(F.lit("sequence longer than the maximum")).cast(df.schema[prompt].dataType)).otherwise(ids)
    elif truncation in ("left", "right"):
        start = F.when(over & F.lit(truncation == "left"), n - max_length + 1).otherwise(1)
        kept = F.slice(ids, start, F.lit(max_length))
    else:
        raise ValueError(f"unknown truncation {truncation!r}")
    rows = df.withColumn("_n", F.least(n, F.lit(max_length))).withColumn("_p", p).withColumn("_all", n).withColumn("_k", kept)
    at = F.sequence(F.lit(0), F.lit(max_length - 1))
    real = lambda i: (i < F.col("_n")).cast("int")
    hidden = F.when(F.col("_p") > 1, F.least(F.col("_p"), F.lit(max_length)) - 1).otherwise(0)
    final = F.least(F.col("_all"), F.lit(max_length)) - 1
    return rows.select(
        *[c for c in df.columns if c not in (prompt, response)],
        F.concat("_k", F.array_repeat(F.lit(pad_id).cast(df.schema[prompt].dataType.elementType), F.lit(max_length) - F.col("_n"))).alias("input_ids"),
        F.transform(at, real).alias("attention_mask"),
        F.transform(at, lambda i: F.greatest(F.least(i + 1, F.col("_n")) - 1, F.lit(0))).alias("position_ids"),
        F.transform(at, lambda i: F.when((i < hidden) | (i == final), 0).otherwise(real(i))).alias("loss_mask"))


def preference_rows(df: DataFrame, keys: Sequence[str], chosen: str, rejected: str) -> DataFrame:
    """Two rows per prompt: (keys, kind, response)."""
    return df.unpivot(list(keys), [F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected")], "kind", "response")


def message_placeholders(df: DataFrame, key: Sequence[str], content: str) -> DataFrame:
    """Content as typed segments in order: text, image, video."""
    parts = F.filter(F.split(content, r"(?=<image>|<video>)|(?<=<image>)|(?<=<video>)"), lambda s: s != "")
    rows = df.select(*key, F.posexplode(parts).alias("segment", "_s"))
    return rows.select(*key, "segment", F.when(F.col("_s") == "<image>", "image").when(F.col("_s") == "<video>", "video").otherwise("text").alias("type"),
                       F.when(~F.col("_s").isin("<image>", "<video>"), F.col("_s")).alias("text"))


# Fixed value: label of the turn under judgement.
TO_BE_JUDGED = "[Assistant # to be judged]"


def judge_transcript(messages: Column, answer: Column) -> Column:
    """Labelled turns without system turns, then the answer under its own label."""
    turns = F.filter(messages, lambda m: F.lower(strip(m["role"])) != "system")
    lines = F.transform(turns, lambda m: F.concat(
        F.when(F.lower(strip(m["role"])) == "assistant", "[Assistant]\n").otherwise("[User]\n"), strip(text_or_empty(m["content"]))))
    return F.array_join(F.concat(lines, F.array(F.concat(F.lit(TO_BE_JUDGED + "\n"), strip(text_or_empty(answer))))), "\n\n")


def coerce_prompt(text: Column) -> Column:
    """A prompt given as text: a JSON list of messages, else one user turn; blank gives no turn."""
    parsed = F.from_json(text, MESSAGES, {"mode": "PERMISSIVE"})
    one = F.array(message("user", text))
    return F.when(F.coalesce(strip(text), F.lit("")) == "", F.array().cast(MESSAGES)).when(
        F.startswith(strip(text), F.lit("[")) & F.try_parse_json(text).isNotNull(), parsed).otherwise(one)


def fill_template(template: str, **values: Column) -> Column:
    """{name} markers replaced by columns."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else text_or_empty(values[p]) for i, p in enumerate(parts)])


def format_passages(passages: Column) -> Column:
    """Ranked passages as one text: ordinal, first line as title, the rest as body."""
    def one(p: Column, i: Column) -> Column:
        lines = F.split(p, "\n")
        body = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
        return F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), lines[0], F.lit(")\n"), body)

    return strip(F.array_join(F.transform(passages, one), "\n\n"))
