"""Scorers as column expressions: answers, choices, code blocks, penalties, verdicts."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollstat.functions.columns import last, let, strip, text_or_empty


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def rfind(text: Column, marker: str) -> Column:
    """1-based place of the last occurrence, 0 when absent."""
    back = F.instr(F.reverse(text), marker[::-1])
    return F.when(back > 0, F.length(text) - back - len(marker) + 2).otherwise(0)


def replace_each(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# ---- integer answers ----------------------------------------------------------------

def integer_answer(text: Column) -> Column:
    """Last boxed content, else the last line that is or holds one short number, else the last integer."""
    return let(strip(text_or_empty(text)), _integer_answer)


def _integer_answer(whole: Column) -> Column:
    no_commas = lambda c: F.replace(c, F.lit(","), F.lit(""))
    integers = lambda c: find_all(no_commas(c), r"-?\d+")
    boxed = last(find_all(whole, r"\\boxed\{([^}]*)\}", 1))
    lines = F.filter(F.transform(F.split(whole, r"\r\n|[\n\r]"), strip), lambda x: x != "")
    short = lambda s: F.rlike(s, F.lit(r"^\d{1,3}$"))
    value = lambda x: F.when(short(x), x).otherwise(F.get(integers(x), 0))
    fits = lambda x: short(x) | ((F.size(integers(x)) == 1) & short(F.get(integers(x), 0)))
    line = last(F.transform(F.filter(lines, fits), value))
    return F.when(boxed.isNotNull(), F.coalesce(last(integers(boxed)), strip(boxed))).otherwise(
        F.coalesce(line, last(integers(whole)), whole))


def _plain_integer(text: Column) -> Column:
    """Canonical form of an integer text, null for other text."""
    digits = F.regexp_replace(text, r"^[+-]?0*(?=\d)", "")
    canon = F.concat(F.when(F.startswith(text, F.lit("-")) & (digits != "0"), "-").otherwise(""), digits)
    return F.when(F.rlike(text, F.lit(r"^[+-]?\d+$")), canon)


def score_integer_answer(completion: Column, answer: Column) -> Column:
    """True when both answers are the same integer (033 = 33), else the same text."""
    pair = F.struct(integer_answer(completion).alias("a"), integer_answer(answer).alias("b"))
    return let(pair, lambda p: F.coalesce(_plain_integer(p["a"]) == _plain_integer(p["b"]), p["a"] == p["b"]))


# ---- boxed answers ------------------------------------------------------------------

def _balanced_from(text: Column, start: Column) -> Column:
    """Text from ``start`` to the brace that closes the first one; null when unbalanced."""
    begin = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(s: Column, ch: Column) -> Column:
        depth = s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        closes = (s["end"] == 0) & (ch == "}") & (depth == 0)
        return F.struct((s["i"] + 1).alias("i"), depth.alias("depth"), F.when(closes, s["i"] + 1).otherwise(s["end"]).alias("end"))

    tail = F.substring(text, start, F.length(text))
    cut = lambda t: let(F.aggregate(F.split(t, ""), begin, step, lambda s: s["end"]),
                        lambda end: F.when(end > 0, F.substring(t, F.lit(1), end)))
    return F.when(start > 0, let(tail, cut))


def last_boxed(text: Column) -> Column:
    """Last boxed (else framed) expression with balanced braces; the space form ends at a dollar sign."""
    spaced = F.concat(F.lit("\\boxed "), F.split_part(F.element_at(F.split(text, r"\\boxed "), -1), F.lit("$"), F.lit(1)))
    start = F.coalesce(F.nullif(rfind(text, "\\boxed"), F.lit(0)), rfind(text, "\\fbox"))
    return F.when(F.contains(text, F.lit("\\boxed ")), spaced).otherwise(let(start, lambda i: _balanced_from(text, i)))


def boxed_content(text: Column) -> Column:
    """Content of the last boxed expression; null for framed or unbalanced ones."""
    return let(last_boxed(text), lambda b: F.when(
        F.startswith(b, F.lit("\\boxed ")), F.substring(b, F.lit(8), F.length(b))).when(
        F.startswith(b, F.lit("\\boxed{")), F.substring(b, F.lit(8), F.length(b) - 8)))


def strict_boxed(text: Column) -> Column:
    """Content of the last \\boxed{...} only."""
    return let(_balanced_from(text, rfind(text, "\\boxed{")), lambda b: F.substring(b, F.lit(8), F.length(b) - 8))


# Spellings removed or unified before two answers are compared.
LATEX_SPELLINGS = [
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""),
    ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
]
LATEX_PERCENT = [("\\\\%", ""), ("\\%", ""), (" .", " 0."), ("{.", "{0.")]


def _zero_and_side(s: Column) -> Column:
    """A leading zero, then the right side of a short "x =" form."""
    padded = F.when(F.startswith(s, F.lit(".")), F.concat(F.lit("0"), s)).otherwise(s)
    return let(padded, lambda p: let(F.split(p, "="), lambda sides: F.when(
        (F.size(sides) == 2) & (F.length(sides[0]) <= 2), F.get(sides, 1)).otherwise(p)))


def _braced_fractions(s: Column) -> Column:
    fixed = F.regexp_replace(s, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    fixed = F.regexp_replace(fixed, r"\\frac([^{])\{", r"\\frac{$1}{")
    return F.when(F.rlike(s, F.lit(r"\\frac[^{](\\frac|$)")), s).otherwise(fixed)


def _simple_fraction(s: Column) -> Column:
    half = F.when(s == "0.5", "\\frac{1}{2}").otherwise(s)
    return F.regexp_replace(half, r"^(0|-?[1-9]\d*)/(0|-?[1-9]\d*)$", r"\\frac{$1}{$2}")


def _unless(s: Column, pattern: str) -> Column:
    return F.when(~F.rlike(s, F.lit(pattern)), s)


def normalize_latex(text: Column) -> Column:
    """Normal form of a LaTeX answer; null where the form is broken (then texts are compared as they are)."""
    plain = let(F.split(replace_each(text, LATEX_SPELLINGS), r"\\text\{ "), lambda u: F.when(F.size(u) <= 2, u[0]))
    s = _zero_and_side(replace_each(plain, LATEX_PERCENT))
    s = let(s, lambda x: _unless(x, r"\\sqrt(\\sqrt|$)"))
    s = F.replace(F.regexp_replace(s, r"\\sqrt([^{])", r"\\sqrt{$1}"), F.lit(" "), F.lit(""))
    s = let(s, lambda x: _unless(x, r"\\frac(\\frac|$)"))
    return let(let(s, _braced_fractions), _simple_fraction)


def latex_equal(a: Column, b: Column) -> Column:
    sides = F.struct(a.alias("a"), b.alias("b"), normalize_latex(a).alias("x"), normalize_latex(b).alias("y"))
    return let(sides, lambda s: F.when(s["a"].isNull() & s["b"].isNull(), True).otherwise(
        F.coalesce(s["x"] == s["y"], s["a"] == s["b"], F.lit(False))))


def score_latex_equal(completion: Column, answer: Column) -> Column:
    """1 when the last boxed content equals the answer after normalisation, else 0."""
    return let(boxed_content(completion), lambda c: F.when(c.isNotNull() & latex_equal(c, answer), 1.0).otherwise(0.0))


# ---- answer lines -------------------------------------------------------------------

# Replacements, then removed words and markup, in order.
ANSWER_SUBSTITUTIONS = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","),
    ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]
ANSWER_REMOVALS = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet",
    "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}",
    "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", "\"", "\\dots",
]
# (pattern, replacement) pairs applied after them
ANSWER_MARKUP = [
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"), (r"\\text\{(.*?)\}", "$1"), (r"\\textbf\{(.*?)\}", "$1"),
    (r"\\overline\{(.*?)\}", "$1"), (r"\\boxed\{(.*)\}", "$1"), (r"frac([^{])(.)", r"frac{$1}{$2}"), (r"sqrt([^{])", r"sqrt{$1}"),
]


def normalize_answer_line(text: Column) -> Column:
    s = replace_each(F.element_at(F.split(text, "="), -1), ANSWER_SUBSTITUTIONS)
    s = replace_each(s, [(w, "") for w in ANSWER_REMOVALS])
    for pattern, new in ANSWER_MARKUP:
        s = F.regexp_replace(s, pattern, new)
    bare = F.replace(s, F.lit("$"), F.lit(""))
    digits = lambda x: F.replace(x, F.lit(","), F.lit(""))
    return strip(let(bare, lambda x: F.when(F.rlike(digits(x), F.lit(r"^\d+$")), digits(x)).otherwise(x)))


def score_answer_line(completion: Column, answer: Column) -> Column:
    """struct(score, acc, pred): last "Answer:" in the last 300 characters, +1 or -1."""
    tail = F.right(completion, F.lit(300))
    found = last(find_all(tail, r"(?i)Answer\s*:\s*([^\n]+)", 1))
    pair = F.struct(normalize_answer_line(F.coalesce(found, F.lit("[INVALID]"))).alias("pred"), normalize_answer_line(answer).alias("truth"))
    return let(pair, lambda p: F.struct(F.when(p["pred"] == p["truth"], 1.0).otherwise(-1.0).alias("score"),
                                        (p["pred"] == p["truth"]).alias("acc"), p["pred"].alias("pred")))


def score_strict_box(completion: Column, answer: Column) -> Column:
    """The boxed text of the last 100 characters must equal the answer."""
    ok = lambda p: F.coalesce(p == answer, F.lit(False))
    return let(strict_boxed(F.right(completion, F.lit(100))), lambda p: F.struct(
        F.when(ok(p), 1.0).otherwise(-1.0).alias("score"), ok(p).alias("acc"), p.alias("pred")))


def hash_answer(text: Column, method: str = "strict") -> Column:
    """Strict: last "#### number"; flexible: last number that is not a lone dot."""
    tail = F.right(text, F.lit(300))
    if method == "strict":
        return F.replace(last(find_all(tail, r"#### (\-?[0-9.,]+)", 1)), F.lit(","), F.lit(""))
    numbers = find_all(tail, r"\-?[0-9.,]+")
    return F.coalesce(last(F.filter(numbers, lambda x: x != ".")), F.get(numbers, 0))


def score_hash_answer(completion: Column, answer: Column, method: str = "strict", format_score: float = 0.0, score: float = 1.0) -> Column:
    got = hash_answer(completion, method)
    return F.when(got.isNull(), 0.0).when(got == answer, score).otherwise(format_score)


def score_choice_letter(completion: Column, answer: Column) -> Column:
    """First "Answer: X" with X in A-D."""
    letter = F.regexp_extract(completion, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1)
    return F.when((letter != "") & (letter == answer), 1.0).otherwise(0.0)


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normalize_exact(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    plain = F.translate(F.lower(text), PUNCTUATION, "")
    return strip(F.regexp_replace(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def score_exact_match(completion: Column, golden: Column, *, contained: bool = False, format_score: float = 0.0, score: float = 1.0) -> Column:
    """Last answer tag against any golden answer; a quarter of the score beyond ten tags."""
    answer = last(find_all(completion, r"(?s)<answer>(.*?)</answer>", 1))
    hit = let(normalize_exact(answer), lambda got: F.exists(
        golden, lambda g: F.contains(got, normalize_exact(g)) if contained else normalize_exact(g) == got))
    spam = (F.regexp_count(completion, F.lit("<answer>")) > 10) | (F.regexp_count(completion, F.lit("</answer>")) > 10)
    full = F.lit(score) if contained else F.when(spam, score / 4).otherwise(score)
    return F.when(answer.isNull(), 0.0).when(hit, full).otherwise(format_score)


# ---- composites ---------------------------------------------------------------------

def closed_think(text: Column) -> Column:
    return F.rlike(text_or_empty(text), F.lit(r"(?is)^\s*<think>.*?</think>"))


def think_answer(completion: Column, task_score: Column) -> Column:
    """struct(score, think_score, answer_score): 0.2 for a closed think block, 0.8 for the task."""
    think = F.when(closed_think(completion), 0.2).otherwise(0.0)
    answer = 0.8 * task_score
    return F.struct((think + answer).alias("score"), think.alias("think_score"), answer.alias("answer_score"))


def format_accuracy(completion: Column, acc: Column, format_score: float = 0.1) -> Column:
    """0.9 accuracy + 0.1 for think block followed by a boxed answer."""
    form = F.rlike(completion, F.lit(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z"))
    return (1 - format_score) * acc + format_score * F.when(form, 1.0).otherwise(0.0)


def uniform_score(result: Column) -> Column:
    """A JSON result (object, number, boolean or array) as struct(score, acc)."""
    v = F.try_parse_json(result)
    num = lambda path: F.coalesce(F.try_variant_get(v, path, "double"), F.try_variant_get(v, path, "boolean").cast("double"))
    score, acc = num("$.score"), num("$.acc")
    plain = F.coalesce(num("$"), num("$[0]"))
    return F.struct(F.coalesce(score, acc, plain, F.lit(0.0)).alias("score"), F.coalesce(acc, score, plain, F.lit(0.0)).alias("acc"))


def common_extras(df: DataFrame, extras: str) -> DataFrame:
    """Only the map keys that every row has are kept."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    keys = df.select(F.explode(F.map_keys(extras)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    common = keys.filter(F.col("c") == n).agg(F.collect_set("k").alias("ks")).scalar()
    kept = df.withColumn("_ks", F.coalesce(common, F.array().cast("array<string>")))
    return kept.withColumn(extras, F.map_filter(F.col(extras), lambda k, v: F.array_contains(F.col("_ks"), k))).drop("_ks")


# ---- length rules -------------------------------------------------------------------

def overlong_penalty(length: Column, max_length: int, buffer: int, factor: float) -> Column:
    """min(-(length - (max - buffer)) / buffer * factor, 0)"""
    return F.least(-(length - (max_length - buffer)) / buffer * factor, F.lit(0.0))


# Distance to the budget and the cap that holds there.
LENGTH_CAPS = ((12288.0, 0.8), (8192.0, 0.65), (4096.0, 0.4), (0.0, 0.0))


def length_cap(length: Column, max_length: int, caps: Sequence[tuple[float, float]] = LENGTH_CAPS) -> Column:
    """Cap on the answer score, piecewise linear in the distance to the budget."""
    room = F.lit(float(max_length)) - length.cast("int")
    out = F.when(room >= caps[0][0], caps[0][1])
    for (high, c_high), (low, c_low) in zip(caps, caps[1:]):
        slope = (c_high - c_low) / (high - low) if high != low else 0.0
        out = out.when(room.between(low, high), c_low + (room - low) * slope)
    return out.otherwise(caps[-1][1])


# ---- code -----------------------------------------------------------------------------

def last_code_block(text: Column, entry_point: Column | None = None) -> Column:
    """Last fenced block, by preference the last one that defines the entry point."""
    if entry_point is None:
        return strip(last(find_all(text, r"(?s)```(?:\w+)?\n(.*?)```", 1)))
    blocks = F.transform(find_all(text, r"(?is)```(?:python|py)?\s*\n(.*?)```", 1), strip)
    pattern = F.concat(F.lit(r"(^|\n)\s*def\s+\Q"), entry_point, F.lit(r"\E\s*\("))
    return F.coalesce(last(F.filter(blocks, lambda b: F.rlike(b, pattern))), last(blocks), strip(text))


def drop_main_guard(code: Column) -> Column:
    """Code without its main guard and the indented block below it."""
    return F.regexp_replace(
        code, r"(?m)(?:(?<=\n)|\A)[ \t]*if __name__ == (?:\"__main__\"|'__main__').*(?:\n(?:[ \t].*|\s*)$)*\n?", "")


def score_testcases(
    owners: DataFrame, results: DataFrame, owner: str, *, has_code: Column, passed: str, size: str, ordinal: str, max_tests: int | None = None
) -> DataFrame:
    """Pass verdict per owner from its testcase results; only the n longest inputs count."""
    cases = results
    if max_tests:
        longest = Window.partitionBy(owner).orderBy(F.col(size).desc(), F.col(ordinal).asc())
        cases = results.withColumn("_r", F.row_number().over(longest)).filter(F.col("_r") <= max_tests)
    by = cases.groupBy(owner).agg(F.count(F.lit(1)).alias("total_tests"), F.count_if(F.col(passed)).alias("passed_tests"))
    rows = owners.join(by, owner, "left").fillna(0, ["total_tests", "passed_tests"])
    ok = has_code & (F.col("total_tests") > 0) & (F.col("passed_tests") == F.col("total_tests"))
    return rows.withColumn("score", F.when(ok, 1.0).otherwise(0.0))


# ---- dispatch -------------------------------------------------------------------------

Scorer = Callable[[Column, Column], Column]
SCORERS: dict[str, Scorer] = {}


def register_scorer(name: str, scorer: Scorer) -> None:
    """A scorer takes the completion and the truth and gives a score column (or is a pandas UDF)."""
    if name in SCORERS:
        raise ValueError(f"scorer {name!r} is already registered")
    SCORERS[name] = scorer


register_scorer("hash_answer", score_hash_answer)
register_scorer("latex", score_latex_equal)
register_scorer("answer_line", lambda c, a: score_answer_line(c, a)["score"])
register_scorer("choice", score_choice_letter)
register_scorer("exact_match", lambda c, a: score_exact_match(c, F.array(a)))
register_scorer("integer", lambda c, a: score_integer_answer(c, a).cast("double"))

# Sources of each scorer; a trailing star is a prefix, stars on both sides a substring.
SOURCE_ROUTES = {
    "hash_answer": ("openai/gsm8k",),
    "latex": ("lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500", "math_dapo_boxed"),
    "answer_line": ("math_dapo", "math", "math_dapo_reasoning", "aime*"),
    "choice": ("Idavidrein/gpqa",),
    "exact_match": ("searchR1_nq", "searchR1_triviaqa", "searchR1_popqa", "searchR1_hotpotqa", "searchR1_2wikimultihopqa",
                    "searchR1_musique", "searchR1_bamboogle"),
    "testcases": ("codecontests", "apps", "codeforces", "taco", "codecontests_lcb", "livecodebench*"),
    "instructions": ("*ifeval*", "nemotron_if", "ifbench", "instruction_following"),
}


def scorer_route(source: Column, routes: Mapping[str, Sequence[str]] = SOURCE_ROUTES) -> Column:
    """Name of the scorer of a data source, null when unknown."""
    out = None
    for name, patterns in routes.items():
        hit = F.lit(False)
        for p in patterns:
            core = F.lit(p.strip("*"))
            if p.startswith("*"):
                hit = hit | F.contains(source, core)
            elif p.endswith("*"):
                hit = hit | F.startswith(source, core)
            else:
                hit = hit | (source == core)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def dispatch_scorer(
    df: DataFrame, source: str, completion: str, answer: str, *, strict: bool = True, given: Mapping[str, str] | None = None,
) -> DataFrame:
    """Score every row with its source's scorer; sources without one raise (or score null).

    Test cases and instructions are scored by jobs of their own: ``given`` names the column with
    such a route's score; a route with neither raises as well.
    """
    rows = df.withColumn("route", scorer_route(F.col(source)))
    fail = F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(F.col(source), F.lit("null")))) if strict else F.lit(None)
    score = F.when(F.col("route").isNull(), fail.cast("double"))
    for name, column in (given or {}).items():
        score = score.when(F.col("route") == name, F.col(column).cast("double"))
    for name, fn in SCORERS.items():
        score = score.when(F.col("route") == name, fn(F.col(completion), F.col(answer)).cast("double"))
    return rows.withColumn("score", score.otherwise(fail.cast("double")))


# ---- adjustments ----------------------------------------------------------------------

def flawed_positive_score(correct: Column, split: Column, error_at: Column, penalty: float = 1.0) -> Column:
    """+-1, less the penalty for a correct training row whose judge found an error (location other than -1)."""
    base = F.when(correct, 1.0).otherwise(-1.0)
    flawed = correct & (split != "test") & F.coalesce(error_at.try_cast("int") != -1, F.lit(False))
    return F.struct(F.when(flawed, base - penalty).otherwise(base).alias("score"), flawed.alias("is_flawed_positive"))


def tool_turn_score(score: Column, turns: Column) -> Column:
    """A wrong answer earns 0.1 per extra turn pair, at most -0.6."""
    return F.when(score < 0, F.least(F.lit(-0.6), score + (turns - 2) / 2 * 0.1)).otherwise(score)


def boxed_equal_score(completion: Column, answer: Column) -> Column:
    return F.when(boxed_content(completion) == answer, 1).otherwise(0)


def collinear(points: Column) -> Column:
    """Any three points (x, y) on one line."""
    close = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))
    n = F.size(points)
    at = lambda i: F.get(points, i)
    upto = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    def line(i: Column, j: Column, k: Column) -> Column:
        p, q, r = at(i), at(j), at(k)
        return close((q["y"] - p["y"]) * (r["x"] - p["x"]), (r["y"] - p["y"]) * (q["x"] - p["x"]))

    return F.exists(upto(F.lit(0), n - 3), lambda i: F.exists(
        upto(i + 1, n - 2), lambda j: F.exists(upto(j + 1, n - 1), lambda k: line(i, j, k))))


def ranked_hit_reward(points: Column, box: Mapping[str, float], fmt_ratio: float = 1.0, acc_ratio: float = 1.0) -> Column:
    """Ordered point predictions against a box; unreadable (null) or collinear points score -1."""
    inside = F.transform(points, lambda p: p["x"].between(box["x1"], box["x2"]) & p["y"].between(box["y1"], box["y2"]))
    rank, n = F.array_position(inside, F.lit(True)), F.size(points)
    bad = points.isNull()
    line = F.coalesce(collinear(points), F.lit(False))
    acc = F.when(bad | line | (n == 0), -1.0).when(rank > 0, 1 / F.sqrt(n * rank)).otherwise(-1.0 / n)
    score = F.when(bad | line, -1.0).otherwise(fmt_ratio + acc_ratio * acc)
    return F.struct(score.alias("score"), acc.alias("accuracy"), line.cast("int").alias("is_collinear"),
                    F.when(~(bad | line) & (rank == 1), 1).otherwise(0).alias("first_correct"))


def weighted_conversation_score(df: DataFrame, prompt: str, metric: str, value: str, weights: Mapping[str, float]) -> DataFrame:
    """Per metric: mean over the repeats times its weight, clamped to [-1, 1]; then the sum. Null is a failed metric."""
    w = F.lit(0.0)
    for name, x in weights.items():
        w = F.when(F.col(metric) == name, float(x)).otherwise(w)
    by = df.groupBy(prompt, metric).agg((F.sum(F.coalesce(value, F.lit(0.0)) * w) / F.count(F.lit(1))).alias("_v"))
    return by.groupBy(prompt).agg(F.sum(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_v")))).alias("score"))


def tool_use_answer(text: Column) -> Column:
    """struct(answer, bad): the answer tag, else text after the last tool response, else cleaned text, else all."""
    return let(strip(F.element_at(F.split(text, "</think>"), -1)), lambda body: _tool_use_answer(text, body))


def _tool_use_answer(text: Column, body: Column) -> Column:
    has_think = F.contains(text, F.lit("</think>"))
    tagged = F.rlike(body, F.lit(r"(?s)<answer>.*?</answer>"))
    tag = strip(F.regexp_extract(body, r"(?s)<answer>(.*?)</answer>", 1))
    after_pattern = r"(?sm)</tool_response>\s*assistant\s*\n(.*?)$"
    after = F.rlike(body, F.lit(after_pattern))
    cleaned = F.regexp_replace(body, r"(?s)<tool_call>.*?</tool_call>", "")
    cleaned = F.regexp_replace(cleaned, r"(?s)<tool_response>.*?</tool_response>", "")
    cleaned = strip(F.regexp_replace(cleaned, r"\b(user|assistant)\b", ""))
    answer = F.when(tagged, tag).when(after, strip(F.regexp_extract(body, after_pattern, 1))).when(has_think, cleaned).otherwise(strip(text))
    unpaired = lambda t, tag_: F.regexp_count(t, F.lit(f"<{tag_}>")) != F.regexp_count(t, F.lit(f"</{tag_}>"))
    bad = unpaired(text, "think") | unpaired(body, "answer") | ~tagged
    return let(answer, lambda a: F.struct(F.when(a == "", strip(text)).otherwise(a).alias("answer"), (bad | (a == "")).alias("bad")))


def tool_use_composite(text: Column, verdict: Column) -> Column:
    """0.8 * accuracy + 0.2 * format + 1.2 * (a tool was used and the answer is right)."""
    return let(tool_use_answer(text), lambda got: _tool_use_composite(text, verdict, got))


def _tool_use_composite(text: Column, verdict: Column, got: Column) -> Column:
    long = F.length(got["answer"]) >= 1000
    right = F.rlike(F.coalesce(verdict, F.lit("")), F.lit(r"(?i)\bCORRECT\b")) & ~long
    used = F.rlike(text, F.lit(r"(?s)<tool_call>.*?</tool_call>|<tool_response>.*?</tool_response>"))
    acc = F.when(right, 1.0).otherwise(0.0)
    return 0.8 * acc + F.when(got["bad"] | long, -0.2).otherwise(0.0) + F.when(used & right, 1.2).otherwise(0.0)


# ---- judge verdicts -------------------------------------------------------------------

def parse_verdict(text: Column) -> Column:
    """Judge text to true, false or null: verdict tag, boxed, last clear line, then the whole text."""
    return let(strip(text), _parse_verdict)


def _parse_verdict(t: Column) -> Column:
    truth = lambda g: F.when(g != "", F.lower(g).isin("yes", "true"))
    tag = truth(F.regexp_extract(t, r"(?i)<verdict>\s*(yes|no|true|false)\s*</verdict>", 1))
    box = truth(F.regexp_extract(t, r"(?i)\\boxed\{\s*(yes|no|true|false)\s*\}", 1))

    def clear(line: Column) -> Column:
        yes, no = F.rlike(line, F.lit(r"(?iU)\byes\b")), F.rlike(line, F.lit(r"(?iU)\bno\b"))
        return F.when(yes & ~no, True).when(no & ~yes, False)

    lines = F.filter(F.transform(F.split(t, r"\r\n|[\n\r]"), clear), lambda v: v.isNotNull())
    return F.when(F.coalesce(t, F.lit("")) != "", F.coalesce(tag, box, last(lines), clear(t)))


def apply_judge_verdicts(
    df: DataFrame, verdicts: DataFrame, key: str, *, families: Sequence[str] = (), keep_think: bool = True,
    fail_cap: float = 0.0, fail_mode: str = "open",
) -> DataFrame:
    """Cap the score of rule-passing training rows whose verdict failed.

    ``df`` has score, content_ok, think_format_ok, family, is_eval; ``verdicts`` has (key, verdict_text).
    A verdict that cannot be read follows the open or closed policy.
    """
    called = (F.col("content_ok") >= 1) & ~F.col("is_eval")
    if families:
        called = called & F.col("family").isin(list(families))
    rows = df.join(verdicts.select(key, parse_verdict(F.col("verdict_text")).alias("_v")), key, "left")
    cap = F.when(F.col("think_format_ok") >= 1, 0.2).otherwise(0.0) if keep_think else F.lit(float(fail_cap))
    capped = called & F.coalesce(~F.col("_v"), F.lit(fail_mode == "closed"))
    new = F.when(capped, F.least(F.col("score"), cap)).otherwise(F.col("score"))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return rows.select(
        *[c for c in df.columns if c != "score"], new.alias("score"), flag(called).alias("judge_called"),
        flag(called & F.coalesce(F.col("_v"), F.lit(False))).alias("judge_pass"), flag(called & F.col("_v").isNull()).alias("judge_error"),
        flag(capped).alias("judge_capped"), F.greatest(F.col("score") - new, F.lit(0.0)).alias("judge_penalty"))
