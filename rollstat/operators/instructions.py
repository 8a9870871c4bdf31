"""Instruction checkers, instruction accuracy and the tiered instruction reward."""
from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollstat.functions.columns import BLANKS, any_contains, let, strip, text_or_empty
from rollstat.operators.scoring import find_all

Args = Callable[[str], Column]

# Frequent words that mark a language (an approximation of trained detection).
LANGUAGE_WORDS = {
    "en": ("the", "and", "of", "is", "in", "that", "for", "it", "was", "on", "are", "as", "with", "at", "be"),
    "fr": ("le", "la", "les", "et", "de", "des", "un", "une", "en", "que", "dans", "est", "pour", "du", "on"),
    "de": ("der", "die", "das", "und", "ist", "ein", "eine", "zu", "den", "mit", "von", "nicht", "sich", "in", "es"),
    "es": ("el", "la", "los", "las", "y", "de", "que", "en", "un", "una", "es", "por", "con", "para", "del"),
    "it": ("il", "lo", "gli", "di", "che", "per", "non", "sono", "una", "della", "del", "nel", "con", "anche", "più"),
    "pt": ("o", "os", "as", "não", "uma", "um", "do", "da", "em", "que", "para", "com", "dos", "são", "mais"),
    "pl": ("i", "w", "nie", "na", "się", "że", "jest", "do", "z", "to", "jak", "ale", "dla", "są", "od"),
    "fi": ("ja", "on", "ei", "se", "että", "ovat", "mutta", "kun", "niin", "myös", "tai", "oli", "hän", "joka", "kuin"),
    "vi": ("và", "của", "là", "có", "không", "được", "cho", "trong", "một", "những", "với", "các", "người", "này", "đã"),
    "sw": ("na", "ya", "wa", "ni", "kwa", "katika", "za", "la", "kuwa", "hii", "ambao", "kama", "lakini", "pia", "cha"),
}
# Answers of the constrained-response checker.
CONSTRAINED_ANSWERS = ("My answer is yes.", "My answer is no.", "My answer is maybe.")


def words(text: Column) -> Column:
    return find_all(text, r"(?U)\w+")


# Languages told by their script (a language's letters are more than half of all).
LANGUAGE_SCRIPTS = {
    "ar": r"\p{IsArabic}", "ur": r"\p{IsArabic}", "fa": r"\p{IsArabic}", "hi": r"\p{IsDevanagari}", "ne": r"\p{IsDevanagari}", "mr": r"\p{IsDevanagari}",
    "ru": r"\p{IsCyrillic}", "uk": r"\p{IsCyrillic}", "bg": r"\p{IsCyrillic}", "ja": r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]", "zh": r"\p{IsHan}",
    "ko": r"\p{IsHangul}", "bn": r"\p{IsBengali}", "th": r"\p{IsThai}", "ta": r"\p{IsTamil}", "te": r"\p{IsTelugu}", "he": r"\p{IsHebrew}", "kn": r"\p{IsKannada}",
    "gu": r"\p{IsGujarati}", "pa": r"\p{IsGurmukhi}", "ml": r"\p{IsMalayalam}", "el": r"\p{IsGreek}",
}

# Frequent words of the languages that share a script, and letters that the others of the script don't use.
SHARED_SCRIPTS: dict[str, dict[str, tuple[str, tuple[str, ...]]]] = {
    "Cyrillic": {
        "ru": ("ёыэъ", ("и", "не", "что", "он", "как", "это", "но", "из", "или", "был", "было", "они", "мы", "для", "так")),
        "uk": ("ґєії", ("і", "й", "не", "що", "він", "як", "це", "але", "із", "або", "було", "вони", "ми", "для", "та")),
        "bg": ("", ("и", "не", "че", "той", "като", "това", "но", "от", "или", "са", "беше", "се", "ще", "на", "за", "със", "във", "как", "сме")),
    },
    "Arabic": {
        "ar": ("ةيىأإؤئ", ("في", "من", "على", "إلى", "أن", "هذا", "هذه", "التي", "الذي", "عن", "مع", "كان", "لا", "ما", "ذلك")),
        "fa": ("", ("و", "در", "به", "از", "که", "این", "را", "با", "است", "برای", "آن", "یک", "تا", "می", "بود")),
        "ur": ("ٹڈڑںےہھ", ("کے", "میں", "کی", "ہے", "اور", "سے", "کا", "کو", "اس", "کہ", "نے", "پر", "ہیں", "یہ", "ہو")),
    },
    "Devanagari": {
        "hi": ("", ("के", "में", "की", "है", "और", "से", "का", "को", "इस", "कि", "ने", "पर", "हैं", "यह", "नहीं")),
        "mr": ("ळ", ("आणि", "आहे", "आहेत", "या", "ते", "हे", "तो", "ती", "मध्ये", "नाही", "होते", "होता", "असे", "म्हणून", "पण")),
        "ne": ("", ("छ", "छन्", "र", "यो", "हो", "पनि", "लागि", "थियो", "मा", "ले", "गर्न", "तथा", "यस", "भएको", "गरेको")),
    },
}
#: A letter of its own tells more than a frequent word.
LETTER_WEIGHT = 2
#: Chinese writes next to no kana, Japanese at least one in so many signs.
KANA_ONE_IN = 20


def _signs(text: Column, kinds: str) -> Column:
    """Number of characters of the kinds, which stand as in a character class; what is none goes in whole stretches."""
    return F.length(F.regexp_replace(text, f"[^{kinds}]++", ""))


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}++", ""))


def script_scores(text: Column, languages: Mapping[str, tuple[str, Sequence[str]]]) -> Column:
    """Per language of one script: its frequent words plus ``LETTER_WEIGHT`` times its own letters."""
    low = F.lower(text)
    count = lambda found, marks: F.size(F.filter(found, lambda w: w.isin(*marks)))
    own = {code: LETTER_WEIGHT * _signs(low, letters) if letters else F.lit(0) for code, (letters, _) in languages.items()}
    return let(F.split(low, r"[^a-z\p{L}\p{M}\p{N}_]+"), lambda found: F.struct(*[
        (count(found, marks) + own[code]).alias(code) for code, (_, marks) in languages.items()]))


def not_outscored(text: Column, code: str) -> Column:
    """No other language of the script scores higher; without any sign all languages of the script hold."""
    if code in ("ja", "zh"):
        kana, every = (_signs(text, p) for p in (r"\p{IsHiragana}\p{IsKatakana}", r"\p{IsHiragana}\p{IsKatakana}\p{IsHan}"))
        return KANA_ONE_IN * kana >= every if code == "ja" else KANA_ONE_IN * kana < every
    for languages in SHARED_SCRIPTS.values():
        if code in languages:
            return let(script_scores(text, languages), lambda s: s[code] >= F.greatest(*[s[other] for other in languages]))
    return F.lit(True)


def detect_language(text: Column) -> Column:
    """Language with the most marker words (ties in the order above); null without a letter, ``other`` if most letters aren't Latin."""
    every = sorted({w for marks in LANGUAGE_WORDS.values() for w in marks})

    def count(found: Column, marks: Sequence[str]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(*marks)))

    def best(found: Column) -> Column:
        return F.array_max(F.array(*[F.struct(count(found, marks).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang"))
                                     for i, (lang, marks) in enumerate(LANGUAGE_WORDS.items())]))["lang"]

    marked = F.filter(F.split(F.lower(text), r"[^a-z\p{L}\p{N}_]+"), lambda w: w.isin(*every))
    # what is no Latin letter goes at once; letters are only counted where some stay
    foreign, letters = F.length(F.regexp_replace(text, r"[\p{IsLatin}\P{L}]++", "")), letter_count(text)
    # all letters up to U+024F but the micro sign are Latin; most texts need no closer look
    beyond = F.rlike(text, F.lit(r"[^\x00-\xB4\xB6-\u024F]"))
    known = F.when(beyond & (foreign > 0) & (2 * foreign > letters), "other").otherwise(let(marked, best))
    return F.when(F.rlike(text, F.lit(r"\p{L}")), known)


def in_language(text: Column, language: Column, detected: Column, letters: Column | None = None) -> Column:
    """Whether a text is in a language; true where that can't be told: no letter, or a language without markers and script.

    ``letters`` is the number of letters of the text, where it is known.
    """
    every = letter_count(text) if letters is None else letters
    by_script = F.lit(True)
    for code, script in LANGUAGE_SCRIPTS.items():
        most = 2 * _signs(text, script.strip("[]")) > every
        by_script = F.when(language == code, most & not_outscored(text, code)).otherwise(by_script)
    return F.when(detected.isNull(), True).when(language.isin(*LANGUAGE_WORDS), detected == language).otherwise(by_script)


def sentence_count(text: Column) -> Column:
    """Runs of text that end in . ! ? before a blank or the end, plus a rest without an end mark."""
    return _sentences(strip(text))


def _sentences(bare: Column) -> Column:
    return F.size(F.filter(F.split(bare, r"(?<=[.!?])\s+"), lambda p: p != ""))


def _relation(value: Column, relation: Column, limit: Column) -> Column:
    return F.when(relation == "less than", value < limit).otherwise(value >= limit)


def _filled(text: Column) -> Column:
    """Not only blanks; looks no further than the first other character."""
    return F.ltrim(text, F.lit(BLANKS)) != ""


def _not_blank(items: Column) -> Column:
    return F.filter(items, _filled)


def _inner_blank(items: Column) -> Column:
    """A blank part that is neither the first nor the last."""
    inner = F.slice(items, 2, F.greatest(F.size(items) - 2, F.lit(0)))
    return F.exists(inner, lambda p: ~_filled(p))


def _strings(arg: Column) -> Column:
    return F.from_json(arg, "array<string>")


@dataclass(frozen=True)
class Shared:
    """What several checks need of one text: its language, matches, letters, and it without blanks on both ends."""

    language: Column
    hits: Column
    letters: Column
    bare: Column

    @property
    def english(self) -> Column:
        return self.language.isNull() | (self.language == "en")


def _paragraphs(text: Column, a: Args) -> Column:
    parts, wanted = F.split(text, r"\s?\*\*\*\s?"), a("num_paragraphs").cast("int")
    whole = F.when(_filled(text), 1).otherwise(0) == wanted
    return F.when(F.contains(text, F.lit("***")), ~_inner_blank(parts) & (F.size(_not_blank(parts)) == wanted)).otherwise(whole)


def _highlights(text: Column, a: Args) -> Column:
    single = F.filter(find_all(text, r"\*[^\n\*]*\*"), lambda h: strip(F.btrim(h, F.lit("*"))) != "")
    double = F.filter(find_all(text, r"\*\*[^\n\*]*\*\*"), lambda h: strip(F.regexp_replace(h, r"^\*\*|\*\*$", "")) != "")
    return F.size(single) + F.size(double) >= a("num_highlights").cast("int")


def _first_word(text: Column, a: Args) -> Column:
    parts = F.split(text, "\n\n")
    n, nth = F.size(_not_blank(parts)), a("nth_paragraph").cast("int")
    para = strip(F.get(parts, nth - 1))
    word = F.regexp_replace(F.regexp_extract(para, r"(?U)^(\S+)", 1), r"^'*\"*", "")
    first = F.lower(F.regexp_extract(word, r"^([^.,?!'\"]*)", 1))
    return F.coalesce((nth <= n) & (para != "") & (n == a("num_paragraphs").cast("int")) & (first == F.lower(a("first_word"))), F.lit(False))


def _json_format(bare: Column) -> Column:
    inner = strip(F.regexp_replace(F.regexp_replace(bare, r"^(?:```json|```Json|```JSON|```)", ""), r"```$", ""))
    return F.try_parse_json(F.when(F.contains(bare, F.lit("```")), inner).otherwise(bare)).isNotNull()


def _two_responses(text: Column) -> Column:
    parts = F.split(text, r"\*\*\*\*\*\*")
    real = F.transform(_not_blank(parts), strip)
    return F.contains(text, F.lit("******")) & ~_inner_blank(parts) & (F.size(real) == 2) & (F.get(real, 0) != F.get(real, 1))


def _letter(text: Column, a: Args) -> Column:
    low, letter = F.lower(text), F.lower(a("letter"))
    return _relation(F.length(low) - F.length(F.replace(low, letter, F.lit(""))), a("let_relation"), a("let_frequency").cast("int"))


def _capital_words(text: Column, a: Args) -> Column:
    capital = F.filter(words(text), lambda w: (F.upper(w) == w) & (F.lower(w) != w))
    return _relation(F.size(capital), a("capital_relation"), a("capital_frequency").cast("int"))


CHECKS: dict[str, Callable[[Column, Args, Column, Shared], Column]] = {
    "language:response_language": lambda t, a, p, s: in_language(t, a("language"), s.language, s.letters),
    "length_constraints:number_sentences": lambda t, a, p, s: _relation(_sentences(s.bare), a("relation"), a("num_sentences").cast("int")),
    "detectable_content:number_placeholders": lambda t, a, p, s: F.regexp_count(t, F.lit(r"\[.*?\]")) >= a("num_placeholders").cast("int"),
    "detectable_format:number_bullet_lists": lambda t, a, p, s: (
        F.when(F.contains(t, F.lit("*")), F.regexp_count(t, F.lit(r"(?m)^\s*\*[^\*].*$"))).otherwise(0)
        + F.when(F.contains(t, F.lit("-")), F.regexp_count(t, F.lit(r"(?m)^\s*-.*$"))).otherwise(0) == a("num_bullets").cast("int")),
    "detectable_format:constrained_response": lambda t, a, p, s: any_contains(t, CONSTRAINED_ANSWERS),
    "detectable_format:number_highlighted_sections": lambda t, a, p, s: _highlights(t, a),
    "detectable_format:multiple_sections": lambda t, a, p, s: s.hits[0] >= a("num_sections").cast("int"),
    "length_constraints:number_paragraphs": lambda t, a, p, s: _paragraphs(t, a),
    "detectable_content:postscript": lambda t, a, p, s: s.hits[0] > 0,
    "keywords:existence": lambda t, a, p, s: F.forall(s.hits, lambda n: n > 0),
    "keywords:frequency": lambda t, a, p, s: _relation(s.hits[0], a("relation"), a("frequency").cast("int")),
    "length_constraints:number_words": lambda t, a, p, s: _relation(F.regexp_count(t, F.lit(r"(?U)\w+")), a("relation"), a("num_words").cast("int")),
    "detectable_format:json_format": lambda t, a, p, s: _json_format(s.bare),
    "length_constraints:nth_paragraph_first_word": lambda t, a, p, s: _first_word(t, a),
    "keywords:forbidden_words": lambda t, a, p, s: F.forall(s.hits, lambda n: n == 0),
    "combination:two_responses": lambda t, a, p, s: _two_responses(t),
    "combination:repeat_prompt": lambda t, a, p, s: F.startswith(F.lower(s.bare), F.lower(strip(F.coalesce(a("prompt_to_repeat"), p)))),
    "startend:end_checker": lambda t, a, p, s: F.endswith(
        F.lower(F.when(F.startswith(s.bare, F.lit('"')) | F.endswith(s.bare, F.lit('"')), F.btrim(s.bare, F.lit('"'))).otherwise(s.bare)),
        F.lower(strip(a("end_phrase")))),
    "detectable_format:title": lambda t, a, p, s: F.exists(
        find_all(t, r"<<[^\n]+>>"), lambda x: strip(F.regexp_replace(x, "^<+|>+$", "")) != ""),
    "keywords:letter_frequency": lambda t, a, p, s: _letter(t, a),
    "change_case:english_capital": lambda t, a, p, s: ~F.rlike(t, F.lit("[a-z]")) & (F.upper(t) == t) & (F.lower(t) != t) & s.english,
    "change_case:english_lowercase": lambda t, a, p, s: ~F.rlike(t, F.lit("[A-Z]")) & (F.lower(t) == t) & (F.upper(t) != t) & s.english,
    "punctuation:no_comma": lambda t, a, p, s: ~F.contains(t, F.lit(",")),
    "change_case:capital_word_frequency": lambda t, a, p, s: _capital_words(t, a),
    "startend:quotation": lambda t, a, p, s: F.startswith(s.bare, F.lit('"')) & F.endswith(s.bare, F.lit('"')) & (F.length(s.bare) > 1),
}


# ---- patterns that users write -----------------------------------------------------
# The words, separators and markers of a checker are used as patterns. Plain ones stay on the
# JVM; those with pattern signs may be unreadable, and are tried one by one: an unreadable one
# is a failed check and a checker error, never a failed job.

#: A pattern whose repeats nest may try for ever; after so long it is a checker error.
PATTERN_SECONDS = 10.0
_SIGNS = r"[\\^$.|?*+()\[\]{}]"


def _patterns(instruction: Column, a: Args) -> Column:
    """(text of the user, before, after, flags) of the patterns of one instruction; null for instructions without."""
    one = lambda user, before="", after="", flags="": F.transform(user, lambda u: F.struct(
        u.alias("user"), F.lit(before).alias("before"), F.lit(after).alias("after"), F.lit(flags).alias("flags")))
    mark = a("postscript_marker")
    fixed = lambda pattern: F.array(F.struct(F.lit("").alias("user"), F.lit(pattern).alias("before"), F.lit("").alias("after"), F.lit("m").alias("flags")))
    return (
        F.when(instruction == "keywords:existence", one(_strings(a("keywords")), flags="i"))
        .when(instruction == "keywords:frequency", one(F.array(a("keyword")), flags="i"))
        .when(instruction == "keywords:forbidden_words", one(_strings(a("forbidden_words")), r"\b", r"\b", "i"))
        .when(instruction == "detectable_format:multiple_sections", one(F.array(a("section_spliter")), r"\s?", r"\s?\d+\s?"))
        .when(instruction == "detectable_content:postscript", F.when(mark == "P.P.S", fixed(r"\s*p\.\s?p\.\s?s.*$")).when(
            mark == "P.S.", fixed(r"\s*p\.\s?s\..*$")).otherwise(one(F.array(F.lower(mark)), r"\s*", ".*$", "m"))))


def _plain_hits(text: Column, patterns: Column) -> Column:
    flags = lambda p: F.when(p["flags"] == "i", "(?iU)").when(p["flags"] == "m", "(?m)").otherwise("")
    return F.transform(patterns, lambda p: F.regexp_count(text, F.concat(flags(p), p["before"], p["user"], p["after"])))


def _tried_hits(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    """Number of matches of each pattern of each instruction, -1 for an unreadable or endless one; rows without a text have none.

    ``patterns`` has a JSON list per instruction, or null.
    """
    known: dict[tuple, regex.Pattern | None] = {}

    def read(pattern: str, flags: str) -> regex.Pattern | None:
        if (pattern, flags) not in known:
            try:
                known[pattern, flags] = regex.compile(pattern, {"i": regex.IGNORECASE, "m": regex.MULTILINE}.get(flags, 0))
            except (regex.error, OverflowError, RecursionError):
                known[pattern, flags] = None
        return known[pattern, flags]

    def count(text: str, p) -> int:
        pattern = None if p.get("user") is None else read(p["before"] + p["user"] + p["after"], p["flags"])
        try:
            return -1 if pattern is None else sum(1 for _ in pattern.finditer(text.lower() if p["flags"] == "m" else text, timeout=PATTERN_SECONDS))
        except TimeoutError:
            return -1

    def every(text: str | None, items) -> list | None:
        return None if text is None else [None if ps is None else [count(text, p) for p in json.loads(ps)] for ps in items]

    return pd.Series([every(t, ps) for t, ps in zip(texts, patterns, strict=True)], dtype=object)


def _tried_variants(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    """``_tried_hits`` of every text of a row."""
    pairs = [(text, items) for variants, items in zip(texts, patterns, strict=True) if variants is not None for text in variants]
    hits = iter(_tried_hits(pd.Series([t for t, _ in pairs], dtype=object), pd.Series([items for _, items in pairs], dtype=object)))
    return pd.Series([None if variants is None else [next(hits) for _ in variants] for variants in texts], dtype=object)


def check_instruction(text: Column, instruction: Column, kwargs: Column, prompt: Column, shared: Shared, only: Sequence[str] | None = None) -> Column:
    """Verdict of one instruction on one text; null for an id without a checker or arguments that don't fit."""
    arg: Args = lambda name: F.get_json_object(kwargs, f"$.{name}")
    out = F.lit(None).cast("boolean")
    for name in only or CHECKS:
        out = F.when(instruction == name, CHECKS[name](text, arg, prompt, shared)).otherwise(out)
    return out


def strip_think(text: Column) -> Column:
    return strip(F.regexp_replace(text_or_empty(text), r"(?is)<think>.*?</think>", ""))


def loose_variants(text: Column) -> Column:
    """The response and its versions without both ends' lines, the first line, the last line, and without asterisks."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    part = lambda start, drop: strip(F.array_join(F.slice(lines, start, F.greatest(n - drop, F.lit(0))), "\n"))
    base = F.array(text, part(2, 2), part(2, 1), part(1, 1))
    return F.concat(base, F.transform(base, lambda x: F.replace(x, F.lit("*"), F.lit(""))))


def check_instructions(
    df: DataFrame, key: str, response: str, prompt: str, instructions: str, *, loose: bool = True, only: Sequence[str] | None = None,
) -> DataFrame:
    """One row per (key, ordinal) with the strict and loose verdicts and ``error``.

    ``instructions`` is an array of struct(id, kwargs JSON); ``key`` tells the rows apart.  Each
    row is judged on its own response (the strict check fails an empty one).  What several checks
    need of a response is computed once, each check looks at its own instruction only, and where the
    response failed every looser variant goes through the check, until one passes.  ``error`` marks checks that could
    not be made: an unknown id, arguments that don't fit, an unreadable pattern; they count as failed.
    ``only`` names the ids that occur, to keep the expression short.
    """
    names = list(only or CHECKS)
    rows = df.select(key, F.col(prompt).alias("_p"), F.col(instructions).alias("_is"), strip_think(F.col(response)).alias("_t"))
    patterned = any(n.startswith("keywords:") or n in ("detectable_format:multiple_sections", "detectable_content:postscript") for n in names)
    needs_language = any(n.startswith(("language:", "change_case:english")) for n in names)
    by_script = "language:response_language" in names
    language = detect_language if needs_language else lambda t: F.lit(None).cast("string")
    rows = rows.withColumns({"_lang": language(F.col("_t")), "_letters": letter_count(F.col("_t")) if by_script else F.lit(None).cast("int")})
    if loose:
        rows = rows.withColumn("_texts", F.array_distinct(F.concat(F.array("_t"), loose_variants(F.col("_t")))))
    texts = F.col("_texts") if loose else F.array("_t")
    if patterned:
        of = lambda i: _patterns(i["id"], lambda name: F.get_json_object(i["kwargs"], f"$.{name}"))
        odd = lambda ps: F.exists(ps, lambda p: F.coalesce(F.rlike(p["user"], F.lit(_SIGNS)), F.lit(True)))
        rows = rows.withColumn("_pats", F.transform("_is", of))
        rows = rows.withColumn("_odd", F.transform("_pats", lambda ps: F.when(odd(ps), F.to_json(ps))))
        rows = rows.withColumn("_any", F.exists("_odd", lambda ps: ps.isNotNull()))
        tried = F.pandas_udf(_tried_variants, "array<array<array<int>>>")(F.when(F.col("_any"), texts), F.when(F.col("_any"), F.col("_odd")))
        rows = rows.withColumn("_tried", tried)
    # the lists go along item by item, not whole
    lists = F.arrays_zip(F.col("_is").alias("i"), *[F.col(c).alias(c[1:]) for c in (("_pats", "_odd") if patterned else ())])
    if loose:
        more = F.transform(F.col("_texts"), lambda t, n: F.struct(t.alias("t"), strip(t).alias("bare"), n.alias("n")))
        rows = rows.withColumn("_more", F.slice(more, 2, F.size("_texts")))
    rows = rows.select(key, "_p", "_t", "_lang", "_letters", *(["_more"] if loose else []), *(["_tried"] if patterned else []),
                       F.posexplode(lists).alias("ordinal", "_z")).withColumns({"instruction_id": F.col("_z.i.id"), "_k": F.col("_z.i.kwargs")})

    def found(text: Column, n: Column) -> Column:
        if not patterned:
            return F.lit(None).cast("array<int>")
        seen = F.when(F.col("instruction_id") == "detectable_content:postscript", F.lower(text)).otherwise(text)
        return F.when(F.col("_z.odd").isNotNull(), F.get(F.get(F.col("_tried"), n), F.col("ordinal"))).otherwise(_plain_hits(seen, F.col("_z.pats")))

    def judged(text: Column, shared: Shared) -> Column:
        unreadable = F.coalesce(F.exists(shared.hits, lambda n: n < 0), F.lit(False))
        verdict = check_instruction(text, F.col("instruction_id"), F.col("_k"), F.col("_p"), shared, names)
        return F.when(unreadable, F.lit(None)).otherwise(verdict)

    passed = lambda text, ok: F.coalesce(_filled(text) & ok, F.lit(False))
    rows = rows.withColumn("_hits", found(F.col("_t"), F.lit(0)))
    # the response itself has no blanks on its ends
    rows = rows.withColumn("_ok", judged(F.col("_t"), Shared(F.col("_lang"), F.col("_hits"), F.col("_letters"), F.col("_t"))))
    rows = rows.withColumns({"strict": passed(F.col("_t"), F.col("_ok")), "error": F.col("_ok").isNull()})
    if not loose:
        return rows.select(key, "ordinal", "instruction_id", "strict", "error")

    def passes(v: Column) -> Column:
        return let(found(v["t"], v["n"]), lambda hits: passed(v["t"], judged(v["t"], Shared(language(v["t"]), hits, letter_count(v["t"]), v["bare"]))))

    rows = rows.withColumn("loose", F.when(F.col("strict"), True).otherwise(F.exists("_more", passes)))
    return rows.groupBy(key, "ordinal", "instruction_id").agg(F.max("strict").alias("strict"), F.max("loose").alias("loose"), F.max("error").alias("error"))


def reward_inputs(checked: DataFrame, key: str) -> DataFrame:
    """Per key: ``ids`` and ``checks`` in order, and ``errors``, the number of checks that could not be made."""
    items = F.array_sort(F.collect_list(F.struct("ordinal", "instruction_id", "strict")))
    by = checked.groupBy(key).agg(items.alias("_i"), F.count_if("error").cast("int").alias("errors"))
    return by.select(key, F.col("_i.instruction_id").alias("ids"), F.col("_i.strict").alias("checks"), "errors")


# Data sets and evaluators whose rows are judged as in their evaluation.
OFFICIAL_EVALUATORS = ("ifeval", "ifbench")
OFFICIAL_DATASETS = ("ifeval", "ifbench_test", "ifbench_mt_ifbench")


def official_eval(eval_prompt: Column, evaluator: Column, metadata: Column, dataset: Column) -> Column:
    """Rows that are judged by the evaluation's own rule: by their prompt, evaluator, or metadata and data set."""
    low = lambda c: F.lower(strip(text_or_empty(c)))
    return (text_or_empty(eval_prompt) != "") | low(evaluator).isin(*OFFICIAL_EVALUATORS) | (
        (text_or_empty(metadata) != "") & low(dataset).isin(*OFFICIAL_DATASETS))


def official_scores(checked: DataFrame, key: str) -> DataFrame:
    """Per key the official evaluation: score 1 if every strict check passes, and the strict and loose shares."""
    by = checked.groupBy(key).agg(F.min("strict").alias("s"), F.min("loose").alias("l"), F.count(F.lit(1)).cast("int").alias("num_constraints"),
                                  F.count_if("strict").alias("ns"), F.count_if("loose").alias("nl"))
    flag, n = lambda c: F.when(F.col(c), 1.0).otherwise(0.0), F.col("num_constraints")
    return by.select(
        key, flag("s").alias("score"), (F.col("ns") / n).alias("base_score"), flag("s").alias("official_eval_strict_prompt"),
        flag("l").alias("official_eval_loose_prompt"), (F.col("ns") / n).alias("official_eval_strict_instruction"),
        (F.col("nl") / n).alias("official_eval_loose_instruction"), "num_constraints", (n - F.col("ns")).cast("int").alias("num_failed_constraints"))


def instruction_reward(
    df: DataFrame, key: str, response: str, prompt: str, instructions: str, *, family: str, official: Column | None = None,
    mode: str = "tiered_think_format", options: Mapping[str, object] | None = None, only: Sequence[str] | None = None,
) -> DataFrame:
    """(key, score, base_score, num_constraints, num_failed_constraints, num_checker_errors, scoring_mode) of every row.

    Rows where ``official`` holds, or all with mode ``official_eval``, are judged by the official rule on the response
    without its thinking part; the others by the tiered reward on the answer behind an exact think prefix.
    """
    all_official = mode in ("official_eval", "eval_official", "standalone_eval")
    rule = F.lit(True) if all_official else F.coalesce(official, F.lit(False)) if official is not None else F.lit(False)
    rows = df.withColumn("_official", rule)
    columns = ["score", "base_score", "num_constraints", "num_failed_constraints", "num_checker_errors", "scoring_mode"]
    judged = check_instructions(rows.filter("_official"), key, response, prompt, instructions, only=only)
    errors = reward_inputs(judged, key).select(key, F.col("errors").alias("num_checker_errors"))
    name = "official_eval" if all_official else "official_eval_auto"
    out = official_scores(judged, key).join(errors, key).withColumn("scoring_mode", F.lit(name)).select(key, *columns)
    rest = rows.filter("not _official").drop("_official").withColumn("_answer", answer_text(F.col(response)))
    inputs = reward_inputs(check_instructions(rest, key, "_answer", prompt, instructions, loose=False, only=only), key)
    joined = rest.drop("_answer").join(inputs.select(key, F.col("ids").alias("_ids"), F.col("checks").alias("_checks"), F.col("errors").alias("_errors")), key)
    tiered = tiered_instruction_reward(joined, response, checks="_checks", errors="_errors", ids="_ids", family=family, prompt=prompt, options=options)
    return out.unionByName(tiered.select(key, *columns))


def instruction_accuracy(checked: DataFrame, key: str) -> DataFrame:
    """Instruction accuracy in total, per family and per id, strict and loose."""
    rows = checked.withColumn("family", F.split_part("instruction_id", F.lit(":"), F.lit(1)))
    share = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    return rows.groupingSets([[], ["family"], ["family", "instruction_id"]], "family", "instruction_id").agg(
        F.count(F.lit(1)).alias("n"), share("strict").alias("strict"), share("loose").alias("loose"))


def prompt_accuracy(checked: DataFrame, key: str) -> DataFrame:
    """Share of prompts with every instruction followed, and of instructions followed."""
    by = checked.groupBy(key).agg(F.min("strict").alias("s"), F.min("loose").alias("l"), F.count(F.lit(1)).alias("n"),
                                  F.count_if("strict").alias("ns"), F.count_if("loose").alias("nl"))
    share = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    return by.agg(F.count(F.lit(1)).alias("prompt_total"), F.count_if("s").alias("prompt_correct"), F.sum("n").alias("instruction_total"),
                  F.sum("ns").alias("instruction_correct"), share("s").alias("strict_prompt"), share("l").alias("loose_prompt"),
                  (F.sum("ns") / F.sum("n")).alias("strict_instruction"), (F.sum("nl") / F.sum("n")).alias("loose_instruction"))


# ---- tiered reward ----------------------------------------------------------------

EXACT_THINK = "<think>\n</think>"
GUARDED = ("other", "keywords", "language", "count_or_pattern", "lexical_constraints")
LENGTH_EXEMPT = ("length_constraints", "detectable_format")
# Wordings of a task whose right answer is short.
SHORT_ANSWER_MARKERS = (
    "answer with one word", "respond with one word", "in one word", "one-word", "single word", "answer with a single",
    "respond with a single", "yes or no", "true or false", "multiple choice", "choose one", "select one", "pick one",
    "only the letter", "letter only", "answer only with", "respond only with",
)
# Replies that say nothing.
EMPTY_REPLIES = ("?", "!", "ok", "yes", "no", "maybe", "n/a", "null", "none")
BANDS = ((120, 0.45), (200, 0.30), (400, 0.15))
WEAK_BANDS = ((120, 0.20), (200, 0.10), (400, 0.0))


def exact_think(text: Column) -> Column:
    return F.startswith(F.regexp_replace(text_or_empty(text), r"(?U)^\s+", ""), F.lit(EXACT_THINK))


def answer_text(text: Column) -> Column:
    left = F.regexp_replace(text_or_empty(text), r"(?U)^\s+", "")
    rest = F.regexp_replace(F.substring(left, F.lit(len(EXACT_THINK) + 1), F.length(left)), r"^[\r\n]+", "")
    once = strip(F.regexp_replace(left, r"(?is)\A(.*?)<think>.*?</think>", "$1"))
    return F.when(F.startswith(left, F.lit(EXACT_THINK)), rest).otherwise(once)


def digit_sequence(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?U)^[\d\s,.;:/+\-_]+$")) & F.rlike(text, F.lit(r"(?U)\d"))


def single_token(text: Column) -> Column:
    s = strip(text)
    return (s != "") & (F.length(s) <= 50) & ~F.rlike(s, F.lit(r"(?U)\s")) & ~F.contains(s, F.lit("<<"))


def says_nothing(text: Column) -> Column:
    s = strip(text)
    low = F.lower(s)
    return ((s == "") | digit_sequence(s) | F.rlike(s, F.lit(r"(?U)^[\"'`“”‘’\s]+$")) | low.isin(*EMPTY_REPLIES)
            | (F.contains(low, F.lit("anything else i can help with")) & (F.length(s) <= 64)))


def _tiers(content: Column, think: Column) -> Column:
    return F.when(content & think, 1.0).when(content, 0.8).when(think, 0.2).otherwise(0.0)


def _has_prefix(ids: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.exists(ids, lambda i: F.startswith(i, F.lit(p)))
    return out


def tiered_instruction_reward(
    df: DataFrame, response: str, *, checks: str, errors: str, ids: str, family: str, prompt: str, options: Mapping[str, object] | None = None,
) -> DataFrame:
    """Tiered score with the short-answer penalties and semantic guards.

    ``checks`` is an array of booleans aligned with ``ids``; ``errors`` counts checker errors
    (an errored check is false). ``options`` switches penalties on and sets their limits.
    """
    o = dict(options or {})
    on = lambda name: bool(o.get(name, False))
    rows = df.withColumn("answer_text", answer_text(F.col(response))).withColumn("think", exact_think(F.col(response)))
    # the tests on the text are columns of their own: each is evaluated once
    rows = rows.withColumn("_x", strip("answer_text"))
    rows = rows.withColumn("_n", F.length("_x")).withColumn("_digits", digit_sequence(F.col("_x"))).withColumn(
        "_one", single_token(F.col("_x"))).withColumn("_nothing", says_nothing(F.col("_x")))
    passed = F.size(F.filter(checks, lambda c: c))
    rows = rows.withColumn("n_checks", F.size(checks)).withColumn("n_failed", F.size(checks) - passed)
    rows = rows.withColumn("base_score", F.when(F.col("n_checks") > 0, passed / F.col("n_checks")).otherwise(0.0))
    content = F.col("n_failed") == 0
    tier = _tiers(content, F.col("think"))
    rows = rows.withColumn("tiered_score", tier).withColumn(
        "score", F.col("base_score") if o.get("mode") == "legacy" else F.col("tiered_score"))
    fam, txt, n = F.col(family), F.col("_x"), F.col("_n")
    zero = F.lit(0.0)

    # short answers with full score
    tiny = F.when(n < o.get("tiny_len", 8), float(o.get("tiny_penalty", 0.5))).when(n < o.get("min_len", 16), float(o.get("small_penalty", 0.25))).otherwise(0.0)
    exempt = fam.isin(*o.get("short_exempt", LENGTH_EXEMPT))
    short = F.when((F.col("score") == 1) & ~exempt, tiny).otherwise(0.0) if on("short_penalty") else zero
    rows = rows.withColumn("short_penalty", short).withColumn("score", F.greatest(F.col("score") - F.col("short_penalty"), zero))

    # length bands of rule-passing answers
    short_task = any_contains(F.lower(prompt), SHORT_ANSWER_MARKERS) | F.exists(ids, lambda i: F.rlike(F.lower(i), F.lit("option|multiple_choice")))
    weak = fam.isin(*(o.get("weak_families") or ("",))) | _has_prefix(F.col(ids), o.get("weak_prefixes", ()))
    def banded(bands, pick):
        out = None
        for limit, penalty in bands:
            value = F.lit(float(penalty)) if pick == "penalty" else F.lit(f"lt_{limit}")
            out = F.when(n < limit, value) if out is None else out.when(n < limit, value)
        return out.otherwise(0.0 if pick == "penalty" else "")
    active = (F.col("base_score") == 1) & ~fam.isin(*o.get("band_exempt", LENGTH_EXEMPT)) & ~short_task & ~_has_prefix(F.col(ids), o.get("band_exempt_prefixes", ()))
    if on("band_penalty"):
        strong_bands, weak_bands = o.get("bands", BANDS), o.get("weak_bands", WEAK_BANDS)
        size = F.when(weak, banded(weak_bands, "penalty")).otherwise(banded(strong_bands, "penalty"))
        bucket = F.when(weak, banded(weak_bands, "bucket")).otherwise(banded(strong_bands, "bucket"))
        rows = rows.withColumn("band_bucket", F.when(active, bucket).otherwise("")).withColumn(
            "band_mode", F.when(F.col("band_bucket") == "", "").when(weak, "weak").otherwise("standard")).withColumn(
            "band_penalty", F.when(active, F.least(size, F.col("score"))).otherwise(0.0))
        rows = rows.withColumn("score", F.col("score") - F.col("band_penalty"))
    else:
        rows = rows.withColumn("band_bucket", F.lit("")).withColumn("band_mode", F.lit("")).withColumn("band_penalty", zero)

    # passive guard
    guarded = fam.isin(*o.get("guard_families", GUARDED))
    hollow = (n <= o.get("guard_max_len", 50)) & (F.col("_one") | F.col("_nothing"))
    guard = F.when((F.col("score") == 1) & guarded & hollow, float(o.get("guard_penalty", 0.5))).otherwise(0.0) if on("guard") else zero
    rows = rows.withColumn("guard_penalty", guard).withColumn("score", F.greatest(F.col("score") - F.col("guard_penalty"), zero))

    # active guard with a reason
    heavy = fam.isin("count_or_pattern", "lexical_constraints") | _has_prefix(F.col(ids), ("count:", "words:", "ratio:"))
    limit = o.get("active_max_len", 50)
    fits = n <= limit
    reason = (F.when(fits & F.col("_digits"), "digit_only").when(fits & F.col("_nothing"), "semantically_empty")
              .when(fits & (n <= o.get("active_tiny_len", 20)) & F.rlike(txt, F.lit("^[A-Za-z0-9]$")), "trivial_tiny_output")
              .when(fits & F.col("_one"), "single_tokenish")
              .when((n <= o.get("active_constraint_max_len", limit)) & heavy, "constraint_only_short_answer").otherwise(""))
    watch = (F.col("base_score") == 1) & fam.isin(*o.get("active_families", GUARDED)) & ~fam.isin(*o.get("active_exempt", LENGTH_EXEMPT))
    rows = rows.withColumn("active_reason", F.when(watch, reason).otherwise("") if on("active_guard") else F.lit(""))
    why = F.col("active_reason")
    caps, softs = o.get("cap_reasons"), tuple(o.get("soft_reasons", ()))
    if caps is None and softs:
        caps = ("digit_only", "single_tokenish", "semantically_empty", "trivial_tiny_output")
    is_cap = (why != "") if caps is None else why.isin(*caps)
    cap = F.lit(float(o.get("active_cap", 0.5)))
    for name, value in dict(o.get("cap_by_reason", {})).items():
        cap = F.when(why == name, float(value)).otherwise(cap)
    soft = float(o.get("soft_penalty", 0.1))
    is_soft = why.isin(*softs) & F.lit(soft > 0) if softs else F.lit(False)
    new = F.when((why != "") & is_cap, F.least(F.col("score"), F.greatest(cap, zero))).when(
        (why != "") & is_soft, F.greatest(F.col("score") - soft, zero)).otherwise(F.col("score"))
    rows = rows.withColumn("active_action", F.when(why == "", "").when(is_cap, "cap").when(is_soft, "soft").otherwise("observe"))
    rows = rows.withColumn("active_penalty", F.col("score") - new).withColumn("score", F.col("score") - F.col("active_penalty"))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    failed = F.array_join(F.transform(F.filter(F.arrays_zip(F.col(ids).alias("i"), F.col(checks).alias("c")), lambda z: ~z["c"]), lambda z: z["i"]), ",")
    return rows.select(
        *df.columns, "score", "base_score", F.col("base_score").alias("constraint_ratio"), "tiered_score", flag(F.col("think")).alias("think_format_ok"),
        flag(content).alias("content_ok"), F.lit(o.get("mode", "tiered_think_format")).alias("scoring_mode"), F.col("n_checks").alias("num_constraints"),
        F.col("n_failed").alias("num_failed_constraints"), F.col(errors).alias("num_checker_errors"), flag(content).alias("all_constraints_passed"),
        "answer_text", failed.alias("failed_constraints_text"), n.alias("response_char_len"), flag(F.col("_one")).alias("is_single_tokenish"),
        flag(F.col("_nothing")).alias("looks_semantically_empty"), F.col("short_penalty").alias("short_fullscore_penalty"),
        F.col("band_penalty").alias("short_fullscore_band_penalty"), F.col("band_bucket").alias("short_fullscore_band_bucket"),
        F.col("band_mode").alias("short_fullscore_band_mode"), (F.col("short_penalty") + F.col("band_penalty")).alias("short_fullscore_total_penalty"),
        F.col("guard_penalty").alias("semantic_guard_penalty"), F.col("active_penalty").alias("semantic_guard_active_penalty"),
        F.when(F.col("active_action") == "cap", F.col("active_penalty")).otherwise(0.0).alias("semantic_guard_active_cap_penalty"),
        F.when(F.col("active_action") == "soft", F.col("active_penalty")).otherwise(0.0).alias("semantic_guard_active_soft_penalty"),
        flag(why != "").alias("semantic_guard_active_triggered"), F.col("active_reason").alias("semantic_guard_active_reason"),
        F.col("active_action").alias("semantic_guard_active_action"), flag(guarded).alias("semantic_guard_family_enabled"))
