"""Spelling variants: words one edit apart, by permuterm rotations.

A word w is marked with a terminator and rotated.  For every place i the rotation that starts
behind code point i is ``w[i+1:] $ w[:i]`` and then w[i]: all but its last code point is the key
of w with that code point skipped.  The whole rotations ``w[i:] $ w[:i]`` are keys too.  So the
words below one key are the key's own word and the words that put one more code point at its
end; the first is one deletion away from the others, these are one replacement from each
other.  The rotations of a key are a prefix range of all sorted rotations, and grouping by the key
collects that range.

The place that a replacement skips is the only one, so such a pair meets once.  A doubled
code point can be deleted at several places; only the first of equal neighbours counts, so a
deletion meets once as well.  Each group therefore adds up exactly, and no pair is written: a
member leaves with the number of its neighbours there and the best of them.

Below one key there are at most as many words as the alphabet has code points, and one, so a
group is bounded by the alphabet whatever the number of words.

Defined cases: words hold no U+0000, the terminator; a null or empty text has no words; copies of a document count each time; a null
id reads as empty in ``count_words``; null words or counts are left out; ties go to the smallest
word in code-point order; an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollstat.llm.common import bounded_batches
from rollstat.session import materialize

#: Distinct words that a task holds before it hands on their counts.
HELD = 200_000
#: A form has at least ``ratio`` >= 2 times the count, so 64 steps pass every long.
DOUBLINGS = 6
TERMINATOR = "\x00"

# UTF-8: U+00C0 to U+00FF are the byte C3 and one more; no other code point starts with C3.
_LETTERS = bytes(range(97, 123)) + b"\xc3" + bytes(range(0x80, 0xC0))
_OTHERS = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c in _LETTERS else 32 for c in range(256))


def latin_runs(text: str) -> list[bytes]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case, as UTF-8."""
    return _OTHERS.sub(b" ", text.encode("utf-8", "surrogatepass")).translate(_TO_WORDS).split()


def without_point(word: bytes, at: int) -> bytes:
    points = word.decode()
    at %= len(points)
    return (points[:at] + points[at + 1:]).encode()


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = 5, slip: int = 97) -> DataFrame:
    """(word, n) over whole texts, for words of at least ``shortest`` code points.

    Where ``slip`` divides the crc32 h of ``<id>:<run>``, code point h modulo the length is missing
    (0: never).  Tasks count first, so a frequent word sends one row a task.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()

        def hand_on() -> pd.DataFrame:
            words = [(w.decode(), n) for w, n in held.items()]
            return pd.DataFrame([(w, n) for w, n in words if len(w) >= shortest], columns=["word", "n"])

        for batch in batches:
            for key, text in zip(batch["id"], batch["text"], strict=True):
                if text is None:
                    continue
                start = zlib.crc32(f"{key or ''}:".encode())
                for run, n in Counter(latin_runs(text)).items():
                    if slip:
                        h = zlib.crc32(run, start)
                        if h % slip == 0:
                            run = without_point(run, h)
                    held[run] += n
            if len(held) >= HELD:
                yield hand_on()
                held.clear()
        if held:
            yield hand_on()

    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _rotations(words: DataFrame) -> DataFrame:
    """(key, word, n, kind): kind 0 the key's own word, 1 one more code point, 2 the same behind an equal one."""
    word, i = F.col("word"), F.col("i")
    marked = lambda behind, before: F.concat(F.substring(word, behind, F.length(word)), F.lit(TERMINATOR), F.substring(word, F.lit(1), before))
    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    own = F.struct(marked(i + 1, i).alias("key"), F.lit(0).cast("byte").alias("kind"))
    twin = (i > 0) & (F.substring(word, i + 1, F.lit(1)) == F.substring(word, i, F.lit(1)))
    skipped = F.struct(marked(i + 2, i).alias("key"), F.when(twin, 2).otherwise(1).cast("byte").alias("kind"))
    # behind the last code point there is none to skip
    both = F.when(i < F.length(word), F.array(own, skipped)).otherwise(F.array(own))
    return places.select("word", "n", F.explode(both).alias("r")).select("r.key", "word", "n", "r.kind")


def nearest(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n) for distinct ``words`` (word, n): near words are one edit away."""
    members = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("fewer"), "word", "kind")))
    groups = _rotations(words).groupBy("key").agg(members.alias("all")).filter(F.size("all") > 1)
    # each list comes in three: every one that adds a code point, those of them that count as deletions, the own word
    groups = groups.select(
        F.filter("all", lambda m: m["kind"] > 0).alias("adds"), F.filter("all", lambda m: m["kind"] == 1).alias("deletions"),
        F.filter("all", lambda m: m["kind"] == 0).alias("own"))
    better = lambda lists: F.try_element_at(F.array_sort(F.concat(*lists)), F.lit(1))

    def of(member: Column) -> Column:
        """Neighbours of a member: their number and the best."""
        others = F.slice(F.filter("adds", lambda o: o["word"] != member["word"]), 1, 1)
        nothing = F.slice("own", 1, 0)
        own = F.when(member["kind"] == 1, F.col("own")).otherwise(nothing)
        is_own = member["kind"] == 0
        count = F.when(is_own, F.size("deletions")).otherwise(F.size("adds") - 1 + F.size(own))
        best = better([F.when(is_own, F.slice("deletions", 1, 1)).otherwise(others), F.when(is_own, nothing).otherwise(own)])
        return F.struct(member["word"].alias("word"), count.cast("bigint").alias("n_near"), best["fewer"].alias("fewer"), best["word"].alias("best"))

    found = groups.select(F.explode(F.transform(F.concat("adds", "own"), of)).alias("f")).filter("f.n_near > 0").select("f.*")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("fewer", "best")).alias("b"))
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.col("b.best").alias("best"), (-F.col("b.fewer")).alias("best_n"))


def spelling_variants(words: DataFrame, ratio: float = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct (word, n).

    ``form`` is the near word of largest count if that is at least ``ratio`` times the word's own;
    ``root`` is the end of the chain of forms.
    """
    if ratio < 2:
        raise ValueError("a form has at least twice the count")
    known = materialize(words.filter("word is not null and n is not null"), "words")
    strong = F.col("best_n") >= ratio * F.col("n")
    formed = materialize(nearest(known).select(
        "word", "n", "n_near", F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")), "forms")
    # chains: each round doubles the steps; rows whose form has no form are done
    steps = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = materialize(steps.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "chains")
        steps = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    return formed.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
