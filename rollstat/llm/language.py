"""Language identification by compression.

Each language has a zstandard dictionary of raw content: normalised excerpts of a bounded sample
of its learning rows.  A text is compressed piece by piece with every dictionary; the language
whose dictionary gives the fewest bytes in all is chosen.  The whole text counts; pieces keep a
long text from becoming its own dictionary.  Where the two best are close, the row is ``rejected``.

Normalised means lower case with every run of other characters than letters (Unicode category L) as
one blank.

Sample per language: ``sample_rows`` rows at most in expectation, chosen by a hash of the id, of
each at most ``excerpt`` characters at a place that another hash chooses.  Every sampled row fills
the same part of the ``dictionary_bytes``.  Nothing else is bounded: all texts are read whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 (and so are all if
there is no language to learn); equal sizes go to the language with more learning rows, then the
smaller code; null ids hash as the empty id; an empty table gives an empty result; further columns
are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollstat.llm.common import bounded_batches, fold

PIECE = 2000
LEVEL = 5
_OTHER = regex.compile(r"\P{L}+")
_BLOCK = 1 << 20


def normalised(text: str) -> bytes:
    return (" " + _OTHER.sub(" ", text.lower()) + " ").encode("utf-8", "surrogatepass")


def pieces(text: str) -> Iterator[bytes]:
    for start in range(0, len(text), _BLOCK):
        data = normalised(text[start:start + _BLOCK])
        if data.strip():  # it has a letter
            for at in range(0, len(data), PIECE):
                yield data[at:at + PIECE]


def _compressors(dictionaries: list[tuple[str, bytes]]) -> list:
    import zstandard

    out = []
    for _, content in dictionaries:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def classify(text: str | None, names: list[str], compressors: list, narrow: float) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected) of one text."""
    sizes = np.zeros(len(names))
    for piece in pieces(text or ""):
        for k, compressor in enumerate(compressors):
            sizes[k] += len(compressor.compress(piece))
    if not len(names) or not sizes.any():
        return "und", 0.0, 0.0, True
    order = np.argsort(sizes, kind="stable")
    best = sizes[order[0]]
    margin = 1.0 if len(names) == 1 else float((sizes[order[1]] - best) / sizes[order[1]])
    spread = 2 + 0.005 * best  # bytes that mean little
    score = 1 / sum(math.exp(-min(float(s - best) / spread, 500.0)) for s in sizes)
    return names[order[0]], score, margin, margin < narrow


def dictionaries(
    rows: DataFrame, sample_rows: int = 400, excerpt: int = 1000, dictionary_bytes: int = 64_000, most_languages: int = 1000,
) -> list[tuple[str, bytes]]:
    """(language, content) from learning rows (id, lang, text), the most frequent language first.

    Every text is compressed once per language, so there can't be many: more than ``most_languages`` raise.
    """
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()
    if len(counted) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    counts = {r["lang"]: r["n"] for r in counted}
    if not counts:
        return []
    # the chance is a literal per language: texts are sampled where they lie
    chance = F.pmod(F.xxhash64(F.lit("dictionary"), "id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    # a notice at the top of many texts is no more of the dictionary than of the texts
    room = F.greatest(F.length("text") - excerpt + 1, F.lit(1))
    start = (F.pmod(F.xxhash64(F.lit("place"), "id", "lang"), room) + 1).cast("int")
    limits = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(sample_rows / n))])
    sample = rows.filter(chance < F.element_at(limits, F.col("lang"))).select("lang", F.substring(F.col("text"), start, F.lit(excerpt)).alias("text"), chance.alias("at"))
    texts: dict[str, list] = {}
    for r in sample.collect():  # about sample_rows excerpts for each language
        texts.setdefault(r["lang"], []).append((r["at"], r["text"]))
    out = []
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        sampled = sorted(texts.get(lang, []))
        part = dictionary_bytes // max(len(sampled), 1)
        content = b"".join(normalised(t)[:part] for _, t in sampled)
        if len(content) >= 8:  # zstandard takes no shorter dictionary
            out.append((lang, content))
    return out


def identify(
    docs: DataFrame, folds: int = 4, held_out_fold: int = 2, narrow: float = 0.01, id_column: str = "doc_id", text_column: str = "text",
    lang_column: str = "lang", sample_rows: int = 400, excerpt: int = 1000, dictionary_bytes: int = 64_000,
) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (0 to 1), margin, rejected."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    out = fold("id", folds) == held_out_fold
    learned = dictionaries(rows.filter(~out).filter("lang is not null and text is not null"), sample_rows, excerpt, dictionary_bytes)
    names = [name for name, _ in learned]

    @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = _compressors(learned)
        for texts in batches:
            yield pd.DataFrame([classify(t, names, compressors, narrow) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])

    return rows.select(F.col("id").alias(id_column), out.alias("held_out"), of("text").alias("p")).select(id_column, "held_out", "p.*")
