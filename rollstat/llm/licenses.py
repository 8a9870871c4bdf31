"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A file's units are its lines, its header (the lines up to the first blank one) and its paragraphs
(the lines between blank or comment-only ones), so a notice may be wrapped wherever it stands.  A
licence file is compared as a whole: every window of a template's number of terms is a unit too.  Each unit is
compared with every template as a sparse vector of term counts times inverse document frequency;
document frequencies are counted over all files.  Terms that no template has weigh as much as a
term never seen.  The best template at or above ``threshold`` is the file's licence.

Only units with a term that a match needs are looked at: a unit without any of a template's
heaviest terms, those without which the template's remaining weight is below the threshold, can't
reach it (Cauchy-Schwarz), so nothing is lost.

A licence file (by name, or a file at least half of whose words are in its licence unit) speaks
for its directory; files without a licence of their own inherit from the nearest ancestor
directory that has one, by joins on directory paths.  Native operations only.

Defined cases: a null text counts as empty; a null path is a file in no directory; equal texts
share one comparison; of equally good templates the first by name wins, of equally good licence
files the smallest path; an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollstat.session import materialize

#: Short notices of common licences, by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Names of licence files.
LICENSE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice)([.\-][^/]*)?$"
_SPLIT = "[^a-z0-9]+"
#: Line breaks around lines of blanks and comment marks.
PARAGRAPH = r"\n(?:[ \t\r]*+[#*/;%!-]*+[ \t\r]*+\n)+"


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def _template_terms(text: str) -> Counter:
    low = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower())
    return Counter(low.split())


def _weights(templates: Sequence[tuple[str, str]], idf: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    """(licence, unit-length weights) of each template."""
    out = []
    for name, text in templates:
        raw = {w: n * idf[w] for w, n in _template_terms(text).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.append((name, {w: v / norm for w, v in raw.items()}))
    return out


def _needed(weights: list[tuple[str, dict[str, float]]], threshold: float) -> list[str]:
    """Terms of which a unit must have one to reach the threshold with any template."""
    needed: set[str] = set()
    for _, vector in weights:
        rest = sorted(vector.items(), key=lambda kv: (kv[1], kv[0]))
        left = 0.0
        for term, value in rest:
            if math.sqrt(left + value * value) < threshold - 1e-9:
                left += value * value
            else:
                needed.add(term)
    return sorted(needed)


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(v))])


def term_weights(texts: DataFrame, templates: Sequence[tuple[str, str]]) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the templates' terms over all ``text`` rows, and that of an unseen term."""
    vocabulary = sorted(set().union(*[_template_terms(t) for _, t in templates]))
    words = F.array_intersect(F.split(F.lower("text"), _SPLIT), F.array(*[F.lit(w) for w in vocabulary]))
    n = texts.count()
    seen = {r["w"]: r["n"] for r in texts.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # template terms
    return {w: math.log((n + 1) / (seen.get(w, 0) + 1)) + 1 for w in vocabulary}, math.log(n + 1) + 1


def own_licenses(texts: DataFrame, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """(k1, k2, named, license, score, covered) of the texts (k1, k2, named, text) that a template matches.

    ``named`` says that the text is a licence file's.
    """
    idf, unseen = term_weights(texts, templates)
    weights = _weights(templates, idf)
    pattern = r"(?:^|[^a-z0-9])(?:" + "|".join(_needed(weights, threshold)) + r")(?:[^a-z0-9]|$)"
    key = ["k1", "k2", "named"]
    likely = texts.filter(F.lower("text").rlike(pattern)).dropDuplicates(key).withColumn("terms", _terms(F.col("text")))
    lines = F.split("text", r"[\r\n]+")
    header = F.element_at(F.split("text", r"\r?\n[ \t]*\r?\n"), 1)
    paragraphs = F.split("text", PARAGRAPH)
    units = likely.select(*key, F.size("terms").alias("words"), F.posexplode(F.concat(F.array(header), lines, paragraphs)).alias("unit", "line"))
    units = units.filter(F.lower("line").rlike(pattern)).select(*key, "words", "unit", _terms(F.col("line")).alias("terms"))
    # licence files only: their terms, window by window, behind all other units
    widths = F.array(*[F.lit(n) for n in sorted({sum(_template_terms(t).values()) for _, t in templates})])
    windows = likely.filter("named and size(terms) > 0").select(*key, "terms", F.explode(widths).alias("width"))
    windows = windows.withColumn("width", F.least("width", F.size("terms")))
    windows = windows.select(*key, F.size("terms").alias("words"), "terms", "width", F.posexplode(F.sequence(F.lit(1), F.size("terms") - F.col("width") + 1)).alias("at", "start"))
    windows = windows.select(*key, "words", (F.col("width") * (1 << 24) + F.col("at")).alias("unit"), F.slice("terms", F.col("start"), F.col("width")).alias("terms")).distinct()
    units = units.unionByName(windows.filter(F.arrays_overlap("terms", F.array(*[F.lit(t) for t in _needed(weights, threshold)]))))
    words = units.select(*key, "words", "unit", F.explode("terms").alias("w"))
    counted = words.groupBy(*key, "words", "unit", "w").agg(F.count(F.lit(1)).alias("tf"))
    value = F.col("tf") * F.coalesce(F.element_at(_map(idf), F.col("w")), F.lit(unseen))
    dots = [F.sum(F.coalesce(F.element_at(_map(v), F.col("w")), F.lit(0.0)) * value).alias(f"d{i}") for i, (_, v) in enumerate(weights)]
    scored = counted.groupBy(*key, "words", "unit").agg(F.sqrt(F.sum(value * value)).alias("norm"), F.sum("tf").alias("length"), *dots)
    options = F.array(*[F.struct(F.round(F.col(f"d{i}") / F.col("norm"), 6).alias("score"), F.lit(-i).alias("i"), F.lit(name).alias("name"))
                        for i, (name, _) in enumerate(weights)])
    best = F.array_max(options).alias("b")
    found = scored.select(*key, "words", "length", "unit", best).filter(F.col("b.score") >= threshold)
    # the best unit of a text: its score, then the first template, then the longest unit
    top = found.groupBy(*key).agg(F.max(F.struct("b.score", "b.i", "length", (-F.col("unit")).alias("u"), "b.name", "words")).alias("t"))
    return top.select(*key, F.col("t.name").alias("license"), "t.score", (F.col("t.length") / F.col("t.words")).alias("covered"))


def scan_licenses(
    files: DataFrame, path: Column, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.75, covers: float = 0.5,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per file: id, path, license, score, inherited, inherited_from (the directory)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = files.select(F.col(id_column).alias("id"), path.alias("path"), text.alias("text"))
    rows = rows.select("id", "path", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"),
                       F.coalesce(F.col("path").rlike(LICENSE_NAMES), F.lit(False)).alias("named"))
    found = materialize(own_licenses(rows.select("k1", "k2", "named", "text"), templates, threshold), "licenses")
    own = rows.select("id", "path", "k1", "k2", "named").join(found, ["k1", "k2", "named"], "left").select(
        "id", "path", "license", "score", "covered", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"))
    own = materialize(own, "own")
    speaks = F.col("license").isNotNull() & F.col("path").contains("/") & ((F.col("covered") >= covers) | F.col("path").rlike(LICENSE_NAMES))
    declared = own.filter(speaks).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("d")).select(
        F.col("dir").alias("from_dir"), F.col("d.license").alias("inherited"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("at")))
    above = own.filter(F.col("path").contains("/")).select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.at")
    nearest = above.join(declared, above["at"] == declared["from_dir"]).groupBy("dir").agg(
        F.max(F.struct("depth", "from_dir", "inherited")).alias("n")).select("dir", "n.inherited", F.col("n.from_dir").alias("inherited_from"))
    out = own.join(nearest, "dir", "left")
    none = F.lit(None).cast("string")
    return out.select(
        F.col("id").alias(id_column), "path", "license", "score",
        F.when(F.col("license").isNull(), F.col("inherited")).otherwise(none).alias("inherited"),
        F.when(F.col("license").isNull(), F.col("inherited_from")).otherwise(none).alias("inherited_from"))
