"""Mixing sources to target weights.

Every document gets a hash-random key; within its source the documents are range-sorted by the
key and a distributed prefix sum of their sizes tells where the source's budget ends.  A budget
above the source's size takes whole epochs first; the document at the cut gives its first words,
so a source meets its budget to the word.  Native operations only.

Defined cases: a null text has size 0; the null source is a source like any other, last in the
order; null ids share the key of the empty id; rows that agree in everything are interchangeable
and share what they are taken for; sources whose documents have no words get target 0; an empty
table gives an empty result; further columns are ignored by ``mixture``, carried by ``mix``.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollstat.llm.common import WORD
from rollstat.llm.positions import numbered, running_sum
from rollstat.session import materialize


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat over the sources in order.

    No target exceeds ``most`` times its source's size; the excess goes to the others by weight
    until none is above.  Each round is one small aggregate; two numbers reach the driver.
    """
    ranked = numbered(sizes.withColumn("no_source", F.col("source").isNull()), ["no_source", "source"], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("top")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level = min(share, most) * total, None
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * F.lit(level[0]) / F.lit(level[1]) > F.col("top")
        got = ranked.agg(F.sum(F.when(capped, F.col("top"))), F.sum(F.when(~capped, F.col("weight")))).first()
        left, rest = budget - (got[0] or 0.0), got[1]
        if not rest or (left, rest) == level:
            break
        level = (left, rest)
    if level is None:  # no source
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    fair = F.col("weight") * F.lit(level[0]) / F.lit(level[1])
    return ranked.select("source", "source_size", F.least(fair, F.col("top")).alias("target"))


def _taken(rows: DataFrame, order: Sequence[str], weights: Sequence[float], share: float, most: float, seed: str) -> DataFrame:
    """``rows`` (id, source, size, ...) with source_size, target, epochs and the words of the partial epoch."""
    rows = materialize(rows, "sizes")  # texts are read once
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(per_source, weights, share, most)
    key = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 16)
    run = running_sum(rows.withColumn("key", key), "source", ["key", *order], "size", "until")
    joined = run.join(goal.withColumnRenamed("source", "_s"), run["source"].eqNullSafe(F.col("_s")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    joined = joined.withColumn("epochs", epochs.cast("bigint")).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    part = F.least(F.greatest(F.col("rest") - (F.col("until") - F.col("size")), F.lit(0)), F.col("size"))
    return joined.withColumn("part", part.cast("bigint")).drop("_s", "until", "rest", "key")


def mixture(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: str = "mix",
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), words(F.col(text_column)).alias("size"))
    out = _taken(rows, ["id", "size"], weights, share, most, seed)
    return out.select(F.col("id").alias(id_column), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: str = "mix",
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", length_column: str | None = "n_chars",
) -> DataFrame:
    """The mixed documents: a row per copy; a copy cut at the budget keeps the text up to its last word taken."""
    keys = [F.xxhash64(*docs.columns).alias("k1"), F.xxhash64(F.lit(1), *docs.columns).alias("k2")]
    rows = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), words(F.col(text_column)).alias("size"), *keys)
    plan = _taken(rows, ["id", "size", "k1", "k2"], weights, share, most, seed)
    whole = F.col("epochs") + (F.col("part") == F.col("size")).cast("bigint") * (F.col("size") > 0).cast("bigint")
    cut = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.col("part"))
    # a budget ends once per source, so repeated rows have one cut copy at most
    plan = plan.groupBy("k1", "k2").agg(F.sum(whole).alias("whole"), F.max(cut).alias("cut"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), *keys).dropDuplicates(["k1", "k2"])
    copies = F.concat(F.array_repeat(F.lit(None).cast("bigint"), F.col("whole").cast("int")), F.when(F.col("cut").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("cut")))
    rows = packed.join(plan.filter("whole > 0 or cut is not null"), ["k1", "k2"]).select("row", F.explode(copies).alias("keep"))
    text = F.col(f"row.{text_column}")
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("keep").isNull(), text).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("keep").cast("int")), ""))
    rows = rows.withColumn("kept_text", text)
    out = []
    for c in docs.columns:
        if c == text_column:
            out.append(F.col("kept_text").alias(c))
        elif c == length_column:
            out.append(F.when(F.col("keep").isNull(), F.col(f"row.{c}")).otherwise(F.length("kept_text")).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"row.{c}").alias(c))
    return rows.select(*out)
