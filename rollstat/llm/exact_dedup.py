"""Exact duplicates: a 128-bit content hash, then the bytes inside each hash group.

Texts are equal when they agree after white space ``[\\x20\\x09-\\x0D]`` is deleted.  Copies
are counted by (hash, bytes) and shrink before the shuffle, so a text that a third of all rows
share sends one row per task; the bytes in the grouping key keep colliding hashes apart.

Defined cases: a null text counts as empty; of equal texts the one with the most code points
stays, then the smallest id (a null id is last); of rows that repeat id and text one stays;
an empty table gives an empty result; further columns are carried by ``keep_first`` and ignored
by ``exact_duplicates``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollstat.llm.common import without_white


def content_hash(body: Column) -> Column:
    return F.unhex(F.md5(body))


def _bodies(docs: DataFrame, id_column: str, text_column: str, hash_of: Callable[[Column], Column], *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(*more, F.col(id_column).alias("id"), F.length(text).alias("points"), without_white(text).alias("body"))
    return rows.withColumn("hash", hash_of(F.col("body")))


def _order(*more: Column) -> Column:
    """Most code points first, then the smallest id."""
    return F.struct((-F.col("points")).alias("fewer"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), *more)


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    bodies = _bodies(docs, id_column, text_column, hash_of)
    # texts are compared here, as part of the key; a class leaves as one narrow row
    classes = bodies.groupBy("hash", "body").agg(F.count(F.lit(1)).alias("group_size"), F.min(_order()).alias("best")).select(
        "hash", F.unhex(F.sha2("body", 256)).alias("sha"), "group_size", "best")
    # rows that agree in all of this are repeats; one of them is copy 1
    members = bodies.groupBy("hash", F.unhex(F.sha2("body", 256)).alias("sha"), "id", "points").agg(F.count(F.lit(1)).alias("copies"))
    rows = members.join(classes, ["hash", "sha"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return rows.select(
        F.col("id").alias(id_column), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("points") == -F.col("best.fewer")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """The rows that stay, whole."""
    row = F.struct(*docs.columns).alias("row")
    bodies = _bodies(docs, id_column, text_column, hash_of, row)
    best = F.min_by("row", _order(F.xxhash64("row").alias("row_hash")))
    return bodies.groupBy("hash", "body").agg(best.alias("row")).select("row.*")
