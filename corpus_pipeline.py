"""The corpus pipeline: quality, exact copies, near copies, source mix, packed sequences."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollstat.llm.common import table
from rollstat.llm.exact_dedup import keep_first
from rollstat.llm.mixing import mix
from rollstat.llm.packing import pack
from rollstat.llm.quality import keep_good
from rollstat.llm.queries import ORACLES, QUERIES, tokenizer_path
from rollstat.llm.simhash import keep_one
from rollstat.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3, folds=5, held_out_fold=0).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return keep_first(docs).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return keep_one(docs, shingle=3, max_bits=3).select(*docs.columns)


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one at the end of a budget keeps its first words."""
    return mix(docs, weights=(5, 2, 1), share=1.0, most=3.0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2,048 tokens."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("source_mixing", sources),
    ("best_fit_packing", packed),
]

#: SQL can't train the classifier or run the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


QUERIES["pipeline"] = run
if ORACLE_SQL is not None:
    ORACLES["pipeline"] = ORACLE_SQL
