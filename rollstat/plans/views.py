"""Views that give the tables the shape of rollouts, token logs and conversations.

Each view exists twice: as a DataFrame and as a SQL common table expression.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for text work.

    ``spark.rollstat.scan.partitions`` deals the rows out anew, for tables of few row groups; unset, a scan is left as it is.
    """
    docs, parts = table(spark, sf, "documents"), spark.conf.get("spark.rollstat.scan.partitions", None)
    return docs.repartition(int(parts)) if parts else docs


def v_roll(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("sample_id"),
        F.col("o_orderpriority").alias("domain"),
        F.date_trunc("month", "o_orderdate").cast("date").alias("step"),
        (F.col("o_totalprice") / 100000).alias("score"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("acc"),
        F.col("o_orderstatus").alias("pred"),
    )


ROLL = """v_roll AS (
SELECT o_custkey AS uid, o_orderkey AS sample_id, o_orderpriority AS domain,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS step, o_totalprice / 100000 AS score,
       CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS acc, o_orderstatus AS pred
FROM orders)"""


def v_tok(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """One row per token, or the named columns of it: operators that write rows in between write all they get.

    A sequence is one order: its length is bounded by the context size.
    """
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    log = l.select(
        F.col("l_orderkey").alias("sample_id"), F.row_number().over(order).alias("pos"),
        F.col("l_partkey").alias("token_id"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("mask"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_end"),
        (F.col("l_quantity") / 50).alias("reward"), (F.col("l_extendedprice") / 100000).alias("value"),
        (-(F.col("l_discount") * 10 + 0.05)).alias("logp_old"),
        (-(F.col("l_tax") * 10 + 0.05)).alias("logp_rollout"),
        (-((F.col("l_discount") + F.col("l_tax")) * 5 + 0.05)).alias("logp_ref"),
    )
    heads = o.select(
        F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("sample_id"),
        F.col("o_orderpriority").alias("domain"),
        F.date_trunc("month", "o_orderdate").cast("date").alias("step"),
    )
    out = log.join(heads, "sample_id")
    return out.select(*columns) if columns else out


TOK = """v_tok AS (
SELECT o.o_custkey AS uid, l.l_orderkey AS sample_id, o.o_orderpriority AS domain,
       CAST(date_trunc('month', o.o_orderdate) AS DATE) AS step,
       row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS pos,
       l.l_partkey AS token_id, CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END AS mask,
       CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS is_end,
       l.l_quantity / 50 AS reward, l.l_extendedprice / 100000 AS value,
       -(l.l_discount * 10 + 0.05) AS logp_old, -(l.l_tax * 10 + 0.05) AS logp_rollout,
       -((l.l_discount + l.l_tax) * 5 + 0.05) AS logp_ref
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


def v_msg(spark: SparkSession, sf: str) -> DataFrame:
    """One row per conversation with its ordered messages."""
    c = table(spark, sf, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return c.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id",
        F.transform("turns", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"),
    )


MSG = """v_msg AS (
SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages
FROM conversations GROUP BY conv_id)"""


def v_doc(spark: SparkSession, sf: str) -> DataFrame:
    d, l = documents(spark, sf), table(spark, sf, "labels")
    return d.join(l, "doc_id", "left").select(
        "doc_id", F.col("lang").alias("domain"), F.col("source").alias("dataset"),
        F.col("text").alias("completion"), "n_chars", F.col("quality").alias("acc"), "toxic",
        F.when(F.col("n_chars") >= 8000, 1).otherwise(0).alias("truncated"),
    )


DOC = """v_doc AS (
SELECT d.doc_id, d.lang AS domain, d.source AS dataset, d.text AS completion, d.n_chars,
       l.quality AS acc, l.toxic, CASE WHEN d.n_chars >= 8000 THEN 1 ELSE 0 END AS truncated
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def v_topk(spark: SparkSession, sf: str, k: int = 8) -> DataFrame:
    """One row per token: k student log-probs and three teachers over the same candidates."""
    e = table(spark, sf, "embeddings")
    part = lambda i: F.slice("embedding", 1 + i * k, k).cast("array<double>")
    return e.select(
        F.col("vec_id").alias("token"), F.col("label").alias("domain"), part(0).alias("student"),
        part(1).alias("t1"), part(2).alias("t2"), part(3).alias("t3"),
    )


TOPK = """v_topk AS (
SELECT vec_id AS token, label AS domain, CAST(embedding[1:8] AS DOUBLE[]) AS student,
       CAST(embedding[9:16] AS DOUBLE[]) AS t1, CAST(embedding[17:24] AS DOUBLE[]) AS t2,
       CAST(embedding[25:32] AS DOUBLE[]) AS t3
FROM embeddings)"""


def with_ctes(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def q8(expr: str, name: str) -> str:
    """SQL twin of ``r8``: a double rounded to eight digits."""
    return f"round(CAST({expr} AS DOUBLE) + 3e-11, 8) + 0.0 AS {name}"


def q8s(*names: str, prefix: str = "") -> str:
    return ", ".join(q8(prefix + n, n) for n in names)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Round the named double columns to eight digits."""
    from rollstat.functions.columns import r8

    return df.select(*[r8(c).alias(c) if c in names else F.col(c) for c in df.columns])
