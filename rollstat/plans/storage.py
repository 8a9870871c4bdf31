"""Scans and sinks: tables are written to a fresh shared folder and read back."""
from __future__ import annotations

from pyspark.sql import functions as F

from rollstat.operators.ranking import position  # noqa: F401
from rollstat.plans.registry import query
from rollstat.plans.views import ROLL, q8, rounded, table, v_roll, with_ctes
from rollstat.session import shared_dir
from rollstat.sources import io


@query("scan_parquet", """SELECT c_custkey, c_name, c_nationkey, s_suppkey, s_name FROM (SELECT * FROM customer UNION ALL BY NAME SELECT * FROM supplier)""")
def scan_parquet(spark, sf):
    return io.scan_parquet(spark, [f"{sf}/customer.parquet", f"{sf}/supplier.parquet"]).select("c_custkey", "c_name", "c_nationkey", "s_suppkey", "s_name")


def _lines(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id") % 10
    line = F.when(k == 0, "").when(k == 1, "   ").when(k == 2, "[1, 2]").when(k == 3, '{"k": ').otherwise(
        F.concat(F.lit('{"id": '), F.col("event_id"), F.lit(', "type": "'), F.col("event_type"), F.lit('"}')))
    path = shared_dir(spark, "jsonl")
    e.select(line.alias("value")).write.text(path)
    return io.scan_jsonl_counted(spark, path, "id bigint, type string")


@query("scan_jsonl_counted", """SELECT count(*)::BIGINT AS input_rows, count(*) FILTER (event_id % 10 < 2)::BIGINT AS blank_rows, count(*) FILTER (event_id % 10 > 3)::BIGINT AS object_rows,
 count(*) FILTER (event_id % 10 IN (2, 3))::BIGINT AS invalid_rows FROM events""")
def scan_jsonl_counted(spark, sf):
    return _lines(spark, sf)[1]


@query("scan_jsonl_rows", "SELECT event_id AS id, event_type AS type FROM events WHERE event_id % 10 > 3")
def scan_jsonl_rows(spark, sf):
    return _lines(spark, sf)[0]


@query("write_sharded", """SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 300)::INTEGER AS shard FROM documents""")
def write_sharded(spark, sf):
    path = shared_dir(spark, "shards")
    io.write_sharded(table(spark, sf, "documents"), path, ["doc_id"], 300)
    return spark.read.parquet(path).select("doc_id", "shard")


@query("write_bounded", "SELECT count(*)::BIGINT AS n, true AS bounded FROM documents")
def write_bounded(spark, sf):
    path = shared_dir(spark, "bounded")
    io.write_bounded(table(spark, sf, "documents"), path, 300)
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count(F.lit(1)).alias("c"))
    return files.agg(F.sum("c").alias("n"), (F.max("c") <= 300).alias("bounded"))


@query("write_by_dataset", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'documents' ELSE source END AS dataset FROM documents")
def write_by_dataset(spark, sf):
    d = table(spark, sf, "documents").withColumn("dataset", F.when(F.col("doc_id") % 8 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("source")))
    path = shared_dir(spark, "datasets")
    io.write_by_dataset(d, path, "dataset", "documents")
    return spark.read.parquet(path).select("doc_id", "dataset")


@query("dump_generations", with_ctes(ROLL) + f"SELECT sample_id, uid, domain, CAST(step AS VARCHAR) AS step, {q8('score', 'score')}, pred FROM v_roll")
def dump_generations(spark, sf):
    path = shared_dir(spark, "dump")
    rows = v_roll(spark, sf).withColumn("round", F.lit(0)).withColumn("ground_truth", F.lit("x"))
    io.dump_generations(rows, path, ["step", "round"])
    back = spark.read.schema("sample_id bigint, uid bigint, domain string, score double, pred string, step date, round int").json(path)
    return rounded(back.select("sample_id", "uid", "domain", F.col("step").cast("string").alias("step"), "score", "pred"), "score")


EX = "('src3', 'src7')"
DIGEST = "sha256(concat_ws(chr(31), coalesce(CAST(doc_id AS VARCHAR), '\\N'), coalesce(lang, '\\N'), coalesce(CAST(n_chars AS VARCHAR), '\\N'), coalesce(source, '\\N'), coalesce(text, '\\N')))"


@query("manifest", f"""WITH k AS (SELECT * FROM documents WHERE source NOT IN {EX}), s AS (SELECT source, count(*) AS n, count(*) FILTER (source IN {EX}) AS x FROM documents GROUP BY 1)
SELECT 'dataset' AS section, 'rows' AS name, CAST(count(*) AS VARCHAR) AS value FROM k UNION ALL SELECT 'dataset', 'seed', '42' UNION ALL SELECT 'dataset', 'columns', 'doc_id,text,lang,source,n_chars' UNION ALL
SELECT 'domain', lang, CAST(count(*) AS VARCHAR) FROM k GROUP BY lang UNION ALL SELECT 'scanned', source, CAST(n AS VARCHAR) FROM s UNION ALL SELECT 'excluded', source, CAST(x AS VARCHAR) FROM s UNION ALL
SELECT 'selected', source, CAST(n - x AS VARCHAR) FROM s UNION ALL SELECT * FROM (SELECT 'top_source', source, CAST(n - x AS VARCHAR) FROM s ORDER BY n - x DESC, source LIMIT 5) UNION ALL
SELECT 'dataset', 'checksum', CAST(sum(CAST('0x' || substr({DIGEST}, 1, 8) AS BIGINT)) AS VARCHAR) FROM k""")
def manifest(spark, sf):
    return io.manifest(table(spark, sf, "documents"), domain="lang", source="source", excluded=["src3", "src7"], seed=42)


@query("write_back_scores", f"""SELECT 'orders.parquet' AS source_file, o_orderkey AS id, {q8('o_totalprice / 100000', 'score')} FROM orders UNION ALL SELECT 'events.parquet', event_id, {q8('value', 'score')} FROM events""")
def write_back_scores(spark, sf):
    o = io.with_source_file(table(spark, sf, "orders")).select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100000).alias("score"), "_src_file")
    e = io.with_source_file(table(spark, sf, "events")).select(F.col("event_id").alias("id"), F.col("value").alias("score"), "_src_file")
    path = shared_dir(spark, "scored")
    io.write_back_scores(o.unionByName(e), path, root=sf)
    return rounded(spark.read.parquet(path).select("source_file", "id", "score"), "score")


@query("metrics_long", f"""WITH m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS step, sum(l_quantity) AS quantity, avg(l_discount) AS discount, max(l_extendedprice) AS price FROM lineitem GROUP BY 1)
SELECT step, 'quantity' AS metric, {q8('quantity', 'value')} FROM m UNION ALL SELECT step, 'discount', {q8('discount', 'value')} FROM m UNION ALL SELECT step, 'price', {q8('price', 'value')} FROM m""")
def metrics_long(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("step")).agg(
        F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.max("l_extendedprice").alias("price"))
    return rounded(io.metrics_long(m, ["step"], ["quantity", "discount", "price"]), "value")
