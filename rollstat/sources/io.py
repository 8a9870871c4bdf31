"""Scans and sinks: Parquet, counted JSON lines, shards, dumps, manifests."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollstat.functions.columns import blank_to_null
from rollstat.operators.ranking import position
from rollstat.session import materialize


def scan_parquet(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One file, a list, or folders of files as one table; columns missing in a file are null."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no input path")
    out: DataFrame | None = None
    for p in paths:
        one = spark.read.option("mergeSchema", "true").parquet(p)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def scan_jsonl_counted(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Parsed rows and one row of counters. Blank lines are skipped; unreadable or non-object lines counted."""
    lines = spark.read.text(path).withColumn("_blank", F.trim("value") == "")
    parsed = F.try_parse_json("value")
    good = F.rlike("value", F.lit(r"^\s*\{")) & parsed.isNotNull()
    tagged = lines.withColumn("_good", F.coalesce(good, F.lit(False)) & ~F.col("_blank"))
    rows = tagged.filter("_good").select(F.from_json("value", schema).alias("r")).select("r.*")
    counters = tagged.agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if("_blank").alias("blank_rows"), F.count_if("_good").alias("object_rows"),
        F.count_if(~F.col("_good") & ~F.col("_blank")).alias("invalid_rows"))
    return rows, counters


def shard_ids(df: DataFrame, order: Sequence[str], rows_per_shard: int) -> DataFrame:
    """``shard`` = row ordinal div rows_per_shard."""
    ranked = position(df, order, name="_p")
    return ranked.withColumn("shard", F.floor((F.col("_p") - 1) / rows_per_shard).cast("int")).drop("_p")


def write_sharded(df: DataFrame, path: str, order: Sequence[str], rows_per_shard: int, *, overwrite: bool = False) -> None:
    """Zstd Parquet shards of exactly ``rows_per_shard`` rows (the last may be shorter), one folder per shard."""
    shards = shard_ids(df, order, rows_per_shard)
    shards.repartition("shard").sortWithinPartitions("shard", *order).write.option("compression", "zstd").mode(
        "overwrite" if overwrite else "errorifexists").partitionBy("shard").parquet(path)


def write_bounded(df: DataFrame, path: str, max_rows: int, *, overwrite: bool = False) -> None:
    """Files of at most ``max_rows`` rows without a global order: no shuffle."""
    df.write.option("maxRecordsPerFile", max_rows).option("compression", "zstd").mode(
        "overwrite" if overwrite else "errorifexists").parquet(path)


def dataset_label(dataset: str, fallback: str | Column) -> Column:
    """The dataset, or the input's name where it is null or blank."""
    return F.when(blank_to_null(dataset).isNotNull(), F.col(dataset)).otherwise(F.lit(fallback) if isinstance(fallback, str) else fallback)


def write_by_dataset(df: DataFrame, path: str, dataset: str, fallback: str) -> None:
    df.withColumn(dataset, dataset_label(dataset, fallback)).write.option("compression", "zstd").partitionBy(dataset).parquet(path)


def dump_generations(df: DataFrame, path: str, step: Sequence[str], drop: Sequence[str] = ("ground_truth",)) -> None:
    """Scored generations as JSON lines, one folder per step, without the ground truth."""
    df.drop(*drop).write.partitionBy(*step).json(path)


def row_digest(df: DataFrame) -> Column:
    """sha256 of the row as text, columns in name order."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)]), 256)


def content_checksum(df: DataFrame) -> DataFrame:
    """Order-free checksum of any size: the sum of the first 32 bits of every row digest."""
    part = F.conv(F.substring(row_digest(df), 1, 8), 16, 10).cast("decimal(38,0)")
    return df.agg(F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("checksum"))


def manifest(df: DataFrame, *, domain: str, source: str, excluded: Sequence[str] = (), seed: int, top: int = 5) -> DataFrame:
    """Dataset manifest as rows (section, name, value): counts, per-source funnel, seed, columns, checksum, top sources."""
    gone = F.coalesce(F.col(source).isin(list(excluded)), F.lit(False))
    part = F.conv(F.substring(row_digest(df), 1, 8), 16, 10).cast("decimal(38,0)")
    # one scan: counts and checksum parts per (domain, source), a small table, give every number
    by = df.groupBy(F.col(domain).alias("d"), F.col(source).alias("s"), gone.alias("gone")).agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("c"))
    by = materialize(by, "manifest")
    zero, text = F.lit(0), lambda c: c.cast("string").alias("value")
    sums = by.agg(F.coalesce(F.sum(F.when(~F.col("gone"), F.col("n"))), zero).alias("rows"), F.coalesce(F.sum(F.when(~F.col("gone"), F.col("c"))), zero).alias("sum"))
    one = lambda name, value: F.struct(F.lit("dataset").alias("section"), F.lit(name).alias("name"), text(value))
    head = sums.select(F.explode(F.array(one("rows", F.col("rows")), one("seed", F.lit(seed)), one("columns", F.lit(",".join(df.columns))),
                                         one("checksum", F.col("sum")))).alias("e")).select("e.*")
    kept = by.filter(~F.col("gone"))
    domains = kept.groupBy(F.col("d").alias("name")).agg(F.sum("n").alias("n")).select(F.lit("domain").alias("section"), "name", text(F.col("n")))
    funnel = by.groupBy(F.col("s").alias("name")).agg(F.sum("n").alias("scanned"), F.sum(F.when(F.col("gone"), F.col("n")).otherwise(0)).alias("excluded"))
    funnel = funnel.withColumn("selected", F.col("scanned") - F.col("excluded"))
    counts = funnel.unpivot("name", ["scanned", "excluded", "selected"], "section", "value").select("section", "name", text(F.col("value")))
    best = funnel.orderBy(F.col("selected").desc(), "name").limit(top).select(F.lit("top_source").alias("section"), "name", text(F.col("selected")))
    return head.unionByName(domains).unionByName(counts).unionByName(best)


def with_source_file(df: DataFrame, name: str = "_src_file") -> DataFrame:
    """The file every row was read from."""
    return df.select("*", F.col("_metadata.file_path").alias(name))


def write_back_scores(df: DataFrame, path: str, src: str = "_src_file", root: str | None = None) -> None:
    """Scored rows to a new path, one folder per source file (the input itself is never overwritten).

    ``source_file`` is the file's path below ``root`` (else its whole path): equal names in different folders stay apart.
    """
    label = F.regexp_replace(F.col(src), r"^[a-z0-9]+:/+", "/")
    if root is not None:
        below = F.lit("/" + root.split("://")[-1].strip("/").split(":/")[-1].strip("/") + "/")
        at = F.instr(label, below)
        label = F.when(at > 0, F.substring(label, at + F.length(below), F.length(label))).otherwise(label)
    df.withColumn("source_file", label).drop(src).write.option("compression", "zstd").partitionBy("source_file").parquet(path)


def metrics_long(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric rows to (ids, metric, value)."""
    return df.unpivot(list(ids), list(metrics), "metric", "value")
