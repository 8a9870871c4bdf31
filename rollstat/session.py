"""Session defaults and the shared scratch folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "rollstat", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_scratch: str | None = None


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; only a local session may
    fall back to a temporary folder.
    """
    global _local_scratch
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="run-")
        base = _local_scratch
    return f"{base.rstrip('/')}/rollstat-{label}-{uuid.uuid4().hex[:12]}"


def materialize(df, label: str):
    """Write ``df`` once and read it back: cuts lineage, survives executor loss."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
