"""Registered queries next to their SQL twins on the smallest tables."""
from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

# one or two of every kind; tools/check.py runs them all
NAMES = [
    "scan_parquet", "scan_jsonl_counted", "write_sharded", "write_by_dataset", "manifest", "metrics_long",
    "adv_group_relative", "adv_pass_k", "adv_leave_one_out", "soft_mean_center", "best_of_n_weights", "pair_preference_loss",
    "masked_stats", "response_mask", "adv_process", "adv_gae", "adv_discounted_return", "kl_coefficient_path", "ratio_diagnostics", "covariance_outliers",
    "importance_weights_sequence", "weight_metrics_geometric", "offpolicy_metrics", "distill_reward_union_student", "delta_metrics_by_chunk",
    "route_teachers", "domain_loss_weights_top10", "teacher_conflict", "mixture_schedule",
    "govern_rows", "bottom_k_hash_sample", "weighted_batch_plan", "jittered_batch_plan", "round_robin_mix", "band_filter_downsample", "balanced_sharding", "pack_report",
    "normalize_shard_record", "build_if_record", "canonical_kwargs", "filter_overlong_report", "validate_conversation", "truncate_pad_tokens", "format_passages",
    "score_latex_equal", "score_answer_line", "dispatch_scorer", "tiered_instruction_reward", "apply_judge_verdicts", "prompt_accuracy",
    "eval_scorecard", "repetition_metrics", "validation_metrics", "batch_data_metrics", "reduce_run", "staleness_metrics", "stream_score_rates",
]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7) + 0.0
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    res = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    want = Counter(tuple(plain(r[cols.index(c)]) for c in order) for r in res.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    root = __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__)))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 200"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
