"""User-supplied pieces: advantage estimators and samplers by name (scorers: operators.scoring).

An entry is a function over DataFrames or columns; a pandas UDF fits where no expression exists.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from rollstat.operators import advantages as A
from rollstat.operators import sampling as S

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {
    "group_relative": A.adv_group_relative, "process": A.adv_process, "pass_k": A.adv_pass_k,
    "group_baseline_whitened": A.adv_group_baseline_whitened, "leave_one_out": A.adv_leave_one_out,
    "length_weighted": A.adv_length_weighted, "discounted_return": A.adv_discounted_return, "greedy_baseline": A.adv_greedy_baseline,
    "scaled_centered": A.adv_scaled_centered, "gae": A.adv_gae, "token_direct": A.adv_token_direct,
    "direct_plus_outcome": A.adv_direct_plus_outcome, "process_leave_one_out": A.adv_process_loo,
}
SAMPLERS: dict[str, Callable[..., DataFrame]] = {
    "weighted_batches": S.weighted_batch_plan, "jittered_batches": S.jittered_batch_plan, "first_or_seeded": S.max_samples,
    "balanced_domains": S.balanced_domain_sample, "bottom_k": S.bottom_k_hash_sample,
}


def register(table: dict[str, Callable[..., DataFrame]], name: str, fn: Callable[..., DataFrame]) -> None:
    if name in table:
        raise ValueError(f"{name!r} is already registered")
    table[name] = fn


def get(table: dict[str, Callable[..., DataFrame]], name: str) -> Callable[..., DataFrame]:
    if name not in table:
        raise ValueError(f"unknown name {name!r}, known: {sorted(table)}")
    return table[name]
