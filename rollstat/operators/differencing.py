"""Exact mode of the cost-balanced shards: largest differencing inside one batch.

A batch is a training batch of fixed size, so one group of rows stays small.
"""
from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame


def difference_shards(costs: list[int], shards: int, equal_size: bool, partial: bool = False) -> list[int]:
    """Shard of every item: the two partitions with the largest spread are merged, big sums onto small ones.

    With ``partial`` the smallest items make up a group that does not fill all shards.
    """
    if not partial and (len(costs) < shards or (equal_size and len(costs) % shards)):
        raise ValueError("too few items, or not divisible into equal shards")
    order = sorted(range(len(costs)), key=lambda i: (costs[i], i))
    if equal_size:
        rest = len(order) % shards
        starts = [order[:rest]] * (rest > 0) + [order[i: i + shards] for i in range(rest, len(order), shards)]
    else:
        starts = [[i] for i in order]
    heap = []
    for n, items in enumerate(starts):
        bins = sorted(((costs[i], [i]) for i in items), key=lambda b: -b[0])
        bins += [(0, [])] * (shards - len(bins))
        heapq.heappush(heap, (bins[-1][0] - bins[0][0], n, bins))
    tie = len(starts)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))]
        merged.sort(key=lambda m: (-m[0], m[1]))
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], tie, merged))
        tie += 1
    out = [0] * len(costs)
    for shard, (_, items) in enumerate(heap[0][2]):
        for i in items:
            out[i] = shard
    return out


def balanced_sharding_exact(
    df: DataFrame, batch: str, pos: str, cost: str, shards: int, *, equal_size: bool = True, partial: bool = False,
) -> DataFrame:
    """(batch, pos, cost, shard) by differencing; one call handles one batch.

    Raises for a batch with fewer rows than shards, or (``equal_size``) one that does not divide.  With ``partial``
    such a batch, like the last one of a table, is dealt as far as it goes: its shards differ by one row.
    """
    slim = df.select(batch, pos, cost)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(pos, ignore_index=True)
        return part.assign(shard=difference_shards([int(c) for c in part[cost]], shards, equal_size, partial))

    fields = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in slim.columns)
    return slim.groupBy(batch).applyInPandas(solve, f"{fields}, shard int")
