"""Ordered running values over token sequences.

Everything is windows over (sequence, chunk of positions): one shuffle and one sort, and no
task ever holds more of a sequence than one chunk.  The rows with their values inside the
chunk are written once; the input is read once.

What a chunk does to the state that enters it is an affine map with a few numbers, and maps
compose.  Sequences of more than one chunk have their maps composed by doubling: after round
j a chunk's map covers the 2**j chunks before it, by one join of the chunk table with itself, so
a sequence of a million chunks takes twenty rounds and never meets in one row or task.  The
composed maps give the carries, which are joined to the written rows.  Rows without a
sequence form one.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollstat.operators.ranking import join_null_safe, position, with_group_stats
from rollstat.session import materialize

CHUNK = 4096

Map = Mapping[str, Column]


def _chunked(df: DataFrame, pos: str, size: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor((F.col(pos) - 1) / size))


def _to_end(seq: str, pos: str, *more: str):
    """From this position to the end of the chunk."""
    return Window.partitionBy(seq, "_chunk", *more).orderBy(F.col(pos).desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)


def compose_before(
    steps: DataFrame, group: list[str], at: str, fields: list[str], then: Callable[[Map, Map], Map], first: int = 1,
) -> DataFrame:
    """The maps of steps ``first`` .. ``at``, composed; ``at`` counts from ``first`` without gaps per group.

    ``then(near, far)`` is the map that applies ``far``, the earlier steps, and ``near`` after them.
    """
    last = steps.agg(F.max(at)).first()[0]
    span = 1
    while last is not None and span <= last - first:
        far = steps.select(*group, (F.col(at) + span).alias(at), *[F.col(f).alias(f"_far_{f}") for f in fields])
        joined = join_null_safe(steps, far, [*group, at], "left")
        both = then({f: F.col(f) for f in fields}, {f: F.col(f"_far_{f}") for f in fields})
        # steps that reach back to the first one are done
        steps = materialize(joined.select(*group, at, *[
            F.when(F.col(at) - span >= first, both[f]).otherwise(F.col(f)).alias(f) for f in fields]), "maps")
        span *= 2
    return steps


def _carries(
    rows: DataFrame, seq: str, summary: Map, then: Callable[[Map, Map], Map], state: Callable[[Map], Map], *, reverse: bool,
) -> DataFrame | None:
    """(seq, _chunk, state fields that enter the chunk) for chunks behind another one; None if there are none.

    ``summary`` aggregates a chunk's rows to its map, ``state`` gives the state behind a map that nothing entered.
    """
    parts = rows.groupBy(seq, "_chunk").agg(*[v.alias(n) for n, v in summary.items()])
    parts = with_group_stats(parts, [seq], _chunks=F.count(F.lit(1))).filter("_chunks > 1").drop("_chunks")
    parts = materialize(parts.withColumn("_order", -F.col("_chunk") if reverse else F.col("_chunk")), "chunks")
    if parts.isEmpty():
        return None
    steps = materialize(position(parts, ["_order"], [seq], name="_k"), "chunks")
    done = compose_before(steps.select(seq, "_k", *summary), [seq], "_k", list(summary), then)
    into = done.select(seq, (F.col("_k") + 1).alias("_k"), *[v.alias(n) for n, v in state({f: F.col(f) for f in summary}).items()])
    return join_null_safe(steps.select(seq, "_chunk", "_k"), into, [seq, "_k"]).drop("_k")


def _entered(
    rows: DataFrame, seq: str, summary: Map, then: Callable[[Map, Map], Map], state: Callable[[Map], Map], *, reverse: bool = True,
) -> DataFrame:
    """``rows`` written once, with the state that enters their chunk (0 where nothing does)."""
    rows = materialize(rows, "scan")
    carries = _carries(rows, seq, summary, then, state, reverse=reverse)
    names = list(state({f: F.lit(0.0) for f in summary}))
    if carries is None:
        return rows.withColumns({n: F.lit(0.0) for n in names})
    out = join_null_safe(rows, carries, [seq, "_chunk"], "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})


def running_sums(
    df: DataFrame, seq: str, pos: str, values: Map, *, reverse: bool = False, chunk: int = CHUNK
) -> DataFrame:
    """Inclusive running sums of several columns, from the start or (``reverse``) to the end."""
    rows = _chunked(df, pos, chunk).select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    inside = Window.partitionBy(seq, "_chunk").orderBy(F.col(pos).desc() if reverse else F.col(pos)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(*df.columns, "_chunk", *[F.col(f"_v_{n}") for n in values], *[F.sum(f"_v_{n}").over(inside).alias(f"_i_{n}") for n in values])
    # a chunk adds its total
    out = _entered(
        rows, seq, {f"_t_{n}": F.coalesce(F.sum(f"_v_{n}"), F.lit(0)) for n in values},
        lambda near, far: {f: near[f] + far[f] for f in near}, lambda m: {f"_c_{n}": m[f"_t_{n}"] for n in values}, reverse=reverse)
    kinds = {f.name: f.dataType for f in rows.schema}
    return out.select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_c_{n}")).cast(kinds[f"_i_{n}"]).alias(n) for n in values])


def running_sum(
    df: DataFrame, seq: str, pos: str, value: Column, *, name: str, reverse: bool = False, chunk: int = CHUNK
) -> DataFrame:
    return running_sums(df, seq, pos, {name: value}, reverse=reverse, chunk=chunk)


def suffix_sum(df: DataFrame, seq: str, pos: str, value: Column, *, name: str, chunk: int = CHUNK) -> DataFrame:
    """Sum of ``value`` from this position to the end of the sequence."""
    return running_sum(df, seq, pos, value, name=name, reverse=True, chunk=chunk)


def _safe_chunk(factor: float, chunk: int) -> int:
    """Chunk length for which powers of the factor stay inside the double range."""
    if not 0 < factor <= 1:
        raise ValueError("the discount factor must be in (0, 1]")
    return chunk if factor == 1 else max(1, min(chunk, int(250 / -math.log10(factor))))


def discounted_return(
    df: DataFrame, seq: str, pos: str, reward: Column, mask: str, *, gamma: float, name: str, chunk: int = CHUNK
) -> DataFrame:
    """x_t = r_t + gamma * mask_{t+1} * x_{t+1}: a token with mask 0 ends what reaches further left."""
    rows = _chunked(df, pos, _safe_chunk(gamma, chunk)).withColumn("_r", reward.cast("double"))
    # tokens of one segment share the number of zeros behind their left neighbour, counted from the right
    strictly = Window.partitionBy(seq, "_chunk").orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_seg", F.coalesce(F.sum(1 - F.col(mask)).over(strictly), F.lit(0)))
    # one sort by (chunk, segment, position) serves both: a segment is a stretch of positions
    segment = Window.partitionBy(seq, "_chunk", "_seg").orderBy(F.col(pos).desc())
    rows = rows.withColumn("_u", F.row_number().over(segment))
    lift = F.pow(F.lit(gamma), -F.col("_u").cast("double"))
    rows = rows.withColumn("_x", F.sum(F.col("_r") * lift).over(_to_end(seq, pos, "_seg")) / lift)
    # y, mask times x of the token to the right, enters the first segment only: y' = shift + scale * y
    opens = F.min(F.col("_seg") == 0)
    left_mask, left_x = F.min_by(mask, pos).cast("double"), F.min_by("_x", pos)
    summary = {"_shift": left_mask * left_x, "_scale": F.when(opens, left_mask * F.pow(F.lit(gamma), F.count(F.lit(1)))).otherwise(0.0)}
    out = _entered(
        rows, seq, summary, lambda near, far: {"_shift": near["_shift"] + near["_scale"] * far["_shift"], "_scale": near["_scale"] * far["_scale"]},
        lambda m: {"_y": m["_shift"]})
    reach = F.when(F.col("_seg") == 0, F.pow(F.lit(gamma), F.col("_u")) * F.col("_y")).otherwise(0.0)
    return out.withColumn(name, F.col("_x") + reach).select(*df.columns, name)


def advantage_recursion(
    df: DataFrame, seq: str, pos: str, reward: str, value: str, mask: str, *, gamma: float, lam: float,
    name: str, chunk: int = CHUNK,
) -> DataFrame:
    """A_t = r_t + gamma*V(next valid) - V_t + gamma*lam*A(next valid) on valid tokens.

    A masked token takes the value of the next valid token, 0 behind the last one.
    """
    c = gamma * lam
    rows = _chunked(df, pos, _safe_chunk(c, chunk))
    valid = F.col(mask) > 0
    right = _to_end(seq, pos)
    strictly = Window.partitionBy(seq, "_chunk").orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_u", F.sum(mask).over(right)).withColumn(
        "_nv", F.coalesce(F.last(F.when(valid, F.col(value)), ignorenulls=True).over(strictly), F.lit(0.0)))
    lift = F.pow(F.lit(c), -F.col("_u").cast("double"))
    delta = F.col(reward) + gamma * F.col("_nv") - F.col(value)
    rows = rows.withColumn("_a", F.sum(F.when(valid, delta * lift).otherwise(0.0)).over(right) / lift)
    # state: value v and advantage a of the next valid token; a chunk with a valid token sets v,
    # and a' = shift + of_v * v + of_a * a; one without passes both on
    some = F.max("_u") > 0
    power = F.pow(F.lit(c), F.max("_u") - 1)
    summary = {
        "_v": F.when(some, F.min_by(F.when(valid, F.col(value)), F.when(valid, F.col(pos)))).otherwise(0.0),
        "_keep": F.when(some, 0.0).otherwise(1.0), "_shift": F.when(some, F.min_by("_a", pos)).otherwise(0.0),
        "_of_v": F.when(some, power * gamma).otherwise(0.0), "_of_a": F.when(some, power * c).otherwise(1.0),
    }

    def then(near: Map, far: Map) -> Map:
        return {
            "_v": near["_v"] + near["_keep"] * far["_v"], "_keep": near["_keep"] * far["_keep"],
            "_shift": near["_shift"] + near["_of_v"] * far["_v"] + near["_of_a"] * far["_shift"],
            "_of_v": near["_of_v"] * far["_keep"] + near["_of_a"] * far["_of_v"], "_of_a": near["_of_a"] * far["_of_a"]}

    out = _entered(rows, seq, summary, then, lambda m: {"_in_v": m["_v"], "_in_a": m["_shift"]})
    reach = F.pow(F.lit(c), F.col("_u") - 1) * (gamma * F.col("_in_v") + c * F.col("_in_a"))
    return out.withColumn(name, F.when(F.col("_u") > 0, F.col("_a") + reach).otherwise(F.col("_in_a"))).select(*df.columns, name)
