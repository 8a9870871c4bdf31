"""Recovering an ordered selection from its source stream.

Both streams are read in order and every target takes the earliest later source row with its key.
Done row by row this is one long sequential pass; here it is a tree.

What a target does to the place reached so far is a monotone step function, shared by all
targets of one key: (start, end) rows, where a place before ``start`` leads to ``end``.  Neighbouring blocks
of targets are composed pairwise by as-of joins, level by level; then the places are walked down the
same tree.  That makes twice log2 of the targets rounds, whatever the order of the selection.

Rows stay few for two reasons.  Of starts with the same end one is kept, so a block has no
more rows than its rarest key has places, and only the smaller side of a pair looks up the
other.  And a block is known by the hash of its keys: a function that many blocks share, such as
that of a key a third of the rows have, is kept once.  A level holds, over its different blocks,
the sum of the places of their rarest keys.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollstat.operators.ranking import join_null_safe
from rollstat.session import materialize

BUCKET = 100_000
#: Before every place.
START = -(1 << 53)


def nearest_mark(asks: DataFrame, marks: DataFrame, *, after: bool, bucket: int = BUCKET) -> DataFrame:
    """As-of join: asks (h, x, ...) with ``found``, the value of the nearest mark (h, x, value).

    The mark lies strictly after x, or strictly before it; without one ``found`` is null.  Both kinds lie
    on one axis that is cut into buckets, so a frequent ``h`` is spread over many tasks.
    """
    others = [c for c in asks.columns if c not in ("h", "x")]
    kind = marks.schema["value"].dataType
    asking = asks.select("h", "x", F.lit(0).alias("_kind"), *others, F.lit(None).cast(kind).alias("_v"))
    marking = marks.select("h", "x", F.lit(1).alias("_kind"), *[F.lit(None).cast(asks.schema[c].dataType).alias(c) for c in others], F.col("value").alias("_v"))
    axis = asking.unionByName(marking).withColumn("_b", F.floor(F.col("x") / bucket))
    toward = (lambda c: F.col(c).desc()) if after else (lambda c: F.col(c).asc())
    # an ask comes before a mark at its own place and does not see it
    inside = Window.partitionBy("h", "_b").orderBy(toward("x"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    passed = Window.partitionBy("h").orderBy(toward("_b")).rowsBetween(Window.unboundedPreceding, -1)
    place = F.when(F.col("_kind") == 1, F.col("x"))
    edge = F.min_by("_v", place) if after else F.max_by("_v", place)
    edges = axis.groupBy("h", "_b").agg(edge.alias("_e")).select("h", "_b", F.last("_e", ignorenulls=True).over(passed).alias("_p"))
    seen = axis.withColumn("_i", F.last("_v", ignorenulls=True).over(inside)).filter("_kind = 0").join(edges, ["h", "_b"])
    return seen.select(*asks.columns, F.coalesce("_i", "_p").alias("found"))


def _marks(functions: DataFrame, place: str, value: str) -> DataFrame:
    return functions.select("h", F.col(place).alias("x"), F.col(value).alias("value"))


def _compose(pairs: DataFrame, functions: DataFrame) -> DataFrame:
    """(h, s, e) of every block of the next level from those of its halves."""
    sizes = functions.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    size = lambda side: sizes.select(F.col("h").alias(side), F.col("n").alias(f"n_{side}"))
    both = pairs.filter("hr is not null").select("h", "hl", "hr").distinct().join(size("hl"), "hl").join(size("hr"), "hr")
    both = materialize(both.withColumnRenamed("h", "new"), "restore-pairs")
    rows = lambda side: functions.select(F.col("h").alias(side), "s", "e")
    # few starts on the left: from their ends to the next start on the right
    ahead = both.filter("n_hl <= n_hr").join(rows("hl"), "hl").select(F.col("hr").alias("h"), F.col("e").alias("x"), "new", "s")
    ahead = nearest_mark(ahead, _marks(functions, "s", "e"), after=True).filter("found is not null")
    ahead = ahead.groupBy(F.col("new").alias("h"), F.col("found").alias("e")).agg(F.max("s").alias("s"))
    # few on the right: from their starts to the last end on the left
    back = both.filter("n_hl > n_hr").join(rows("hr"), "hr").select(F.col("hl").alias("h"), F.col("s").alias("x"), "new", "e")
    back = nearest_mark(back, _marks(functions, "e", "s"), after=False).filter("found is not null")
    back = back.groupBy(F.col("new").alias("h"), F.col("found").alias("s")).agg(F.min("e").alias("e"))
    single = functions.join(pairs.filter("hr is null").select("h").distinct(), "h", "left_semi")
    out = ahead.select("h", "s", "e").unionByName(back.select("h", "s", "e")).unionByName(single.select("h", "s", "e"))
    return materialize(out.distinct(), "restore-functions")


def ordered_subset_restore(
    selection: DataFrame, source: DataFrame, *, domain: str, index: str, pos: str, key: Column
) -> DataFrame:
    """(domain, index, source_pos) for an ordered selection (``index`` 0..n-1 per domain) of a source stream.

    Raises when the indexes have gaps or a target has no match.  Null domains and null keys are values like others.
    """
    named = F.unhex(F.md5(F.to_json(F.struct(F.col(domain).cast("string").alias("d"), key.cast("string").alias("k")))))
    targets = materialize(selection.select(F.col(domain).alias("dom"), F.col(index).cast("bigint").alias("blk"), named.alias("h")), "restore-targets")
    gaps = targets.groupBy("dom").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("blk").alias("d"), F.max("blk").alias("m")).filter("n <> d or m <> n - 1")
    if not gaps.isEmpty():
        raise ValueError("selection indexes are not contiguous")
    places = source.select(named.alias("h"), F.col(pos).cast("bigint").alias("s")).join(targets.select("h").distinct(), "h", "left_semi")
    functions = materialize(places.distinct().withColumn("e", F.col("s")), "restore-source")
    blocks, levels = targets, []
    last = targets.agg(F.max("blk")).first()[0] or 0
    while last > 0:
        half = F.col("blk") % 2
        pairs = blocks.groupBy("dom", F.expr("blk div 2").alias("blk")).agg(
            F.max(F.when(half == 0, F.col("h"))).alias("hl"), F.max(F.when(half == 1, F.col("h"))).alias("hr"))
        pairs = materialize(pairs.withColumn("h", F.when(F.col("hr").isNull(), F.col("hl")).otherwise(
            F.unhex(F.md5(F.concat("hl", "hr"))))), "restore-blocks")
        levels.append((pairs, functions))
        functions = _compose(pairs, functions)
        blocks, last = pairs.select("dom", "blk", "h"), last // 2
    if not blocks.join(functions, "h", "left_anti").isEmpty():
        raise ValueError("the selection cannot be restored from this source")
    state = blocks.select("dom", "blk", F.lit(START).cast("bigint").alias("x"))
    for pairs, functions in reversed(levels):
        here = join_null_safe(state, pairs.drop("h"), ["dom", "blk"])
        left = here.select("dom", (F.col("blk") * 2).alias("blk"), "x")
        asks = here.filter("hr is not null").select(F.col("hl").alias("h"), "x", "dom", (F.col("blk") * 2 + 1).alias("blk"))
        right = nearest_mark(asks, _marks(functions, "s", "e"), after=True).select("dom", "blk", F.col("found").alias("x"))
        state = materialize(left.unionByName(right), "restore-places")
    leaves = join_null_safe(state, targets, ["dom", "blk"])
    if levels:
        functions = levels[0][1]
    found = nearest_mark(leaves.select("h", "x", "dom", "blk"), _marks(functions, "s", "e"), after=True)
    return found.select(F.col("dom").alias(domain), F.col("blk").alias(index), F.col("found").alias("source_pos"))
