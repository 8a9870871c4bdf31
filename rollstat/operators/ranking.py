"""Group statistics, ranks and positions that hold when one group is huge.

A plain ``row_number`` or ``avg`` window over a group puts the whole group on one
task.  The helpers below avoid that:

* statistics are aggregated (partial aggregation on the map side) and joined back;
* ranks are split into buckets of the order key, so a group is spread over many
  tasks and each row's rank is its rank in the bucket plus the rows before it.

There is one plan for every size.  Buckets are hash prefixes, or the partitions of a range
sort over the whole order key that is written once; Spark sizes them.  Group keys are joined
null-safe: rows without a group form one.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollstat.functions.columns import col
from rollstat.session import materialize


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls included; the keys come from the left side."""
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    renamed = right.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in right.columns if c not in names])
    if not names:
        return left.join(renamed, F.lit(True), how)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(renamed, on, how).drop(*names.values())


def with_group_stats(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Append per-group aggregates to every row (aggregate, then join back)."""
    stats = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return join_null_safe(df, stats, keys)


def scalar_struct(df: DataFrame, **aggs: Column) -> Column:
    """Global aggregates of ``df`` as one struct-valued scalar subquery."""
    return df.agg(F.struct(*[a.alias(n) for n, a in aggs.items()]).alias("_s")).scalar()


def cumulate(
    df: DataFrame, order: Sequence[Column], group: Sequence[str], name: str,
    weight: Column | None = None, keep: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``weight`` (default: row count) inside ``group``.

    ``_bucket`` follows ``order``: the window runs inside a bucket and the total of the
    earlier buckets, one row each, is added.
    """
    counted = weight is None
    rows = df.withColumn("_w", F.lit(1) if counted else weight)
    keys = [*group, "_bucket"]
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys).agg(F.sum("_w").alias("_t")).select(
        *keys, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before")
    )
    if keep is not None:
        offsets = offsets.filter(F.col("_before") < keep)
    inside = Window.partitionBy(*keys).orderBy(*order)
    run = F.row_number().over(inside) if counted else F.sum("_w").over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the bucket tells most rows apart; the null-safe part is for the group
    out = join_null_safe(rows, offsets, keys).withColumn(name, F.col("_before") + run)
    if keep is not None:
        out = out.filter(F.col(name) <= keep)
    return out.drop("_bucket", "_before", "_w")


def hash_position(
    df: DataFrame,
    key: str,
    group: Sequence[str] = (),
    *,
    tie: Sequence[str] = (),
    name: str = "position",
    keep: int | None = None,
    hex_digits: int = 4,
) -> DataFrame:
    """1-based rank by a hex hash column, optionally only the first ``keep`` per group.

    The first hex digits of the hash are the bucket: even, known without sampling and
    the same in every run.  With ``keep`` the buckets that start after rank ``keep``
    are dropped before the rows are shuffled.  ``hex_digits`` scales the bucket count
    (16**digits per group).
    """
    bucketed = df.withColumn("_bucket", F.substring(F.col(key), 1, hex_digits))
    order = [F.col(key), *[col(t) for t in tie]]
    return cumulate(bucketed, order, group, name, keep=keep)


def with_range_bucket(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """``_bucket`` = partition of a range sort by ``columns``; written once, so it stays what it is.

    A value that a third of the rows share is split by the columns after it.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    return materialize(df.repartitionByRange(*columns).withColumn("_bucket", F.spark_partition_id()), "ranges")


#: Types that may be large: they stay out of range sorts and windows.
_WIDE = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """Hash of the whole row, for every column type: rows that differ nowhere share it."""
    parts = [F.to_json(F.struct(f.name)) if _has_map(f.dataType) else F.col(f.name) for f in df.schema]
    return F.struct(F.xxhash64(*parts).alias("a"), F.hash(*parts).alias("b"))


def position(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    *,
    name: str = "position",
    keep: int | None = None,
) -> DataFrame:
    """1-based position in the ascending order of ``order``, per group.

    Rows that tie follow the hash of the whole row, whatever their columns are; rows that are
    equal throughout all stay and take neighbouring positions.  Texts and nested columns are
    fetched for the ranked keys afterwards, and are hashed only where keys do tie.
    """
    keys = list(dict.fromkeys([*group, *order]))
    others = [f for f in df.schema if f.name not in keys]

    def ranked(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        return cumulate(rows, [F.col(c) for c in by], group, name, keep=keep)

    if not others:
        return ranked(with_range_bucket(df, order), order)
    tagged = df.withColumn("_tie", row_hash(df))
    by = [*order, "_tie"]
    if not any(isinstance(f.dataType, _WIDE) for f in others):
        return ranked(with_range_bucket(tagged, by), by).drop("_tie")
    rows = with_range_bucket(df.select(*keys), order)
    if rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        return join_null_safe(df, ranked(rows, order), keys)
    rows = with_range_bucket(tagged.select(*keys, "_tie"), by)
    # equal rows are one row with several places, of which ``keep`` may cut some
    copies = rows.groupBy(*keys, "_tie").agg(F.count(F.lit(1)).alias("_copies"))
    places = ranked(rows, by).groupBy(*keys, "_tie").agg(F.min(name).alias("_first"), F.max(name).alias("_last"))
    places = materialize(join_null_safe(places, copies, [*keys, "_tie"]), "places")
    found = join_null_safe(tagged, places, [*keys, "_tie"])
    one = found.filter("_copies = 1").select(*df.columns, F.col("_first").alias(name))
    more = found.filter("_copies > 1").dropDuplicates([*keys, "_tie"]).select(
        *df.columns, F.explode(F.sequence("_first", "_last")).alias(name))
    return one.unionByName(more)


def cumulative_counts(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Distinct (group, value) with the row count ``n`` and the count of rows at or below, ``cum``.

    Ties shrink to one row before any ordering.
    """
    distinct = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return cumulate(with_range_bucket(distinct, value), [F.col(value)], group, "cum", weight=F.col("n"))


def exact_quantiles(
    df: DataFrame, value: str, quantiles: dict[str, float], group: Sequence[str] = (), *, discrete: bool = False, accuracy: int = 10_000,
) -> DataFrame:
    """Exact quantiles per group: linear interpolation, or the lower value when ``discrete``; nulls don't count.

    A mergeable sketch per group brackets each wanted rank.  A second pass counts what lies below a
    bracket and keeps the distinct values inside, about 4 rows in ``accuracy``, where the rank is
    selected exactly.  Groups too small for a sketch keep all their values.  A rank outside its
    bracket shows, as it meets no value inside; then the brackets are opened to all values.
    """
    group, qs = list(group), sorted(set(quantiles.values()))
    rows = df.select(*group, F.col(value).alias("_v"))
    margin = 2 / accuracy
    wanted = [min(max(q + side * margin, 0.0), 1.0) for q in qs for side in (-1, 1)]
    edges = materialize(rows.groupBy(*group).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        F.percentile_approx("_v", wanted, accuracy).alias("_p")), "sketches")

    def select(bracketed: bool) -> DataFrame:
        e = edges if bracketed else edges.withColumn("_p", F.transform("_p", lambda _: F.lit(None)))
        e = e.select(*group, F.struct("_n", "_lo", "_hi", "_p").alias("_e"))
        known = rows.filter("_v is not null")
        known = join_null_safe(known, e, group) if group else known.withColumn("_e", e.scalar())
        few, v = F.col("_e._n") < 4 * accuracy, F.col("_v")
        part = lambda x, inside: F.struct(x.alias("v"), F.lit(inside).alias("inside"))
        key = F.when(F.lit(False), part(v, 1))
        for j in range(len(qs)):
            low = F.coalesce(F.when(~few, F.col("_e._p")[2 * j]), F.col("_e._lo"))
            high = F.coalesce(F.when(~few, F.col("_e._p")[2 * j + 1]), F.col("_e._hi"))
            key = key.when(v < low, part(low, 0)).when(v <= high, part(v, 1))
        counts = known.select(*group, key.alias("_key")).filter("_key is not null").groupBy(*group, "_key").agg(F.count(F.lit(1)).alias("n"))
        cums = cumulate(with_range_bucket(counts, "_key"), [F.col("_key")], group, "cum", weight=F.col("n"))
        total = F.col("_e._n")
        cums = join_null_safe(cums, e, group) if group else cums.withColumn("_e", e.scalar())
        at = lambda rank: F.min(F.when(F.col("cum") >= rank, F.col("_key")))
        aggs = []
        for name, q in quantiles.items():
            if discrete:
                aggs.append(F.struct(at(F.greatest(F.lit(1), F.ceil(F.lit(q) * total))).alias("low"), F.lit(0.0).alias("between")).alias(name))
            else:
                h = F.lit(q) * (total - 1)
                aggs.append(F.struct(at(F.floor(h) + 1).alias("low"), at(F.ceil(h) + 1).alias("high"), F.max(h - F.floor(h)).alias("between")).alias(name))
        per = cums.groupBy(*group).agg(*aggs)
        sizes = edges.select(*group, "_n")
        return materialize(join_null_safe(sizes, per, group, "left") if group else per.withColumn("_n", sizes.scalar()), "quantiles")

    found = select(True)
    ends = [f"{n}.{end}.inside" for n in quantiles for end in (("low",) if discrete else ("low", "high"))]
    missed = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(0)) == 0 for c in ends])
    if not found.filter((F.col("_n") > 0) & missed).isEmpty():
        found = select(False)
    low, high = (lambda n: F.col(f"{n}.low.v")), (lambda n: F.col(f"{n}.high.v"))
    return found.select(*group, *[
        (low(n) if discrete else low(n) + (high(n) - low(n)) * F.col(f"{n}.between")).alias(n) for n in quantiles])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the smallest in ``order`` (ties by the row's hash).

    The choice is made on (keys, order, hash); rows are fetched for the chosen ones only.
    """
    tagged = df.withColumn("_row", F.xxhash64(*df.columns))
    best = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("_row").alias("row")))
    chosen = tagged.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best.row").alias("_row"))
    return join_null_safe(tagged, chosen, [*keys, "_row"], "left_semi").dropDuplicates([*keys, "_row"]).select(*df.columns)
