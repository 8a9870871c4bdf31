"""Embedding near-duplicates through NN-descent.

A graph of near neighbours is refined round by round: whoever shares a neighbour is compared
(the neighbours-of-neighbours join), and each vector keeps its ``k`` best.  A list whose ``k``
entries all reach the threshold is saturated and grows to twice its length in the next round.
The first lists come from blocks of vectors that fall on the same sides of random hyperplanes.
After the rounds an audit compares hash-chosen vectors with all others in blocks and measures
recall; while it is too low, further blocks and rounds follow, and if they stop helping, all
vectors are compared block against block.  Vectors are drawn until ``AUDIT_LINKED`` of them have
links or ``AUDIT_MOST`` are drawn; with fewer links seen, there are also so many tables that a
pair at the threshold shares a code in one of them with a chance of ``recall``.

Links within the threshold join vectors to components.  A link that no list holds, because both
its ends have saturated lists, can still join two components: the saturated members of different
components are compared exactly, but for pairs that the components' means and radii rule out.
Inside a component every pair is settled, so a list that was still too short costs nothing:

* with all members within half the threshold angle of the component's mean, all are linked (by
  the triangle inequality of angles) and no pair is looked at, whatever the size;
* other components are compared block against block; only counts leave a task.

Equal vectors are one vector with a count throughout.  Cosines are in double precision.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, and so does a vector of another length than its counterpart; ids that repeat return a row
each and count as vectors; null ids count for nothing in ``component_id`` unless alone; an empty
table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollstat.llm.common import local_components, runs
from rollstat.llm.components import components
from rollstat.llm.positions import numbered
from rollstat.session import materialize

_LOG = logging.getLogger(__name__)

BLOCK = 512
#: In-neighbours of a hub that one task compares with its list.
FAN = 256
#: An audit with this many linked vectors is enough; it draws no more than so many vectors.
AUDIT_LINKED, AUDIT_MOST = 100, 8192


def _matrix(column: pd.Series) -> np.ndarray:
    """One row per vector; vectors of several lengths stay an array of arrays."""
    units = column.to_numpy()
    if len({len(u) for u in units}) > 1:
        return units
    return np.stack(units).astype(np.float64) if len(units) else np.empty((0, 0))


def _rows(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The chosen rows, which have one length, as a matrix."""
    return x[rows] if x.ndim == 2 or not len(rows) else np.stack(x[rows]).astype(np.float64)


def unit_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, unit) of every row; ``unit`` is null for vectors that link with nothing."""
    @F.pandas_udf("array<double>")
    def unit(column: pd.Series) -> pd.Series:
        out = []
        for v in column:
            x = None if v is None else np.array([np.nan if a is None else a for a in v], float)
            if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                out.append(None)
                continue
            x = x / np.abs(x).max()  # no overflow in the square
            out.append(x / math.sqrt(float(x @ x)))
        return pd.Series(out, dtype=object)

    return vectors.select(F.col(id_column).alias("id"), unit(F.col(vector_column).cast("array<double>")).alias("unit"))


def _codes(planes: int, tables: int, first: int):
    """Side of ``planes`` random hyperplanes in each of ``tables`` tables."""
    @F.pandas_udf("array<bigint>")
    def of(column: pd.Series) -> pd.Series:
        codes, length = np.zeros((len(column), tables), np.int64), column.map(len).to_numpy()
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            x = _matrix(column.iloc[rows])
            for t in range(tables):
                normal = np.random.default_rng([11, first + t]).standard_normal((n, planes))
                codes[rows, t] = ((x @ normal) > 0) @ (1 << np.arange(planes, dtype=np.int64))
        return pd.Series(codes.tolist())

    return of


def _best(sims: np.ndarray, ids: np.ndarray, asking: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``sims`` its ``k`` best columns, as (a, b, sim)."""
    top = min(int(k.max()), sims.shape[1])
    order = np.argpartition(-sims, top - 1, axis=1)[:, :top]
    values = np.take_along_axis(sims, order, axis=1)
    rank = np.argsort(np.argsort(-values, axis=1, kind="stable"), axis=1, kind="stable")
    keep = (rank < k[:, None]) & (values > -2)
    rows = np.nonzero(keep)[0]
    return asking[rows], ids[order[keep]], values[keep]


def _frame(parts: list[tuple]) -> pd.DataFrame:
    a, b, s = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0) for i in range(3))
    return pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64), "sim": s.astype(float)})


def _groups(frame: pd.DataFrame, keys: list[str]) -> Iterator[np.ndarray]:
    same = np.ones(len(frame) - 1, bool)
    for key in keys:
        column = frame[key].to_numpy()
        same &= column[1:] == column[:-1]
    yield from np.split(np.arange(len(frame)), np.flatnonzero(~same) + 1)


def _block_lists(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(batches, ["length", "table", "code", "part"]):
            parts, x, ids = [], _matrix(frame["unit"]), frame["node"].to_numpy()
            for rows in _groups(frame, ["length", "table", "code", "part"]):
                if len(rows) < 2:
                    continue
                for at in range(0, len(rows), BLOCK):
                    asking = rows[at:at + BLOCK]
                    sims = _rows(x, asking) @ _rows(x, rows).T
                    sims[np.arange(len(asking)), at + np.arange(len(asking))] = -9
                    parts.append(_best(sims, ids[rows], ids[asking], np.full(len(asking), k)))
            yield _frame(parts)
    return run


def _planes(n: int) -> int:
    return max(1, math.ceil(math.log2(max(n, 2) / 64)))


def _least_tables(n: int, threshold: float, recall: float) -> int:
    """Tables in one of which a pair at the threshold shares its code with a chance of ``recall``."""
    same = (1 - math.acos(max(-1.0, min(threshold, 1.0))) / math.pi) ** _planes(n)
    return 1 if same >= 1 else math.ceil(math.log(max(1 - recall, 1e-6)) / math.log1p(-max(same, 1e-9)))


def _first_lists(nodes: DataFrame, n: int, k: int, tables: int, first: int) -> DataFrame:
    coded = nodes.select("node", "unit", F.size("unit").alias("length"), F.posexplode(_codes(_planes(n), tables, first)("unit")).alias("table", "code"))
    sizes = coded.groupBy("length", "table", "code").agg(F.count(F.lit(1)).alias("size"))
    # a crowded side is dealt out by hash; its members are near each other anyway
    part = F.pmod(F.xxhash64("node", "table"), F.ceil(F.col("size") / BLOCK).cast("bigint"))
    placed = coded.join(sizes, ["length", "table", "code"]).select("length", "table", "code", part.alias("part"), "node", "unit")
    placed = placed.repartition("length", "table", "code", "part").sortWithinPartitions("length", "table", "code", "part")
    return placed.mapInPandas(_block_lists(k), "a bigint, b bigint, sim double")


def _merge(candidates: DataFrame, limits: DataFrame) -> DataFrame:
    """The ``k`` best distinct neighbours of each vector; ``k`` from ``limits``."""
    distinct = candidates.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    lists = distinct.groupBy("a").agg(F.reverse(F.array_sort(F.collect_list(F.struct("sim", (-F.col("b")).alias("minus_b"))))).alias("l"))
    cut = lists.join(limits, "a").select("a", "k", F.explode(F.expr("slice(l, 1, k)")).alias("e"))
    return cut.select("a", "k", (-F.col("e.minus_b")).alias("b"), F.col("e.sim").alias("sim"))


def _join_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Around each vector: the in-neighbours against its list, and its list against itself."""
    for frame in runs(batches, ["center", "fan"]):
        parts, x = [], _matrix(frame["unit"])
        ids, own, floor, k = (frame[c].to_numpy() for c in ("node", "own", "floor", "k"))
        for rows in _groups(frame, ["center", "fan"]):
            listed, asking = rows[own[rows]], rows[~own[rows]]
            if not len(listed):
                continue
            sets = [asking] if frame["fan"].iat[rows[0]] else [asking, listed]
            for some in sets:
                if not len(some):
                    continue
                sims = _rows(x, some) @ _rows(x, listed).T
                sims[ids[some][:, None] == ids[listed][None, :]] = -9
                sims[sims <= floor[some][:, None]] = -9  # no better than what the list ends with
                parts.append(_best(sims, ids[listed], ids[some], k[some]))
        yield _frame(parts)


def _refine(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """Candidates (a, b, sim) from neighbours of neighbours that would improve a list."""
    ends = lists.groupBy("a").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("n"), F.first("k").alias("k")).select(
        F.col("a").alias("node"), F.when(F.col("n") < F.col("k"), F.lit(-1.5)).otherwise(F.col("low")).alias("floor"), "k")
    known = nodes.join(ends, "node").select("node", "unit", "floor", "k")
    fans = lists.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("fans")).select(F.col("b").alias("center"), "fans")
    asking = lists.select(F.col("b").alias("center"), F.col("a").alias("node")).join(fans, "center").select(
        "center", F.pmod(F.xxhash64("node"), F.col("fans")).alias("fan"), "node", F.lit(False).alias("own"))
    listed = lists.select(F.col("a").alias("center"), F.col("b").alias("node")).join(fans, "center", "left").select(
        "center", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("fans", F.lit(1)) - 1)).alias("fan"), "node", F.lit(True).alias("own"))
    members = asking.unionByName(listed).join(known, "node").select("center", "fan", "node", "own", "floor", "k", "unit")
    members = members.repartition("center", "fan").sortWithinPartitions("center", "fan")
    return members.mapInPandas(_join_lists, "a bigint, b bigint, sim double")


def _limits(nodes: DataFrame, lists: DataFrame | None, k: int, threshold: float) -> DataFrame:
    """(a, k): twice the length for lists all of whose entries reach the threshold."""
    if lists is None:
        return nodes.select(F.col("node").alias("a"), F.lit(k).alias("k"))
    full = lists.groupBy("a").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("n"), F.first("k").alias("k"))
    wide = full.select("a", F.when((F.col("n") >= F.col("k")) & (F.col("low") >= threshold), F.col("k") * 2).otherwise(F.col("k")).alias("k"))
    return nodes.select(F.col("node").alias("a")).join(wide, "a", "left").select("a", F.coalesce("k", F.lit(k)).alias("k"))


def near_links(nodes: DataFrame, threshold: float, queries: DataFrame) -> DataFrame:
    """Exact (a, b) with cosine >= threshold from a bounded set of query rows (node, unit) to all nodes."""
    asked = [(r["node"], r["unit"]) for r in queries.collect()]
    wanted = np.array([q for q, _ in asked], np.int64)
    by_length: dict[int, list[int]] = {}
    for i, (_, unit) in enumerate(asked):
        by_length.setdefault(len(unit), []).append(i)
    blocks = {n: (wanted[at], np.array([asked[i][1] for i in at])) for n, at in by_length.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            parts = []
            for n, rows in frame.groupby(frame["unit"].map(len)):
                if n in blocks:
                    ids, x = blocks[n]
                    y, others = _matrix(rows["unit"]), rows["node"].to_numpy()
                    for at in range(0, len(x), BLOCK):
                        i, j = np.nonzero(x[at:at + BLOCK] @ y.T >= threshold)
                        parts.append((ids[at + i], others[j], np.ones(len(i))))
            out = _frame(parts)
            yield out[out["a"] != out["b"]][["a", "b"]]

    return nodes.mapInPandas(run, "a bigint, b bigint")


def _audit_links(nodes: DataFrame, n: int, threshold: float, rows: int) -> tuple[DataFrame, bool]:
    """Exact links of hash-chosen vectors, and whether enough were seen."""
    chance = F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(1 << 30)) / float(1 << 30)
    low, high, truth = 0.0, rows / max(n, 1), None
    while True:
        drawn = materialize(near_links(nodes, threshold, nodes.filter((chance >= low) & (chance < high))), "truth")
        truth = drawn if truth is None else truth.unionByName(drawn)
        if high >= 1 or truth.select("a").distinct().count() >= AUDIT_LINKED:
            return truth, True
        if high >= AUDIT_MOST / n:
            return truth, False
        low, high = high, min(high * 4, max(high, AUDIT_MOST / n))


def _exact_blocks(threshold: float):
    """The links of two blocks as stars."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(batches, ["i", "j"]):
            units, ids, side, own = frame["unit"], frame["node"].to_numpy(), frame["left"].to_numpy(), frame["own"].to_numpy()
            length, out = units.map(len).to_numpy(), []
            for rows in _groups(frame, ["i", "j"]):
                for n in np.unique(length[rows]):
                    some = rows[length[rows] == n]
                    a, b = some[side[some]], some[~side[some] | own[some]]
                    x, y = _matrix(units.iloc[a]), _matrix(units.iloc[b])
                    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                    for at in range(0, len(a) if len(b) else 0, BLOCK):
                        i, j = np.nonzero(x[at:at + BLOCK] @ y.T >= threshold)
                        left.append(a[at + i])
                        right.append(b[j])
                    star = local_components(len(frame), np.concatenate(left), np.concatenate(right))
                    far = some[star[some] != some]
                    out.append(pd.DataFrame({"a": ids[far], "b": ids[star[far]]}, dtype=np.int64))
            yield pd.concat(out)
    return run


def exact_links(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b) that join whatever vectors reach the threshold: every block against every block."""
    blocks = math.ceil(max(n, 1) / (4 * BLOCK))
    dealt = nodes.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")).select(
        "node", "unit", "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).select(
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "unit",
        (F.col("block") <= F.col("other")).alias("left"), (F.col("block") == F.col("other")).alias("own"))
    dealt = dealt.repartition("i", "j").sortWithinPartitions("i", "j")
    return materialize(dealt.mapInPandas(_exact_blocks(threshold), "a bigint, b bigint"), "exact")


def _joined_share(truth: DataFrame, roots: DataFrame) -> float:
    """Mean over the audited vectors with links of the share of the links inside a component."""
    left, right = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    hit = F.avg(F.coalesce(F.col("ra") == F.col("rb"), F.lit(False)).cast("int")).alias("hit")
    share = truth.join(left, "a", "left").join(right, "b", "left").groupBy("a").agg(hit).agg(F.avg("hit")).first()[0]
    return 1.0 if share is None else share


def _angle(cosine):
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _dot(left: str, right: str):
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _near_shapes(reach: float):
    """Pairs of components whose means are within both radii and ``reach`` of each other."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(batches, ["length", "i", "j"]):
            out, x = [], _matrix(frame["m"])
            root, radius, side, own = (frame[c].to_numpy() for c in ("root", "radius", "left", "own"))
            for rows in _groups(frame, ["length", "i", "j"]):
                a, b = rows[side[rows]], rows[~side[rows] | own[rows]]
                if not len(a) or not len(b):
                    continue
                angle = np.arccos(np.clip(_rows(x, a) @ _rows(x, b).T, -1, 1))
                i, j = np.nonzero(angle <= radius[a][:, None] + radius[b][None, :] + reach)
                i, j = root[a[i]], root[b[j]]
                differ = i != j if not own[rows[0]] else i < j
                out.append(np.stack([np.minimum(i, j)[differ], np.maximum(i, j)[differ]], axis=1))
            yield pd.DataFrame(np.concatenate([*out, np.empty((0, 2), np.int64)]), columns=["p", "q"])
    return run


def _best_across(threshold: float):
    """The best link of each pair of blocks, if it reaches the threshold."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(batches, ["p", "q", "i", "j"]):
            parts, x, ids, side = [], _matrix(frame["unit"]), frame["node"].to_numpy(), frame["left"].to_numpy()
            for rows in _groups(frame, ["p", "q", "i", "j"]):
                a, b = rows[side[rows]], rows[~side[rows]]
                if not len(a) or not len(b):
                    continue
                sims = _rows(x, a) @ _rows(x, b).T
                u, v = np.unravel_index(int(np.argmax(sims)), sims.shape)
                if sims[u, v] >= threshold:
                    parts.append((ids[a[[u]]], ids[b[[v]]], sims[[u], [v]]))
            yield _frame(parts)
    return run


def saturated_links(nodes: DataFrame, lists: DataFrame, roots: DataFrame, threshold: float) -> DataFrame | None:
    """(a, b, sim) that join all components linked through vectors whose lists are saturated.

    Angles obey the triangle inequality, so what the means and radii rule out has no link.
    """
    ends = lists.groupBy("a").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("n"), F.first("k").alias("k"))
    full = ends.filter((F.col("n") >= F.col("k")) & (F.col("low") >= threshold)).select(F.col("a").alias("node"))
    members = materialize(nodes.select("node", "unit").join(full, "node").join(roots, "node").select("root", "node", "unit"), "saturated")
    shapes = materialize(_means(members), "means")
    shapes = members.join(shapes, "root").groupBy("root").agg(F.first("m").alias("m"), F.max(_angle(_dot("unit", "m"))).alias("radius"))
    shapes = materialize(shapes, "shapes")
    count = shapes.count()
    if count < 2:
        return None
    slack = 1e-6  # above the rounding of angles
    reach = math.acos(max(-1.0, min(threshold, 1.0))) + slack
    blocks = math.ceil(count / BLOCK)
    dealt = shapes.withColumn("block", F.pmod(F.xxhash64("root"), F.lit(blocks)).cast("int")).select(
        "root", "m", "radius", "block", F.size("m").alias("length"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).select(
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "length", "root", "m", "radius",
        (F.col("block") <= F.col("other")).alias("left"), (F.col("block") == F.col("other")).alias("own"))
    dealt = dealt.repartition("length", "i", "j").sortWithinPartitions("length", "i", "j")
    near = materialize(dealt.mapInPandas(_near_shapes(reach), "p bigint, q bigint"), "near")
    if near.isEmpty():
        return None
    sides = near.select("p", "q", F.col("p").alias("root"), F.col("q").alias("far"), F.lit(True).alias("left")).unionByName(
        near.select("p", "q", F.col("q").alias("root"), F.col("p").alias("far"), F.lit(False).alias("left")))
    sides = sides.join(shapes.select(F.col("root").alias("far"), "m", "radius"), "far")
    asked = members.join(sides, "root").withColumn("dot", _dot("unit", "m")).filter(_angle(F.col("dot")) <= F.col("radius") + reach)
    asked = materialize(asked.select("p", "q", "left", "node", "unit", "dot"), "asked")
    # most linked components are linked where they face each other
    best = [F.max_by(F.struct("node", "unit"), F.when(side, F.col("dot"))).alias(name) for name, side in (("l", F.col("left")), ("r", ~F.col("left")))]
    sizes = [F.ceil(F.count_if(side) / BLOCK).cast("int").alias(name) for name, side in (("nl", F.col("left")), ("nr", ~F.col("left")))]
    pairs = asked.groupBy("p", "q").agg(*best, *sizes).filter("nl > 0 and nr > 0").select(
        "p", "q", "nl", "nr", F.col("l.node").alias("a"), F.col("r.node").alias("b"), _dot("l.unit", "r.unit").alias("sim"))
    pairs = materialize(pairs, "facing")
    facing = pairs.filter(F.col("sim") >= threshold).select("a", "b", "sim")
    rest = asked.join(pairs.filter(F.col("sim") < threshold).select("p", "q", "nl", "nr"), ["p", "q"])
    mine, theirs = F.when(F.col("left"), F.col("nl")).otherwise(F.col("nr")), F.when(F.col("left"), F.col("nr")).otherwise(F.col("nl"))
    rest = rest.select("p", "q", "left", "node", "unit", F.pmod(F.xxhash64("node"), mine).cast("int").alias("block"),
                       F.explode(F.sequence(F.lit(0), theirs - 1)).alias("other"))
    rest = rest.select("p", "q", F.when(F.col("left"), F.col("block")).otherwise(F.col("other")).alias("i"),
                       F.when(F.col("left"), F.col("other")).otherwise(F.col("block")).alias("j"), "left", "node", "unit")
    rest = rest.repartition("p", "q", "i", "j").sortWithinPartitions("p", "q", "i", "j")
    return materialize(facing.unionByName(rest.mapInPandas(_best_across(threshold), "a bigint, b bigint, sim double")), "across")


def neighbour_lists(
    nodes: DataFrame, threshold: float, k: int = 12, tables: int = 4, rounds: int = 3, recall: float = 0.98, audit_rows: int = 512,
) -> tuple[DataFrame, list[float]]:
    """Refined lists (a, k, b, sim) of ``nodes`` (node, unit), and the recall of each audit."""
    lists, _, audits = near_components(nodes, threshold, k, tables, rounds, recall, audit_rows)
    return lists, audits


def near_components(
    nodes: DataFrame, threshold: float, k: int = 12, tables: int = 4, rounds: int = 3, recall: float = 0.98, audit_rows: int = 512,
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Refined lists (a, k, b, sim), components (node, root) of the links, and the recall of each audit.

    Recall is the mean over hash-chosen vectors with a link (of ``audit_rows`` or more drawn) of the
    share of their links whose two ends are in one component, the form in which links are used.
    """
    n = nodes.count()
    truth, enough = _audit_links(nodes, n, threshold, audit_rows)
    least = 0 if enough else _least_tables(n, threshold, recall)
    lists, audits = None, []
    while True:
        first = _first_lists(nodes, n, k, tables, first=tables * len(audits))
        candidates = first if lists is None else first.unionByName(lists.select("a", "b", "sim"))
        lists = materialize(_merge(candidates, _limits(nodes, lists, k, threshold)), "lists")
        for _ in range(rounds):
            before = lists
            found = _refine(nodes, before).unionByName(before.select("a", "b", "sim"))
            lists = materialize(_merge(found, _limits(nodes, before, k, threshold)), "lists")
        roots = components(lists.filter(F.col("sim") >= threshold), "a", "b")
        roots = materialize(roots, "roots")
        across = saturated_links(nodes, lists, roots, threshold)
        if across is not None:
            links = lists.filter(F.col("sim") >= threshold).select("a", "b").unionByName(across.select("a", "b"))
            roots = materialize(components(links, "a", "b"), "roots")
        audits.append(_joined_share(truth, roots))
        _LOG.info("recall of the audits: %s", audits)
        if audits[-1] >= recall and tables * len(audits) >= least:
            return lists, roots, audits
        if audits[-1] < recall and len(audits) > 2 and audits[-1] <= audits[-3]:
            roots = materialize(components(exact_links(nodes, n, threshold), "a", "b"), "roots")
            audits.append(_joined_share(truth, roots))
            _LOG.warning("further rounds found nothing, all vectors compared; recall of the audits: %s", audits)
            return lists, roots, audits


def _block_counts(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(batches, ["root", "i", "j"]):
            x, ids, count, side = _matrix(frame["unit"]), frame["node"].to_numpy(), frame["copies"].to_numpy(), frame["left"].to_numpy()
            nodes, links = [], []
            for rows in _groups(frame, ["root", "i", "j"]):
                a, b = rows[side[rows]], rows[~side[rows]]
                if not len(b):  # a block with itself
                    near = _rows(x, a) @ _rows(x, a).T >= threshold
                    np.fill_diagonal(near, False)
                    nodes.append(ids[a])
                    links.append(near @ count[a])
                    continue
                near = _rows(x, a) @ _rows(x, b).T >= threshold
                nodes += [ids[a], ids[b]]
                links += [near @ count[b], near.T @ count[a]]
            yield pd.DataFrame({"node": np.concatenate(nodes), "links": np.concatenate(links).astype(np.int64)})
    return run


def _means(members: DataFrame) -> DataFrame:
    """(root, m): the mean direction of each component's members (root, unit)."""
    mean = members.select("root", F.posexplode("unit").alias("at", "x")).groupBy("root", "at").agg(F.sum("x").alias("x"))
    mean = mean.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("m")).select("root", F.col("m.x").alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, v: s + v * v))
    return mean.select("root", F.transform("m", lambda v: F.coalesce(v / F.nullif(norm, F.lit(0.0)), F.lit(0.0))).alias("m"))


def component_links(nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(node, links): links of each member of a component to the component's other vectors."""
    members = materialize(nodes.join(roots, "node").select("root", "node", "unit", "copies"), "members")
    safe = math.cos(math.acos(min(threshold, 1.0)) / 2) + 1e-9
    shape = members.join(_means(members), "root").groupBy("root").agg(
        F.min(_dot("unit", "m")).alias("nearest"), F.sum("copies").alias("total"), F.count(F.lit(1)).alias("size"))
    shape = materialize(shape.withColumn("tight", F.coalesce(F.col("nearest") >= safe, F.lit(False))), "shape")
    tight = members.join(shape.filter("tight"), "root").select("node", (F.col("total") - F.col("copies")).alias("links"))
    # others: block against block, at most BLOCK x BLOCK vectors at a time
    loose = members.join(shape.filter("not tight"), "root").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    loose = loose.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pair = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = loose.select("root", "node", "unit", "copies", "block", pair).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        ((F.col("block") < F.col("other")) | (F.col("block") == F.col("other"))).alias("left"), "node", "unit", "copies")
    placed = placed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    counted = placed.mapInPandas(_block_counts(threshold), "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))
    return tight.unionByName(counted)


def embedding_near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 12, tables: int = 4,
    rounds: int = 3, recall: float = 0.98,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    rows = materialize(unit_vectors(vectors, id_column, vector_column), "units")
    distinct = rows.filter("unit is not null").groupBy("unit").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # numbers of their own: ids may be null or repeat
    distinct = materialize(numbered(distinct.withColumn("hash", F.xxhash64("unit")), ["first", "hash", "unit"], "node").drop("hash"), "distinct")
    nodes = distinct.select("node", "unit", "copies")
    _, roots, _ = near_components(nodes.select("node", "unit"), threshold, k, tables, rounds, recall)
    links = component_links(nodes, roots, threshold)
    named = distinct.select("node", "first", "copies").join(roots, "node", "left").join(links, "node", "left")
    named = named.select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = materialize(named, "named")
    groups = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(groups, "root").select("node", "n_links", "component_id").join(distinct.select("node", "unit"), "node").select("unit", "n_links", "component_id")
    out = rows.join(named, "unit", "left")
    component = F.when(F.col("unit").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"))
