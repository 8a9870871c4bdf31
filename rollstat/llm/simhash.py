"""SimHash near-duplicates through vantage-point trees.

Fingerprints are partitioned by their Hamming distance to vantage points.  Over all 64 bits
distances crowd around 32 and a triangle bound of a few bits prunes next to nothing, so the
shards are cut by the distance over a band of the bits, which is a metric of its own: of
``BANDS`` bands one must hold at most ``max_bits // BANDS`` of a pair's differing bits, and in
that band's tree the two lie within that many rings of each other, for every vantage point
(triangle bound).  A fingerprint is stored in its own shard and queries the shards that its
bound overlaps; at 3 bits over four bands the bound is 0 and its own shard is the only one.
A shard above ``SHARD`` fingerprints is split again by itself, by bands of the bits outside its
own (so many bands that the bound is 0), until it is small or those bits run out.  Each row carries
the ``path`` of shards it comes from, so shards of different sources or values never pool and none
is larger than the one it comes from.
In a shard a vantage-point tree over all 64 bits, pruned by the full bound, finds the pairs.
Each shard returns its links as stars, one row per linked fingerprint; components join them.

Equal fingerprints are one row throughout.  Defined cases: a null or wordless text has
fingerprint zero and links like any other; ids that are null count for nothing in
``component_id`` unless no other is there; rows that repeat an id each return a row; an empty
table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollstat.llm.common import blocks, bounded_batches, local_components, runs
from rollstat.llm.components import components
from rollstat.session import materialize

BITS = 64
BANDS = 4
SHARD = 2048
SEED = 42


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of the whole text; bits set in over half the shingle hashes."""
    counts, total, tail = np.zeros(BITS, np.int64), 0, []
    data = (text or "").encode("utf-8", "surrogatepass")
    for block in blocks(data):
        words = tail + block.lower().split()  # bytes: A-Z only, ASCII white space only
        if len(words) < shingle:
            tail = words
            continue
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=False)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        tail = words[len(words) - shingle + 1:]
    if not total and tail:
        digest = np.array([xxhash.xxh64_intdigest(b" ".join(tail), seed)], np.uint64)
        counts, total = np.unpackbits(digest.view(np.uint8), bitorder="little").astype(np.int64), 1
    bits = np.packbits(2 * counts > total, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text)


def _parts(bits: list[int], bands: int) -> list[list[int]]:
    return [list(map(int, part)) for part in np.array_split(np.array(bits, int), bands)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _vantage_points(count: int) -> list[int]:
    return np.random.default_rng(7).integers(-(1 << 63), 1 << 63, count, dtype=np.int64).tolist()


def close_pairs(points: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of distinct fingerprints within ``max_bits``: a vantage-point tree."""
    left, right = [], []
    everything = np.arange(len(points))
    stack = [(everything, everything)]
    while stack:
        stored, asking = stack.pop()
        inner = None
        if len(stored) * len(asking) > 1 << 14:
            vantage = points[stored[len(stored) // 2]]
            to_stored, to_asking = np.bitwise_count(points[stored] ^ vantage), np.bitwise_count(points[asking] ^ vantage).astype(int)
            radius = int(np.median(to_stored))
            inner = to_stored <= radius
        if inner is None or inner.all():
            for k in range(0, len(asking), 512):  # bounded memory
                near = np.bitwise_count(points[asking[k:k + 512], None] ^ points[stored][None, :]) <= max_bits
                a, b = np.nonzero(near)
                a, b = asking[k + a], stored[b]
                left.append(a[a < b])
                right.append(b[a < b])
            continue
        stack.append((stored[inner], asking[to_asking <= radius + max_bits]))
        stack.append((stored[~inner], asking[to_asking > radius - max_bits]))
    return np.concatenate(left), np.concatenate(right)


def _star_rows(keys: np.ndarray, prints: np.ndarray, max_bits: int) -> pd.DataFrame:
    """Links inside each key's shard as (fp, root)."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    shard = np.repeat(np.arange(len(starts)), sizes)
    small = np.flatnonzero(sizes[shard] <= 64)
    for step in range(1, 64):  # small shards together: the pairs at each distance in the order
        near = small[small + step < len(keys)]
        near = near[shard[near] == shard[near + step]]
        if not len(near):
            break
        hit = near[np.bitwise_count(prints[near] ^ prints[near + step]) <= max_bits]
        left.append(hit)
        right.append(hit + step)
    for k in np.flatnonzero(sizes > 64):
        a, b = close_pairs(prints[starts[k]:starts[k] + sizes[k]], max_bits)
        left.append(a + starts[k])
        right.append(b + starts[k])
    a, b = np.concatenate([*left, np.empty(0, int)]).astype(int), np.concatenate([*right, np.empty(0, int)]).astype(int)
    root = local_components(len(keys), a, b)
    linked = np.flatnonzero(root != np.arange(len(keys)))
    return pd.DataFrame({"fp": prints[linked].view(np.int64), "root": prints[root[linked]].view(np.int64)})


def _search(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(batches, ["path"]):
            yield _star_rows(frame["path"].to_numpy(), frame["fp"].to_numpy().view(np.uint64), max_bits)
    return run


def _shards(prints: DataFrame, masks: dict[int, int], bands: int, bound: int) -> DataFrame:
    """(parent, path, fp) to (tree, path, fp): one row per band, and one per overlapped shard beyond its own.

    ``masks`` has the bits of each tree's band; a parent's trees are its number times ``bands`` and on.
    ``path`` is a hash of the parent's path, the tree and the shard.  Equal hashes would only be
    searched together.
    """
    # at bound 0 more points cost nothing: fifteen tell the values of a 16-bit band apart
    points = _vantage_points(15 if bound == 0 else 2)
    width = BITS // BANDS + 1 if bound == 0 else BITS + 1 + 2 * bound
    known = F.array(*[F.lit(masks.get(t, 0)) for t in range(max(masks) + 1)])
    rows = prints.select("fp", "path", F.explode(F.transform(
        F.array(*[F.lit(k) for k in range(bands)]), lambda k: F.col("parent") * bands + k)).alias("tree"))
    rows = rows.withColumn("mask", F.element_at(known, F.col("tree") + 1))
    shard = F.lit(0).cast("bigint")
    for p in points:
        shard = shard * width + F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(F.col("mask"))).cast("bigint")
    rows = rows.select("tree", "path", shard.alias("shard"), "fp")
    if bound == 0:
        return rows.select("tree", F.xxhash64("path", "tree", "shard").alias("path"), "fp")
    # every ring the bound reaches; a pair meets in the shards that both reach
    shifts = [a * width + b for a in range(-bound, bound + 1) for b in range(-bound, bound + 1)]
    return rows.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts]))).select(
        "tree", F.xxhash64("path", "tree", F.col("shard") + F.col("shift")).alias("path"), "fp")


def linked_prints(prints: DataFrame, max_bits: int = 3, shard_rows: int = SHARD) -> DataFrame:
    """Links between distinct fingerprints ``fp`` within ``max_bits``, as stars (fp, root)."""
    bands = BANDS
    #: tree -> bits not used by its ancestors
    free = {0: list(range(BITS))}
    rows, found = prints.select("fp", F.lit(0).alias("parent"), F.lit(0).cast("bigint").alias("path")), []
    while True:
        masks, rest = {}, {}
        for parent, bits in free.items():
            for k, band in enumerate(_parts(bits, bands)):
                masks[parent * bands + k] = _mask(band)
                rest[parent * bands + k] = [b for b in bits if b not in band]
        shards = materialize(_shards(rows, masks, bands, max_bits // bands), "shards")
        sizes = shards.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shards = shards.join(sizes, "path")
        # all but the last bits are equal in a shard now, so it holds no more than the values of those
        last = min(len(b) for b in rest.values()) <= 12
        fits = shards if last else shards.filter(F.col("n") <= shard_rows)
        grouped = fits.select("path", "fp").repartition("path").sortWithinPartitions("path", "fp")
        found.append(materialize(grouped.mapInPandas(_search(max_bits), "fp bigint, root bigint"), "stars"))
        if last:
            break
        rows = shards.filter(F.col("n") > shard_rows).select("fp", F.col("tree").alias("parent"), "path")
        wide = [r["parent"] for r in rows.select("parent").distinct().collect()]  # at most bands**level tree numbers
        if not wide:
            break
        # at bound 0 a fingerprint is in one shard a tree; overlapping ones would multiply it by level
        free, bands = {t: rest[t] for t in wide}, max(BANDS, max_bits + 1)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def simhash_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, max_bits: int = 3, *carry: Column,
) -> DataFrame:
    """One row per input row: id, fp (signed), fingerprint (hex), component_id, and ``carry`` columns."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), fingerprints(F.col(text_column), shingle).alias("fp"), *carry)
    rows = materialize(rows, "prints")
    prints = rows.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(linked_prints(prints, max_bits), "fp", "root")
    joined = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    joined = materialize(joined, "roots")
    names = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_column), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        *[c for c in rows.columns if c not in ("id", "fp")])


def simhash_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    return simhash_components(docs, id_column, text_column, shingle, max_bits).select(id_column, "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of each component stays: the smallest id, then the smallest hash of the row."""
    keys = [F.xxhash64(*docs.columns).alias("k1"), F.xxhash64(F.lit(1), *docs.columns).alias("k2")]
    found = simhash_components(docs, id_column, text_column, shingle, max_bits, *keys)
    best = found.groupBy("component_id").agg(F.min(F.struct(
        F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id"), "k1", "k2")).alias("b")).select("b.k1", "b.k2")
    packed = docs.select(F.struct(*docs.columns).alias("row"), *keys)
    return packed.join(best, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
