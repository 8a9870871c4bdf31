"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of consecutive words in which words ``q`` apart are identical, ``q`` being its
smallest period, that holds at least ``exponent`` periods and ``least`` words and that no
neighbouring word extends.

Periods below ``SHORT`` are found by direct lag scans.  A run whose lag stretch holds T equal
pairs has one at every T-th place, so a lag is probed there and only hits with equal
neighbours are extended.

Periods from P to 2P - 1 (P = SHORT, 2 SHORT, ...) are one scale.  Windows of P words choose
the smallest hash of their m-word pieces, m = P / 2 (leftmost of ties).  Inside a run windows one period apart
hold the same words, so their minima lie one period apart and have the same hash: each pair of
equal minimizers at a distance of the scale is a seed, extended by comparing words in both
directions.  Pieces that are periodic themselves (m / 3 or less) are left out, or a stretch of
one repeated word would make every place a minimizer; they lie in runs that the smaller
scales have found.  A run of smallest period q has such a piece in every q places, since a
period of its own would divide q.  Equal pieces that are left are more than m / 3 apart, so a
minimizer has at most a dozen partners within 2P words and the work stays n log n.

Two lags that give the same stretch are multiples of its smallest period; the smallest stays.
A document is one task's work, held as four-byte word numbers.

Defined cases: a null or empty text has no words and no runs; copies and ties are found row by
row; a null id is kept; an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollstat.llm.common import bounded_batches

#: Smallest period that is left to minimizers; half of it has to hold ``least`` words.
SHORT = 48

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
#: An odd factor, its inverse modulo 2**64, and a mixer of word numbers.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    return np.fromiter(map(seen.__getitem__, words), np.int32, len(words))


def _forward(ids: np.ndarray, left: int, right: int) -> int:
    """Length of the common run of words that starts at ``left`` and at ``right`` > ``left``."""
    total, most, step = 0, len(ids) - right, 64
    while total < most:
        size = min(step, most - total)
        differ = ids[left + total:left + total + size] != ids[right + total:right + total + size]
        if differ.any():
            return total + int(differ.argmax())
        total, step = total + size, step * 4
    return total


def _backward(ids: np.ndarray, left: int, right: int) -> int:
    """Length of the common run of words that ends before ``left`` and before ``right`` > ``left``."""
    total, step = 0, 64
    while total < left:
        size = min(step, left - total)
        differ = ids[left - total - size:left - total] != ids[right - total - size:right - total]
        if differ.any():
            return total + int(differ[::-1].argmax())
        total, step = total + size, step * 4
    return total


class _Runs:
    """Runs found so far: (start, end) -> smallest lag."""

    def __init__(self, ids: np.ndarray, least: int, exponent: int):
        self.ids, self.least, self.exponent = ids, least, exponent
        self.found: dict[tuple[int, int], int] = {}

    def extend(self, places: np.ndarray, lag: int) -> None:
        """Stretches with ``lag`` through the seeds ``places`` (ascending)."""
        end = -1
        for place in places.tolist():
            if place < end:  # in the stretch of the seed before
                continue
            start = place - _backward(self.ids, place, place + lag)
            same = place + _forward(self.ids, place, place + lag)
            end = max(same, place + 1)
            if same + lag - start >= max(self.least, self.exponent * lag):
                key = (start, same + lag)
                self.found[key] = min(lag, self.found.get(key, lag))


def _scan_lag(runs: _Runs, lag: int) -> None:
    ids = runs.ids
    pairs = max(runs.least, runs.exponent * lag) - lag
    if len(ids) - lag < pairs:
        return
    places = np.arange(pairs - 1, len(ids) - lag, pairs)
    places = places[ids[places] == ids[places + lag]]
    if not len(places):
        return
    # half of the equal pairs lie to the right or to the left of the probe
    top = len(ids) - lag - 1
    right, left = np.ones(len(places), bool), np.ones(len(places), bool)
    for off in range(1, min(8, (pairs - 1) // 2) + 1):
        after, before = places + off, places - off
        right &= (after <= top) & (ids[np.minimum(after, top)] == ids[np.minimum(after, top) + lag])
        left &= (before >= 0) & (ids[np.maximum(before, 0)] == ids[np.maximum(before, 0) + lag])
    runs.extend(places[right | left], lag)


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` keys: block minima from both sides."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, _NONE, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _scan_scale(runs: _Runs, period: int, prefix: np.ndarray, inverse: np.ndarray) -> None:
    """Runs of periods ``period`` to ``2 * period - 1`` from pairs of equal minimizers."""
    piece = period // 2
    hashes = (prefix[piece:] - prefix[:-piece]) * inverse[:len(prefix) - piece]
    hashes ^= hashes >> np.uint64(32)
    hashes *= _MIX
    keys = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    for (start, end), lag in runs.found.items():
        if lag * 3 <= piece:
            keys[start:max(end - piece + 1, start)] = _NONE
    minima = np.unique(_window_minima(keys, period - piece + 1))
    places = (minima[minima != _NONE] & _LOW).astype(np.int64)
    order = np.lexsort((places, hashes[places]))
    places, marks = places[order], hashes[places[order]]
    seeds: list[np.ndarray] = []
    for ahead in range(1, len(places)):
        lag = places[ahead:] - places[:-ahead]
        near = (marks[ahead:] == marks[:-ahead]) & (lag < 2 * period)
        if not near.any():
            break
        near &= lag >= period
        seeds.append(np.stack([lag[near], places[:-ahead][near]]))
    if not seeds:
        return
    lags, at = np.concatenate(seeds, axis=1)
    order = np.lexsort((at, lags))
    lags, at = lags[order], at[order]
    cuts = np.flatnonzero(np.diff(lags)) + 1
    for group_lag, group in zip(lags[np.r_[0, cuts]] if len(lags) else [], np.split(at, cuts), strict=False):
        runs.extend(group, int(group_lag))


def find_runs(ids: np.ndarray, least: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word numbers, by start and period."""
    if exponent < 3 or 2 * least > SHORT:
        raise ValueError(f"at least 3 periods, and at most {SHORT // 2} words as the least length")
    runs = _Runs(ids, least, exponent)
    n = len(ids)
    for lag in range(1, min(SHORT - 1, n // exponent) + 1):
        _scan_lag(runs, lag)
    if n >= exponent * SHORT:
        values = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        values ^= values >> np.uint64(29)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(_BASE, n), out=prefix[1:])
        inverse = _powers(_INVERSE, n)
        period = SHORT
        while exponent * period <= n:
            _scan_scale(runs, period, prefix, inverse)
            period *= 2
    return sorted((start, end - start, lag) for (start, end), lag in runs.found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False where some run holds the word after the run's first period."""
    depth = np.zeros(n + 1, np.int32)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text: Column | str = "text", least: int = 24, exponent: int = 3) -> DataFrame:
    """One row per document: id, n_words, runs (start, length, period), collapsed text.

    The collapsed text keeps the first period of every run; its words are joined by one space.
    """
    bounded_batches(docs.sparkSession)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, collapsed = [], [], []
            for value in batch.column("text"):
                words = (value.as_buffer().to_pybytes() if value.is_valid else b"").split()
                own = find_runs(numbered(words), least, exponent)
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                if own:
                    words = [w for w, keep in zip(words, kept_words(len(words), own).tolist(), strict=True) if keep]
                collapsed.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(run)), pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_column).alias("id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(search, f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_column)


def with_planted_tails(text: Column, hashes: Column) -> Column:
    """Words of ``text``; where the hash h ends in 0, a tail repeats itself.

    With g = h / 10 and n words, word i >= a becomes word a + (i - a) mod p for a = g mod n and
    p = 1 + (n - a) / (3 + g mod 8), in whole numbers.
    """
    @F.pandas_udf("string")
    def plant(texts: pd.Series, keys: pd.Series) -> pd.Series:
        out = []
        for value, h in zip(texts, keys, strict=True):
            words = value.encode("utf-8", "surrogatepass").split() if value is not None and h % 10 == 0 else []
            if words:
                n, g = len(words), int(h) // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                unit = words[a:a + p]
                times = -(-(n - a) // p)
                value = b" ".join(words[:a] + (unit * times)[:n - a]).decode("utf-8", "surrogatepass")
            out.append(value)
        return pd.Series(out, dtype=object)

    return plant(text, hashes)


def run_digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per document: the run of greatest length / period and digests of all runs and of the collapsed text."""
    def better(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(left != right, F.when(left > right, -1).otherwise(1)).when(
            a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.signum(a["period"] - b["period"]).cast("int"))

    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    top = F.try_element_at(F.array_sort("runs", better), F.lit(1))
    rows = found.withColumn("top", top)
    return rows.select(
        id_column, F.size("runs").cast("bigint").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"),
        F.col("top.period").alias("period"), F.floor(F.expr("1000 * top.length div top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
