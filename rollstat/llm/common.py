"""What several operators share: text blocks, grouped batches, stable keys."""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; every other character belongs to a word.
WHITE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

_GAP = re.compile(rb"[\x20\x09-\x0D]")
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2000, bytes_: int = 8 << 20) -> None:
    """Arrow batches of a few megabytes, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(bytes_))


def without_white(text: Column) -> Column:
    """``text`` without ASCII white space; byte-wise replacement is the cheapest form."""
    for char in WHITE:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; rows without an id count as id ''."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % modulus


def blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The whole of ``data`` in pieces that end at white space."""
    start, end = 0, len(data)
    while start < end:
        stop = start + size
        if stop >= end:
            yield data[start:]
            return
        gap = _GAP.search(data, stop)
        stop = gap.start() if gap else end
        yield data[start:stop]
        start = stop


def runs(batches: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from batches sorted by ``keys``.

    Each frame holds as many complete groups as a batch brings; a group that goes on in the
    next batch waits for it.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[list(keys)].iloc[-1].tolist()
        same = np.ones(len(batch), bool)
        for key, value in zip(keys, last, strict=True):
            same &= (batch[key] == value).to_numpy()
        cut = len(batch) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut == 0 and held:
            first = held[0]
            if first[list(keys)].iloc[0].tolist() != last:
                yield pd.concat(held, ignore_index=True)
                held = []
        if cut:
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member index of each of ``n`` nodes' components under the pairs (left, right)."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(label, before):
            break
    return label
