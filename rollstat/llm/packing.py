"""Best-fit packing of token sequences by large-item matching.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens.  A packing depends on
the lengths only, so it is planned on their histogram (at most ``capacity`` counts, however many
documents there are) and every piece finds its place by its rank among the pieces of its length:

* pieces above a third of the capacity are matched, at most two to a bin: in descending order
  each takes the largest partner that still fits;
* smaller pieces, in descending order, go to the tightest gap that holds them, or open a bin.

Both steps move whole runs of equal bins, so the plan has a few thousand rows.  Ranks are counted
in hash buckets, so a length that a third of all pieces share is spread over many tasks.

Defined cases: a null or empty text is the end token alone; ids may be null or repeat, each row is
packed; equal rows are interchangeable; an empty table gives an empty result; further columns are
ignored.  Whole texts are tokenized, in blocks that end at white space.
"""
from __future__ import annotations

import bisect
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollstat.llm.common import bounded_batches
from rollstat.session import materialize

BUCKETS = 1024
CACHED_WORDS = 500_000
_SPLIT = regex.compile(r"[\x20\x09-\x0D]+")
#: White space to Python but not to the contract's words, or beyond ASCII; each is looked for by itself, which is fastest.
_ODD_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\x0b\f\r"]
#: Words of these characters are split and lower-cased here as the tokenizer does it.
_PLAIN = regex.compile(r"[\x21-\x7eÀ-ɏ]+")
#: Marks that end words; a run of them is one part.
_TAIL = ".,;:!?%*&#|)\""
_BLOCK = 1 << 20


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones as they are, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordIds(dict):
    """Token ids (little-endian uint32 bytes) of white-space separated words, cached.

    The tokenizer lower-cases, cuts at white space and then by its own pattern, and merges
    inside each part alone, so a text's ids are those of its words in turn, and a word's those
    of its parts, which are words themselves.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.letters = _byte_letters()
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if 2 * len(self) >= CACHED_WORDS:  # what was used since the last time stays at hand
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            found = self._ids(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def _ids(self, word: str) -> bytes:
        low = word.lower()
        core = low.rstrip(_TAIL)
        plain = word.isascii() and core.isalpha() or _PLAIN.fullmatch(word) and "İ" not in word and "<|" not in word
        if not plain:
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if core.isalpha():
            if len(core) == len(word):
                return self._merged(core) if low == word else self[core]
            return self[core] + self[low[len(core):]]
        parts = self.pattern.findall(low)
        return self._merged(word) if parts == [word] else b"".join([self[p] for p in parts])

    def _merged(self, part: str) -> bytes:
        """Ids of one part, lower case already: the merges alone."""
        spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def text(self, text: str) -> Iterator[bytes]:
        start, end = 0, len(text)
        while start < end:
            stop, gap = end, None
            if start + _BLOCK < end:
                gap = _SPLIT.search(text, start + _BLOCK)
                stop = gap.start() if gap else end
            block = text[start:stop]
            if _latin(block) and "<|" not in block:  # lower case letter by letter, composed: what the tokenizer makes of it
                block = block.lower()
            odd = any(c in block for c in _ODD_SPACES)
            yield b"".join(map(self.__getitem__, [w for w in _SPLIT.split(block) if w] if odd else block.split()))
            start = stop


def word_ids(path: str) -> WordIds:
    """One cache per worker process and vocabulary; the next tasks there go on with it."""
    store = sys.modules.setdefault("_packing_word_ids", types.ModuleType("_packing_word_ids")).__dict__
    if path not in store:
        store[path] = WordIds(path)
    return store[path]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, size = word_ids(path), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                held, piece = b"", 0
                for block in (*ids.text(text), tail):
                    held += block
                    while len(held) > size:
                        rows.append((doc, piece, held[:size]))
                        held, piece = held[size:], piece + 1
                rows.append((doc, piece, held))
            out = pd.DataFrame({
                "id": pd.Series([r[0] for r in rows], dtype=batch["id"].dtype), "piece": np.array([r[1] for r in rows], np.int32),
                "length": np.array([len(r[2]) // 4 for r in rows], np.int64),
                "ids_crc32": np.array([zlib.crc32(r[2]) for r in rows], np.int64)})
            if with_ids:
                out["ids"] = [np.frombuffer(r[2], "<u4").astype(np.int32) for r in rows]
            yield out
    return run


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ``ids``) of every piece of every text."""
    bounded_batches(docs.sparkSession)
    # a null id would turn a whole batch into floats
    rows = docs.select(F.struct(F.col(id_column)).alias("key"), F.coalesce(text_column, F.lit("")).alias("text"))
    kind = docs.schema[id_column].dataType.simpleString()
    rows = rows.select(F.col(f"key.{id_column}").cast("string").alias("id"), "text")
    schema = "id string, piece int, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    cut = rows.mapInPandas(_pieces(tokenizer, capacity, end_id, with_ids), schema)
    return cut.withColumn("id", F.col("id").cast(kind)).withColumn("start", F.col("piece").cast("bigint") * capacity)


def match_large(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int], int]]:
    """Bins (number, lengths, gap) of the pieces above a third of the capacity, at most two to a bin."""
    left = {n: c for n, c in counts.items() if 3 * n > capacity and c > 0}
    order, bins = sorted(left), []
    while order:
        big = order[-1]
        here = left[big]
        k = bisect.bisect_right(order, capacity - big) - 1  # the largest partner that fits
        if k < 0:
            bins.append((here, [big], capacity - big))
            order.pop()
            continue
        partner = order[k]
        pairs = here // 2 if partner == big else min(here, left[partner])
        if not pairs:  # one piece left, as long as its partner would be
            if k == 0:
                bins.append((here, [big], capacity - big))
                order.pop()
                continue
            partner = order[k - 1]
            pairs = min(here, left[partner])
        bins.append((pairs, [big, partner], capacity - big - partner))
        for n in (big, partner):
            left[n] -= pairs
        for n in {big, partner}:
            if not left[n]:
                order.remove(n)
    return bins


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first bin, pieces per bin, offset in the bin)."""
    plan, ranks, bins = [], dict.fromkeys(counts, 0), 0
    gaps: list[tuple[int, int, int]] = []  # (gap, first bin, number of bins), ascending

    def place(length: int, first: int, each: int, offset: int, items: int) -> None:
        plan.append((length, ranks[length], ranks[length] + items, first, each, offset))
        ranks[length] += items

    for number, lengths, gap in match_large(counts, capacity):
        if len(lengths) == 2 and lengths[0] == lengths[1]:
            place(lengths[0], bins, 2, 0, 2 * number)
        else:
            for k, n in enumerate(lengths):
                place(n, bins, 1, sum(lengths[:k]), number)
        if gap:
            gaps.append((gap, bins, number))
        bins += number
    gaps.sort()
    for length in sorted((n for n in counts if 3 * n <= capacity and counts[n] > 0), reverse=True):
        todo = counts[length]
        while todo:
            k = bisect.bisect_left(gaps, (length, -1, -1))
            if k == len(gaps):
                each = capacity // length
                number = -(-todo // each)
                gaps.append((capacity, bins, number))
                bins += number
                continue
            gap, first, number = gaps.pop(k)
            each = gap // length
            full = min(number, todo // each)
            if full:
                place(length, first, each, capacity - gap, full * each)
                todo -= full * each
                if gap - each * length:
                    bisect.insort(gaps, (gap - each * length, first, full))
            if full < number:
                rest, used = todo, full
                if rest:  # fewer than a bin takes
                    place(length, first + full, rest, capacity - gap, rest)
                    todo, used = 0, full + 1
                    if gap - rest * length:
                        bisect.insort(gaps, (gap - rest * length, first + full, 1))
                if used < number:
                    bisect.insort(gaps, (gap, first + used, number - used))
    return plan


def place_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (id, piece, start, length, ...) with sequence_id and offset."""
    spark: SparkSession = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = packing_plan(counts, capacity)
    schema = "plan_length bigint, rank0 bigint, rank1 bigint, bin0 bigint, each bigint, base bigint"
    table = spark.createDataFrame(plan, schema)
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(BUCKETS)))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = bucketed.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["length", "bucket"]).withColumn(
        "rank", F.col("rank") + F.col("before"))
    # one plan row per piece; the plan's size is bounded by the number of lengths
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank1")))
    at = F.col("rank") - F.col("rank0")
    return placed.withColumn("sequence_id", F.col("bin0") + F.floor(at / F.col("each"))).withColumn(
        "offset", F.col("base") + at % F.col("each") * F.col("length")).drop(
        "bucket", "before", "rank", "plan_length", "rank0", "rank1", "bin0", "each", "base")


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``)."""
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id, id_column, text_column, with_ids), "pieces")
    return place_pieces(pieces, capacity).withColumnRenamed("id", id_column)
