"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation again and again as it grows.  Rolling hashes of turn prefixes (128
bits: running XORs of hashes of position, role and text) show which conversations are the
beginning of longer ones; anti-joins keep the maximal ones, which are then rendered.

Turns are ordered by turn number, then role and text; positions and running hashes are computed in
chunks of turn numbers, so one huge conversation is spread over tasks.  A rendered row holds at
most ``part_turns`` turns; longer conversations give several parts.  Native operations only.

Defined cases: null role and text count as empty; a null turn comes last; rows that repeat a turn
exactly count once; a null conversation id is an id of its own; of equal conversations the
smallest id stays (null only if alone) and ``copies`` counts them; an empty table gives an empty
result; further columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollstat.session import materialize

CHUNK = 1024
_LAST = (1 << 62)


def turn_prefixes(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, pos, total, role, text, p1, p2): every turn with the hash of the prefix it ends.

    ``key`` is a struct of the conversation id, so that a null id joins like any other.
    """
    rows = conversations.select(
        F.struct(F.col(conv).alias("id")).alias("key"), F.coalesce(F.col(turn).cast("bigint"), F.lit(_LAST)).alias("slot"),
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    inside = Window.partitionBy("key", "chunk").orderBy("slot", "role", "text")
    earlier = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    counts = rows.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n")).select(
        "key", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    placed = rows.withColumn("local", F.row_number().over(inside)).join(counts, ["key", "chunk"]).select(
        "key", "chunk", (F.col("local") + F.col("before")).alias("pos"), "total", "role", "text")
    placed = placed.withColumn("h1", F.xxhash64("pos", "role", "text")).withColumn("h2", F.xxhash64(F.lit(1), "pos", "role", "text"))
    placed = materialize(placed, "turns")
    totals = placed.groupBy("key", "chunk").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2")).select(
        "key", "chunk", *[F.coalesce(F.bit_xor(f"t{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    running = Window.partitionBy("key", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.select("key", "chunk", "pos", "total", "role", "text", *[F.bit_xor(f"h{i}").over(running).alias(f"r{i}") for i in (1, 2)])
    return summed.join(totals, ["key", "chunk"]).select(
        "key", "pos", "total", "role", "text", *[F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"p{i}") for i in (1, 2)])


def maximal(prefixes: DataFrame) -> DataFrame:
    """(key, copies) of the conversations that begin no longer one, equal ones once."""
    full = prefixes.filter("pos = total").groupBy("total", "p1", "p2").agg(
        F.min(F.struct(F.col("key.id").isNull().alias("no_id"), "key")).alias("best"), F.count(F.lit(1)).alias("copies"))
    inner = prefixes.filter("pos < total").select(F.col("pos").alias("total"), "p1", "p2").distinct()
    return full.join(inner, ["total", "p1", "p2"], "left_anti").select(F.col("best.key").alias("key"), "copies")


def format_chats(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    opening: str = "<|im_start|>", closing: str = "<|im_end|>", part_turns: int = CHUNK,
) -> DataFrame:
    """One row per maximal conversation and part: id, part, n_turns, copies, rendered text."""
    prefixes = materialize(turn_prefixes(conversations, conv, turn, role, text), "prefixes")
    kept = maximal(prefixes.select("key", "pos", "total", "p1", "p2"))
    rendered = F.concat(F.lit(opening), "role", F.lit("\n"), "text", F.lit(f"{closing}\n"))
    rows = prefixes.select("key", "pos", "total", rendered.alias("turn")).join(kept, "key")
    part = F.floor((F.col("pos") - 1) / part_turns).cast("int")
    parts = rows.groupBy("key", part.alias("part")).agg(
        F.first("total").alias("n_turns"), F.first("copies").alias("copies"),
        F.array_sort(F.collect_list(F.struct("pos", "turn"))).alias("turns"))
    return parts.select(F.col("key.id").alias(conv), "part", "n_turns", "copies", F.array_join(F.col("turns.turn"), "").alias("text"))
