"""Structured Streaming jobs over arriving rollout files.

Every job takes a ``Place``: the folders of its sink and its checkpoint, and a trigger.  With the
same place a stopped or restarted job goes on where it was; a batch that is repeated overwrites
what it wrote.  The default place is new and in the shared folder, and the job ends when the files
present are read (``availableNow``).
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rollstat.operators.ranking import join_null_safe
from rollstat.session import shared_dir


@dataclass(frozen=True)
class Place:
    """Where a stream keeps its result and its progress, and when it runs."""

    sink: str
    checkpoint: str
    trigger: Mapping[str, object] = field(default_factory=lambda: {"availableNow": True})

    @classmethod
    def new(cls, spark: SparkSession, label: str) -> Place:
        return cls(shared_dir(spark, label), shared_dir(spark, f"{label}-state"))


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_stream(stream: DataFrame, place: Place, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run to the end of what is there, or for good with another trigger."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", place.checkpoint).trigger(
        **place.trigger).foreachBatch(each).start()
    query.awaitTermination()


def _read_batches(spark: SparkSession, path: str, schema: T.StructType, number: str = "batch") -> DataFrame:
    with_batch = T.StructType([*schema.fields, T.StructField(number, T.LongType())])
    try:
        return spark.read.schema(with_batch).parquet(path)
    except Exception as err:  # no batch was written: the source was empty
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], with_batch)


def collect_to_table(stream: DataFrame, label: str, mode: str = "append", place: Place | None = None) -> DataFrame:
    """Run the stream into a table, one folder per batch, and read it back."""
    place = place or Place.new(stream.sparkSession, label)
    run_stream(stream, place, mode, lambda df, i: df.write.mode("overwrite").parquet(f"{place.sink}/batch={i}"))
    return _read_batches(stream.sparkSession, place.sink, stream.schema)


def last_state(stream: DataFrame, label: str, keys: Sequence[str], place: Place | None = None) -> DataFrame:
    """The newest row of every key; a batch writes only the rows it changed."""
    out = collect_to_table(stream, label, "update", place)
    rest = [c for c in stream.columns if c not in keys]
    newest = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(*keys, "_r.*").select(*stream.columns)


# ---- running scorecard ------------------------------------------------------------------

def stream_score_rates(rows: DataFrame, dataset: str, correct: Column) -> DataFrame:
    """Scored rows, correct rows and live accuracy per dataset so far (the state is one row per dataset)."""
    scored = F.count(F.lit(1))
    return rows.groupBy(dataset).agg(scored.alias("scored_rows"), F.count_if(correct).alias("correct"),
                                     (F.count_if(correct) / scored).alias("live"))


# ---- keyed state ------------------------------------------------------------------------

def with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, *, pandas: bool = True) -> DataFrame:
    """Rows of a watermarked stream through a processor with state and event-time timers per ``key``.

    The processor gets data frames, for many rows of few keys, or else rows, for few rows of many keys.
    """
    rows.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    grouped = rows.groupBy(key)
    return (grouped.transformWithStateInPandas if pandas else grouped.transformWithState)(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


# ---- group assembly ---------------------------------------------------------------------

GROUP_OUT = "uid string, group_no bigint, size int, score double, members array<string>, dropped boolean"


class GroupAssembly(StatefulProcessor):
    """All that a prompt keeps is one value, read and written once per batch; a timer stands at the newest member plus the timeout."""

    def __init__(self, n: int, wait_ms: int):
        self.n, self.wait = n, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "done bigint, deadline bigint, members array<string>, scores array<double>")

    def _take(self, uid: str, number: int, members: list[tuple], dropped: bool) -> Row:
        scores = [score for _, score in members]
        total = None if None in scores else float(sum(scores))
        return Row(uid=uid, group_no=number, size=len(members), score=None if total is None or math.isnan(total) else total,
                   members=[member for member, _ in members], dropped=dropped)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done, deadline, members, scores = self.group.get() or (0, 0, [], [])
        waiting, out, before = list(zip(members, scores, strict=True)), [], deadline
        arrived = sorted(((r["ms"], r["member"], r["score"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
        for ms, member, score in arrived:
            if waiting and ms is not None and ms > deadline:  # the row comes after the group's time, whichever batch brings it
                out.append(self._take(key[0], -1, waiting, True))
                waiting = []
            waiting.append((member, score))
            deadline = deadline if ms is None else max(deadline, ms + self.wait)
            if len(waiting) == self.n:
                out.append(self._take(key[0], done, waiting, False))
                done, waiting = done + 1, []
        deadline = deadline if waiting else 0
        if before != deadline:
            if before:
                self.handle.deleteTimer(before)
            if deadline:
                self.handle.registerTimer(deadline)
        self.group.update((done, deadline, [member for member, _ in waiting], [score for _, score in waiting]))
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        done, _, members, scores = self.group.get()
        self.group.update((done, 0, [], []))
        if members:
            yield self._take(key[0], -1, list(zip(members, scores, strict=True)), True)

    def close(self) -> None:
        pass


def stream_group_assembly(rows: DataFrame, uid: str, ts: str, score: str, n: int, timeout: str, late: str = "1 day", member: str | None = None) -> DataFrame:
    """Emit a prompt group with its ``members`` once n responses are in; a group without news for ``timeout`` is ``dropped``.

    Dropped groups come out too, with the members they had and group number -1: as soon as a later row of the
    prompt or the watermark shows that their time is over.  Rows later than ``late`` are left out.  The state of
    a prompt is fewer than n members, however many responses it gets.
    """
    wait = int(pd.Timedelta(timeout).total_seconds() * 1000)
    name = F.col(member).cast("string") if member else F.lit(None).cast("string")
    slim = rows.select(F.col(uid).cast("string").alias("uid"), F.col(ts).alias("ts"), F.unix_millis(F.col(ts)).alias("ms"), F.col(score).cast("double").alias("score"), name.alias("member"))
    return with_state(slim.withWatermark("ts", late), "uid", GroupAssembly(n, wait), GROUP_OUT, pandas=False)


# ---- mixture per finished step ----------------------------------------------------------

SIGNAL_OUT = "domain string, step bigint, t bigint, raw double, ema double, gap double, velocity double, signal double, _ready boolean"


class DomainSignal(StatefulProcessor):
    """Per domain: sums of the open steps, the moving average, the initial value and the last averages.

    A step is finished when the watermark passes its end; then its row comes out, once.
    """

    def __init__(self, step_ms: int, ema_window: int, initial_steps: int, velocity_window: int, velocity_windows: int, kl_floor: float = 1e-6):
        self.step_ms, self.alpha, self.first = step_ms, 2.0 / (ema_window + 1.0), initial_steps
        self.window, self.windows, self.floor = velocity_window, velocity_windows, kl_floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "step bigint", "s double, n bigint")
        self.path = handle.getValueState("path", "t bigint, first double, ring array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            sums = batch.groupby(batch["ms"] // self.step_ms * self.step_ms)["reward"].agg(["sum", "count"])
            for step, s, n in zip(sums.index.tolist(), sums["sum"].tolist(), sums["count"].tolist(), strict=True):
                if self.open.containsKey((step,)):
                    old = self.open.getValue((step,))
                    s, n = s + old[0], n + old[1]
                else:
                    self.handle.registerTimer(step + self.step_ms)
                self.open.updateValue((step,), (float(s), int(n)))
        yield from ()

    def _finish(self, domain: str, step: int) -> dict:
        s, n = self.open.getValue((step,))
        self.open.removeKey((step,))
        t, first, ring = self.path.get() if self.path.exists() else (0, 0.0, [])
        ring, raw = list(ring), max(0.0, -s / n) if n else None
        last = ring[-1] if ring else None
        ema = raw if last is None or raw is None else self.alpha * raw + (1 - self.alpha) * last
        t += 1
        if t <= self.first:
            first = None if raw is None or first is None else first + raw / self.first
        ring = [*ring, ema][-(self.window * self.windows + 1):]
        self.path.update((t, first, ring))
        used = min(self.windows, t // self.window - 1)
        ready = t >= 2 * self.window and t >= self.first and first is not None and used > 0
        gap = velocity = 0.0
        if ready and ema is not None:
            ends = [ring[-1 - k * self.window] for k in range(used + 1)]
            changes = [(new - old) / max(old, self.floor) for new, old in zip(ends, ends[1:], strict=False) if new is not None and old is not None]
            velocity, gap = max(0.0, -sum(changes) / used), max(0.0, ema / max(first, self.floor))
        return {"domain": domain, "step": step, "t": t, "raw": raw, "ema": ema, "gap": gap, "velocity": velocity,
                "signal": gap * velocity, "_ready": ready}

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        steps = sorted(k[0] for k in self.open.keys() if k[0] + self.step_ms <= end)
        if steps:
            yield pd.DataFrame([self._finish(key[0], step) for step in steps])

    def close(self) -> None:
        pass


def stream_mixture(
    rows: DataFrame, ts: str, every: str, domain: str, reward: Column, label: str, place: Place | None = None, *, late: str = "1 day",
    ema_window: int, initial_steps: int, velocity_window: int, velocity_windows: int, update_interval: int, floor: float, temperature: float,
    kl_floor: float = 1e-6,
) -> DataFrame:
    """Mixture per step and domain as steps finish; a step is ``every`` of event time.

    A step is finished when the watermark, ``late`` behind the newest row, passes its end.  A batch writes the
    rows of the steps that it finished, where a sampler reads them, and the mixture in force (one row per
    domain); it reads no more than that of the batch before.  Gives the rows of all finished steps so far.
    """
    from rollstat.operators.domains import with_due_mixture

    spark = rows.sparkSession
    place = place or Place.new(spark, label)
    step_ms = int(pd.Timedelta(every).total_seconds() * 1000)
    slim = rows.select(F.col(ts).alias("ts"), F.unix_millis(F.col(ts)).alias("ms"), F.col(domain).cast("string").alias("domain"), reward.cast("double").alias("reward"))
    signals = with_state(slim.withWatermark("ts", late), "domain", DomainSignal(
        step_ms, ema_window, initial_steps, velocity_window, velocity_windows, kl_floor), SIGNAL_OUT)
    held_schema = "domain string, held double"

    def add(batch: DataFrame, i: int) -> None:
        held = spark.read.schema(held_schema).parquet(f"{place.sink}/held/{i - 1}") if i else spark.createDataFrame([], held_schema)
        due = with_due_mixture(batch, "step", update_interval=update_interval, floor=floor, temperature=temperature)
        upto = Window.partitionBy("domain").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        due = due.withColumn("_last", F.last("_due", ignorenulls=True).over(upto))
        now = join_null_safe(due, held, ["domain"], "left").withColumn("_held", F.coalesce("_last", "held"))
        out = now.withColumn("mixture", F.coalesce("_held", 1.0 / F.col("_k")))
        out.withColumn("step", F.timestamp_millis("step")).drop("_k", "_due", "_last", "_held", "held", "_ready").write.mode("overwrite").parquet(f"{place.sink}/schedule/batch={i}")
        newest = now.groupBy("domain").agg(F.max_by("_held", "step").alias("held")).filter("held is not null")
        rest = join_null_safe(held, newest.select("domain"), ["domain"], "left_anti")
        # never coalesced: that task would do the joins of all partitions and keep the memory of each until its end
        newest.unionByName(rest).write.mode("overwrite").parquet(f"{place.sink}/held/{i}")

    run_stream(signals, place, "append", add)
    schema = T.StructType([T.StructField("step", T.TimestampType()) if f.name == "step" else f for f in signals.schema if f.name != "_ready"]).add("mixture", "double")
    return _read_batches(spark, f"{place.sink}/schedule", schema).drop("batch")


# ---- dynamic sampling -------------------------------------------------------------------

def stream_dynamic_sampling(
    rows: DataFrame, uid: str, acc: str, domain: str, quotas: Mapping[str, int], max_rounds: int, label: str, place: Place | None = None
) -> DataFrame:
    """Collect informative groups round by round until every domain quota is met, then emit a batch.

    After ``max_rounds`` rounds without a full batch the round's own groups are taken
    unfiltered. Groups are complete inside a round. Emitted rows carry ``batch_no``,
    ``filtered`` and their round.
    """
    from rollstat.operators.sampling import informative_groups

    spark = rows.sparkSession
    place = place or Place.new(spark, label)
    path, kept_path, state_path = f"{place.sink}/batches", f"{place.sink}/kept", f"{place.sink}/state"

    def state_before(i: int) -> tuple[list[int], int]:
        """Open rounds and emitted batches before round ``i``, from the table of states: one row per round."""
        if i == 0:
            return [], 0
        # written last in its round, so a round that failed half-way is done again as a whole
        found = spark.read.schema("open array<int>, emitted int, round int").parquet(state_path).filter(F.col("round") == i - 1).take(2)
        if len(found) != 1:
            raise RuntimeError(f"the state of round {i - 1} is missing from {state_path}")
        return list(found[0]["open"]), found[0]["emitted"]

    def pick(pool: DataFrame) -> DataFrame:
        heads = pool.groupBy(uid).agg(F.min("round").alias("_round"), F.min(domain).alias("_d"))
        from rollstat.operators.ranking import hash_position

        keyed = heads.filter(F.col("_d").isin(list(quotas))).withColumn(
            "_k", F.concat(F.lpad(F.hex("_round"), 8, "0"), F.sha2(F.col(uid).cast("string"), 256)))
        limit = F.lit(None)
        for d, q in quotas.items():
            limit = F.when(F.col("_d") == d, F.lit(q)).otherwise(limit)
        chosen = hash_position(keyed, "_k", ["_d"], keep=max(quotas.values()), name="_r", hex_digits=10).filter(F.col("_r") <= limit)
        return pool.join(chosen.select(uid), uid, "left_semi")

    def enough(pool: DataFrame) -> bool:
        have = {r[0]: r[1] for r in pool.filter(F.col(domain).isin(list(quotas))).groupBy(domain).agg(F.countDistinct(uid)).collect()}
        return all(have.get(d, 0) >= q for d, q in quotas.items())

    def on_round(batch: DataFrame, i: int) -> None:
        open_rounds, emitted = state_before(i)
        tagged = batch.withColumn("round", F.lit(i).cast("bigint"))
        informative_groups(tagged, uid, acc).write.mode("overwrite").parquet(f"{kept_path}/r{i}")
        open_rounds.append(i)
        pool = spark.read.parquet(*[f"{kept_path}/r{r}" for r in open_rounds])
        if enough(pool):
            out, filtered = pick(pool), True
        elif len(open_rounds) >= max_rounds:
            out, filtered = pick(tagged), False
        else:
            out = None
        if out is not None:
            out.withColumn("filtered", F.lit(filtered)).write.mode("overwrite").parquet(f"{path}/batch_no={emitted}")
            open_rounds, emitted = [], emitted + 1
        spark.createDataFrame([(open_rounds, emitted)], "open array<int>, emitted int").write.mode("overwrite").parquet(f"{state_path}/round={i}")

    run_stream(rows, place, "append", on_round)
    return _read_batches(spark, path, T.StructType([*rows.schema.fields]).add("round", "long").add("filtered", "boolean"), "batch_no")


# ---- staleness --------------------------------------------------------------------------

def stream_staleness_filter(rows: DataFrame, versions: DataFrame, run: str, version: str, max_lag: int) -> DataFrame:
    """Rows whose lag behind their run's current version is within the limit, with ``stale`` for a lag of one or more.

    ``versions`` is a static table (run, current).
    """
    lag = F.col("current") - F.col(version)
    return rows.join(versions, run).withColumn("lag", lag).withColumn("stale", lag >= 1).withColumn("dropped", lag > max_lag)


def staleness_counts(tagged: DataFrame, run: str) -> DataFrame:
    return tagged.groupBy(run).agg(F.count(F.lit(1)).alias("seen"), F.count_if("dropped").alias("dropped"),
                                   F.count_if(F.col("stale") & ~F.col("dropped")).alias("stale_kept"))


# ---- step metrics -----------------------------------------------------------------------

def stream_step_metrics(
    log: DataFrame, ts: str, metric: str, value: str, interval: str, late: str, *, slide: str | None = None, session: bool = False,
) -> DataFrame:
    """Metrics reduced by name over each reporting interval; rows later than ``late`` are left out.

    Intervals follow each other, start every ``slide``, or (``session``) last until ``interval``
    passes without a row.
    """
    name = F.col(metric)
    out = F.when(F.contains(name, F.lit("max")), F.max(value)).when(F.contains(name, F.lit("min")), F.min(value)).otherwise(F.avg(value))
    window = F.session_window(ts, interval) if session else F.window(ts, interval, slide) if slide else F.window(ts, interval)
    return log.withWatermark(ts, late).groupBy(window.alias("w"), metric).agg(out.alias("value"), F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), metric, "value", "n")
