"""Streams end with the state a batch job computes, and drop what they should."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rollstat.session import shared_dir
from rollstat.streaming import jobs as J


def files(spark, batches, schema):
    path = shared_dir(spark, "test-stream")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return J.read_files(spark, path, spark.createDataFrame([], schema).schema, 1)


def test_groups_span_files_and_time_out(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    schema = "uid string, ts timestamp, score double"
    stream = files(spark, [[("a", t(1), 1.0), ("b", t(1), 1.0)], [("a", t(2), 2.0)], [("c", t(20), 1.0)], [("b", t(25), 5.0)], [("c", t(25), 5.0)]], schema)
    groups = J.stream_group_assembly(stream, "uid", "ts", "score", 2, "3 days", late="1 day")
    got = {(r["uid"], r["score"]) for r in J.collect_to_table(groups, "test-groups").collect()}
    assert ("a", 3.0) in got  # collected over two files
    assert ("b", 6.0) not in got  # the first half was dropped long before


def test_staleness(spark):
    stream = files(spark, [[("r", 1)], [("r", 5), ("r", 4)]], "run string, v long")
    versions = spark.createDataFrame([("r", 5)], "run string, current long")
    tagged = J.stream_staleness_filter(stream, versions, "run", "v", 2)
    got = J.last_state(J.staleness_counts(tagged, "run"), "test-stale", ["run"]).first()
    assert (got["seen"], got["dropped"], got["stale_kept"]) == (3, 1, 1)


def test_dynamic_sampling_emits_full_or_unfiltered(spark):
    schema = "uid long, domain string, acc double"
    mixed = lambda u: [(u, "d", 0.0), (u, "d", 1.0)]
    flat = lambda u: [(u, "d", 1.0), (u, "d", 1.0)]
    stream = files(spark, [mixed(1) + flat(2), mixed(3), flat(4) + flat(5), flat(6) + flat(7)], schema)
    out = J.stream_dynamic_sampling(stream, "uid", "acc", "domain", {"d": 2}, 2, "test-dyn").collect()
    first = {r["uid"] for r in out if r["batch_no"] == 0}
    assert first == {1, 3} and all(r["filtered"] for r in out if r["batch_no"] == 0)
    second = [r for r in out if r["batch_no"] == 1]
    assert len(second) == 4 and not any(r["filtered"] for r in second)


def append(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_a_stopped_stream_goes_on(spark):
    """Group state, running counts and the schedule go on from their checkpoint; nothing counts twice."""
    t = lambda d: dt.datetime(2024, 1, d)
    schema, path = "uid string, ts timestamp, score double", shared_dir(spark, "restart-files")
    groups, rates = J.Place.new(spark, "restart-groups"), J.Place.new(spark, "restart-rates")
    read = lambda: J.read_files(spark, path, spark.createDataFrame([], schema).schema, 1)
    assemble = lambda: {(r["uid"], r["score"], tuple(r["members"])) for r in J.collect_to_table(
        J.stream_group_assembly(read(), "uid", "ts", "score", 2, "9 days", late="9 days", member="score"), "x", place=groups).collect()}
    count = lambda: {r["uid"]: r["scored_rows"] for r in J.last_state(J.stream_score_rates(read(), "uid", F.col("score") > 1), "x", ["uid"], place=rates).collect()}
    append(spark, path, [("a", t(1), 1.0), ("b", t(1), 1.0)], schema)
    assert assemble() == set() and count() == {"a": 1, "b": 1}
    append(spark, path, [("a", t(2), 2.0)], schema)
    assert assemble() == {("a", 3.0, ("1.0", "2.0"))} and count() == {"a": 2, "b": 1}
    assert assemble() == {("a", 3.0, ("1.0", "2.0"))} and count() == {"a": 2, "b": 1}
    append(spark, path, [("b", t(3), 5.0)], schema)
    assert assemble() == {("a", 3.0, ("1.0", "2.0")), ("b", 6.0, ("1.0", "5.0"))}


def test_dynamic_sampling_goes_on(spark):
    schema, path = "uid long, domain string, acc double", shared_dir(spark, "restart-rounds")
    mixed = lambda u: [(u, "d", 0.0), (u, "d", 1.0)]
    place = J.Place.new(spark, "restart-dynamic")
    run = lambda: J.stream_dynamic_sampling(J.read_files(spark, path, spark.createDataFrame([], schema).schema, 1), "uid", "acc", "domain", {"d": 2}, 3, "x", place=place)
    append(spark, path, mixed(1) + mixed(2), schema)
    assert {(r["batch_no"], r["uid"]) for r in run().collect()} == {(0, 1), (0, 2)}
    append(spark, path, mixed(3), schema)
    assert {(r["batch_no"], r["uid"]) for r in run().collect()} == {(0, 1), (0, 2)}
    append(spark, path, mixed(4), schema)  # the open round of the run before counts
    assert {(r["batch_no"], r["uid"]) for r in run().collect()} == {(0, 1), (0, 2), (1, 3), (1, 4)}


def test_late_rows_are_left_out(spark):
    t = lambda h: dt.datetime(2024, 1, 1 + h // 24, h % 24)
    schema, path = "ts timestamp, metric string, value double", shared_dir(spark, "late-files")
    place = J.Place.new(spark, "late")
    run = lambda: {(r["start"], r["value"], r["n"]) for r in J.last_state(J.stream_step_metrics(
        J.read_files(spark, path, spark.createDataFrame([], schema).schema, 1), "ts", "metric", "value", "1 hour", "2 hours"), "x", ["start", "end", "metric"], place=place).collect()}
    append(spark, path, [(t(1), "m", 1.0), (t(10), "m", 2.0)], schema)
    run()
    append(spark, path, [(t(1), "m", 9.0), (t(9), "m", 4.0)], schema)  # the first is eight hours behind the mark, the second is in time
    assert run() == {(t(1), 1.0, 1), (t(10), 2.0, 1), (t(9), 4.0, 1)}


def test_dropped_groups_come_out_with_their_members(spark):
    """By a later row of the prompt, by the mark alone, and never because of a row that is too late."""
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema, path = "uid string, ts timestamp, score double, id string", shared_dir(spark, "drop-files")
    place = J.Place.new(spark, "drop")

    def run():
        groups = J.stream_group_assembly(J.read_files(spark, path, spark.createDataFrame([], schema).schema, 1), "uid", "ts", "score", 3, "2 days", late="1 day", member="id")
        return {(r["uid"], r["group_no"], r["dropped"], r["score"], "".join(r["members"])) for r in J.collect_to_table(groups, "x", place=place).collect()}

    append(spark, path, [("a", t(1), 1.0, "p"), ("a", t(1, 5), 2.0, "q"), ("b", t(1), 1.0, "u"), ("c", t(1), 1.0, "x"), ("c", t(1), 1.0, "y"), ("c", t(1), 1.0, "z"), ("c", t(1), 1.0, "zz")], schema)
    first = {("c", 0, False, 3.0, "xyz")}
    assert run() == first
    append(spark, path, [("a", t(3), 4.0, "r")], schema)  # in time: 43 hours behind the newest
    second = first | {("a", 0, False, 7.0, "pqr")}
    assert run() >= second
    append(spark, path, [("a", t(9), 1.0, "s"), ("c", t(9), 1.0, "w")], schema)  # c's last one waited for too long
    third = second | {("c", -1, True, 1.0, "zz"), ("b", -1, True, 1.0, "u")}
    assert run() == third
    append(spark, path, [("a", t(1), 50.0, "old"), ("a", t(9, 1), 1.0, "t"), ("a", t(9, 2), 1.0, "v")], schema)  # the first is a week too late
    assert run() == third | {("a", 1, False, 3.0, "stv")}
    append(spark, path, [("e", t(30), 1.0, "end")], schema)
    assert run() == third | {("a", 1, False, 3.0, "stv"), ("c", -1, True, 1.0, "w")}


def test_a_batch_of_a_prompt_reads_and_writes_its_state_once():
    from pyspark.sql import Row

    class State:
        value, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    class Handle:
        timers = []

        def getValueState(self, name, schema):
            return State()

        def registerTimer(self, ms):
            self.timers.append(ms)

        def deleteTimer(self, ms):
            self.timers.remove(ms)

    processor, handle = J.GroupAssembly(4, 100), Handle()
    processor.init(handle)
    feed = lambda *ms: [(r["size"], r["dropped"], r["score"], "".join(r["members"])) for r in processor.handleInputRows(
        ("a",), iter([Row(uid="a", ts=None, ms=m, score=1.0, member=chr(97 + m % 26)) for m in ms]), None)]
    assert feed(30, 10, 20) == [] and handle.timers == [130]
    assert feed(40, 50) == [(4, False, 4.0, "".join(chr(97 + m % 26) for m in (10, 20, 30, 40)))] and handle.timers == [150]
    assert feed(500) == [(1, True, 1.0, chr(97 + 50 % 26))] and handle.timers == [600]
    assert State.calls == ["get", "update"] * 3


def test_mixture_goes_on_and_writes_new_steps_only(spark):
    """Stopped after each file or run in one go: the same steps, each written once, equal to the batch schedule."""
    import random

    from rollstat.operators import domains as H

    rnd, kw = random.Random(3), dict(ema_window=4, initial_steps=2, velocity_window=2, velocity_windows=2, update_interval=2, floor=0.05, temperature=0.5)
    schema = "ts timestamp, d string, r double"
    days = [[(dt.datetime(2024, 3, day, rnd.randrange(24)), d, -rnd.random() / day) for d in "xyz" for _ in range(3)] for day in range(1, 15)]
    parts = [sum(days[:5], []), sum(days[5:6], []), sum(days[6:], []), [(dt.datetime(2024, 6, 1), "end", 0.0)]]
    paths = [shared_dir(spark, f"mixture-{i}") for i in (0, 1)]
    places = [J.Place.new(spark, f"mixture-{i}") for i in (0, 1)]
    run = lambda i: J.stream_mixture(J.read_files(spark, paths[i], spark.createDataFrame([], schema).schema, 1), "ts", "1 day", "d", F.col("r"), "x", places[i], late="1 day", **kw)
    key = lambda out: sorted((str(r["step"])[:10], r["domain"], r["t"], round(r["ema"], 9), round(r["signal"], 9), round(r["mixture"], 9)) for r in out.collect())
    seen = []
    for part in parts:
        for path in paths:
            append(spark, path, part, schema)
        seen.append(key(run(0)))
    assert seen[-1] == key(run(1)) and len(seen[-1]) == 14 * 3
    assert 0 < len(seen[0]) < len(seen[2]) < 42 and all(set(a) <= set(b) for a, b in zip(seen, seen[1:]))
    rows = spark.createDataFrame(sum(days, []), schema).groupBy(F.to_date("ts").alias("step"), F.col("d").alias("domain")).agg((-F.avg("r")).alias("raw"))
    want = H.mixture_schedule(rows, "step", "domain", "raw", **kw)
    assert key(want) == seen[-1]


def test_no_task_does_the_joins_of_all_partitions_of_the_mixture_in_force(spark):
    """It is written by the tasks of its partitions; domains without news keep theirs."""
    import glob
    import random

    from rollstat.operators import domains as H

    rnd, kw = random.Random(5), dict(ema_window=4, initial_steps=2, velocity_window=2, velocity_windows=2, update_interval=2, floor=0.01, temperature=0.5)
    schema, path, place = "ts timestamp, d string, r double", shared_dir(spark, "held-files"), J.Place.new(spark, "held")
    names = [f"d{k}" for k in range(20)]
    days = [[(dt.datetime(2024, 3, day, 12), d, -rnd.random() / day) for d in [*names, *["early"] * (day < 4)]] for day in range(1, 13)]
    for part in (sum(days[:5], []), sum(days[5:9], []), sum(days[9:], []), [(dt.datetime(2024, 6, 1), "end", 0.0)]):
        append(spark, path, part, schema)
    out = J.stream_mixture(J.read_files(spark, path, spark.createDataFrame([], schema).schema, 1), "ts", "1 day", "d", F.col("r"), "x", place, late="1 day", **kw)
    key = lambda df: sorted((str(r["step"])[:10], r["domain"], r["t"], round(r["mixture"], 9)) for r in df.collect())
    rows = spark.createDataFrame(sum(days, []), schema).groupBy(F.to_date("ts").alias("step"), F.col("d").alias("domain")).agg((-F.avg("r")).alias("raw"))
    want = key(H.mixture_schedule(rows, "step", "domain", "raw", **kw))
    assert key(out) == want and len(want) == 12 * 20 + 3
    last = max(int(at.rsplit("/", 1)[1]) for at in glob.glob(f"{place.sink}/held/*"))
    held = {r["domain"]: round(r["held"], 9) for r in spark.read.parquet(f"{place.sink}/held/{last}").collect()}
    assert held == {domain: mixture for _, domain, t, mixture in want if t == 12 or (domain, t) == ("early", 3)}
    assert all(len(glob.glob(f"{place.sink}/held/{i}/part-*")) > 1 for i in (last - 1, last))


def test_a_missing_state_is_an_error(spark):
    import os
    import shutil

    import pytest

    schema, path = "uid long, domain string, acc double", shared_dir(spark, "lost-rounds")
    place = J.Place.new(spark, "lost")
    run = lambda: J.stream_dynamic_sampling(J.read_files(spark, path, spark.createDataFrame([], schema).schema, 1), "uid", "acc", "domain", {"d": 2}, 3, "x", place=place)
    append(spark, path, [(1, "d", 0.0), (1, "d", 1.0)], schema)
    assert run().count() == 0  # nothing is due yet
    append(spark, path, [(2, "d", 0.0), (2, "d", 1.0)], schema)
    os.rename(f"{place.sink}/state/round=0", f"{place.sink}/state-lost")
    with pytest.raises(Exception, match="is missing"):
        run()
    shutil.move(f"{place.sink}/state-lost", f"{place.sink}/state/round=0")
    assert {r["uid"] for r in run().collect()} == {1, 2}
