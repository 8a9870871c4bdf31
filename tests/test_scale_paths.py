"""The paths taken on large or skewed tables, forced on small ones and checked by brute force."""
from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from rollstat.operators import advantages as A
from rollstat.operators import ranking as R
from rollstat.operators import scans
from rollstat.operators.differencing import difference_shards
from rollstat.operators.restore import ordered_subset_restore


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables keep as many ranges as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def skewed(spark, n=600, seed=1):
    """One group holds a third of all rows and many rows share a value."""
    rnd = random.Random(seed)
    data = [(i, "hot" if i % 3 == 0 else f"g{i % 7}", rnd.choice([0.0, 0.0, 0.0, 1.0, round(rnd.random(), 3)])) for i in range(n)]
    return data, spark.createDataFrame(data, "id long, g string, v double")


def test_position_in_buckets_equals_plain_order(spark):
    data, df = skewed(spark)
    got = rows(R.position(df, ["v", "id"], ["g"]), "id", "position")
    want = []
    for g in {d[1] for d in data}:
        for p, d in enumerate(sorted((d for d in data if d[1] == g), key=lambda d: (d[2], d[0])), 1):
            want.append((d[0], p))
    assert got == sorted(want)
    kept = R.position(df, ["v", "id"], ["g"], keep=5)
    assert rows(kept, "id", "position") == sorted(w for w in want if w[1] <= 5)


def test_rows_without_a_group_stay(spark):
    rows_ = [(1, None, 1.0), (2, None, 3.0), (3, "a", 2.0), (4, "a", 4.0)]
    df = spark.createDataFrame(rows_, "id long, g string, v double")
    assert rows(R.position(df, ["v", "id"], ["g"]), "id", "position") == [(1, 1), (2, 2), (3, 1), (4, 2)]
    assert rows(R.with_group_stats(df, ["g"], m=F.avg("v")), "id", "m") == [(1, 2.0), (2, 2.0), (3, 3.0), (4, 3.0)]
    assert {r["g"]: r["q"] for r in R.exact_quantiles(df, "v", {"q": 0.5}, ["g"]).collect()} == {None: 2.0, "a": 3.0}
    assert A.adv_group_relative(df.withColumnRenamed("g", "uid").withColumnRenamed("v", "score"), "uid", "score").count() == 4


def test_texts_stay_out_of_range_sorts(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "id long, text string")
    got = R.position(df, ["id"])
    assert rows(got, "id", "position") == [(i, i + 1) for i in range(50)] and got.columns == ["id", "text", "position"]


def test_ties_and_repeated_rows_keep_their_places(spark):
    """The same for narrow, text, array and map columns; equal rows all stay."""
    data = [(i % 2, i // 3) for i in range(24)] + [(0, 99)] * 5
    df = spark.createDataFrame(data, "k int, v int")
    kinds = {"v": F.col("v"), "text": F.col("v").cast("string"), "list": F.array("v"), "map": F.create_map(F.lit("x"), F.col("v"))}
    for kind in kinds.values():
        rows_ = df.select("k", kind.alias("c"), F.to_json(F.struct(kind.alias("c"))).alias("j"))
        a, b = (R.position(rows_.repartition(n), ["k"]).select("k", "j", "position").collect() for n in (2, 9))
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))  # ties do not depend on the layout
        assert [r[2] for r in sorted(a, key=lambda r: r[2])] == list(range(1, 30))
        assert [r[0] for r in sorted(a, key=lambda r: r[2])] == sorted(k for k, _ in data)
        assert sorted((r[0], r[1]) for r in a) == sorted((r["k"], r["j"]) for r in rows_.collect())
        kept = R.position(rows_, ["k"], keep=7).collect()
        assert sorted(r["position"] for r in kept) == list(range(1, 8))
        per = R.position(rows_, ["j"], ["k"], keep=2).collect()
        assert sorted((r["k"], r["position"]) for r in per) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_tied_values_are_split_over_buckets(spark):
    _, df = skewed(spark)
    assert max(r["count"] for r in R.with_range_bucket(df, ["v", "id"]).groupBy("_bucket").count().collect()) < 250  # 0.0 alone holds half of the 600 rows


def test_hash_position_keeps_the_smallest(spark):
    data, df = skewed(spark)
    keyed = df.withColumn("k", F.sha2(F.col("id").cast("string"), 256))
    all_ = {(r["id"], r["g"], r["position"]) for r in R.hash_position(keyed, "k", ["g"]).collect()}
    kept = {(r["id"], r["g"], r["position"]) for r in R.hash_position(keyed, "k", ["g"], keep=9).collect()}
    assert kept == {x for x in all_ if x[2] <= 9}
    import hashlib
    hot = sorted((hashlib.sha256(str(d[0]).encode()).hexdigest(), d[0]) for d in data if d[1] == "hot")
    assert [x[0] for x in sorted((x for x in all_ if x[1] == "hot"), key=lambda x: x[2])] == [h[1] for h in hot]


def test_quantiles(spark):
    data, df = skewed(spark)
    got = {r["g"]: (r["a"], r["b"]) for r in R.exact_quantiles(df, "v", {"a": 0.5, "b": 0.9}, ["g"]).collect()}
    import numpy as np
    for g in {d[1] for d in data}:
        vals = [d[2] for d in data if d[1] == g]
        assert got[g] == pytest.approx((np.quantile(vals, 0.5), np.quantile(vals, 0.9)))


def test_quantiles_inside_brackets(spark, monkeypatch):
    """A coarse sketch forces brackets, a wrong one opens them; the values stay exact."""
    import numpy as np
    rnd = random.Random(4)
    data = [(g, None if rnd.random() < 0.05 else rnd.choice([0.0, 0.5, rnd.random()])) for g, n in ((None, 3000), ("a", 500), ("b", 7)) for _ in range(n)] + [("c", None)] * 3
    df = spark.createDataFrame(data, "g string, v double")
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    pairs = []
    real = R.with_range_bucket
    monkeypatch.setattr(R, "with_range_bucket", lambda d, by: pairs.append(d.count()) or real(d, by))
    sketch = F.percentile_approx
    for lie in (False, True):
        if lie:
            monkeypatch.setattr(R.F, "percentile_approx", lambda c, p, n: F.transform(sketch(c, p, n), lambda x: x * 0 - 1))
        for discrete in (False, True):
            got = {r["g"]: r for r in R.exact_quantiles(df, "v", wanted, ["g"], discrete=discrete, accuracy=50).collect()}
            for g in (None, "a", "b"):
                vals = [v for k, v in data if k == g and v is not None]
                want = np.quantile(vals, list(wanted.values()), method="inverted_cdf" if discrete else "linear")
                assert [got[g][n] for n in wanted] == pytest.approx(list(want))
            assert got["c"]["a"] is None and len(got) == 4
    assert pairs[0] < 0.7 * len({d for d in data}) and len(pairs) == 6  # the wrong sketch took the second way
    plain = R.exact_quantiles(df, "v", {"q": 0.9}, accuracy=50).first()["q"]
    assert plain == pytest.approx(np.quantile([v for _, v in data if v is not None], 0.9))
    assert R.exact_quantiles(df.filter("false"), "v", {"q": 0.9}).first()["q"] is None


def test_positions_do_not_depend_on_partitioning(spark):
    _, df = skewed(spark)
    a = rows(R.position(df.repartition(3), ["v", "id"], ["g"]), "id", "position")
    b = rows(R.position(df.repartition(11), ["v", "id"], ["g"]), "id", "position")
    assert a == b


def token_rows(spark, seed=3):
    rnd = random.Random(seed)
    data = [(s, p, rnd.randint(0, 1), rnd.random(), rnd.random()) for s, n in ((1, 37), (2, 1), (3, 8), (4, 16), (None, 29)) for p in range(1, n + 1)]
    return data, spark.createDataFrame(data, "s long, pos int, mask int, r double, v double")


@pytest.mark.parametrize("chunk", [1, 4, 7, 4096])
def test_sequence_recursions_with_carries(spark, chunk):
    data, df = token_rows(spark)
    ret = scans.discounted_return(df, "s", "pos", F.col("r"), "mask", gamma=0.9, name="x", chunk=chunk)
    gae = scans.advantage_recursion(df, "s", "pos", "r", "v", "mask", gamma=0.97, lam=0.9, name="x", chunk=chunk)
    suf = scans.suffix_sum(df, "s", "pos", F.col("r"), name="x", chunk=chunk)
    run = scans.running_sum(df, "s", "pos", F.col("mask"), name="x", chunk=chunk)
    got = [{(r["s"], r["pos"]): r["x"] for r in d.collect()} for d in (ret, gae, suf, run)]
    for s in (1, 2, 3, 4, None):  # rows without a sequence form one
        seq = sorted((d for d in data if d[0] == s), key=lambda d: d[1])
        x = nv = a = t = 0.0
        for _, p, m, r, v in reversed(seq):
            x = r + 0.9 * x
            assert got[0][s, p] == pytest.approx(x, abs=1e-9)
            x *= m
            step = r + 0.97 * nv - v + 0.97 * 0.9 * a
            nv, a = (v, step) if m else (nv, a)
            assert got[1][s, p] == pytest.approx(a, abs=1e-9)
            t += r
            assert got[2][s, p] == pytest.approx(t)
        c = 0
        for _, p, m, *_ in seq:
            c += m
            assert got[3][s, p] == c


def test_pair_accuracy_against_all_pairs(spark):
    rnd = random.Random(5)
    data = [(f"g{g}", i, rnd.choice([0.1, 0.5, rnd.random()]), rnd.choice([0.0, 0.25, 0.5, 1.0, rnd.random()])) for g, n in ((0, 30), (1, 1), (2, 7)) for i in range(n)]
    df = spark.createDataFrame(data, "g string, i int, s double, a double")
    got = {r["g"]: r["pair_accuracy"] for r in A.pairwise_ranking_accuracy(df, "g", "s", "a", "i").collect()}
    for g in ("g0", "g1", "g2"):
        part = sorted((d for d in data if d[0] == g), key=lambda d: d[1])
        num = den = 0.0
        for x in range(len(part)):
            for y in range(x + 1, len(part)):
                d = part[x][3] - part[y][3]
                den += abs(d)
                num += abs(d) * ((part[x][2] > part[y][2]) == (d > 0))
        assert got[g] == pytest.approx(num / den if den else 0.5)


@pytest.mark.parametrize("seed", range(3))
def test_restore_equals_sequential_pass(spark, seed):
    rnd = random.Random(seed)
    source = [("d", p, rnd.choice("aaabcde")) for p in range(1, 61)]
    picked, at = [], 0
    while at < 60 and len(picked) < 20:
        at += rnd.randint(1, 3)
        if at <= 60:
            picked.append(source[at - 1][2])
    sel = spark.createDataFrame([("d", i, k) for i, k in enumerate(picked)], "dom string, i long, k string")
    src = spark.createDataFrame(source, "dom string, p long, k string")
    got = rows(ordered_subset_restore(sel, src, domain="dom", index="i", pos="p", key=F.col("k")), "i", "source_pos")
    want, t = [], 0
    for _, p, k in source:
        if t < len(picked) and k == picked[t]:
            want.append((t, p))
            t += 1
    assert got == want


def sequential(source, picked):
    want, t = [], 0
    for p, k in source:
        if t < len(picked) and k == picked[t]:
            want.append((t, p))
            t += 1
    return want


def test_restore_of_a_thousand_backward_targets(spark, monkeypatch):
    """Every target lies behind the next one in the source; rounds grow with the logarithm."""
    from rollstat.operators import restore

    picked = [9 - i % 10 for i in range(1000)]
    source = [(p, p % 10) for p in range(1, 9500)]
    rounds = []
    monkeypatch.setattr(restore, "nearest_mark", lambda *a, _f=restore.nearest_mark, **kw: rounds.append(1) or _f(*a, bucket=700, **kw))
    sel = spark.createDataFrame([(None, i, k) for i, k in enumerate(picked)] + [("one", 0, 4)], "dom string, i long, k int")
    src = spark.createDataFrame([(None, p, k) for p, k in source] + [("one", 5, None), ("one", 6, 4), ("one", 7, 4)], "dom string, p long, k int")
    got = rows(ordered_subset_restore(sel, src, domain="dom", index="i", pos="p", key=F.col("k")).filter("dom is null"), "i", "source_pos")
    assert got == sequential(source, picked) and len(got) == 1000
    assert len(rounds) <= 3 * 10 + 1  # per level two looks up, one down


def test_nearest_marks(spark):
    rnd = random.Random(8)
    marks = [(rnd.choice("ab"), rnd.randint(-20, 60)) for _ in range(40)]
    marks = sorted(set(marks))
    asks = [(rnd.choice("abc"), rnd.randint(-30, 70), i) for i in range(80)]
    m = spark.createDataFrame([(h, x, x * 10) for h, x in marks], "h string, x long, value long")
    a = spark.createDataFrame(asks, "h string, x long, i long")
    from rollstat.operators.restore import nearest_mark
    for after in (True, False):
        got = {r["i"]: r["found"] for r in nearest_mark(a, m, after=after, bucket=7).collect()}
        for h, x, i in asks:
            near = [y for k, y in marks if k == h and (y > x if after else y < x)]
            assert got[i] == (None if not near else 10 * (min(near) if after else max(near)))


def test_restore_refuses_gaps_and_misses(spark):
    src = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "dom string, p long, k string")
    for bad in ([("d", 1, "a")], [("d", 0, "b"), ("d", 1, "a")]):
        sel = spark.createDataFrame(bad, "dom string, i long, k string")
        with pytest.raises(ValueError):
            ordered_subset_restore(sel, src, domain="dom", index="i", pos="p", key=F.col("k")).collect()


def test_differencing_beats_row_order():
    rnd = random.Random(2)
    costs = [rnd.randint(1, 1000) ** 2 for _ in range(64)]
    for equal in (True, False):
        shard = difference_shards(costs, 8, equal)
        sums = [sum(c for c, s in zip(costs, shard) if s == k) for k in range(8)]
        plain = [sum(costs[i: i + 8]) for i in range(0, 64, 8)]
        assert max(sums) - min(sums) < (max(plain) - min(plain)) / 5
        if equal:
            assert all(shard.count(k) == 8 for k in range(8))


def test_sharding_refuses_batches_that_do_not_fit(spark):
    from rollstat.operators import sampling as S
    from rollstat.operators.differencing import balanced_sharding_exact

    df = spark.createDataFrame([(b, i, 10 * i) for b, n in ((1, 8), (2, 6)) for i in range(n)], "b int, i int, t long")
    assert S.balanced_sharding(df.filter("b = 1"), "b", "i", "t", 4).count() == 8
    assert S.balanced_sharding(df, "b", "i", "t", 4, equal_size=False).count() == 14
    for bad in (lambda: S.balanced_sharding(df, "b", "i", "t", 4), lambda: S.balanced_sharding(df, "b", "i", "t", 7, equal_size=False),
                lambda: balanced_sharding_exact(df, "b", "i", "t", 4), lambda: balanced_sharding_exact(df, "b", "i", "t", 7, equal_size=False)):
        with pytest.raises(Exception, match="too few"):
            bad().collect()


def test_sharding_queries_deal_the_last_batch(spark, tmp_path):
    """82 rows are left behind the whole batches, or 3: all of them get a shard, evenly."""
    from collections import Counter

    from rollstat.plans import load_all

    for name, n in (("a", 2 * 256 + 82), ("b", 256 + 3)):
        spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") * 37 % 1009 + 40).alias("n_chars")).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for query in ("balanced_sharding", "balanced_sharding_exact"):
            rows = load_all()[0][query](spark, f"{tmp_path}/{name}").collect()
            assert sorted(r["doc_id"] for r in rows) == list(range(n))
            for batch in {r["batch"] for r in rows}:
                sizes = Counter(r["shard"] for r in rows if r["batch"] == batch)
                assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(8)) <= 1
        report = load_all()[0]["sharding_report"](spark, f"{tmp_path}/{name}").collect()
        assert len(report) == -(-n // 256) and all(r["balanced_spread"] <= r["spread"] or n % 256 < 8 for r in report)


def test_token_queries_write_only_what_they_need(spark, tmp_path, monkeypatch):
    import datetime as dt

    from rollstat.plans import load_all

    spark.createDataFrame([(k, k % 3, "FO"[k % 2], 100.0 * k, dt.datetime(2024, 1, 1), "p") for k in range(12)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, k, k, line, 1.0 * line, 9.0, 0.1, 0.1, "R", "FO"[line % 2]) for k in range(12) for line in range(5)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                          "l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    written = []
    keep = scans.materialize
    monkeypatch.setattr(scans, "materialize", lambda df, label: written.append(set(df.columns)) or keep(df, label))
    for name in ("adv_process", "adv_process_loo", "adv_discounted_return", "adv_greedy_baseline", "adv_gae", "response_mask"):
        assert load_all()[0][name](spark, str(tmp_path)).count() == 60
    assert written and not any({"domain", "step", "token_id", "logp_old", "logp_rollout", "logp_ref"} & columns for columns in written)


def test_loose_verdicts_equal_those_of_every_variant(spark):
    """Variants are judged where the text failed and only those that may pass; the texts are exploded per instruction only."""
    from rollstat.operators import instructions as I
    from rollstat.plans.scores import INSTRUCTIONS

    checks = [*INSTRUCTIONS.items(), ("keywords:frequency", '{"keyword": "un", "frequency": 2, "relation": "at least"}'), ("keywords:existence", '{"keywords": ["f("]}'),
              ("keywords:frequency", '{"keyword": "th.", "frequency": 3, "relation": "less than"}'),
              *[(n, k.replace("at least", "less than")) for n, k in INSTRUCTIONS.items() if "at least" in k],
              *[("language:response_language", f'{{"language": "{code}"}}') for code in ("fr", "ru", "uk", "ja", "zh", "ar")]]
    pool = ["the cat and the dog is in it.", "un chat, et le chien est dans la rue", "ALL CAPS HERE", "P.S. bye", "* one", "- two", "", " ", "SECTION 1 x", "SECTION 2", "de un un un", "\"", "<<T>>",
            '{"a": 1}', "```json", "th*e a*nd", "***", "******", "x [a] [b]", "\u042d\u0442\u043e \u0431\u044b\u043b\u043e \u0438 \u043d\u0435 \u043e\u043d", "\u3053\u306e\u753a\u306f\u5ddd", "SECTION", "1 p. s. x", "word " * 60]
    rnd = random.Random(5)
    texts = ["", "a", *["\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 5))) for _ in range(150)]]
    arr = F.array(*[F.struct(F.lit(n).alias("id"), F.lit(k).alias("kwargs")) for n, k in checks])
    run = lambda rows_, schema, loose: I.check_instructions(spark.createDataFrame(rows_, schema).withColumn("is", arr), "k", "t", "p", "is", loose=loose)
    checked = run([(i, t, "p") for i, t in enumerate(texts)], "k long, t string, p string", True)
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    variants = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string").withColumn("t", I.strip_think("t")).select(
        "k", F.posexplode(F.concat(F.array("t"), I.loose_variants(F.col("t")))).alias("v", "t")).collect()
    each = run([(1000 * r["k"] + r["v"], r["t"], "p") for r in variants], "k long, t string, p string", False).collect()
    want = {}
    for r in each:
        want.setdefault((r["k"] // 1000, r["ordinal"]), []).append((r["k"] % 1000, r["strict"]))
    got = {(r["k"], r["ordinal"]): (r["strict"], r["loose"]) for r in checked.collect()}
    assert len(got) == len(texts) * len(checks)
    assert {k: v for k, v in got.items() if v != (min(want[k])[1], any(ok for _, ok in want[k]))} == {}


def test_every_looser_variant_goes_through_its_check(spark, monkeypatch):
    """No check leaves out a variant for what it found in the response: each passes here on one variant alone, one after the other."""
    from rollstat.operators import instructions as I
    from rollstat.plans.scores import INSTRUCTIONS

    variants = {
        "first\nmiddle\nlast": ("middle", "middle\nlast", "first\nmiddle"),
        "*first\nmid*dle\nlast": ("mid*dle", "mid*dle\nlast", "*first\nmid*dle", "first\nmiddle\nlast", "middle", "middle\nlast", "first\nmiddle"),
    }
    for name in I.CHECKS:
        monkeypatch.setitem(I.CHECKS, name, lambda t, a, p, s: t == a("passes"))
    asked = {t: [(n, json.dumps(json.loads(k) | {"passes": v})) for n, k in INSTRUCTIONS.items() for v in vs] for t, vs in variants.items()}
    df = spark.createDataFrame([(t, "p", checks) for t, checks in asked.items()], "t string, p string, is array<struct<id string, kwargs string>>")
    got = I.check_instructions(df, "t", "t", "p", "is").collect()
    assert len(got) == sum(map(len, asked.values())) and set(INSTRUCTIONS) == set(I.CHECKS)
    assert {asked[r["t"]][r["ordinal"]] for r in got if r["strict"] or r["error"] or not r["loose"]} == set()


def test_subspace_energy_against_a_plain_decomposition(spark):
    import numpy as np

    from rollstat.operators import runlog as L

    rng = np.random.default_rng(1)
    rows_ = [(k, (rng.normal(size=6) * [5, 3, 1, 1, 0.5, 0.1]).tolist()) for k in (None, "a", "b") for _ in range(40)]
    got = {(r["k"], r["rank"]): (r["energy"], r["random_energy"]) for r in L.subspace_energy(spark.createDataFrame(rows_, "k string, v array<double>"), "v", ["k"], [1, 2, 6], seed=3).collect()}
    picked = np.random.default_rng(3).permutation(6)
    for k in (None, "a", "b"):
        x = np.array([v for key, v in rows_ if key == k])
        squares = np.linalg.svd(x, compute_uv=False) ** 2
        for rank in (1, 2, 6):
            assert got[k, rank] == pytest.approx((squares[:rank].sum() / squares.sum(), (x[:, picked[:rank]] ** 2).sum() / (x ** 2).sum()))


def test_first_rows_of_the_browser(spark):
    from rollstat.operators import evals as E

    df = spark.createDataFrame([(i, i % 4, "key " * (i % 3)) for i in range(60)], "i int, k int, t string")
    got = E.sample_browser(df, ["i", "k"], "t", "key", [F.col("k").desc(), F.col("i")], 11)
    want = sorted((r for r in ((i, i % 4, i % 3) for i in range(60)) if r[2]), key=lambda r: (-r[1], r[0]))[:11]
    assert rows(got, "i", "k", "hits") == sorted(want)


def test_endless_patterns_are_errors(monkeypatch):
    import pandas as pd

    from rollstat.operators import instructions as I

    monkeypatch.setattr(I, "PATTERN_SECONDS", 0.2)
    pattern = lambda p: f'[{{"user": "{p}", "before": "", "after": "", "flags": ""}}]'
    out = I._tried_hits(pd.Series(["a" * 40 + "b", "aab"]), pd.Series([[pattern("(a|a|aa)+$"), pattern("a.")], [pattern("("), None]]))
    assert out.tolist() == [[[-1], [20]], [[-1], None]]


def test_null_groups_keep_their_rows(spark):
    """Rows without a key form one group, in every operator that joins group values back."""
    from rollstat.operators import domains as H
    from rollstat.operators import evals as E
    from rollstat.operators import runlog as L

    schema = "g string, q string, pos int, mask int, r double, s double, a double"
    data = [(g, f"{g}{q}" if q else None, p, int(p != 2), 0.1 * p + q, 0.3 * p - q, float(q)) for g in (None, "x") for q in (0, 1, 2) for p in (1, 2, 3)]
    df = spark.createDataFrame(data, schema)
    named = df.withColumn("g", F.coalesce("g", F.lit("-"))).withColumn("q", F.coalesce("q", F.concat(F.coalesce("g", F.lit("-")), F.lit("?"))))

    def same(fn, keys, *cols, source=df, other=named):
        """The result with nulls equals the one with names in their place."""
        fill = lambda d: sorted(tuple("-" if v is None or v in ("-?", "x?") else v if not isinstance(v, float) else round(v, 9) for v in r) for r in d.select(*keys, *cols).collect())
        got, want = fill(fn(source)), fill(fn(other))
        assert got == want and got

    one = lambda d: d.filter("pos = 1")
    same(lambda d: A.adv_pass_k(one(d), "g", "s", "r"), ["g"], "s", "advantage", source=df, other=named)
    same(lambda d: A.best_of_n_weights(one(d), "g", "s"), ["g"], "s", "weight")
    same(lambda d: A.pairwise_ranking_accuracy(d, "g", "s", "a", "r"), ["g"], "pair_accuracy")
    same(lambda d: A.adv_group_baseline_whitened(d, "g", "q", "r", "mask"), ["g", "q"], "pos", "advantage")
    same(lambda d: A.adv_greedy_baseline(d.filter("g is null or g = '-'"), d.filter("g is null or g = '-'").groupBy("q").agg(F.avg("s").alias("baseline")), "q", "pos", "r", "mask"), ["q"], "pos", "advantage")
    same(lambda d: A.adv_process_loo(d.filter("g is null or g = '-'"), d.filter("g is null or g = '-'").groupBy("q").agg(F.max("a").alias("acc")), "g", "q", "pos", "r", "mask"), ["g", "q"], "pos", "advantage")
    same(lambda d: A.kl_penalised_reward(d, "g", "q", "r", "s", "a", "mask", beta=0.1, target=0.2, horizon=10), ["g", "q"], "pos", "penalised")
    same(lambda d: A.response_mask(d.filter("g is null or g = '-'"), "q", "pos", "mask"), ["q"], "pos", "response_mask")
    for stat in ("mean", "q90", "top10"):
        same(lambda d: H.domain_loss_weights(d, "g", "mask", targets=None, reward="r", alpha=0.5, stat=stat), ["g"], "weight")
    same(lambda d: L.staleness_metrics(d, current=3, version_start="pos", version_end="pos", seconds="s", keys=["g"]), ["g"], "n", "time_p50", "time_p99")
    same(lambda d: L.timing_throughput(d, d.groupBy("q").agg(F.lit(5).alias("prompt_tokens"), F.lit(6).alias("response_tokens")), "q", "g", "s", 2), ["q", "g"], "ms_per_token")
    metrics = df.select("g", F.lit("acc").alias("variable"), F.concat(F.lit("mean@"), F.col("pos")).alias("metric"))
    assert sorted((r["g"] or "-", r["metric"], r["section"]) for r in E.core_aux_labels(metrics.distinct(), "g").collect()) == sorted(
        (g, f"mean@{p}", "val-core" if p == 3 else "val-aux") for g in ("-", "x") for p in (1, 2, 3))
    rec = E.domain_macro_recovery(df, "g", "q", "pos", "s", base="x", reference="x")
    assert {r["g"] for r in rec.collect()} == {None, "x"}


def test_resampling_does_not_depend_on_the_layout(spark):
    from rollstat.operators import sampling as S

    rnd = random.Random(11)
    data = [(i, rnd.random() ** 3 + 1e-8) for i in range(2000)]
    df = spark.createDataFrame(data, "id long, w double")
    got = [rows(S.importance_resample(df.repartition(n), "id", "w", 5000, 3), "id", "copies") for n in (3, 300)]
    assert got[0] == got[1] and sum(c for _, c in got[0]) == 5000
    import hashlib
    import bisect
    import itertools
    ends = list(itertools.accumulate(w for _, w in data))
    want = {}
    for i in range(5000):
        x = int(hashlib.sha256(f"3:{i}".encode()).hexdigest()[:12], 16) / 2 ** 48 * ends[-1]
        k = bisect.bisect_right(ends, x)
        want[k] = want.get(k, 0) + 1
    assert dict(got[0]) == want


def test_paths_over_a_million_steps(spark):
    """The coefficient and the moving average of a long run, against plain loops."""
    import numpy as np

    from rollstat.operators import domains as H

    n = 1_000_000
    log = spark.range(1, n + 1).select(F.col("id").alias("step"), F.lit(1).alias("seq"), (F.sin(F.col("id") * 0.7) + 0.2).alias("kl"), F.lit(1).alias("mask"))
    got = A.kl_path(log, "step", "seq", F.col("kl"), "mask", beta=0.3, target=0.2, horizon=50.0)
    t = np.arange(1, n + 1)
    kl = (np.sin(t * 0.7) + 0.2) / (1 + A.MASK_EPS)
    path = 0.3 * np.cumprod(1 + np.clip(kl / 0.2 - 1, -0.2, 0.2) / 50)
    picks = [1, 2, 4096, 4097, 123_456, 999_999, n]
    found = {r["step"]: (r["beta"], r["next_beta"]) for r in got.filter(F.col("step").isin(picks)).collect()}
    for p in picks:
        assert found[p] == pytest.approx((path[p - 2] if p > 1 else 0.3, path[p - 1]), rel=1e-8)
    steps = spark.range(1, n + 1).select(F.col("id").alias("step"), F.lit("d").alias("dom"), F.when(F.col("id") % 250_007 != 0, F.abs(F.sin(F.col("id") * 0.3))).alias("raw"))
    out = H.mixture_schedule(steps, "step", "dom", "raw", ema_window=19, initial_steps=5, velocity_window=3, velocity_windows=2, update_interval=4, floor=0.1, temperature=1.0)
    ema, e = {}, None
    for i in range(1, n + 1):
        r = None if i % 250_007 == 0 else abs(np.sin(i * 0.3))
        e = None if r is None else r if e is None else 0.1 * r + 0.9 * e
        ema[i] = e
    more = [*picks, 250_006, 250_007, 250_008, 250_010]
    for r in out.filter(F.col("step").isin(more)).collect():
        assert r["ema"] == (None if ema[r["step"]] is None else pytest.approx(ema[r["step"]], rel=1e-9)) and r["mixture"] == 1.0


def test_coefficient_path_with_zero_and_negative_factors(spark):
    log = spark.createDataFrame([(s, q, kl, 1) for s, kl, n in ((1, 0.3, 2), (2, 0.0, 5), (3, 0.5, 1), (4, 0.0, 10)) for q in [f"{s}-{i}" for i in range(n)]], "step int, seq string, kl double, mask int")
    for stop in (3, 4):  # 1 - 0.2 * 5 = 0 at step 2; 1 - 0.2 * 10 = -1 at step 4
        part = log.filter(F.col("step") != (2 if stop == 4 else 4))
        got = {r["step"]: (r["beta"], r["next_beta"]) for r in A.kl_path(part, "step", "seq", F.col("kl"), "mask", beta=1.0, target=0.2, horizon=1.0).collect()}
        beta = 1.0
        for s, kl, n in ((1, 0.3, 2), (2, 0.0, 5), (3, 0.5, 1), (4, 0.0, 10)):
            if s in got:
                after = beta * (1 + max(-0.2, min(0.2, kl / 0.2 - 1)) * n)
                assert got[s] == pytest.approx((beta, after), abs=1e-6)
                beta = after
