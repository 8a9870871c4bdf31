"""Small worked cases with known results."""
from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rollstat.functions import registry
from rollstat.operators import domains as H
from rollstat.operators import evals as E
from rollstat.operators import instructions as I
from rollstat.operators import normalize as N
from rollstat.operators import sampling as S
from rollstat.operators import scoring as D


def value(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], list(cells))
    return df.select(column.alias("v")).first()["v"]


def text(spark, fn, t):
    return value(spark, fn(F.col("t")), t=t)


def test_integer_answers(spark):
    score = lambda c, a: value(spark, D.score_integer_answer(F.col("c"), F.col("a")), c=c, a=a)
    assert score("so \\boxed{033}", "33")
    assert not score("so \\boxed{34}", "33")
    assert score("first 5\nthe answer is 204.", "204")


def test_quotas_and_allocation():
    assert S.quotas(128, {"math": 0.1, "code": 0.2, "if": 0.7}) == {"math": 13, "code": 26, "if": 89}
    assert S.allocate(100, {"a": 1, "b": 1, "c": 1}) == {"a": 33, "b": 33, "c": 34}
    with pytest.raises(ValueError):
        S.quotas(10, {"a": 0.0, "b": 1.0})


def test_batches_hold_exact_quotas(spark):
    rows = [(i, "abc"[0 if i < 10 else 1 if i < 50 else 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, domain string")
    plan = S.weighted_batch_plan(df, "domain", "id", batch_size=12, weights={"a": 1, "b": 1, "c": 1}, seed=3).collect()
    assert len(plan) == 96
    for b in range(8):
        batch = [r for r in plan if r["batch"] == b]
        assert sorted(r["domain"] for r in batch) == sorted("abc" * 4)
        assert sorted(r["place"] for r in batch) == list(range(1, 13))
    # the pool of ten is used up and started again: every row two to four times
    uses = [sum(r["id"] == i for r in plan) for i in range(10)]
    assert min(uses) >= 3 and max(uses) <= 4
    again = S.weighted_batch_plan(df.repartition(7), "domain", "id", batch_size=12, weights={"a": 1, "b": 1, "c": 1}, seed=3).collect()
    assert sorted(map(tuple, plan)) == sorted(map(tuple, again))


def test_latest_success(spark):
    rows = [("p", "old", 1.0, 1), ("p", "new", 1.0, 2), ("q", "bad", 0.0, 3)]
    df = spark.createDataFrame(rows, "input string, output string, score double, step int")
    best, counts = S.latest_success_per_prompt(df, prompt="input", response="output", step="step", score="score", min_score=1.0)
    assert [(r["input"], r["output"]) for r in best.collect()] == [("p", "new")]
    assert tuple(counts.first()) == (3, 2, 1)


def test_funnel(spark):
    q = lambda i, text, d, a: (i, text, d, a)
    df = spark.createDataFrame([q(0, "a  b", 3, "1"), q(1, "a b", 3, "1"), q(2, "c", 3, "1"), q(3, "d", 20, "1"), q(4, "e", 0, "1"), q(5, "f " * 30, 3, "1")],
                               "i long, t string, d int, a string")
    args = dict(question=F.col("t"), difficulty=F.col("d"), answer=F.col("a"), tokens=F.regexp_count("t", F.lit(r"\S+")), source_row="i",
                seed=42, min_difficulty=1, max_difficulty=15, max_tokens=10)
    rows, counts = S.govern_rows(df, target_rows=2, **args)
    assert sorted(r["i"] for r in rows.collect()) == [0, 2]
    c = counts.first()
    assert (c["rejected_difficulty"], c["rejected_prompt_too_long"], c["deduplicated"]) == (2, 1, 1)
    with pytest.raises(Exception, match="too few"):
        S.govern_rows(df, target_rows=5, **args)[1].collect()


def test_flat_prompt(spark):
    got = value(spark, N.flat_prompt_to_messages(F.col("p"), F.lit("hi")), p="system\nbe nice\nuser\nhello\nassistant\n")
    assert [(m["role"], m["content"]) for m in got] == [("system", "be nice"), ("user", "hello"), ("assistant", "hi")]


def test_families(spark):
    assert text(spark, N.classify_family, "Include the keywords a and b.") == "keywords"
    assert text(spark, N.classify_family, "Your  ENTIRE response should be in German, no keyword.") == "language"
    assert text(spark, N.classify_family, "Say it.") == "other"


def test_kwargs(spark):
    got = value(spark, N.canonical_kwargs(F.col("k"), F.lit(N.COUNT_WORD_INSTRUCTION)), k='{"keyword2": ["x y"], "b": null, "a": [1, 2]}')
    assert json.loads(got) == {"a": [1, 2], "b": None, "keyword2": "x y"}
    assert value(spark, N.canonical_kwargs(F.col("k"), F.lit("other")), k='{"keyword2": ["x"]}') == '{"keyword2": ["x"]}'


@pytest.mark.parametrize("answer, verdict", [
    ("<verdict>YES</verdict>", True), ("<verdict> no </verdict>", False), ("\\boxed{true}", True), ("maybe\nNo", False), ("yes and no", None), ("", None), ("unsure", None)])
def test_verdicts(spark, answer, verdict):
    assert text(spark, D.parse_verdict, answer) is verdict


def test_latex_forms(spark):
    eq = lambda a, b: value(spark, D.latex_equal(F.col("a"), F.col("b")), a=a, b=b)
    assert eq("\\dfrac12", "\\frac{1}{2}") and eq("0.5", "1/2") and eq("x=3", "3") and eq("\\sqrt2", "\\sqrt{2}") and eq(".5", "\\frac{1}{2}")
    assert not eq("3", "4") and not eq("\\frac", "1")


def test_boxed(spark):
    assert text(spark, D.boxed_content, "a \\boxed{x{y}z} b") == "x{y}z"
    assert text(spark, D.boxed_content, "a \\boxed{x") is None
    assert text(spark, D.boxed_content, "none") is None


def test_main_guard(spark):
    code = "a = 1\nif __name__ == '__main__':\n    run()\n\n    more()\nb = 2"
    assert text(spark, D.drop_main_guard, code) == "a = 1\nb = 2"


def test_behaviour_rates(spark):
    loop = " ".join(["wait, I see"] * 10)
    df = spark.createDataFrame([(loop, 10, 10), ("a fine answer", 3, 10)], "completion string, n int, cap int")
    rows = E.repetition_metrics(df, "completion")
    r = E.behavior_rates(rows, [], F.col("n") >= F.col("cap"), F.col("repetitive")).first()
    assert (r["trunc_rows"], r["repeat_rows"], r["trunc_repeat_rows"], r["trunc_rate"]) == (1, 1, 1, 0.5)


def brute_overlap(s):
    suffixes = sorted(s[i:] for i in range(len(s)))
    common = 0
    for a, b in zip(suffixes, suffixes[1:]):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        common += k
    return 2 * common / (len(s) * (len(s) + 1)) if len(s) > 1 else 0.0


@pytest.mark.parametrize("s", ["", "a", "ab", "aaaaaaaa", "abcabcabcabd", "banana banana", "xyzzy" * 7, "Grüße aus Köln"])
def test_self_overlap(s):
    assert E._overlap_share(s) == pytest.approx(brute_overlap(s))


def test_majority_of_one_answer(spark):
    df = spark.createDataFrame([("s", 1, i, "x", 1.0) for i in range(4)], "src string, uid long, pos long, pred string, acc double")
    got = {r["k"]: r["maj_mean"] for r in E.majority_metrics(df, "src", "uid", "pred", "acc").collect()}
    assert got == {2: 1.0, 4: 1.0}


def test_domain_shares(spark):
    rows = [("math", 1, p, 1, 1.0) for p in range(80)] + [("if", 2, p, 1, -2.0) for p in range(4)]
    df = spark.createDataFrame(rows, "domain string, s long, pos int, mask int, r double")
    got = {r["domain"]: r for r in H.domain_shares(df, "domain", "s", "mask", "r").collect()}
    assert got["math"]["prompt_share"] == 0.5 and got["math"]["token_share"] == pytest.approx(80 / 84)
    assert got["if"]["reward_abs_mean"] == 2.0
    w = H.domain_loss_weights(df, "domain", "mask", targets=None).collect()
    assert sum(r["weight"] * r["token_share"] for r in w) == pytest.approx(1.0)


def test_reward_tiers(spark):
    think = "<think>\n</think>"
    df = spark.createDataFrame([(think + "fine long answer", True), ("fine long answer", True), (think + "x", False), ("x", False)], "r string, ok boolean")
    df = df.select("r", F.array("ok").alias("checks"), F.array(F.lit("punctuation:no_comma")).alias("ids"), F.lit("other").alias("fam"), F.lit("Tell.").alias("p"), F.lit(0).alias("err"))
    out = I.tiered_instruction_reward(df, "r", checks="checks", errors="err", ids="ids", family="fam", prompt="p")
    assert sorted((r["r"], r["score"]) for r in out.select("r", "score").collect()) == sorted([
        (think + "fine long answer", 1.0), ("fine long answer", 0.8), (think + "x", 0.2), ("x", 0.0)])


def test_resample_counts(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(200)], "id long, s double")
    w = S.resample_weights(df, "s", "pow")
    got = S.importance_resample(w, "id", "weight", 1000, 7).collect()
    assert sum(r["copies"] for r in got) == 1000
    assert sum(r["copies"] for r in got if r["s"] == 0) < 5
    assert 380 < sum(r["copies"] for r in got if r["s"] == 4.0) < 690  # 16/30 of the weight


def test_registries():
    assert registry.get(registry.ESTIMATORS, "gae")
    with pytest.raises(ValueError):
        registry.get(registry.SAMPLERS, "nope")
    with pytest.raises(ValueError):
        D.register_scorer("latex", D.score_latex_equal)


def test_pad_and_unpad(spark):
    df = spark.range(10)
    padded = S.pad_to_divisor(df, "id", 4)
    assert padded.count() == 12 and padded.filter("is_pad and id < 2").count() == 2
    assert S.unpad(padded).count() == 10
    assert S.pad_to_divisor(spark.range(3), "id", 8).count() == 8


def test_win_chances_against_every_draw():
    import itertools
    from collections import Counter

    for counts, n in (((1, 2, 3), 4), ((2, 2), 5), ((1, 1, 1, 2), 3), ((5,), 4)):
        rows = [p for p, c in enumerate(counts) for _ in range(c)]
        wins = Counter()
        for draw in itertools.product(rows, repeat=n):
            seen = Counter(draw)
            top = max(seen.values())
            wins[next(p for p in draw if seen[p] == top)] += 1
        total = len(rows) ** n
        classes = Counter(counts)
        chances = dict(zip(classes, E.win_chances(list(classes), list(classes.values()), n), strict=True))
        assert [chances[c] for c in counts] == pytest.approx([wins[p] / total for p in range(len(counts))])
    assert sum(E.win_chances((40, 300, 7), (1, 1, 1), 200)) == pytest.approx(1.0)


def test_win_chances_of_a_thousand_answers():
    import time

    start = time.perf_counter()
    assert E.win_chances([1], [1024], 1024) == pytest.approx([1 / 1024], rel=1e-9)
    assert time.perf_counter() - start < 5
    low, high = E.win_chances([1, 2], [1000, 12], 1024)
    assert 1000 * low + 12 * high == pytest.approx(1.0, rel=1e-9) and high > 2 * low


def test_majority_takes_answers_by_their_frequency(spark):
    """Three answers once, one twice: 4 draws of 5 rows, every draw listed."""
    import itertools
    from collections import Counter

    rows = [("a", 1.0), ("b", 0.0), ("c", 0.5), ("d", 0.25), ("d", 0.75)]
    df = spark.createDataFrame([(None, 1, p, v) for p, v in rows], "src string, uid int, pred string, v double")
    got = {r["k"]: (r["maj_mean"], r["maj_std"]) for r in E.majority_metrics(df, "src", "uid", "pred", "v").collect()}
    values = []
    for draw in itertools.product(rows, repeat=4):
        top = Counter(p for p, _ in draw)
        values.append(next(v for p, v in draw if top[p] == max(top.values())))
    mean = sum(values) / len(values)
    assert got[4] == pytest.approx((mean, (sum(v * v for v in values) / len(values) - mean * mean) ** 0.5))
