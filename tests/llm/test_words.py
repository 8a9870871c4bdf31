"""Periodic runs, spelling variants and voted rules against brute force, and their defined cases."""
from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollstat.llm import periods, rules, variants
from rollstat.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, id string, word string, n int, runs int, key string, symbols int, posterior string"
TEXTS = [
    None, "", "  \t\n", "a", "a " * 23, "a " * 24, "a " * 25, "é " * 30, "　 " * 30, "word " * 3000, ("one two three " * 20) + "end",
    " ".join(f"w{i % 60}" for i in range(400)), " ".join(f"w{i % 60}" if i != 200 else "x" for i in range(400)),
    " ".join(["x", "x", "y"] * 9 + ["x"] * 40), "x" * 100_000, "line one here\nline one here\n \nline one here\nother", "Tab\x0bsplit\x0cwords\rhere",
    "Straße STRASSE straße Ärger Ärgers ärger worden werden wurden worden worden worden wordens wordenss wordensss", "#$ %& | <> * word.", "日本語 テキスト. 日本語!",
    "aab aab ab", "hello helo hallo hello hello jello cello cells " * 5, "\x00 \x1c nul \x85 \xa0",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, null ids, clashing further columns."""
    rows = [(i, t, None, "x", "w", 1, 2, "k", 3, "p") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[9], rows[9], (None, "a " * 30, *[None] * 8), (None, None, *[None] * 8)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def row_key(row):
    return tuple((v is None, str(v)) for v in row)


def same_rows(got, want):
    assert sorted(map(tuple, got), key=row_key) == sorted(map(tuple, want), key=row_key)


# ---- periodic runs


def all_runs(words, least=24, exponent=3):
    """Every lag, every stretch; the smallest lag of a stretch is its period."""
    found = {}
    for lag in range(1, len(words) // exponent + 1):
        start = None
        for i in range(len(words) - lag + 1):
            same = i < len(words) - lag and words[i] == words[i + lag]
            if same and start is None:
                start = i
            if not same and start is not None:
                if i - start + lag >= max(least, exponent * lag):
                    found.setdefault((start, i + lag), lag)
                start = None
    return sorted((s, e - s, q) for (s, e), q in found.items())


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        n, vocabulary = rng.choice([0, 1, 30, 200, 500, 900]), rng.choice([1, 2, 3, 30, 1000])
        words = [rng.randrange(vocabulary) for _ in range(n)]
        for _ in range(rng.randrange(4) if n else 0):
            start, period = rng.randrange(n), rng.choice([1, 2, 7, 20, 47, 48, 49, 95, 96, 97, 150, 200, 300])
            unit = [rng.randrange(vocabulary) for _ in range(period)]
            if rng.random() < 0.4:  # runs inside the period of a longer run
                inner = rng.choice([1, 2, 3, 5])
                unit = [unit[i % inner] for i in range(period)]
                for _ in range(rng.randrange(3)):
                    unit[rng.randrange(period)] = -1
            for i in range(start, min(n, start + rng.randrange(1, 6 * period + 30))):
                words[i] = unit[(i - start) % period]
        assert periods.find_runs(np.array(words, np.int32)) == all_runs(words)


def test_long_texts_and_parameters():
    assert periods.find_runs(np.zeros(500_000, np.int32)) == [(0, 500_000, 1)]
    nested = np.tile(np.r_[np.zeros(1000, np.int32), np.arange(1, 1001, dtype=np.int32)], 4)
    assert periods.find_runs(nested) == [(0, 1000, 1), (0, 8000, 2000), (2000, 1000, 1), (4000, 1000, 1), (6000, 1000, 1)]
    with pytest.raises(ValueError):
        periods.find_runs(nested, least=30)
    with pytest.raises(ValueError):
        periods.find_runs(nested, exponent=2)


def period_truth(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    return (
        doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def period_query(docs):
    text = periods.with_planted_tails(F.col("text"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return periods.run_digest(periods.periodic_runs(docs, "doc_id", text))


def test_periods_of_odd_rows(spark, odd, none):
    short = odd.filter("text is null or length(text) < 50000 and length(text) <> 15000")  # brute force is quadratic
    same_rows(period_query(short).collect(), [period_truth(r["doc_id"], r["text"]) for r in short.collect()])
    long = {r["doc_id"]: r for r in period_query(odd).collect()}
    assert (long[9]["start"], long[9]["length"], long[9]["period"], long[9]["exponent_milli"]) == (0, 3000, 1, 3_000_000)
    assert long[14]["n_runs"] == 0 and period_query(none).count() == 0
    plain = {r["doc_id"]: r for r in periods.periodic_runs(odd).collect()}
    assert plain[10]["collapsed"] == "one two three end" and plain[10]["n_words"] == 61
    assert [tuple(x) for x in plain[11]["runs"]] == [(0, 400, 60)] and plain[0]["collapsed"] == ""


def test_periods_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_periods"](spark, sf).collect()}
    rows = [r for r in docs.select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    for r in rows:
        if len(r["text"] or "") < 12_000 or zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0:
            assert got[r["doc_id"]] == period_truth(r["doc_id"], r["text"])


# ---- spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_truth(rows, shortest=5, slip=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= shortest:
                counts[run] += 1
    return counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variant_truth(counts):
    near = {w: [] for w in counts}
    by_size = {}
    for w in counts:
        by_size.setdefault(len(w), []).append(w)
    for size, own in by_size.items():
        for i, a in enumerate(own):
            for b in own[i + 1:] + by_size.get(size + 1, []):
                if one_edit(a, b):
                    near[a].append(b)
                    near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def as_words(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n bigint")


def test_word_counts(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for slip in (97, 2, 0):
        got = variants.count_words(odd, shortest=3, slip=slip).collect()
        same_rows(got, word_truth(rows, 3, slip).items())
    assert variants.count_words(none).count() == 0
    assert variants.latin_runs("AbĀcéÐ× x\U0001f600y") == [b"ab", "céÐ×".encode(), b"x", b"y"]


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_brute_force(spark, seed):
    """Dense words over few letters: doubled letters, every kind of edit, long chains, ties."""
    rng = random.Random(seed)
    letters = ["ab", "abcé", "abcdefgh"][seed]
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))): rng.choice([1, 2, 3, 4, 8, 16, 40, 100]) for _ in range(400)}
    same_rows(variants.spelling_variants(as_words(spark, counts)).collect(), variant_truth(counts))


def test_long_chain_and_empty(spark):
    counts = {"a" * k: 2 ** k for k in range(1, 50)}
    got = {r["word"]: r for r in variants.spelling_variants(as_words(spark, counts)).collect()}
    assert {r["root"] for r in got.values()} == {"a" * 49} and got["a" * 7]["form"] == "a" * 8 and got["a" * 49]["form"] is None
    assert variants.spelling_variants(as_words(spark, {"x": 1}).filter("false")).count() == 0
    blanks = spark.createDataFrame([(None, 3, 1), ("word", None, 1), ("words", 4, 1)], "word string, n bigint, form int")
    assert [tuple(r) for r in variants.spelling_variants(blanks).collect()] == [("words", None, "words", 4, 0, None)]
    with pytest.raises(ValueError):
        variants.spelling_variants(blanks, ratio=1.5)


def test_variants_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = {w: n for w, n in word_truth(rows).items() if n >= 3}
    same_rows(QUERIES["op12_variants"](spark, sf).collect(), variant_truth(counts))


# ---- voted rules


def count_truth(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in (i, i + 1, i + 2)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_adjacent": sum(a == b for a, b in zip(words, words[1:], strict=False)),
        "n_upper": len(re.findall("[A-Z]", text)), "n_lower": len(re.findall("[a-z]", text)),
        "n_ends": sum(w[-1] in ".!?" for w in words), "n_top": max(Counter(words).values(), default=0)}


def test_counts_of_texts(spark, sf, odd, none):
    texts = [*TEXTS, *[r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]]
    for text in texts:
        assert dict(zip(rules.STATISTICS, rules.statistics((text or "").encode()), strict=True)) == count_truth(text)
    rng = random.Random(5)
    for _ in range(200):
        ids = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(12))]
        for window in (2, 3, 4):
            found = [tuple(ids[i:i + window]) for i in range(len(ids) - window + 1)]
            inside = {j for i, w in enumerate(found) if found.count(w) > 1 for j in range(i, i + window)}
            assert rules.repeated_words(np.array(ids, np.int32), window) == len(inside)


def em_truth(votes, rounds=1000):
    """Expectation-maximisation document by document, in plain Python."""
    share, good, bad, weight = rules.START
    k = len(votes[0])
    chance = [[dict(zip(rules.VOTES, p, strict=True)) for _ in range(k)] for p in (good, bad)]
    for _ in range(rounds):
        post = []
        for v in votes:
            a, b = share, 1 - share
            for j in range(k):
                a, b = a * chance[0][j][v[j]], b * chance[1][j][v[j]]
            post.append(a / (a + b))
        new_share = (math.fsum(post) + weight * rules.START[0]) / (len(votes) + weight)
        fresh = []
        for c, start in ((0, good), (1, bad)):
            w = [p if c == 0 else 1 - p for p in post]
            per_rule = []
            for j in range(k):
                got = {o: math.fsum(x for x, v in zip(w, votes, strict=True) if v[j] == o) + weight * s for o, s in zip(rules.VOTES, start, strict=True)}
                total = sum(got.values())
                got = {o: x / total for o, x in got.items()}
                if c == 0 and got[-1] > rules.MOST_FALSE:
                    scale = (1 - rules.MOST_FALSE) / (1 - got[-1])
                    got = {1: got[1] * scale, 0: got[0] * scale, -1: rules.MOST_FALSE}
                per_rule.append(got)
            fresh.append(per_rule)
        moved = max(abs(fresh[c][j][o] - chance[c][j][o]) for c in (0, 1) for j in range(k) for o in rules.VOTES)
        chance, share = fresh, new_share
        if moved < 1e-10:
            break
    return share, chance


def test_accuracies_equal_plain_em():
    rng = np.random.default_rng(2)
    truth = rng.random(3000) < 0.7
    right = np.array([0.95, 0.8, 0.99, 0.6])
    speaks = rng.random((3000, 4)) < 0.7
    correct = rng.random((3000, 4)) < right
    votes = np.where(speaks, np.where(correct == truth[:, None], 1, -1), 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = rules.fit_votes(patterns, counts.astype(float))
    share, chance = em_truth(votes.tolist())
    assert model.good_share == pytest.approx(share, abs=1e-6)
    for c in (0, 1):
        for j in range(4):
            assert model.chances[c, j] == pytest.approx([chance[c][j][o] for o in rules.VOTES], abs=1e-6)


def test_accuracies_are_recovered():
    rng = np.random.default_rng(4)
    truth = rng.random(40_000) < 0.8
    false, found = np.array([0.002, 0.005, 0.001, 0.004]), np.array([0.7, 0.5, 0.6, 0.4])
    bad = np.where(truth[:, None], rng.random((40_000, 4)) < false, rng.random((40_000, 4)) < found)
    patterns, counts = np.unique(np.where(bad, -1, 1), axis=0, return_counts=True)
    model = rules.fit_votes(patterns, counts.astype(float))
    got = model.accuracies()
    assert got[:, 0] == pytest.approx(1 - false, abs=0.01) and got[:, 1] == pytest.approx(found, abs=0.05)
    assert model.good_share == pytest.approx(0.8, abs=0.02)


def test_no_patterns_and_one_pattern():
    empty = rules.fit_votes(np.zeros((0, 7), np.int64), np.zeros(0))
    assert 0 < empty.good_share < 1
    one = rules.fit_votes(np.ones((1, 7), np.int64), np.array([1000.0]))
    assert one.posterior(np.ones((1, 7)))[0] > 0.9


def test_judged_rows(spark, odd, none):
    judged = rules.judge_quality(odd).collect()
    assert len(judged) == odd.count() and rules.judge_quality(none).count() == 0
    by_id = {r["doc_id"]: r for r in judged if r["doc_id"] is not None}
    for i, text in enumerate(TEXTS):
        want = count_truth(text)
        assert {n: by_id[i][n] for n in rules.STATISTICS} == want
    assert all(by_id[0][r.name] == 0 for r in rules.RULES)  # no text: every rule abstains
    assert by_id[9]["repetition"] == -1 and by_id[9]["top_word"] == -1
    # the expression equals the model
    patterns, counts = np.unique([[r[x.name] for x in rules.RULES] for r in judged], axis=0, return_counts=True)
    model = rules.fit_votes(patterns, counts.astype(float))
    for r in judged:
        assert r["posterior"] == pytest.approx(model.posterior(np.array([[r[x.name] for x in rules.RULES]]))[0], rel=1e-6, abs=1e-9)
        assert r["good"] == (r["posterior"] >= 0.5)
    with pytest.raises(ValueError):
        rules.judge_quality(odd, rules=rules.RULES * 2)


def test_rules_query(spark):
    """Labels are not read; they only measure the verdict."""
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op13_rules"](spark, sf)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good, bad = [], []
    for r in out.collect():
        want = count_truth(docs[r["doc_id"]])
        assert all(r[k] == want[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (r["base_failed"] and r["kept"])
        if labels.get(r["doc_id"]) is not None and not r["base_failed"]:
            (good if labels[r["doc_id"]] == 1 else bad).append(r["kept"])
    assert sum(good) > 0.97 * len(good) and sum(bad) < 0.1 * len(bad)
