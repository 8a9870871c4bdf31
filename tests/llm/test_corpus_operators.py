"""The corpus operators against brute force, and their defined cases."""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollstat.llm import chat, components, exact_dedup, language, licenses, mixing, neighbours, packing, positions, quality, simhash, toxicity
from rollstat.llm.common import blocks, local_components, runs
from rollstat.llm.queries import tokenizer_path

WHITE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, k1 int, id string, hash int, label int"
TEXTS = [
    None, "", "  \t\n", "a", "A b c", "a  b\nc", "abc", "the cat sat on the mat today", "the cat sat on the mat today", "The Cat sat on the mat  today",
    "one two", "é É ü", "x" * 5000, "word " * 3000, "last one\x0b\x0c end", "日本語 テキスト", "1 2 3 4",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, null ids, clashing further columns."""
    rows = [(i, t, "en" if i % 3 else None, [None, "a", "b", "c"][i % 4], len(t or ""), "r", 1, "x", 2, 0) for i, t in enumerate(TEXTS)]
    rows += [rows[8], rows[8], (None, "no id here", "en", "a", 10, None, None, None, None, None), (None, "no id here", "en", "a", 10, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def plain(df):
    return [tuple(r) for r in df.collect()]


def order(value):
    return (value is None, value if value is not None else 0)


# ---- helpers


def test_blocks_cover_everything():
    data = (b"ab cd\tef\n" * 50) + b"z" * 100 + b" end"
    parts = list(blocks(data, 10))
    assert b"".join(parts) == data and len(parts) > 10
    assert [w for p in parts for w in p.split()] == data.split()


def test_runs_keep_groups_whole():
    keys = [1, 1, 2, 3, 3, 3, 3, 4, 5, 5]
    frame = pd.DataFrame({"k": keys, "v": range(10)})
    for size in (1, 2, 3, 10):
        got = list(runs((frame.iloc[i:i + size] for i in range(0, 10, size)), ["k"]))
        assert pd.concat(got)["v"].tolist() == list(range(10))
        assert sum(f["k"].nunique() for f in got) == 5


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, None)] + [(500, 500 + k) for k in range(1, 60)]
    got = dict(plain(components.components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b")))
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100} | {500 + k: 500 for k in range(60)}
    assert got == want
    assert not plain(components.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b"))
    assert local_components(5, np.array([0, 3]), np.array([3, 4])).tolist() == [0, 1, 2, 0, 0]


def test_running_sum_over_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.5 else f"g{rng.integers(3)}", int(rng.integers(50)), i, int(rng.integers(9))) for i in range(3000)]
    got = positions.running_sum(spark.createDataFrame(rows, "g string, a int, b int, w int").repartition(7), "g", ["a", "b"], "w", "s")
    sums, want = Counter(), {}
    for g, a, b, w in sorted(rows, key=lambda r: (r[0] or "", r[0] is None, r[1], r[2])):
        sums[g] += w
        want[b] = sums[g]
    assert {r["b"]: r["s"] for r in got.collect()} == want
    numbers = positions.numbered(spark.createDataFrame(rows, "g string, a int, b int, w int"), ["a", "b"], "n")
    assert [r["n"] for r in numbers.orderBy("a", "b").collect()] == list(range(3000))


# ---- exact duplicates


def exact_truth(rows):
    norm = lambda t: WHITE.sub("", t or "")
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(norm(r["text"]), []).append(r)
    out = []
    for body, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), order(r["doc_id"])))
        first = True
        for r in sorted(members, key=lambda r: (-len(r["text"] or ""), order(r["doc_id"]))):
            out.append((r["doc_id"], best["doc_id"], len(members), first, hashlib.sha256(body.encode()).hexdigest()))
            first = False
    return sorted(out, key=lambda x: tuple(map(str, x)))


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(odd, weak):
    hash_of = (lambda b: F.lit(b"x")) if weak else exact_dedup.content_hash  # every hash collides
    got = sorted(plain(exact_dedup.exact_duplicates(odd, hash_of=hash_of)), key=lambda x: tuple(map(str, x)))
    assert got == exact_truth(odd.collect())


def test_exact_keep_first(odd, none):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    want = Counter((r[0], r[4]) for r in exact_truth(odd.collect()) if r[3])
    assert Counter((r["doc_id"], hashlib.sha256(WHITE.sub("", r["text"] or "").encode()).hexdigest()) for r in kept.collect()) == want
    assert not plain(exact_dedup.exact_duplicates(none)) and not plain(exact_dedup.keep_first(none))


# ---- simhash


def simhash_truth(text):
    words = [w.encode() for w in WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))]
    parts = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def linked(values, near):
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprints_match_and_blocks_agree(odd, spark):
    for r in odd.collect():
        assert simhash.fingerprint(r["text"]) % (1 << 64) == simhash_truth(r["text"])
    spark_hash = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert spark_hash % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)
    long = " ".join(f"w{i * i % 997}" for i in range(300_000))
    assert simhash.fingerprint(long) % (1 << 64) == simhash_truth(long)


def test_simhash_components(odd, none):
    rows = odd.collect()
    prints = [simhash_truth(r["text"]) for r in rows]
    root = linked(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for r, k in zip(rows, root, strict=True):
        if r["doc_id"] is not None:
            low[k] = min(low.get(k, r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f"{p:016x}", low.get(k)) for r, p, k in zip(rows, prints, root, strict=True))
    assert Counter(plain(simhash.simhash_near_duplicates(odd))) == want
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(simhash_truth(r["text"]) for r in kept.collect()).most_common(1)[0][1] == 1 and kept.count() == len(set(root))
    assert not plain(simhash.simhash_near_duplicates(none)) and not plain(simhash.keep_one(none))


@pytest.mark.parametrize("max_bits,shard_rows", [(3, 2048), (3, 8), (5, 64)])
def test_links_are_complete(spark, max_bits, shard_rows):
    """Random fingerprints, dense balls around a few, pairs at exactly the bound; also with tiny shards."""
    rng = np.random.default_rng(5)
    values = set(rng.integers(0, 1 << 62, 200).tolist())
    for center in rng.integers(0, 1 << 62, 3).tolist():
        for _ in range(80 if max_bits == 3 else 25):
            v = center
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    edges = simhash.linked_prints(spark.createDataFrame([(v,) for v in values], "fp bigint"), max_bits, shard_rows)
    got = dict(plain(components.components(edges, "fp", "root")))
    root = linked(values, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= max_bits)
    assert [got.get(v, v) for v in values] == [values[k] for k in root]


def test_large_shards_are_split_by_themselves(spark, monkeypatch):
    """Twelve sources that share twelve bodies: no level has a larger shard than the one before."""
    rng = np.random.default_rng(12)
    heads, bodies = rng.integers(0, 1 << 16, 12).tolist(), rng.integers(0, 1 << 47, 12).tolist()
    values = [(h | b << 16,) for h in heads for b in bodies]
    sizes, write = [], simhash.materialize

    def seen(df, label):
        out = write(df, label)
        if label == "shards":
            sizes.append(out.groupBy(*[c for c in out.columns if c != "fp"]).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(simhash, "materialize", seen)
    simhash.linked_prints(spark.createDataFrame(values, "fp bigint"), 3, 8)
    assert len(sizes) > 2 and sizes == sorted(sizes, reverse=True)


def test_vantage_tree_prunes_exactly():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    points = np.unique(np.r_[base, base[:800] ^ np.uint64(5), base[:500] ^ (np.uint64(1) << np.uint64(40))])
    a, b = simhash.close_pairs(points, 3)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    want = {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}
    assert {(int(i), int(j)) for i, j in zip(a, b, strict=True)} == want


# ---- mixing


def mix_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, rest = total - sum(most * sizes[s] for s in capped), sum(w[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and w[s] * left / rest > most * sizes[s]} if rest else set()
        if not more:
            return {s: float(most * sizes[s]) if s in capped else w[s] * left / rest for s in names}
        capped |= more


def test_mixture(odd, docs, none):
    for df in (odd, docs):
        rows = df.select("doc_id", "source", "text").collect()
        sizes = Counter()
        for r in rows:
            sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        goal = mix_targets(sizes)
        got = mixing.mixture(df).collect()
        assert len(got) == len(rows)
        taken, by_size = Counter(), {(r["source_size"], round(r["target"], 6)) for r in got}
        assert by_size == {(sizes[s], round(goal[s], 6)) for s in sizes}
        for r in got:
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source_size"], r["target"]] += r["taken"]
        same = Counter((sizes[s], goal[s]) for s in sizes)
        for (size, target), words in taken.items():
            n = sum(c for (a, b), c in same.items() if a == size and math.isclose(b, target))
            assert abs(words - n * target) <= n
        assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mixture(df.repartition(5)).collect()))
    assert not plain(mixing.mixture(none))


def test_mix_copies(odd, none):
    plan = mixing.mixture(odd).collect()
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.schema == odd.schema
    rows = out.collect()
    assert sum(len(WORD.findall(r["text"] or "")) for r in rows) == sum(r["taken"] for r in plan)
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in rows:
        assert texts[r["doc_id"]] == r["text"] or texts[r["doc_id"]].startswith(r["text"])
    assert not plain(mixing.mix(none))


# ---- packing


def reference_pieces(rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k:k + capacity], "<u4")
            out[r["doc_id"], k // capacity, k, len(part), zlib.crc32(part.tobytes())] += 1
    return out


def assert_gapless(rows, capacity):
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_pack(odd, docs, none, capacity):
    for df in (odd, docs):
        packed = packing.pack(df, tokenizer_path("word_bpe_49k.json"), capacity).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == reference_pieces(df.collect(), capacity)
        used, least = assert_gapless(packed, capacity), -(-sum(r["length"] for r in packed) // capacity)
        assert used <= least * 1.05 + 2
    assert not plain(packing.pack(none, tokenizer_path("word_bpe_49k.json")))


def test_words_tokenize_as_texts():
    words = packing.WordIds(tokenizer_path("word_bpe_49k.json"))
    texts = ["a\x1cb c\x85d\xa0e", "ΣΑΣ ΟΔΟΣ", "İstanbul x×y ÷ naïve ﬁ", "<|endoftext|> hi", "<|ENDOFTEXT|> Hi", "don't I'LL", "x y", "é é Å Å", " a\tb\n\nc ", "1234 5,6",
             "😀👍🏽 ok", "İı ß ẞ ŉ ǅ", "a" * 3000 + " b", "​zero ﻿", "fo\xadobar", ("lorem Ipsum, " * 200_000)]
    for t in texts:
        assert b"".join(words.text(t)) == np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_plan_is_whole_and_matches_large_items():
    rng = np.random.default_rng(1)
    for trial in range(200):
        capacity = int(rng.integers(3, 60))
        counts = {int(n): int(rng.integers(1, 40)) for n in rng.integers(1, capacity + 1, rng.integers(1, 20))}
        spans: dict[int, list] = {}
        items = Counter()
        for length, low, high, first, each, base in packing.packing_plan(counts, capacity):
            spans.setdefault(length, []).append((low, high))
            for rank in range(high - low):
                items[first + rank // each, base + rank % each * length, length] += 1
        for length, n in counts.items():
            end = 0
            for low, high in sorted(spans[length]):
                assert low == end
                end = high
            assert end == n
        rows = [{"sequence_id": b, "offset": o, "length": n} for (b, o, n), c in items.items() for _ in range(c)]
        bins = assert_gapless(rows, capacity)
        large = Counter(b for (b, _, n) in items if 3 * n > capacity)
        assert max(large.values(), default=0) <= 2
        total = sum(n * c for n, c in counts.items())
        assert bins <= 11 / 9 * max(-(-total // capacity), sum(c for n, c in counts.items() if 2 * n > capacity)) * 1.2 + 4, trial


# ---- classifiers


def test_quality(spark, docs, labels, odd, none):
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(known[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert sum(a == b for a, b in held) >= 0.8 * len(held)
    # labels of the held-out rows teach nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, flipped).collect()}
    assert all(math.isclose(again[r["doc_id"]], r["score"], abs_tol=1e-9) for r in rows)
    assert len(quality.score_quality(odd, labels).collect()) == odd.count()
    blank = spark.createDataFrame([(1, None, None)], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality.score_quality(odd, blank).collect()} == {0.5}
    assert quality.keep_good(odd, blank).columns == odd.columns
    assert not plain(quality.score_quality(none, labels)) and not plain(quality.keep_good(none, labels))
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in rows if r["predicted"]}


def test_discriminant_matches_densities():
    rng = np.random.default_rng(2)
    d = 3
    a, b = rng.normal(0, 1, (400, d)), rng.normal(1.5, 2, (300, d))
    model = quality.Discriminant(np.array([400, 300]), np.array([a.sum(0), b.sum(0)]), np.array([a.T @ a, b.T @ b]), 0.0, 0.0, floor=1e-9)
    def density(x, rows, pooled, n):
        weight = n / (n + 2 * d)
        cov = weight * np.cov(rows.T) + (1 - weight) * pooled
        diff = x - rows.mean(0)
        return -0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1]
    pooled = (np.cov(a.T) * 399 + np.cov(b.T) * 299) / 698
    x = rng.normal(0.5, 1.5, (50, d))
    want = math.log(300 / 400) + density(x, b, pooled, 300) - density(x, a, pooled, 400)
    assert np.allclose(model.log_odds(x), want, atol=1e-6)


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(4)
    clean = [" ".join(f"w{rng.integers(400)}" for _ in range(40)) for _ in range(600)]
    rows, marks = [], []
    for i, text in enumerate(clean):
        toxic = i % 6 == 0
        rows.append((i, text + (" you Badword! nasty" + "ing" * int(rng.integers(2)) if toxic else "")))
        if i // 6 % 2 == 0:
            marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert all((r["doc_id"] % 6 == 0) == bool(r["predicted"]) for r in got if r["held_out"])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert len(toxicity.score_toxicity(odd, labels).collect()) == odd.count()
    assert {r["predicted"] for r in toxicity.score_toxicity(odd, labels.filter("toxic = 0")).collect()} == {0}
    assert not plain(toxicity.score_toxicity(none, labels))
    # labels of the held-out rows teach nothing, and neither does which of the other rows are confirmed clean
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, flipped).collect()}
    assert all(math.isclose(again[r["doc_id"]], r["score"], abs_tol=1e-9) for r in got)
    # in a text without blanks the same beginnings count, wherever they are
    clean = ["".join(f"w{rng.integers(400)}" for _ in range(30)) for _ in range(9)]
    unbroken = [(5000 + 10 * i + bad, text[:20 * i] + "badwording" * bad + text[20 * i:]) for i, text in enumerate(clean) for bad in (0, 1)]
    both = docs.unionByName(spark.createDataFrame(unbroken, docs.schema))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(both, labels).collect()}
    assert all(scores[5001 + 10 * i] > scores[5000 + 10 * i] for i in range(9))


def test_unlabelled_rows_include_the_positives(spark, monkeypatch):
    """Every learning row is unlabelled, the confirmed toxic ones too; held-out rows are neither."""
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words here "), F.when(F.col("id") % 4 == 0, "vile slur").otherwise("fine")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    seen = []
    monkeypatch.setattr(toxicity, "vocabulary", lambda sample, size, prior: seen.append((plain(sample.select("id", "positive")), prior)) or [])
    toxicity.score_toxicity(docs, labels)
    learning = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    rows, prior = seen[0]
    toxic = [i for i in learning if i % 4 == 0]
    assert sorted(rows) == sorted([(i, False) for i in learning] + [(i, True) for i in toxic]) and math.isclose(prior, len(toxic) / len(learning))


def test_toxicity_vocabulary_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(" ".join(rng.choice(["alpha", "beta", "gamma", "vilest", "viler", "x" * 50], 4)) + (" vilest" if p and rng.random() < 0.8 else ""), bool(p)) for p in rng.random(300) < 0.3]
    size, prior = 40, 0.3
    found = {f for text, _ in rows for f in toxicity.features(text)}
    n_p = sum(p for _, p in rows)
    n_u, chosen = len(rows) - n_p, []
    for f in found:
        p, u = (sum(f in toxicity.features(t) for t, toxic in rows if toxic is kind) for kind in (True, False))
        expected = u / n_u * n_p
        if p >= expected + toxicity.DEVIATIONS * math.sqrt(expected + 1) and prior * (p + 0.5) / (n_p + 1) > toxicity.PURITY * (u + 0.5) / (n_u + 1):
            chosen.append((u / (n_u + 1) - p / (n_p + 1), f))
    want = sorted(f for _, f in sorted(chosen)[:size])
    got = toxicity.vocabulary(spark.createDataFrame(rows, "text string, positive boolean"), size, prior)
    assert got == want and want


def test_corrected_risk_is_the_written_out_one():
    rng = np.random.default_rng(3)
    turned = set()
    for trial in range(20):
        g, positive, prior = rng.normal(0, 2, 40), rng.random(40) < 0.5, (0.1, 0.9)[trial % 2]

        def parts(margins, positive=positive, prior=prior):
            loss = lambda x: 1 / (1 + np.exp(x))
            first = prior * loss(margins[positive]).mean()
            return first, loss(-margins[~positive]).mean() - prior * loss(-margins[positive]).mean()

        first, rest = parts(g)
        turned.add(rest < 0)
        risk, slope = toxicity.corrected_risk(g, positive, prior)
        assert math.isclose(risk, first + max(0, rest))
        for i in range(40):
            step = np.eye(40)[i] * 1e-6
            high, low = parts(g + step), parts(g - step)
            want = high[0] - low[0] + (high[1] - low[1] if rest >= 0 else 0)
            assert math.isclose(slope[i], want / 2e-6, abs_tol=1e-7)
    assert turned == {True, False}


def test_corrected_risk_never_goes_negative():
    """With a prior too high the plain corrected risk falls below 0; the training must still separate."""
    rng = np.random.default_rng(6)
    positive = np.r_[np.ones(50, bool), np.zeros(200, bool)]
    has = np.r_[np.ones(50, bool), rng.random(200) < 0.2]
    w = toxicity.train(np.flatnonzero(has), np.zeros(has.sum(), int), positive, 1, prior=0.2, sparsity=0.0)
    assert w[0] + w[-1] > 0 > w[-1] and np.isfinite(w).all()


def test_language(docs, odd, none):
    rows = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held)
    got = language.identify(odd).select("doc_id", "lang_pred", "score", "rejected").collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got} <= {"en", "und"}
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(by_id[i] == "und" for i in (0, 1, 2, 16)) and by_id[7] == "en" and all(0 <= r["score"] <= 1 for r in got)
    assert not plain(language.identify(none))


# ---- embeddings


def test_language_learns_from_its_own_rows_only(docs):
    """Other languages on the held-out rows, or none, change nothing."""
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    want = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs).collect()}
    for other in (F.lit("zz"), F.lit(None).cast("string")):
        changed = docs.withColumn("lang", F.when(held, other).otherwise(F.col("lang")))
        assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(changed).collect()} == want


def test_language_is_the_smallest_compression(docs):
    """Against sizes from a compressor of each language made here, over pieces cut here."""
    import zstandard

    rows = docs.select(F.col("doc_id").alias("id"), "lang", "text").filter("lang is not null and text is not null")
    learned = language.dictionaries(rows)
    names = [n for n, _ in learned]
    made = [zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, c in learned]
    for content in made:
        content.precompute_compress(level=language.LEVEL)
    compressors = language._compressors(learned)
    for r in rows.limit(40).collect():
        data = (" " + re.sub(r"(?:[^\w]|[\d_])+", " ", r["text"].lower()) + " ").encode()
        sizes = [sum(len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(
            data[i:i + language.PIECE])) for i in range(0, len(data), language.PIECE)) for d in made]
        got = language.classify(r["text"], names, compressors, 0.01)
        assert sizes[names.index(got[0])] == min(sizes)
        first, second = sorted(sizes)[:2]
        assert math.isclose(got[2], (second - first) / second) and got[3] == (got[2] < 0.01)
    same = [compressors[0], compressors[0]]
    assert language.classify("words of any kind", ["x", "y"], same, 0.01)[0::2] == ("x", 0.0)
    assert language.classify("words of any kind", ["x", "y"], same, 0.01)[3] and language.classify(None, ["x"], same[:1], 0.01)[0] == "und"


def vector_truth(rows):
    units = []
    for _, v in rows:
        x = None if v is None else np.array([np.nan if a is None else a for a in v], float)
        ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
        units.append(x / np.linalg.norm(x) if ok else None)
    near = lambda a, b: a is not None and b is not None and len(a) == len(b) and float(a @ b) >= 0.95 - 1e-12
    root = linked(units, near)
    links = [sum(near(a, b) for j, b in enumerate(units) if i != j) for i, a in enumerate(units)]
    ids = [i for i, _ in rows]
    low = {k: min(i for i, r in zip(ids, root, strict=True) if r == k) for k in set(root)}
    return sorted((i, n, low[r], i == low[r]) for i, n, r in zip(ids, links, root, strict=True))


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((260, 16))
    cluster = x[0] + 0.08 * rng.standard_normal((90, 16))  # a dense group
    arc = [np.r_[np.cos(t), np.sin(t), np.zeros(14)] for t in np.arange(0, 3, 0.2)]  # a chain: the ends are not linked
    rows = [(1000 - i, v.astype(np.float32).tolist()) for i, v in enumerate([*x, *cluster, *arc, x[5], x[5], 2 * x[6]])]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, []), (5005, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    df = df.withColumn("unit", F.lit("clash")).withColumn("label", F.lit(None).cast("int"))
    got = sorted(plain(neighbours.embedding_near_duplicates(df)))
    want = vector_truth([(i, None if v is None else [None if a is None else np.float32(a) for a in v]) for i, v in rows])
    assert got == want
    assert not plain(neighbours.embedding_near_duplicates(df.limit(0)))


def test_embeddings_of_repeated_and_null_ids(spark):
    """Every row is a vector; a null id is the component's name only where no other is there."""
    near, alone, odd = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(7, near), (7, near), (None, near), (9, [1.0, 0.01, 0.0]), (None, alone), (3, odd), (3, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in neighbours.embedding_near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(7, 3, 7), (7, 3, 7), (None, 3, 7), (9, 3, 7), (None, 0, None), (3, 0, 3), (3, 0, 3)], key=str)


def test_embeddings_of_several_lengths(spark):
    rng = np.random.default_rng(6)
    rows = []
    for length in (3, 16, 24):
        x = rng.standard_normal((30, length))
        rows += [*x, *(x[:9] + 0.02 * rng.standard_normal((9, length))), *(x[0] + 0.01 * rng.standard_normal((20, length))), np.r_[x[1], 0.0]]
    rows = [(i, v.tolist()) for i, v in enumerate(rng.permutation(np.array([*rows, None], object))) if v is not None]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(plain(neighbours.embedding_near_duplicates(df))) == vector_truth(rows)


def test_embedding_groups_that_fill_their_lists_are_joined(spark):
    """Two dense groups linked only across: every list is full of its own group's members.

    A third group has so many links that those across are below two in a hundred.
    """
    rng = np.random.default_rng(3)
    centers = np.zeros((3, 64))
    centers[0, 0], centers[1, :2], centers[2, 2] = 1, (np.cos(0.25), np.sin(0.25)), 1
    of = np.repeat([0, 1, 2], [110, 110, 1200])
    x = centers[of] + 0.009 * rng.standard_normal((len(of), 64))
    units = x / np.linalg.norm(x, axis=1)[:, None]
    near = units @ units.T >= 0.95
    across = (units @ units.T)[:110, 110:220]
    assert across.max() >= 0.95 and np.sort(units[:110] @ units[:110].T, axis=1)[:, -98].min() > across.max()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    want = [(i, int(near[i].sum()) - 1, 0 if i < 220 else 220, i in (0, 220)) for i in range(len(x))]
    assert sorted(plain(neighbours.embedding_near_duplicates(df))) == want


def test_embedding_search_goes_on_for_rare_links_and_ends_exact(spark):
    """Isolated pairs that a first audit can't see; a recall out of reach ends with all compared."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1600, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((40, 64))
    y -= (y * x[:40]).sum(axis=1)[:, None] * x[:40]
    pairs = 0.955 * x[:40] + math.sqrt(1 - 0.955 ** 2) * y / np.linalg.norm(y, axis=1)[:, None]
    units = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*x, *pairs])], "node bigint, unit array<double>").localCheckpoint()
    lists, audits = neighbours.neighbour_lists(units, threshold=0.95, tables=1, rounds=0, audit_rows=8)
    found = {(r["a"], r["b"]) for r in lists.filter("sim >= 0.95").collect()}
    assert sum((i, 1600 + i) in found for i in range(40)) >= 39 and audits[-1] >= 0.98 and audits[0] < 0.98
    _, roots, audits = neighbours.near_components(units, threshold=0.95, tables=1, rounds=0, recall=1.01)
    assert audits[-1] == 1.0 and sorted(plain(roots)) == sorted([(i, i) for i in range(40)] + [(1600 + i, i) for i in range(40)])


def test_embedding_audit_sees_missing_links(spark, sf):
    units = neighbours.unit_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding").withColumnRenamed("id", "node")
    lists, audits = neighbours.neighbour_lists(units, threshold=0.3, k=12, rounds=2)
    assert audits[-1] >= 0.98 and lists.count() > 0


# ---- licences and chats


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [
        ("a/LICENSE", "copyright someone\n" + mit), ("a/b/x.py", "print(1)"), ("a/b/c/LICENSE.txt", gpl + "\nwith more words that follow here and there"),
        ("a/b/c/d/y.py", "nothing"), ("a/b/c/z.py", "# " + mit + "\ncode code code code code code code code code"), ("q/w.py", "the license of the work is none"),
        ("a/b/same.py", mit), ("root.txt", "plain"), (None, mit), ("a/b/c/e.py", None), ("a/LICENSE", "copyright someone\n" + mit),
    ]
    df = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(files)], "doc_id int, path string, text string, license string")
    got = {r["doc_id"]: (r["license"], r["inherited"], r["inherited_from"]) for r in licenses.scan_licenses(df, F.col("path")).collect()}
    assert got == {
        0: ("MIT", None, None), 1: (None, "MIT", "a/b"), 2: ("GPL-3.0", None, None), 3: (None, "GPL-3.0", "a/b/c"), 4: ("MIT", None, None),
        5: (None, None, None), 6: ("MIT", None, None), 7: (None, None, None), 8: ("MIT", None, None), 9: (None, "GPL-3.0", "a/b/c"), 10: ("MIT", None, None)}
    assert not plain(licenses.scan_licenses(df.limit(0), F.col("path")))


def test_wrapped_notices_and_licence_files(spark):
    """Notices wrapped below the first blank line, with and without comment marks; a licence's text in a file of that name."""
    body = "some words of the program that stand first\nand go on for a while here\n"
    mit = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\nconditions are met"
    cc = "This work is licensed under a Creative Commons\nAttribution 4.0 International License."
    marked = lambda text: "# x = 1\n#\n" + "\n".join(f"# {line}" for line in text.split("\n")) + "\n#\n# more words behind it that say nothing\n"
    whole = ("MIT License copyright someone in some year all rights held " * 3 + mit.replace("\n", " ")
             + " the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute")
    texts = {f"s/{i}/{k}.py": body + "\n" + t + "\n\n" + body if k == "plain" else marked(t) for i, t in enumerate((mit, bsd, cc)) for k in ("plain", "marked")}
    texts |= {"w/LICENSE": whole, "w/a/b.py": "nothing of the kind", "v/other.txt": whole, "u/long.py": "license " * 20_000, "u/gap.py": "x\n" + " " * 100_000 + "y\n"}
    texts |= {f"fill/{i}.py": f"common words of files number {i} with the and for use in this work of source and are that" for i in range(40)}
    df = spark.createDataFrame([(p, t) for p, t in texts.items()], "doc_id string, text string")
    got = {r["path"]: (r["license"], r["inherited"]) for r in licenses.scan_licenses(df, F.col("doc_id")).collect()}
    for i, name in enumerate(("MIT", "BSD-3-Clause", "CC-BY-4.0")):
        assert got[f"s/{i}/plain.py"] == got[f"s/{i}/marked.py"] == (name, None)
    assert got["w/LICENSE"] == ("MIT", None) and got["w/a/b.py"] == (None, "MIT")
    assert got["v/other.txt"] == got["u/long.py"] == got["u/gap.py"] == (None, None)


def test_license_ties_and_file_names(spark):
    """Equal templates: the first one. Equal files of a directory: the smaller path. A licence file speaks whatever else it holds."""
    notice = "Released under the MIT License."
    filler = "\n".join(f"word{i} of the other text in line {i}" for i in range(40))
    files = [
        ("t/b.txt", notice), ("t/a.txt", "licensed under the Zed Terms of software use"), ("t/c/x.py", "nothing"),
        ("n/LICENSE", notice + "\n" + filler), ("n/x.py", "nothing"), ("o/notes.txt", notice + "\n" + filler), ("o/x.py", "nothing")]
    df = spark.createDataFrame(files, "doc_id string, text string")
    twins = [("first", notice), ("second", notice), ("zed", "licensed under the Zed Terms of software use")]
    got = {r["path"]: (r["license"], r["inherited"]) for r in licenses.scan_licenses(df, F.col("doc_id"), templates=twins).collect()}
    assert got["t/b.txt"] == ("first", None) and got["t/a.txt"] == ("zed", None) and got["t/c/x.py"] == (None, "zed")
    assert got["n/LICENSE"] == got["o/notes.txt"] == ("first", None)
    assert got["n/x.py"] == (None, "first") and got["o/x.py"] == (None, None)


def test_letters_are_of_category_l(spark, docs):
    rows = docs.select("doc_id", "text", "lang").limit(60).collect()
    signs = ["²", "½ 3", "Ⅷ ⅷ", "١٢٣", "_ 1 -", "ª"]
    df = spark.createDataFrame([tuple(r) for r in rows] + [(10_000 + i, t, None) for i, t in enumerate(signs)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df).collect()}
    assert [got[10_000 + i] == "und" for i in range(6)] == [True] * 5 + [False]


def test_chats(spark):
    turns = {
        1: ["hi", "hello"], 2: ["hi", "hello", "more"], 3: ["hi", "hello", "more"], 4: ["other"], 5: ["hello", "hi"], None: ["hi", "hello", "more", "end"],
        9: [f"t{i}" for i in range(3000)], 10: [f"t{i}" for i in range(2500)], 11: ["hi", None],
    }
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", t, 7) for c, ts in turns.items() for k, t in enumerate(ts)]
    rows += [rows[0], rows[1], (4, None, None, "late", 7)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, pos int").repartition(5)
    got = {(r["conv_id"], r["part"]): (r["n_turns"], r["copies"], r["text"]) for r in chat.format_chats(df, part_turns=1024).collect()}
    assert set(got) == {(4, 0), (5, 0), (None, 0), (9, 0), (9, 1), (9, 2), (11, 0)}
    assert got[4, 0][2] == "<|im_start|>user\nother<|im_end|>\n<|im_start|>\nlate<|im_end|>\n"
    assert got[None, 0][:2] == (4, 1) and got[9, 2][2].count("<|im_start|>") == 3000 - 2048
    assert "".join(got[9, p][2] for p in range(3)) == "".join(f"<|im_start|>{'user' if k % 2 == 0 else 'assistant'}\nt{k}<|im_end|>\n" for k in range(3000))
    same = chat.format_chats(df.filter("conv_id in (2, 3)")).collect()
    assert [(r["conv_id"], r["copies"]) for r in same] == [(2, 2)]
    assert not plain(chat.format_chats(df.limit(0)))


def test_chats_of_long_texts_and_null_turns(spark):
    """Turns without a number come last, by role and text; texts of any length stay whole."""
    loose = [f"n{i:04d}" for i in range(2500)]
    rows = [(1, None, "user", t) for t in loose] + [(1, 0, "user", "first")] + [(2, 0, "user", "y" * 300_000), (2, 1, None, None)] + [(3, 0, "user", "y" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    got = {(r["conv_id"], r["part"]): (r["n_turns"], r["text"]) for r in chat.format_chats(df, part_turns=1024).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 0)} and got[1, 0][0] == 2501
    assert "".join(got[1, p][1] for p in range(3)) == "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for t in ["first", *loose])
    assert got[2, 0] == (2, "<|im_start|>user\n" + "y" * 300_000 + "<|im_end|>\n<|im_start|>\n<|im_end|>\n")


# ---- pipeline


def test_pipeline_stages(spark, sf, docs, none, odd):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (docs, odd, none):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == start.columns, name
            now = spark.createDataFrame(now.collect(), now.schema)
    good = docs.join(quality.score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").select("doc_id"), "doc_id", "left_semi")
    truth = [r for r in exact_truth(good.collect()) if r[3]]
    exact_kept = good.join(spark.createDataFrame([(r[0],) for r in truth], "doc_id bigint"), "doc_id", "left_semi").select(*base)
    prints = [(r, simhash_truth(r["text"])) for r in exact_kept.orderBy("doc_id").collect()]
    root = linked([p for _, p in prints], lambda a, b: (a ^ b).bit_count() <= 3)
    stays = [r for k, (r, _) in enumerate(prints) if root[k] == k]
    mixed = mixing.mix(spark.createDataFrame(stays, exact_kept.schema))
    want = reference_pieces(mixed.collect(), 2048)
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert_gapless(got, 2048)


def test_schemas_are_stable(spark, odd):
    assert isinstance(exact_dedup.exact_duplicates(odd).schema["kept"].dataType, T.BooleanType)
    assert mixing.mixture(odd).dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
