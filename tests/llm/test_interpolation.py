"""Deleted interpolation against counts and mixtures made token by token in plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from inkstream.llm import interpolation
from inkstream.llm.textcore import SPACED_RE, fold
from pyspark.sql import functions as F

from .conftest import rows, words

def trained():
    return F.crc32(F.col("doc_id").cast("string")) % 7 != 2


def tokens_of(text):
    return [*SPACED_RE.findall(fold(text or "")), None]


def is_trained(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 != 2


def grams(t, m):
    padded = [0] * (m - 1) + t
    return [tuple(padded[i : i + m]) for i in range(len(t))]


def model(texts):
    """Counts by order and of contexts, tokens and words of a list of token lists."""
    counts = [Counter(g for t in texts for g in grams(t, m)) for m in range(1, 4)]
    contexts = [Counter(g[:-1] for t in texts for g in grams(t, m)) for m in range(1, 4)]
    return counts, contexts, len(counts[0])


def bucket(n):
    return n.bit_length()


def prob(fitted, weights, t, i, order=3):
    counts, contexts, seen = fitted
    p = 1 / (seen + 1)
    for m in range(1, order + 1):
        g = grams(t[: i + 1], m)[-1]
        c = contexts[m - 1][g[:-1]]
        share = weights[m - 1][bucket(c)]
        p = share * (counts[m - 1][g] / c if c else 0) + (1 - share) * p
    return p


def learned(fitted, held):
    """EM over the held-out tokens themselves, not over histograms."""
    weights = []
    for m in range(1, 4):
        ratios = {}
        for t in held:
            for i in range(len(t)):
                g = grams(t[: i + 1], m)[-1]
                c = fitted[1][m - 1][g[:-1]]
                if c:
                    ratios.setdefault(bucket(c), []).append(fitted[0][m - 1][g] / c / prob(fitted, weights, t, i, m - 1))
        out, last = [0.0] * 65, 0.5
        for k in range(1, 65):
            if k in ratios:
                r, last = np.array(ratios[k]), 0.5
                for _ in range(2000):
                    last = (float((last * r / (last * r + 1 - last)).sum()) + 1) / (len(r) + 2)
            out[k] = last
        weights.append(out)
    return weights


def folds(spark, records):
    df = spark.createDataFrame([(k, fold(t or "")) for k, (_, t) in enumerate(records)], "k int, text string")
    got = {r["k"]: r["f"] == 0 for r in df.select("k", F.pmod(F.xxhash64("text"), F.lit(10)).alias("f")).collect()}
    return [got[k] for k in range(len(records))]


def brute(spark, records):
    out = folds(spark, records)
    tokens = [tokens_of(t) for _, t in records]
    train = [is_trained(i) for i, _ in records]
    weights = learned(model([t for t, a, h in zip(tokens, train, out) if a and not h]), [t for t, a, h in zip(tokens, train, out) if a and h])
    full = model([t for t, a in zip(tokens, train) if a])
    n, seen = sum(full[0][0].values()), full[2]
    want = []
    for (i, _), t in zip(records, tokens):
        c = [full[0][0][(x,)] for x in t]
        base = sum(math.log10((x + 1) / (n + seen + 1)) for x in c)
        want.append((i, len(t), sum(x > 0 for x in c), n, base, sum(math.log10(prob(full, weights, t, k)) for k in range(len(t)))))
    return want


def same(got, want, slack):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:4], r[4])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[4] == pytest.approx(b[4], rel=1e-9, abs=1e-9)
        assert a[5] == pytest.approx(b[5], rel=slack, abs=1e-6)


def sentences(n, seed=0):
    """Texts with word order to learn: walks over a few successors of each word."""
    r = np.random.default_rng(seed)
    nexts = r.integers(0, 60, (60, 3))
    out = []
    for i in range(n):
        w, text = int(r.integers(60)), []
        for _ in range(int(r.integers(0, 40))):
            text.append(f"Word{w}")
            w = int(nexts[w][int(r.integers(3))])
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_scores_of_sentences(spark, monkeypatch, small):
    if small:  # many slices and ranges
        monkeypatch.setattr(interpolation, "SLICE", 50)
        monkeypatch.setattr(interpolation, "RANGE", 200)
    records = sentences(300)
    records += [(1000 + i, records[i][1]) for i in range(5)] + [(2000, None), (2001, ""), (2002, " \n "), (None, "Word1 Word2"), (7, records[7][1])]
    df = spark.createDataFrame(records, "doc_id long, text string").repartition(3)
    same(interpolation.scores(df, trained()).collect(), brute(spark, records), 2e-3)


def test_edge_rows(spark, docs, empty):
    got = interpolation.scores(docs, trained()).collect()
    records = [(r[0], r[1]) for r in rows() if r[0] != 13]
    assert len(got) == len(rows())
    short = spark.createDataFrame(records, "doc_id long, text string")
    same(interpolation.scores(short, trained()).collect(), brute(spark, records), 2e-3)
    assert interpolation.scores(empty, trained()).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in interpolation.scores(df, F.lit(False)).collect()}
    assert got[1]["n_tokens"] == 3 and got[1]["n_known"] == got[1]["train_tokens"] == 0 and got[1]["base_score"] == got[1]["score"] == 0


def test_probabilities_sum_to_one():
    """Over all words of the vocabulary and one unknown, after any context."""
    texts = [tokens_of(t) for _, t in sentences(60)]
    fitted = model(texts)
    r = np.random.default_rng(1)
    weights = [np.concatenate(([0.0], r.random(64))) for _ in range(3)]
    for t in texts[:8]:
        for i in (0, len(t) // 2):
            if t[i] is None:
                continue
            total = 0.0
            candidates = [*fitted[0][0], ("unknown",)]
            grams_ = [np.array([fitted[0][m - 1][grams([*t[:i], w], m)[-1]] for (w,) in candidates]) for m in (1, 2, 3)]
            contexts = [np.full(len(candidates), fitted[1][m - 1][grams([*t[:i], "x"], m)[-1][:-1]]) for m in (2, 3)]
            total = interpolation.mixture(grams_, contexts, weights, sum(fitted[0][0].values()), fitted[2], 3).sum()
            assert total == pytest.approx(1)


def test_order_counts(spark):
    """Unseen texts in the language's order score above the same words shuffled, and above the base."""
    records = sentences(900, seed=3)
    r = np.random.default_rng(0)
    unseen = [(i, t) for i, t in records if not is_trained(i) and len(t.split()) > 10]
    free = [k for k in range(100_000, 102_000) if not is_trained(k)]
    mixed = [(k, " ".join(r.permutation(t.split()))) for k, (_, t) in zip(free, unseen)]
    pairs = [(i, k) for (i, _), (k, _) in zip(unseen, mixed)]
    df = spark.createDataFrame(records + mixed, "doc_id long, text string")
    got = {x["doc_id"]: x for x in interpolation.scores(df, trained()).collect()}
    assert len(pairs) > 20
    assert sum(got[i]["score"] > got[m]["score"] + 3 for i, m in pairs) > 0.95 * len(pairs)
    assert all(got[i]["score"] > got[i]["base_score"] for i, _ in pairs)


def test_packing_of_numbers():
    for x in ([], [0], [1, 2**63, 5], list(range(1000))):
        assert interpolation.unpack(interpolation.pack(np.array(x, np.uint64))).tolist() == x


def test_weights_are_likeliest():
    bins = np.array([0, 1 + 64 * 16 + 32])  # ratios 0 and 4
    n = np.array([30_000, 70_000])
    share = interpolation.learn(bins, n, rounds=5000)
    value = lambda x: 30 * math.log(1 - x) + 70 * math.log(4 * x + 1 - x)
    assert value(share) >= max(value(k / 1000) for k in range(1, 1000)) - 1e-4


def test_long_text_is_whole(spark):
    text = words(1, 20_000)
    got = interpolation.scores(spark.createDataFrame([(0, text)], "doc_id long, text string"), F.lit(True)).first()
    assert got["n_tokens"] == got["n_known"] == got["train_tokens"] == 20_001
