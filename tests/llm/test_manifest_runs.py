"""Merkle manifest and periodic runs against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from inkstream.llm import merkle, runs
from inkstream.llm.textcore import SPACED_RE
from pyspark.sql import functions as F

from .conftest import SCHEMA, rows

_LOWER = {c: c + 32 for c in range(65, 91)}


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields) -> str:
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def grown(leaves: list[str]):
    """Root and, of each leaf, the siblings left and right of its path, level by level."""
    steps, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for own, i in zip(steps, at, strict=True):
            first = i // 8 * 8
            own.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 8])))
        nodes = [digest("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], steps


def brute_manifest(records):
    """Counter of the query's rows; records of doc_id, text, lang, source, n_chars."""
    groups = {}
    for r in records:
        groups.setdefault(r[2], []).append((leaf(r[0], r[3], r[2], r[4], r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    sub = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        sub[g] = grown([h for h, _ in groups[g]])
    root, upper = grown([sub[g][0] for g in order])
    out = Counter()
    for g, more in zip(order, upper, strict=True):
        for (h, r), own in zip(groups[g], sub[g][1], strict=True):
            steps, text = own + more, r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = text.translate(_LOWER)
            walk = leaf(r[0], r[3], r[2], r[4], text)
            for left, right in steps:
                walk = digest(left + walk + right)
            out[r[0], h, sub[g][0], root, digest("".join(a + b for a, b in steps)), walk, walk == root] += 1
    return out


def test_manifest_of_edge_rows(docs, empty):
    got = Counter(tuple(r) for r in merkle.checked(docs).collect())
    assert got == brute_manifest([r[:5] for r in rows()])
    assert merkle.checked(empty).count() == 0


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (8, 9, 1), (64, 65, 0, 7), tuple([1] * 70), (600, 2)])
def test_manifest_of_sizes(spark, sizes):
    """Full and partial runs, lone leaves, many groups: null, empty and other names."""
    names = [None, "", "é", "zz", *[f"l{i}" for i in range(80)]]
    records = [(k * 1000 + i, f"Text {k} {i}", names[k], None if i % 5 else "S", i if i % 7 else None) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(records, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert Counter(tuple(r) for r in merkle.checked(df).collect()) == brute_manifest(records)


def test_copies_are_dealt_over_ranges(spark):
    """Rows that repeat have places of their own, and no range holds them all."""
    from inkstream.llm.common import Scratch

    df = spark.range(4000).select(F.lit(3).alias("k"))
    out = merkle.ranked(df, ["k"], "at", Scratch(spark, "test")).withColumn("part", F.spark_partition_id())
    assert sorted(r["at"] for r in out.collect()) == list(range(4000))
    assert max(r["count"] for r in out.groupBy("part").count().collect()) < 2500


def test_changes_are_found(spark):
    """A row changed, lost or moved to another place gives another root; the order of rows does not matter."""
    records = [(i, f"text {i}", "en", "s", 6) for i in range(30)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string, lang string, source string, n_chars long")
    root = lambda x: {r["root"] for r in merkle.manifest(frame(x)).select("root").collect()}
    first = root(records)
    assert len(first) == 1 and root(records[::-1]) == first
    assert root(records[:-1]) != first and root([*records[:-1], (29, "Text 29", "en", "s", 6)]) != first


# --- runs


def brute_runs(w):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - start >= max(12, 2 * p):
                out.setdefault((start, i + p), p)
            i = max(i, start + 1) if i == start else i
    return sorted((s, e - s, p) for (s, e), p in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 8)), max_size=9), st.booleans())
def test_runs_of_any_words(blocks, small):
    w = [x for block, times in blocks for x in block * times]
    table = runs.TABLE, runs._table
    try:
        if small:  # texts beyond the table of pairs
            runs.TABLE, runs._table = 16, None
        assert runs.periodic_runs(np.array(w, np.uint64)) == brute_runs(w)
    finally:
        runs.TABLE, runs._table = table


def test_run_of_a_very_long_text():
    w = np.concatenate((np.arange(3), np.tile(np.arange(10, 15), 40_000), np.arange(3))).astype(np.uint64)
    assert runs.periodic_runs(w) == [(3, 200_000, 5)]


def brute_digest(key, text):
    words = SPACED_RE.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words) if n < 3000 else [(0, n, 1)] if len(set(words)) == 1 else []
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    out = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
    kept = " ".join(x for i, x in enumerate(words) if i not in gone)
    return (key, len(found), *out, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(kept))


def test_runs_of_edge_rows(docs, empty):
    got = Counter(tuple(r) for r in runs.digests(runs.runs_of_documents(docs, runs.planted)).collect())
    assert got == Counter(brute_digest(r[0], r[1]) for r in rows() if r[0] != 12) + Counter([g for g in got if g[0] == 12])
    assert sum(got.values()) == len(rows()) and next(g for g in got if g[0] == 12)[1] >= 1
    assert runs.digests(runs.runs_of_documents(empty)).count() == 0


def test_planted_runs(spark):
    """Documents made periodic: equal to brute force, and a run is found in most."""
    records = [(i, " ".join(f"w{(i * 7 + j * j) % 61}" for j in range(20 + i % 90))) for i in range(400)]
    df = spark.createDataFrame(records, SCHEMA.split(", lang")[0])
    got = runs.digests(runs.runs_of_documents(df, runs.planted)).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_digest(*r) for r in records)
    altered = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0]
    assert sum(r["n_runs"] > 0 for r in altered) > len(altered) / 2
