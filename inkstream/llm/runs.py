"""Periodic runs: the maximal repetitions of a text's words, found by probing harmonic grids.

A run of period p and length 2p or more holds two neighbouring multiples of p, so words are compared at jp
and (j + 1)p alone: n/1 + n/2 + ... pairs for n words. Pairs that agree are extended both ways by comparing
arrays in chunks; pairs within a run of a divisor of p that is already found can't give a new one and are
skipped. Everything is exact for texts of any length.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, utf8
from .textcore import SPACED, Words

#: A run has so many words at least, and twice its period.
LEAST = 12
#: Texts of up to so many words are probed through one table of pairs (about 6 MB).
TABLE = 1 << 16
_CHUNK = 64
#: A run's matching pairs (words p apart) are LEAST - p or p in a row, whichever is more, and never fewer than this.
_NEAR = (LEAST + 1) // 2
_table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def _pairs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (jp, p) ordered by (j + 1)p, and how many of them lie in a text of n words."""
    global _table
    if _table is None:
        p = np.repeat(np.arange(1, TABLE // 2 + 1), [TABLE // p - 1 if TABLE % p == 0 else TABLE // p for p in range(1, TABLE // 2 + 1)])
        first = np.concatenate(([True], p[1:] != p[:-1]))
        j = np.arange(len(p)) - np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))
        end = (j + 1) * p
        order = np.argsort(end, kind="stable")
        _table = (j * p)[order].astype(np.int32), p[order].astype(np.int32), np.searchsorted(end[order], np.arange(TABLE + 1))
    return _table


def _probed(w: np.ndarray):
    """Grid pairs (i, p) with equal words, in lots of ascending p: by doubling bands of periods."""
    n = len(w)
    if n <= TABLE:
        at, p, many = _pairs()
        at, p = at[: many[n]], p[: many[n]]
        hit = np.flatnonzero(w[at] == w[at + p])
        at, p = at[hit].astype(np.int64), p[hit].astype(np.int64)
        keep = 2 * p <= n
        at, p = at[keep], p[keep]
        order = np.lexsort((at, p))
        at, p = at[order], p[order]
        lo = 1
        while len(p) and lo <= p[-1]:
            a, b = np.searchsorted(p, (lo, 2 * lo))
            if b > a:
                yield at[a:b], p[a:b]
            lo *= 2
        return
    lo = 1
    while 2 * lo <= n:
        places, periods = [], []
        for p in range(lo, min(2 * lo, n // 2 + 1)):
            grid = w[::p]
            i = np.flatnonzero(grid[1:] == grid[:-1]) * p
            places.append(i)
            periods.append(np.full(len(i), p))
        yield np.concatenate(places), np.concatenate(periods)
        lo *= 2


def _promising(w: np.ndarray, at: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which pairs have _NEAR matches in a row around them."""
    n = len(w)
    left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for count, step in ((left, -1), (right, 1)):
        open_ = np.arange(len(at))
        for k in range(1, _NEAR):
            i = at[open_] + step * k
            j = i + p[open_]
            fine = (i >= 0) & (j < n)
            open_, i, j = open_[fine], i[fine], j[fine]
            open_ = open_[w[i] == w[j]]
            if not len(open_):
                break
            count[open_] += 1
    return left + right + 1 >= _NEAR


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries agree; compared in chunks that grow."""
    n, k, size = min(len(a), len(b)), 0, _CHUNK
    while k < n:
        differ = a[k : min(k + size, n)] != b[k : min(k + size, n)]
        if differ.any():
            return k + int(differ.argmax())
        k, size = k + size, 4 * size
    return n


def _covered(at: np.ndarray, p: np.ndarray, found: dict[int, list[tuple[int, int]]]) -> np.ndarray:
    """Pairs within a found run of a proper divisor q of p that is p + q long or longer.

    The stretch of period p around such a pair is that run: were it longer at either end, so would the run be.
    """
    out = np.zeros(len(at), bool)
    for q, runs in found.items():
        todo = np.flatnonzero((p % q == 0) & ~out)
        if not len(todo):
            continue
        bounds = np.array(runs)
        bounds = bounds[np.argsort(bounds[:, 0])]
        k = np.searchsorted(bounds[:, 0], at[todo], side="right") - 1
        start, end = bounds[np.maximum(k, 0)].T
        out[todo] = (k >= 0) & (at[todo] + p[todo] < end) & (end - start >= p[todo] + q)
    return out


def periodic_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an array of word hashes, by start, then period."""
    n = len(w)
    found: dict[int, list[tuple[int, int]]] = {}
    best: dict[tuple[int, int], int] = {}
    if n < LEAST:
        return []
    for at, p in _probed(w):
        if found:
            keep = ~_covered(at, p, found)
            at, p = at[keep], p[keep]
        keep = _promising(w, at, p)
        at, p = at[keep], p[keep]
        k, fresh = 0, []
        while k < len(at):
            i, period = int(at[k]), int(p[k])
            shifted = w[period:]
            right = _reach(w[i : n - period], shifted[i:])
            left = _reach(w[:i][::-1], shifted[:i][::-1])
            start, end = i - left, i + right + period
            if end - start >= max(LEAST, 2 * period):
                # a divisor of the period that has the same stretch was found before it
                if (start, end) not in best:
                    best[start, end] = period
                    fresh.append((period, start, end))
            # grid points up to the mismatch belong to this stretch
            k = max(k + 1, k + int(np.searchsorted(at[k : k + int(np.searchsorted(p[k:], period, side="right"))], i + right)))
        for period, start, end in fresh:
            found.setdefault(period, []).append((start, end))
    return sorted((s, e - s, q) for (s, e), q in best.items())


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def planted(h: int, n: int) -> np.ndarray | None:
    """For h divisible by 10: the original places of a text's words once its end is made periodic."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def runs_of_documents(docs: DataFrame, alter=None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period) and collapsed (the words that stay, one blank between) of every row.

    ``alter(crc32 of doc_id, words)`` may give other places of the words (see ``planted``); of a null doc_id it isn't
    asked. A null text has no words; a text without runs stays whole; repeated rows have equal results; an empty
    table gives no rows; other columns aren't read. A text is read in one task, whole.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(id_column).cast("string").alias("key"), F.coalesce(F.make_valid_utf8(F.col(text_column).cast("string")), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, most=1 << 19):
            raw, offsets = utf8(batch.column(2))
            words = Words(raw, offsets, SPACED, lower=False)
            data, keys = raw.tobytes(), batch.column(1).to_pylist()
            counts, values, texts = [], [], []
            for d, key in enumerate(keys):
                a, b = words.first[d], words.first[d + 1]
                h = words.hash[a:b]
                places = None if key is None or alter is None else alter(zlib.crc32(key.encode()), len(h))
                if places is not None:
                    h = h[places]
                runs = periodic_runs(h)
                cells = data[offsets[d] : offsets[d + 1]].split()
                if runs or places is not None:
                    kept = np.flatnonzero(~dropped(len(h), runs))
                    cells = [cells[i] for i in (kept if places is None else places[kept]).tolist()]
                counts.append(len(runs))
                values.extend(runs)
                texts.append(b" ".join(cells).decode())
            cell = np.array(values, np.int64).reshape(-1, 3)
            ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(cell[:, k]) for k in range(3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.counts.astype(np.int64)), lists, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return map_arrow(rows, run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of all runs and the collapsed text."""
    order = lambda r: F.struct(-r["length"], r["start"], r["period"])
    longest = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(order(r) < order(best), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.withColumn("b", longest)
    milli = F.expr("b.length * 1000 div b.period")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period", milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
