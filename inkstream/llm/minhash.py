"""Near-duplicates by one-permutation hashing with optimal densification, banded buckets and star edges.

Equal shingle sets become one vertex first, so copies cost nothing more. In each band bucket all vertices
are compared with one centre only (a star), each bucket drawing its own, so that a vertex of many buckets
meets many centres; links are confirmed on the full sets. Members of a bucket that end in different
components may hide a link yet: an exact prefix filter over their sets finds those pairs. So no link of a
bucket is lost, and a group of similar documents costs a multiple of its size, not its square.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, flagged, list_array, map_arrow, slices, text_column, text_hash, utf8
from .textcore import SPACED, U, Words, grams, mix

#: 128 bins in 32 bands of 4: a pair at similarity 0.75 shares no bucket with probability 0.684**32 < 6e-6.
BINS, ROWS = 128, 4
BIN_BITS = BINS.bit_length() - 1
SHINGLE = 5


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct k-word shingle hashes; of fewer words, the whole sequence; of none, nothing."""
    n = len(words)
    if n == 0:
        return np.zeros(0, U)
    out = grams(words, k) if n >= k else grams(words, n) ^ U(n)
    out = np.sort(out)
    return out[np.r_[True, out[1:] != out[:-1]]]


def _probes(rounds: int = 64) -> np.ndarray:
    """For each bin, the bins to borrow from, in order: the same for all sets (optimal densification)."""
    i = np.arange(BINS, dtype=U)
    return np.stack([mix(mix(i + U(1)) + U(0x1234567) * U(t + 1)) >> U(64 - BIN_BITS) for t in range(rounds)]).astype(np.int64)


_PROBES = _probes()


def sketch(sorted_set: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin (its top bits are the bin); empty bins borrow by the common probes."""
    hashes = np.sort(mix(sorted_set + U(0x51ED27)))
    bins = (hashes >> U(64 - BIN_BITS)).astype(np.int64)
    first = np.r_[True, bins[1:] != bins[:-1]]
    out, full = np.zeros(BINS, U), np.zeros(BINS, bool)
    out[bins[first]] = hashes[first]
    full[bins[first]] = True
    empty = np.flatnonzero(~full)
    own = full.copy()
    for t in range(len(_PROBES)):
        if not len(empty):
            return out
        source = _PROBES[t][empty]
        hit = own[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
    # a set this sparse: the nearest full bin going round
    at = np.flatnonzero(own)
    out[empty] = out[at[np.searchsorted(at, empty) % len(at)]]
    return out


def bands(sketched: np.ndarray) -> np.ndarray:
    rows = sketched.reshape(-1, ROWS)
    out = np.arange(1, len(rows) + 1, dtype=U) * U(0xA24BAED4963EE407)
    for j in range(ROWS):
        out = mix(out ^ rows[:, j]) + U(j)
    return out


def _key(sorted_set: np.ndarray) -> bytes:
    return hashlib.blake2b(sorted_set.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, tk, n_shingles, set_key (equal sets, equal keys), bands; empty texts have no key and no bands."""

    def run(batches):
        for batch in slices(batches):
            raw, offsets = utf8(batch.column(2))
            w = Words(raw, offsets, SPACED, lower=True)
            sizes, keys, out = [], [], []
            for d in range(batch.num_rows):
                s = shingles(w.hash[w.first[d] : w.first[d + 1]], k)
                sizes.append(len(s))
                keys.append(_key(s) if len(s) else None)
                if len(s):
                    out.append(bands(sketch(s)))
            lengths = np.where(np.array(sizes) > 0, BINS // ROWS, 0)
            flat = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), list_array(flat, lengths, pa.int64())], ["doc_id", "tk", "n_shingles", "set_key", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", text_hash().alias("tk"), text_column().alias("text")), run, f"doc_id {kind}, tk long, n_shingles long, set_key binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """vertex, shingle set for the written ``wanted`` vertices (vertex, set_key, tk of one text): a pass over those texts."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in slices(batches):
            raw, offsets = utf8(batch.column(0))
            w = Words(raw, offsets, SPACED, lower=True)
            keys, out = [], []
            for d in range(batch.num_rows):
                s = shingles(w.hash[w.first[d] : w.first[d + 1]], k)
                key = _key(s)
                if not len(s) or key in seen:
                    continue
                if len(seen) >= 20_000:
                    seen.clear()
                seen.add(key)  # copies in this task are not sent again
                keys.append(key)
                out.append(s)
            if keys:
                flat = np.concatenate(out).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), list_array(flat, np.array([len(s) for s in out]), pa.int64())], ["set_key", "shingles"])

    texts = flagged(docs.select(text_hash().alias("tk"), text_column().alias("text")), "tk", wanted, "tk", "flag").where("flag").select("text")
    found = map_arrow(texts, run, "set_key binary, shingles array<long>")
    return wanted.select("vertex", "set_key").join(found, "set_key").groupBy("vertex").agg(F.first("shingles").alias("shingles"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets reach the similarity: 100 * common >= percent * union."""
    left = sets.select(F.col("vertex").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("vertex").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(right, "b").join(left, "a").where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _near(a: str, b: str, percent: int) -> Column:
    """Set sizes that allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def prefix_pairs(vertices: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, b: all pairs of ``vertices`` (vertex, n, c) of different c that can reach the similarity.

    Two such sets share a shingle among the rarest n - ceil(percent * n / 100) + 1 of either, and from the
    first that they share enough must be left in both. Shingles of one set alone drop out at once, so sets
    that differ from all others by more than that have no pair. For each shingle only the rows outside its
    most frequent c are compared with the others.
    """
    rows = sets.join(vertices, "vertex").select("vertex", "n", "c", F.explode("shingles").alias("s"))
    shared = rows.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    own = Window.partitionBy("vertex")
    ranked = rows.join(shared, "s").select("vertex", "n", "c", "s", (F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("f", "s")) - 1).alias("at"))
    prefix = scratch.table(ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100)))
    most = prefix.groupBy("s", "c").agg(F.count("*").alias("k")).groupBy("s").agg(F.max_by("c", F.struct("k", "c")).alias("top"), F.count("*").alias("cs")).where("cs > 1").select("s", "top")
    minor = prefix.join(most, "s").where("c <> top").select("s", F.col("vertex").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("at").alias("pa"))
    enough = (100 + percent) * F.least(F.col("na") - F.col("pa"), F.col("n") - F.col("at")) >= percent * (F.col("na") + F.col("n"))
    pairs = minor.join(prefix, "s").where((F.col("c") != F.col("ca")) & _near("n", "na", percent) & enough)
    return pairs.select(F.least("a", "vertex").alias("a"), F.greatest("a", "vertex").alias("b")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """vertex, root: the smallest vertex reachable, for vertices with a link; alternating large and small stars.

    Only links and labels move, in written tables; a vertex with very many links is aggregated partially
    and its joins can be split.
    """
    edges = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.table(edges)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == before:
            break
        before = state
        scratch.settle()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = SHINGLE) -> DataFrame:
    """doc_id, tk (hash of the text), n_shingles, component_id (smallest doc_id reachable), kept, for every row.

    Null and empty texts have no shingles and are linked with nothing. Repeated rows are links like other
    copies; a null doc_id is never a component's smallest id unless all of its ids are null. Rows alone in
    their component are kept, and so is each row with the component's id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = scratch.table(sketches(docs, k))
    classes = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("low"), F.min("tk").alias("tk"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.table(classes.withColumn("vertex", F.monotonically_increasing_id()))
    entries = classes.select("vertex", "n", F.explode("bands").alias("h"))
    crowded = entries.groupBy("h").agg(F.count("*").alias("size")).where("size > 1").select("h")
    entries = scratch.table(entries.join(crowded, "h").select("h", "vertex", "n"))
    wanted = scratch.table(classes.join(entries.select("vertex").distinct(), "vertex", "left_semi").select("vertex", "set_key", "tk"))
    sets = scratch.table(_sets(docs, wanted, k))
    scratch.settle()
    # one star per bucket, about a centre of its own
    centre = entries.groupBy("h").agg(F.min(F.struct(F.xxhash64("h", "vertex").alias("p"), F.col("vertex").alias("a"), F.col("n").alias("na"))).alias("s")).select("h", "s.a", "s.na")
    star = entries.join(centre, "h").where((F.col("vertex") != F.col("a")) & _near("n", "na", percent)).select("a", F.col("vertex").alias("b"))
    links = scratch.table(confirm(star.distinct(), sets, percent))
    scratch.settle()
    roots = components(links, scratch)
    # buckets that hold more than one component may hide links yet
    labelled = entries.join(roots, "vertex", "left").select("h", "vertex", "n", F.coalesce("root", "vertex").alias("c"))
    mixed = labelled.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("h")
    left = scratch.table(labelled.join(mixed, "h", "left_semi").select("vertex", "n", "c").distinct())
    more = scratch.table(confirm(prefix_pairs(left, sets, percent, scratch), sets, percent))
    scratch.settle()
    roots = components(more.unionByName(roots.where("vertex != root").select(F.col("vertex").alias("a"), F.col("root").alias("b"))), scratch)
    named = classes.select("set_key", "vertex", "low")
    named = named.join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    named = named.join(lowest, "root").select("set_key", "component")
    out = rows.select("doc_id", "tk", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "tk", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
