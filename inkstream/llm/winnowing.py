"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive item words; an item of fewer, but not none, is one window. Of each text
the smallest k-gram hash in every run of span - k + 1 k-grams is kept, so any shared window shares a kept
fingerprint at the same place in it. Document fingerprints that a bitmap of the benchmark's (of fixed size,
whatever the benchmark's) can't rule out go to an exact join, each with the hashes of the words around it,
and hits are extended word by word within them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BitmapFilter, Scratch, map_arrow, list_array, slices, text_column, text_hash, utf8
from .textcore import ALNUM, U, Words, grams, mix, winnow

SPAN, GRAM = 10, 5


def _around(hashes: np.ndarray, at: np.ndarray, span: int, k: int, pad: int) -> np.ndarray:
    """Word hashes from span - k before each place to span after; ``pad`` beyond the text."""
    padded = np.concatenate((np.full(span - k, pad, U), hashes, np.full(span, pad, U)))
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * span - k)[at]


def _short(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n words that can't be taken for a fingerprint or for another length."""
    return mix(grams(hashes, n) ^ U(0x5851F42D4C957F2D * (n + 1) & (2**64 - 1)))


def item_fingerprints(items: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """fp, size (0: a fingerprint; else the words of a short item), around, and the items that have them."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            raw, offsets = utf8(batch.column(1))
            w = Words(raw, offsets, ALNUM, lower=True)
            rows, fps, sizes, around = [], [], [], []
            for d in range(batch.num_rows):
                h = w.hash[w.first[d] : w.first[d + 1]]
                if len(h) >= span:
                    g = grams(h, k)
                    at = winnow(g, span - k + 1)
                    fps.append(g[at])
                elif len(h):
                    at = np.zeros(1, np.int64)
                    fps.append(_short(h, len(h)))
                else:
                    continue
                rows += [d] * len(at)
                sizes += [0 if len(h) >= span else len(h)] * len(at)
                around.append(_around(h, at, span, k, 1))
            flat = np.concatenate(around).ravel().view(np.int64) if around else np.zeros(0, np.int64)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(np.concatenate(fps).view(np.int64) if fps else [], pa.int64()), pa.array(sizes, pa.int32()), list_array(flat, np.full(len(rows), 2 * span - k), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "fp", "size", "around"])

    found = map_arrow(items.select("item_id", text_column().alias("text")), run, f"item_id {kind}, fp long, size int, around array<long>")
    return found.groupBy("fp", "size", "around").agg(F.collect_set("item_id").alias("items"))


def document_fingerprints(docs: DataFrame, member, sizes: list[int], span: int = SPAN, k: int = GRAM) -> DataFrame:
    """doc_id, tk, n_words, and per fingerprint that ``member`` (a broadcast filter) lets through: fp, size, at, around."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = 2 * span - k

    def run(batches):
        for batch in slices(batches):
            raw, offsets = utf8(batch.column(2))
            w = Words(raw, offsets, ALNUM, lower=True)
            all_grams = grams(w.hash, k)
            passed = member.value.has(all_grams)
            shorts = []
            for n in sizes:
                g = _short(w.hash, n)
                at = np.flatnonzero(member.value.has(g))
                shorts.append((n, at, g[at]))
            hits = []
            for d in range(batch.num_rows):
                a, b = int(w.first[d]), int(w.first[d + 1])
                fps, size, places = [], [], []
                if b - a >= span and passed[a : b - k + 1].any():
                    g = all_grams[a : b - k + 1]
                    at = winnow(g, span - k + 1)
                    at = at[passed[a + at]]
                    fps.append(g[at])
                    size.append(np.zeros(len(at), np.int32))
                    places.append(at)
                for n, at, values in shorts:
                    i, j = np.searchsorted(at, (a, b - n + 1))
                    if j > i:
                        fps.append(values[i:j])
                        size.append(np.full(j - i, n, np.int32))
                        places.append(at[i:j] - a)
                if fps and len(at := np.concatenate(places)):
                    hits.append((d, np.concatenate(fps), np.concatenate(size), at, _around(w.hash[a:b], at, span, k, 0)))
            lengths = np.zeros(batch.num_rows, np.int64)
            for x in hits:
                lengths[x[0]] = len(x[1])
            flat = lambda i, t: np.concatenate([x[i] for x in hits]) if hits else np.zeros(0, t)  # noqa: E731, B023
            columns = [batch.column(0), batch.column(1), pa.array(w.counts, pa.int64()), list_array(flat(1, U).view(np.int64), lengths, pa.int64()), list_array(flat(2, np.int32), lengths, pa.int32()), list_array(flat(3, np.int64), lengths, pa.int64()), list_array(flat(4, U).ravel().view(np.int64), lengths * width, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tk", "n_words", "fp", "size", "at", "around"])

    return map_arrow(docs.select("doc_id", text_hash().alias("tk"), text_column().alias("text")), run, f"doc_id {kind}, tk long, n_words long, fp array<long>, size array<int>, at array<long>, around array<long>")


def _extent(span: int, k: int) -> tuple[Column, Column]:
    """Words before and after the fingerprint's that agree, within what the rows carry."""
    reach, same = span - k, lambda i: F.col("around")[i] == F.col("theirs")[i]
    before, after = F.lit(reach), F.lit(reach)
    for n in range(reach - 1, -1, -1):  # the nearest place that differs decides
        before = F.when(~same(reach - 1 - n), n).otherwise(before)
        after = F.when(~same(span + n), n).otherwise(after)
    return before, after


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """doc_id, tk (hash of the text), n_words, n_hit, n_items, item_ids, items_sha256, contaminated, and the hit spans, for every row.

    Null texts have no words; an item with a null id hits words but is not listed; repeated item ids count
    once; repeated rows get equal results. Empty tables give results without hits or rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "winnowing")
    fingerprints = scratch.table(item_fingerprints(items, span, k))
    member = scratch.share(BitmapFilter.of(fingerprints, "fp"))
    sizes = sorted(r["size"] for r in fingerprints.select("size").distinct().collect() if r["size"])
    rows = scratch.table(document_fingerprints(docs, member, sizes, span, k)).withColumn("row", F.monotonically_increasing_id())
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    ids = F.array().cast("array<string>")
    clean = rows.where(F.size("fp") == 0).select("doc_id", "tk", "n_words", none.alias("spans"), ids.alias("item_ids"))
    width = 2 * span - k
    hits = rows.where(F.size("fp") > 0).select("row", "doc_id", "tk", "n_words", F.posexplode(F.arrays_zip("fp", "size", "at")).alias("i", "x"), "around").select("row", "doc_id", "tk", "n_words", "x.*", F.slice("around", F.col("i") * width + 1, width).alias("around"))
    joined = hits.join(fingerprints.withColumnRenamed("around", "theirs"), ["fp", "size"], "left")
    before, after = _extent(span, k)
    middle = F.lit(True)
    for i in range(span - k, span):
        middle = middle & (F.col("around")[i] == F.col("theirs")[i])
    whole = F.forall(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.get(F.col("around"), i + (span - k)) == F.get(F.col("theirs"), i + (span - k)))
    joined = joined.withColumn("before", before).withColumn("after", after)
    found = F.when(F.col("theirs").isNull(), False).when(F.col("size") > 0, whole).otherwise(middle & (F.col("before") + F.col("after") + k >= span))
    interval = F.when(F.col("size") > 0, F.struct(F.col("at").alias("from"), (F.col("at") + F.col("size")).alias("to"))).otherwise(F.struct((F.col("at") - F.col("before")).alias("from"), (F.col("at") + k + F.col("after")).alias("to")))
    judged = joined.withColumn("found", found)
    per = judged.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("tk").alias("tk"), F.first("n_words").alias("n_words"), F.sort_array(F.collect_set(F.when(F.col("found"), interval))).alias("spans"), F.array_distinct(F.flatten(F.collect_set(F.when(F.col("found"), F.col("items"))))).cast("array<string>").alias("item_ids"))
    merged = F.aggregate(
        "spans",
        none,
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["to"] >= x["from"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.element_at(done, -1)["from"].alias("from"), F.greatest(F.element_at(done, -1)["to"], x["to"]).alias("to"))))).otherwise(F.concat(done, F.array(x))),
    )
    out = clean.unionByName(per.select("doc_id", "tk", "n_words", F.when(F.size("spans") > 0, merged).otherwise(none).alias("spans"), F.sort_array("item_ids").alias("item_ids")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return out.select("doc_id", "tk", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "item_ids", "spans")
