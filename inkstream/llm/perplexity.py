"""Quality rules: word statistics, and bands of n-gram perplexity under modified Kneser-Ney models.

The models are of ORDER code points, one per language, counted by Spark over all documents that pass the
word rules, each n-gram once a text that has it. Kneser-Ney's continuation counts, discounts and
interpolation are joins and aggregations of n-gram tables, which grow with the corpus. For scoring, the
n-grams are 64-bit hashes in sorted arrays, dealt into shards of SHARD entries; each shard has a pass over
the texts of its own, so a task holds one however many there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, list_array, map_arrow, slices, text_column, utf8
from .textcore import SPACED, Words, grams, mix, span_hashes

ORDER = 5
#: Entries of one shard of the model (12 bytes each), and n-grams that a counting task holds before it sends them on.
SHARD, HELD = 1 << 22, 1 << 20
#: Log perplexities are counted in bins of 1/BINS nats for the bands.
BINS = 512
#: Band: median of the language -+ WIDTH robust standard deviations, and never nearer to it than LEAST nats; wider by
#: SHORT / sqrt(n) for a text of n code points, whose mean varies the more the shorter it is.
WIDTH, LEAST, SHORT = 5.0, 0.1, 2.0
MARKS = b"#*$%&|<>"
_MULTIPLIER = 0xD6E8FEB86659FD93


def points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and their offsets by text: blanks are one kind, digits another, all others stay what they are."""
    lead = (raw & 0xC0) != 0x80
    out = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    out[(out >= 9) & (out <= 13)] = 32
    out[(out >= 48) & (out <= 57)] = 48
    return out, np.concatenate(([0], np.cumsum(lead)))[offsets]


def hashed(cps: np.ndarray, starts: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """The hash of the n-gram that ends at each code point, under its text's language; blanks stand before a text."""
    lengths = np.diff(starts)
    place = np.arange(len(cps)) - np.repeat(starts[:-1], lengths)
    out = np.zeros(len(cps), np.uint64)
    for j in range(ORDER - 1, -1, -1):
        earlier = np.full(len(cps), 32, np.uint64)
        earlier[j:] = cps[: len(cps) - j]
        earlier[place < j] = 32
        out = out * np.uint64(_MULTIPLIER) + earlier + np.uint64(1)
    return mix(out ^ np.repeat(langs, lengths))


def windows(cps: np.ndarray, starts: np.ndarray, at: np.ndarray) -> pa.Array:
    """The n-grams that end at the places, as strings."""
    first = starts[np.searchsorted(starts, at, side="right") - 1]
    cells = np.stack([np.where(at - j >= first, cps[np.maximum(at - j, 0)], 32) for j in range(ORDER - 1, -1, -1)], 1).astype("<u4")
    text = cells.tobytes().decode("utf-32-le").encode("utf-8")
    edges = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)[::ORDER]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(edges, len(text)).astype(np.int32).tobytes()), pa.py_buffer(text))


def _lang_hashes(langs: list[str]) -> np.ndarray:
    raw = [x.encode() for x in langs]
    ends = np.cumsum([len(x) for x in raw])
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], ends[:-1])).astype(np.int64), ends.astype(np.int64), lower=False) if raw else np.zeros(0, np.uint64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.make_valid_utf8(F.col("lang").cast("string")), F.lit("")).alias("lang"), text_column().alias("text"))


def counts(docs: DataFrame) -> DataFrame:
    """h, lang, g, n: the n-grams of all texts that pass the word rules and in how many of these each is.

    A task adds up its own before the shuffle, HELD at a time.
    """

    def run(batches):
        held: list[tuple] = []
        size = 0

        def merged():
            h = np.concatenate([x[0] for x in held])
            n = np.concatenate([x[1] for x in held])
            names = pa.chunked_array([x[2] for x in held])
            langs = pa.chunked_array([x[3] for x in held])
            keys, first, of = np.unique(h, return_index=True, return_inverse=True)
            take = pa.array(first)
            return keys, np.bincount(of, n, len(keys)).astype(np.int64), names.take(take).combine_chunks(), langs.take(take).combine_chunks()

        def batch_of(keys, n, names, langs):
            for i in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000].view(np.int64)), langs.slice(i, 50_000), names.slice(i, 50_000), pa.array(n[i : i + 50_000])], ["h", "lang", "g", "n"])

        for batch in slices(batches):
            raw, offsets = utf8(batch.column(2))
            good = ~failed(base_statistics(raw, offsets))
            batch = batch.filter(pa.array(good))
            if not batch.num_rows:
                continue
            raw, offsets = utf8(batch.column(2))
            cps, starts = points(raw, offsets)
            names = batch.column(1).to_pylist()
            h = hashed(cps, starts, _lang_hashes(names))
            order = np.argsort(h, kind="stable")  # texts stay in order within equal hashes
            h, doc = h[order], np.repeat(np.arange(batch.num_rows), np.diff(starts))[order]
            first = np.concatenate(([True], h[1:] != h[:-1]))
            fresh = first | np.concatenate(([True], doc[1:] != doc[:-1]))
            at = np.flatnonzero(first)
            held.append((h[at], np.add.reduceat(fresh.astype(np.int64), at), windows(cps, starts, order[at]), batch.column(1).take(pa.array(doc[at]))))
            size += len(at)
            if size > HELD:
                held = [merged()]
                size = len(held[0][0])
                if 2 * size > HELD:
                    yield from batch_of(*held[0])
                    held, size = [], 0
        if held:
            yield from batch_of(*merged())

    found = map_arrow(_texts(docs), run, "h long, lang string, g string, n long")
    return found.groupBy("h", "lang", "g").agg(F.sum("n").alias("n"))


def _discounted(level: DataFrame) -> DataFrame:
    """``level`` (lang, g, n) with off, the discount of its count from the language's counts of counts."""
    many = lambda c: F.count(F.when(F.col("n") == c, 1)).cast("double")
    per = level.groupBy("lang").agg(*[many(c).alias(f"n{c}") for c in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    enough = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    d = lambda i: F.when(enough, F.greatest(F.lit(0.01), F.least(F.lit(i - 0.01), i - (i + 1) * F.try_divide(y * F.col(f"n{i + 1}"), F.col(f"n{i}"))))).otherwise(F.lit(0.5))
    per = per.select("lang", d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3"))
    return level.join(per, "lang").withColumn("off", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))).drop("d1", "d2", "d3")


def model(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """h, logp of every n-gram of the counts: interpolated modified Kneser-Ney.

    A text is no evidence for itself: an n-gram that one text alone has (at lower orders: that one such
    n-gram alone goes on from) is scored as unseen there, by what its context leaves to shorter ones.
    """
    levels = {ORDER: counted.withColumn("alone", F.col("n") == 1)}
    for m in range(ORDER - 1, 0, -1):  # lower orders: how many code points precede
        longer = levels[m + 1].groupBy("lang", F.substring("g", 2, m).alias("g")).agg(F.count("*").alias("n"), F.min("alone").alias("alone"))
        levels[m] = scratch.table(longer.withColumn("alone", F.col("alone") & (F.col("n") == 1)))
    # uniform over the code points of the language, and one for all others
    low = levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p")).withColumn("q", F.col("p"))
    for m in range(1, ORDER + 1):
        level = _discounted(levels[m]).withColumn("context", F.substring("g", 1, m - 1)).withColumn("g_low", F.substring("g", 2, m - 1))
        left = level.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("off").alias("rest"))
        level = level.join(left, ["lang", "context"])
        level = level.join(low, "lang") if m == 1 else level.join(low.withColumnRenamed("g", "g_low"), ["lang", "g_low"])
        p = (F.col("n") - F.col("off") + F.col("rest") * F.col("p")) / F.col("total")
        q = F.when(~F.col("alone"), p).when(F.col("total") == 1, F.col("q")).otherwise(F.col("rest") / F.col("total") * F.col("q"))
        if m == ORDER:
            return level.select("h", F.ln(q).alias("logp"))
        low = scratch.table(level.select("lang", "g", p.alias("p"), q.alias("q")))


class Shard:
    """Sorted hashes with log probabilities, found through their leading bits."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.logp = np.append(keys[order], np.uint64(2**64 - 1)), np.append(logp[order], 0).astype(np.float32)
        bits = max(8, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def score(self, h: np.ndarray) -> np.ndarray:
        """Log probabilities; 0 of hashes that other shards hold."""
        at = self.first[(h >> self.shift).astype(np.int64)]
        at = np.minimum(at, len(self.keys) - 1)
        open_ = np.flatnonzero(self.keys[at] < h)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.keys[at[open_]] < h[open_]]
        return np.where(self.keys[at] == h, self.logp[at], np.float32(0))


def shards(fitted: DataFrame):
    """The written model in Shards of about SHARD entries, one at a time."""
    n = -(-fitted.count() // SHARD)
    for i in range(max(1, n)):
        part = fitted.where(F.pmod(F.col("h"), F.lit(n)) == i).toArrow() if n else fitted.toArrow()
        yield Shard(part.column("h").to_numpy().view(np.uint64), part.column("logp").to_numpy())


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = ", ".join(f"{x} long" for x in NAMES)


def base_statistics(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The word statistics of each text, in the order of NAMES."""
    marks = np.zeros(256, bool)
    marks[list(MARKS)] = True
    n = len(offsets) - 1
    w = Words(raw, offsets, SPACED, lower=False)
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    breaks = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    end = np.sort(np.concatenate((offsets[1:], breaks)))
    line_first = np.concatenate(([0], np.cumsum(np.diff(np.searchsorted(breaks, offsets)) + 1)))
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    line_hash = span_hashes(raw, start, end, lower=False)
    dup, repeats = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(n):
        lines = line_hash[line_first[d] : line_first[d + 1]][worded[line_first[d] : line_first[d + 1]]]
        if len(lines) > 1:
            dup[d] = len(lines) - len(np.unique(lines))
        h = w.hash[w.first[d] : w.first[d + 1]]
        if len(h) > 3:
            g = grams(h, 3)
            order = np.argsort(g)
            s = g[order]
            same = s[1:] == s[:-1]
            if same.any():
                twice = order[np.r_[same, False] | np.r_[False, same]]
                hit = np.zeros(len(h), bool)
                hit[twice] = hit[twice + 1] = hit[twice + 2] = True
                repeats[d] = hit.sum()
    return [w.counts.astype(np.int64), total(SPACED[raw] & ((raw & 0xC0) != 0x80)), total(marks[raw]), dup, repeats]


def failed(stats: list[np.ndarray]) -> np.ndarray:
    return (stats[0] < 50) | (100 * stats[4] > 50 * stats[0])


def scored(docs: DataFrame, shard, base: bool) -> DataFrame:
    """doc_id, lang, tk, the word statistics (with ``base``), and of texts that pass: n_grams and their log probability in the shard."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            raw, offsets = utf8(batch.column(2))
            stats = base_statistics(raw, offsets)
            good = ~failed(stats)
            part = batch.filter(pa.array(good))
            raw, offsets = utf8(part.column(2))
            cps, starts = points(raw, offsets)
            each = shard.value.score(hashed(cps, starts, _lang_hashes(part.column(1).to_pylist()))).astype(np.float64)
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            total[good], n[good] = np.diff(np.concatenate(([0.0], np.cumsum(each)))[starts]), np.diff(starts)
            columns = [*(batch.column(i) for i in (0, 1, 3)), *(pa.array(x) for x in stats), pa.array(n), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "tk", *NAMES, "n_grams", "logp"])

    texts = _texts(docs).withColumn("tk", F.xxhash64("lang", "text"))
    out = map_arrow(texts, run, f"doc_id {kind}, lang string, tk long, {STATS}, n_grams long, logp double")
    return out if base else out.select("doc_id", "tk", "logp")


def bands(rows: DataFrame, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """lang, lower, upper: log perplexities from the histograms of all texts that pass the word rules."""
    seen = rows.where("log_perplexity is not null").groupBy("lang", F.round(F.col("log_perplexity") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    middle = seen.groupBy("lang").agg(F.expr("percentile(bin, 0.5, n)").alias("middle"))
    spread = seen.join(middle, "lang").groupBy("lang", "middle").agg(F.expr("percentile(abs(bin - middle), 0.5, n)").alias("mad"))
    half = F.greatest(F.lit(least), width * 1.4826 * F.col("mad") / BINS)
    return spread.select("lang", (F.col("middle") / BINS - half).alias("lower"), (F.col("middle") / BINS + half).alias("upper"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, lang, word statistics, base_failed, log_perplexity (nats a code point), its band, and kept, for every row.

    A null text has no words and fails the base; texts that fail it have no perplexity. A null language is that of
    "" ; repeated rows get equal results; an empty table gives no rows; other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "perplexity")
    fitted = scratch.table(model(scratch.table(counts(docs)), scratch))
    rows = None
    for i, shard in enumerate(shards(fitted)):
        share = scratch.share(shard)
        part = scratch.table(scored(docs, share, i == 0))
        if i == 0:
            rows = part
        else:  # rows that repeat id, language and text have equal sums
            more = part.groupBy("doc_id", "tk").agg(F.first("logp").alias("more"))
            more = more.withColumnsRenamed({"doc_id": "d", "tk": "t"})
            rows = rows.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("t"))).withColumn("logp", F.col("logp") + F.col("more")).drop("d", "t", "more")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = scratch.table(rows.withColumn("log_perplexity", F.when(~F.col("base_failed"), F.try_divide(-F.col("logp"), F.col("n_grams")))))
    room = SHORT / F.sqrt(F.greatest("n_grams", F.lit(1)))
    out = rows.join(bands(rows), "lang", "left")
    out = out.withColumn("lower", F.col("lower") - room).withColumn("upper", F.col("upper") + room)
    kept = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.select("doc_id", "lang", *NAMES, "base_failed", kept.alias("kept"), "log_perplexity", "lower", "upper")
