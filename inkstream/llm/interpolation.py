"""Language-model scores by deleted interpolation of word n-grams.

P_m(w | context) = L * c(context w) / c(context) + (1 - L) * P_(m-1)(w | shorter context), down to the uniform
1 / (V + 1) over the V words seen and one for all others. L depends on the order and on the bucket (power of two)
of the context's frequency, and is learned by expectation-maximisation on texts that were held out of the counts.

Texts become slices: written rows of about SLICE tokens as ids of a vocabulary of the slice's own. A slice asks
for the counts of its distinct n-grams, as sorted arrays of 64-bit hashes cut by hash range; the task of a range
adds the slices' counts up and answers each. What is asked grows with the tokens, one entry for an n-gram however
often a slice has it, so a frequent one costs a range no more than an entry for each slice. No table of the model
is broadcast or collected: the driver sees the histograms that the weights are learned from, of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, give_back, map_arrow, slices, text_column, utf8
from .textcore import SPACED, Words, mix

ORDER = 3
#: Tokens of a slice (a longer text is a slice of its own), and entries that a range takes in.
SLICE, RANGE = 1 << 21, 1 << 22
#: One in so many of the training texts is held out for the weights; equal texts go together.
FOLDS = 10
#: Evidence ratios are counted in bins of 1/FINE powers of two, to 2 ** (-+ WIDEST).
FINE, WIDEST = 16, 64
OTHER, KEPT, HELD = 0, 1, 2
_U = np.uint64
_END, _BEGIN, _G = _U(0x8C5A_61F3_9D20_B74E), _U(0x3B97_10E4_C6D8_52AF), _U(0xD6E8FEB86659FD93)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def tokenised(docs: DataFrame, trained: Column, order_of_fold: int = FOLDS) -> DataFrame:
    """slice, kind, doc_ids, lengths, ids, words: slices of texts of one kind (OTHER, KEPT or HELD).

    Tokens are the words of [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then an end for each text.
    """
    text = text_column()
    fold = F.pmod(F.xxhash64(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), F.lit(order_of_fold))
    kind = F.when(~F.coalesce(trained, F.lit(True)), OTHER).when(fold == 0, HELD).otherwise(KEPT)
    rows = docs.select("doc_id", kind.alias("kind"), text.alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held = {k: [[], [], [], 0] for k in (OTHER, KEPT, HELD)}
        part, made = TaskContext.get().partitionId(), 0

        def flush(k):
            nonlocal made
            hashes, ids, lengths, _ = held[k]
            held[k] = [[], [], [], 0]
            words, at, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent words have small ids
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            made += 1
            names = pa.concat_arrays(ids)
            cells = [pa.array([(part << 32) + made]), pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)]
            cells += [pa.array([x], pa.binary()) for x in (pack(np.concatenate(lengths)), pack(rank[at]), pack(words[order]))]
            return pa.RecordBatch.from_arrays(cells, ["slice", "kind", "doc_ids", "lengths", "ids", "words"])

        for batch in slices(batches):
            raw, offsets = utf8(batch.column(2))
            w = Words(raw, offsets, SPACED, lower=True)
            tokens = np.insert(w.hash, w.first[1:], _END)
            n = w.counts + 1
            of = np.repeat(batch.column(1).to_numpy(), n)
            for k in held:
                mine = batch.column(1).to_numpy() == k
                if mine.any():
                    held[k][0].append(tokens[of == k])
                    held[k][1].append(batch.column(0).filter(pa.array(mine)))
                    held[k][2].append(n[mine])
                    held[k][3] += int(n[mine].sum())
                    if held[k][3] >= SLICE:
                        yield flush(k)
        for k in held:
            if held[k][0]:
                yield flush(k)

    return map_arrow(rows, run, f"slice long, kind int, doc_ids array<{id_type}>, lengths binary, ids binary, words binary")


class Slice:
    """The tokens of a written slice, and its n-grams' hashes by order."""

    def __init__(self, row):
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        self.ids, self.words = unpack(row["ids"]).astype(np.int64), unpack(row["words"])
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)

    def shifted(self, values: np.ndarray, before) -> np.ndarray:
        """What stands before each token; ``before`` at the beginning of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = before
        return out

    def grams(self, order: int, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the n-grams that end at each token (or those of the mask), and which of them each has."""
        if order == 1:
            place = np.argsort(self.words)
            rank = np.empty(len(place), np.int64)
            rank[place] = np.arange(len(place))
            return self.words[place], rank[self.ids]
        h = self.words[self.ids]
        earlier, out = h, h
        for k in range(1, order):
            earlier = self.shifted(earlier, _BEGIN)
            power = _U(pow(int(_G), k, 1 << 64))
            out = out + earlier * power
        out = mix(out + _U(order))
        return np.unique(out if where is None else out[where], return_inverse=True)


class Known:
    """What a slice knows of its tokens' n-grams of one order: counts in the texts kept and in all training texts,

    and which are alone: seen once in training, in this slice, and asked for by no other.
    """

    def __init__(self, s: Slice, kind: int, order: int, answers: dict, shorter: Known | None, texts: int):
        self.ask = np.ones(len(s.ids), bool)
        known_alone = ~self.ask
        if order > 2:
            known_alone = s.shifted(shorter.alone, False)
            self.ask = ~known_alone & (s.shifted(shorter.total, texts) > 0)
        if answers is None:
            return
        cells = [unpack(answers[k]).astype(np.int64) for k in sorted(answers) if k[0] == order]
        _, at = s.grams(order, self.ask if order > 2 else None)
        if kind == HELD:
            kept = np.concatenate([c[: len(c) // 2] for c in cells] or [np.zeros(0, np.int64)])[at]
            cells = [c[len(c) // 2 :] for c in cells]
        total = np.concatenate(cells or [np.zeros(0, np.int64)])[at]
        self.alone = known_alone.copy()
        if kind != OTHER:
            self.alone[self.ask] = total == 0
        self.total = self.alone.astype(np.int64)
        self.total[self.ask] += total
        self.kept = self.total
        if kind == HELD:
            self.kept = np.zeros(len(s.ids), np.int64)
            self.kept[self.ask] = kept


def _cut(s: Slice, slice_id: int, kind: int, order: int, bits: int, where: np.ndarray | None = None):
    """Requests of a slice: a batch of level, range, slice, kind, hashes, n."""
    grams, at = s.grams(order, where)
    n = np.bincount(at, minlength=len(grams))
    edges = np.searchsorted(grams, np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits)) if bits else []
    cut = np.concatenate(([0], edges, [len(grams)])).astype(np.int64)
    rows = []
    for r in np.flatnonzero(np.diff(cut)).tolist():
        g = grams[cut[r] : cut[r + 1]]
        rows.append((order, r, slice_id, kind, pack(np.diff(g, prepend=_U(0))), pack(n[cut[r] : cut[r + 1]]) if kind != OTHER else None))
    return _columns(rows, _ASKED)


_ASKED = pa.schema({"level": pa.int32(), "range": pa.int32(), "slice": pa.int64(), "kind": pa.int32(), "hashes": pa.binary(), "n": pa.binary()})
_ANSWERED = pa.schema({"level": pa.int32(), "range": pa.int32(), "slice": pa.int64(), "counts": pa.binary(), "seen_kept": pa.int64(), "seen": pa.int64()})
_REQUESTS = "level int, range int, slice long, kind int, hashes binary, n binary"


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _asked(parts: DataFrame, bits: int) -> DataFrame:
    """The requests of each slice for its words and pairs of words."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Slice(row)
                for order in range(1, min(ORDER, 2) + 1):
                    yield _cut(s, row["slice"], row["kind"], order, bits)

    return map_arrow(parts.select("slice", "kind", "lengths", "ids", "words"), run, _REQUESTS)


def _known(left: pa.Table, right: pa.Table, texts: int, orders) -> tuple[Slice, int, list[Known]]:
    """The slice of a group, its kind, and by order what its answers say."""
    row = left.select(["kind", "lengths", "ids", "words"]).to_pylist()[0]
    answers = {(a, b): c for a, b, c in zip(*(right.column(n).to_pylist() for n in ("level", "range", "counts")), strict=True)}
    s, out = Slice(row), [None]
    for order in orders:
        out.append(Known(s, row["kind"], order, answers, out[-1], texts))
    return s, row["kind"], out[1:]


def _asked_again(parts: DataFrame, answers: DataFrame, order: int, bits: int, texts: int) -> DataFrame:
    """The requests of each slice for its n-grams of an order above two, where the shorter ones' answers leave them open."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        s, kind, known = _known(left, right, texts, range(2, order))
        where = Known(s, kind, order, None, known[-1], texts).ask
        out = pa.Table.from_batches([_cut(s, left.column("slice")[0].as_py(), kind, order, bits, where)])
        give_back()
        return out

    needed = answers.where(F.col("level").between(2, order - 1))
    return parts.drop("doc_ids").groupBy("slice").cogroup(needed.groupBy("slice")).applyInArrow(run, _REQUESTS)


def _answered(asked: DataFrame) -> DataFrame:
    """level, range, slice, counts: for each request the n-grams' counts in all training texts, 0 for those that are alone

    (requests of held-out texts: before these the counts in the texts kept); and a row without a slice for each range: how
    many n-grams were seen in the texts kept, and in all.
    """

    def run(table: pa.Table) -> pa.Table:
        level, part = table.column("level")[0].as_py(), table.column("range")[0].as_py()
        order = np.argsort(table.column("slice").to_numpy(), kind="stable")
        kinds = table.column("kind").to_numpy()[order]
        cells, ns = table.column("hashes"), table.column("n")
        hashes = [np.cumsum(unpack(cells[i].as_py()), dtype=_U) for i in order.tolist()]
        sizes = np.array([len(h) for h in hashes])
        grams, at = np.unique(np.concatenate(hashes), return_inverse=True)
        del hashes
        counts = np.concatenate([np.zeros(m) if k == OTHER else unpack(ns[i].as_py()).astype(float) for i, m, k in zip(order.tolist(), sizes, kinds, strict=True)])
        kept = np.bincount(at, counts * np.repeat(kinds == KEPT, sizes), len(grams)).astype(np.int64)
        total = np.bincount(at, counts, len(grams)).astype(np.int64)
        rows = [(level, part, None, None, int((kept > 0).sum()), int((total > 0).sum()))]
        total[(total == 1) & (np.bincount(at, minlength=len(grams)) == 1)] = 0
        ends = np.cumsum(sizes)
        for i, k, a, b in zip(order.tolist(), kinds, ends - sizes, ends, strict=True):
            counts = np.concatenate((kept[at[a:b]], total[at[a:b]])) if k == HELD else total[at[a:b]]
            rows.append((level, part, table.column("slice")[i].as_py(), pack(counts), 0, 0))
        give_back()
        return pa.Table.from_batches([_columns(rows, _ANSWERED)])

    return asked.groupBy("level", "range").applyInArrow(run, "level int, range int, slice long, counts binary, seen_kept long, seen long")


def bucket(contexts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one more for each power of two."""
    return np.frexp(contexts.astype(float))[1]


def mixture(grams, contexts, weights: list[np.ndarray], tokens: int, seen: int, order: int) -> np.ndarray:
    """Each token's probability by the orders up to ``order``; ``weights`` by order and bucket."""
    p = np.full(len(grams[0]), 1.0 / (seen + 1))
    for m in range(order):
        context = contexts[m - 1] if m else np.full(len(p), tokens)
        share = weights[m][bucket(context)]
        p = share * (grams[m] / np.maximum(context, 1)) + (1 - share) * p
    return p


def evidence(grams, contexts, weights, tokens: int, seen: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and bin of each token's evidence ratio at order m + 1: its estimate over what the lower orders give.

    Tokens of contexts never seen have none. Bin 0 is a ratio of 0.
    """
    context = contexts[m - 1] if m else np.full(len(grams[0]), tokens)
    with np.errstate(divide="ignore"):
        ratio = np.log2(grams[m] / np.maximum(context, 1) / mixture(grams, contexts, weights, tokens, seen, m))
    bins = np.where(grams[m] > 0, np.clip(np.rint(ratio * FINE), -WIDEST * FINE, WIDEST * FINE) + WIDEST * FINE + 1, 0)
    use = context > 0
    return bucket(context)[use], bins[use].astype(np.int64)


def learn(bins: np.ndarray, n: np.ndarray, rounds: int = 200) -> float:
    """The weight that makes a histogram of evidence ratios likeliest, by EM with one token's worth of doubt on either side."""
    ratio = np.where(bins == 0, 0.0, 2.0 ** ((bins - 1 - WIDEST * FINE) / FINE))
    weight = 0.5
    for _ in range(rounds):
        new = (float((n * (weight * ratio / (weight * ratio + 1 - weight))).sum()) + 1) / (float(n.sum()) + 2)
        if abs(new - weight) < 1e-9:
            break
        weight = new
    return weight


def _events(parts: DataFrame, answers: DataFrame, kept_texts: int, texts: int) -> DataFrame:
    """The counts of the held-out slices' tokens, by the texts kept alone."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        s, _, known = _known(left, right, texts, range(1, ORDER + 1))
        grams = [k.kept for k in known]
        contexts = [s.shifted(g, kept_texts) for g in grams[:-1]]
        give_back()
        return pa.table([pa.array([pack(x)], pa.binary()) for x in (*grams, *contexts)], [f"x{i}" for i in range(2 * ORDER - 1)])

    schema = ", ".join(f"x{i} binary" for i in range(2 * ORDER - 1))
    return parts.drop("doc_ids").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, schema)


def weights(events: DataFrame, tokens: int, seen: int) -> list[np.ndarray]:
    """By order and bucket, learned from the written events; a bucket without any takes the last one's weight.

    Each order is a pass over the events, which gives histograms of at most 64 buckets and 2 * WIDEST * FINE + 2 bins.
    """
    found: list[np.ndarray] = []
    for m in range(ORDER):

        def run(batches, m=m, found=tuple(found)):
            for batch in batches:
                for row in batch.to_pylist():
                    x = [unpack(row[f"x{i}"]).astype(np.int64) for i in range(2 * ORDER - 1)]
                    b, bins = evidence(x[:ORDER], x[ORDER:], found, tokens, seen, m)
                    keys, n = np.unique(b * 10_000 + bins, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys // 10_000), pa.array(keys % 10_000), pa.array(n)], ["bucket", "bin", "n"])

        tallies = map_arrow(events, run, "bucket long, bin long, n long").groupBy("bucket", "bin").agg(F.sum("n").alias("n")).toArrow()
        b, bins, n = (tallies.column(c).to_numpy() for c in ("bucket", "bin", "n"))
        out = np.zeros(65)  # bucket 0: a context never seen tells nothing
        last = 0.5
        for k in range(1, 65):
            if (b == k).any():
                last = learn(bins[b == k], n[b == k])
            out[k] = last
        found.append(out)
    return found


def scores(docs: DataFrame, trained: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text) of every row.

    ``trained`` tells which rows are counted; where it is null (a null id), the row is. A null text is an empty one, whose
    only token is its end. Base: add-one estimates of single tokens. Rows that repeat are counted, and scored, each; an
    empty table gives no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "interpolation")
    arrow_rows(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    whole = tokenised(docs, trained)
    # the driver needs how many tokens and texts there are, not the tokens
    parts = scratch.table(whole)
    tallies = {r["kind"]: r for r in _sizes(parts).groupBy("kind").agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens")).collect()}
    texts = {k: tallies[k]["texts"] if k in tallies else 0 for k in (OTHER, KEPT, HELD)}
    tokens = {k: tallies[k]["tokens"] if k in tallies else 0 for k in (OTHER, KEPT, HELD)}
    bits = max(0, (sum(tokens.values()) // RANGE).bit_length())
    n, m = tokens[KEPT] + tokens[HELD], texts[KEPT] + texts[HELD]
    answers = scratch.table(_answered(_asked(parts, bits)))
    scratch.settle()  # lets the shuffled requests go
    r = answers.where("slice is null and level = 1").agg(F.sum("seen_kept").alias("kept"), F.sum("seen").alias("all")).first()
    seen_kept, seen = r["kept"] or 0, r["all"] or 0
    answers = answers.where("slice is not null").select("slice", "level", "range", "counts")
    for order in range(3, ORDER + 1):
        more = scratch.table(_answered(_asked_again(parts, answers, order, bits, m)))
        answers = answers.unionByName(more.where("slice is not null").select("slice", "level", "range", "counts"))
        scratch.settle()
    held = parts.where(F.col("kind") == HELD)
    events = scratch.table(_events(held, answers.join(held.select("slice"), "slice", "left_semi"), texts[KEPT], m))
    learned = weights(events, tokens[KEPT], seen_kept)
    scratch.settle()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        s, _, known = _known(left, right, m, range(1, ORDER + 1))
        grams = [k.total for k in known]
        contexts = [s.shifted(g, m) for g in grams[:-1]]
        of = lambda x: np.add.reduceat(x, s.starts)
        base = of(np.log10((grams[0] + 1) / (n + seen + 1)))
        score = of(np.log10(mixture(grams, contexts, learned, n, seen, ORDER)))
        ids = left.column("doc_ids").combine_chunks().flatten()
        out = pa.table([ids, pa.array(s.lengths), pa.array(of((grams[0] > 0).astype(np.int64))), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])
        give_back()
        return out

    out = parts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _sizes(parts: DataFrame) -> DataFrame:
    """kind, texts and tokens of each slice."""

    def run(batches):
        for batch in batches:
            n = [unpack(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in n]), pa.array([int(x.sum()) for x in n])], ["kind", "texts", "tokens"])

    return map_arrow(parts.select("kind", "lengths"), run, "kind int, texts long, tokens long")
