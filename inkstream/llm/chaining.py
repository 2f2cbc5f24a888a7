"""Substring duplicates: shared k-mer seeds, collinear chains with gap costs, alignment of the chains.

Seeds are the minimisers of the word k-mers. Each seed's first place (smallest doc_id) is its source; every
other document's occurrence meets that one place only, so a passage in n documents costs n rows. Seeds of
a document against a source are chained through a Fenwick tree; chains are aligned on the words of both
and a source's neighbouring stretches merged. Passages of at least ``least`` words are duplicates of their source.

A phrase that many documents have can hide a passage's own source: its seeds then meet other documents.
So what is left of a document where enough seeds have been seen before is searched once more with long
k-mers: the first documents that have those are further sources, chained and aligned in the same way. As the
longest of them are as long as a passage, no passage that an earlier document has word for word is lost: its
anchors lie on one diagonal, and the run through each anchor is a stretch of its own beside the alignment.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BitmapFilter, Scratch, flagged, list_array, map_arrow, slices, spare, text_column, text_hash, utf8
from .textcore import ALNUM, Words, grams, winnow_all

#: Words of a seed, k-mers of which one is a seed (a shared run of SEED + WINDOW - 1 words shares one),
#: words of a duplicate passage (with 4 changed words it has a run of 10 yet), and words that may differ between two merged stretches.
SEED, WINDOW, LEAST, BRIDGE = 6, 5, 50, 3
#: Cost of a word of gap on either side, words that are looked at beyond a chain, and the drop that ends an extension.
GAP, MARGIN, DROP = 0.05, 40, 6
#: Words of the k-mers that cut long gaps between anchors.
SHORT = 3
#: Words of the long k-mers of the second search, beside those as long as a passage.
LONG = 16
#: K-mers of which one task keeps the first places at a time, before any are shuffled.
HELD = 1 << 18


def _through_tree(pos: list[int], other: list[int], k: int, gap: float, score: list[float], before: list[int]) -> None:
    """Fill in each anchor's best score and predecessor, by a Fenwick tree of prefix maxima over the other text's places."""
    order = sorted(range(len(pos)), key=lambda i: (pos[i], -other[i]))
    ranks = {v: r + 1 for r, v in enumerate(sorted(set(other)))}
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ranks) + 1)
    for i in order:
        best, at, r = float("-inf"), -1, ranks[other[i]] - 1
        while r > 0:
            if tree[r][0] > best:
                best, at = tree[r]
            r -= r & -r
        joined = best - gap * (pos[i] + other[i])
        if at >= 0 and joined > 0 and pos[at] < pos[i]:
            score[i], before[i] = k + joined, at
        else:
            score[i] = float(k)
        value, r = score[i] + gap * (pos[i] + other[i]), ranks[other[i]]
        while r < len(tree):
            if value > tree[r][0]:
                tree[r] = (value, i)
            r += r & -r


def chain(pos: list[int], other: list[int], k: int = SEED, gap: float = GAP) -> list[list[int]]:
    """Chains of anchors that rise in both texts, best first, each anchor in one chain.

    A chain scores k per anchor less ``gap`` for each word between anchors on either side. With that linear
    cost the best predecessor is a prefix maximum of score + gap * (pos + other), kept in a Fenwick tree.
    """
    score, before = [0.0] * len(pos), [-1] * len(pos)
    if all(map(operator.lt, pos, pos[1:])) and all(map(operator.lt, other, other[1:])):
        # of anchors that all rise, score + gap * (pos + other) rises too: the one before is the prefix maximum
        best = float("-inf")
        for i, (p, q) in enumerate(zip(pos, other, strict=True)):
            joined = best - gap * (p + q)
            score[i], before[i] = (k + joined, i - 1) if joined > 0 else (float(k), -1)
            best = score[i] + gap * (p + q)
    else:
        _through_tree(pos, other, k, gap, score, before)
    used, out = [False] * len(pos), []
    for i in sorted(range(len(pos)), key=lambda i: -score[i]):
        part = []
        while i >= 0 and not used[i]:
            used[i] = True
            part.append(i)
            i = before[i]
        if part:
            out.append(part[::-1])
    return out


def _extend(a: list, i: int, b: list, j: int, step: int) -> list[tuple[int, int, int]]:
    """Runs (place, place, words) matched going outward from (i, j): +1 a match, -2 a word put in, left out or changed;
    ends DROP below its best."""
    score = best = 0
    out: list[tuple[int, int, int]] = []
    keep = 0
    n, m = len(a), len(b)
    while 0 <= i < n and 0 <= j < m:
        if a[i] == b[j]:
            run = _same(a, i, b, j, step)
            out.append((i, j, run) if step > 0 else (i - run + 1, j - run + 1, run))
            score += run
            if score > best:
                best, keep = score, len(out)
            i, j = i + step * run, j + step * run
            continue
        score -= 2
        if best - score >= DROP:
            break
        i2, j2 = i + step, j + step
        if 0 <= i2 < n and 0 <= j2 < m and a[i2] == b[j2]:
            i, j = i2, j2
        elif 0 <= i2 < n and a[i2] == b[j]:
            i = i2
        elif 0 <= j2 < m and a[i] == b[j2]:
            j = j2
        else:
            i, j = i2, j2
    return out[:keep]


def _same(a: list, i: int, b: list, j: int, step: int, stride: int = 16) -> int:
    """Words that agree from (i, j) on in the direction of ``step``; compared a stride at a time while whole strides do."""
    x = 0
    if step > 0:
        most = min(len(a) - i, len(b) - j)
        while x + stride <= most and a[i + x : i + x + stride] == b[j + x : j + x + stride]:
            x += stride
        while x < most and a[i + x] == b[j + x]:
            x += 1
    else:
        most = min(i, j) + 1
        while x + stride <= most and a[i - x - stride + 1 : i - x + 1] == b[j - x - stride + 1 : j - x + 1]:
            x += stride
        while x < most and a[i - x] == b[j - x]:
            x += 1
    return x


def _between(a: list, i: int, i2: int, b: list, j: int, j2: int) -> list[tuple[int, int, int]]:
    """Matched runs within a gap by longest common subsequence; a long gap is first cut at the best chain of its shorter
    k-mers, and one without any is met from both ends."""
    n, m = i2 - i, j2 - j
    if n <= 0 or m <= 0:
        return []
    if n == m and a[i:i2] == b[j:j2]:
        return [(i, j, n)]
    if n > 80 or m > 80:
        middle = _middle(a, i, i2, b, j, j2)
        if middle:
            return align(a[:i2], b[:j2], *middle, k=SHORT, start=(i, j), end=(i2, j2))
        front = _extend(a[:i2], i, b[:j2], j, 1)
        back = _extend(a[i:i2], n - 1, b[j:j2], m - 1, -1)
        after = (front[-1][0] + front[-1][2], front[-1][1] + front[-1][2]) if front else (i, j)
        for x, y, run in reversed(back):
            cut = max(0, after[0] - x - i, after[1] - y - j)
            if cut < run:
                front.append((x + i + cut, y + j + cut, run - cut))
        return front
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for x in range(n - 1, -1, -1):
        row, below = best[x], best[x + 1]
        for y in range(m - 1, -1, -1):
            row[y] = below[y + 1] + 1 if a[i + x] == b[j + y] else max(below[y], row[y + 1])
    x = y = 0
    out = []
    while x < n and y < m:
        if a[i + x] == b[j + y]:
            out.append((i + x, j + y, 1))
            x, y = x + 1, y + 1
        elif best[x + 1][y] >= best[x][y + 1]:
            x += 1
        else:
            y += 1
    return out


def _middle(a: list, i: int, i2: int, b: list, j: int, j2: int) -> tuple[list[int], list[int]] | None:
    """Places of the best chain of SHORT-word k-mers within a gap, each met where the other text has it first."""
    first: dict[tuple, int] = {}
    for y in range(j, j2 - SHORT + 1):
        first.setdefault(tuple(b[y : y + SHORT]), y)
    met = [(x, y) for x in range(i, i2 - SHORT + 1) if (y := first.get(tuple(a[x : x + SHORT]))) is not None]
    if not met:
        return None
    pos, other = [x for x, _ in met], [y for _, y in met]
    best = chain(pos, other, SHORT)[0]
    return [pos[x] for x in best], [other[x] for x in best]


def diagonals(a: list, b: list, pos: list[int], other: list[int]) -> list[tuple[int, int, int]]:
    """Each anchor's whole run of equal words, both ways along its diagonal: (place, place, words), no run twice.

    Where anchors of different diagonals overlap, an alignment gives the words to one of them; a passage word for word is
    on one diagonal and whole here.
    """
    reached: dict[int, int] = {}
    out = []
    for p, q in zip(pos, other, strict=True):
        if p < reached.get(q - p, -1):
            continue
        back = _same(a, p - 1, b, q - 1, -1) if p and q else 0
        run = back + _same(a, p, b, q, 1)
        reached[q - p] = p - back + run
        out.append((p - back, q - back, run))
    return out


def align(a: list, b: list, pos: list[int], other: list[int], k: int = SEED, start: tuple[int, int] | None = None, end: tuple[int, int] | None = None) -> list[tuple[int, int, int]]:
    """Matched runs (place, place, words) of a chain: its seeds, the words between them, and what goes on at either end,

    or, given where the texts are matched up to and from, the words up to there.
    """
    at = start or (pos[0], other[0])
    out = [] if start else _extend(a, at[0] - 1, b, at[1] - 1, -1)[::-1]
    for p, q in zip(pos, other, strict=True):
        if p > at[0] and q > at[1]:
            out += _between(a, at[0], p, b, at[1], q)
        skip = max(0, at[0] - p, at[1] - q)  # seeds that overlap
        if skip < k:
            out.append((p + skip, q + skip, k - skip))
        at = (max(at[0], p + k), max(at[1], q + k))
    return out + (_between(a, at[0], end[0], b, at[1], end[1]) if end else _extend(a, at[0], b, at[1], 1))


def stretches(words: list[int], chains: list[dict], bridge: int = BRIDGE) -> list[tuple]:
    """(from, to, matched words, source, source_from) of one document's aligned chains."""
    out: list[tuple] = []
    # every chain is aligned: seeds that another chain covers don't tell how far this one's alignment goes
    for c in chains:
        shift, part = c["shift"], None
        other = [x - shift for x in c["other"]]
        out += [(i, i + n, n, c["source"], j + shift) for i, j, n in diagonals(words, c["words"], c["pos"], other)]
        for i, j, n in align(words, c["words"], c["pos"], other):
            if part and i - part[1] <= bridge and j - part[4] <= bridge:
                part[1], part[2], part[4] = i + n, part[2] + n, j + n
                continue
            if part:
                out.append((*part[:3], c["source"], part[3] + shift))
            part = [i, i + n, n, j, j + n]  # from, to, matched, the source's from and to
        if part:
            out.append((*part[:3], c["source"], part[3] + shift))
    return out


def merge(parts: list[tuple], least: int = LEAST, bridge: int = BRIDGE) -> list[dict]:
    """The passages that stretches make: those of one source within ``bridge`` words of each other are one, and count
    from ``least`` words on; passages that meet are one row, with its main source and all others."""
    whole: list[list] = []
    for a, z, n, source, at in sorted(parts, key=lambda x: (x[3] is not None, x[3], x[0], -x[1], -x[2], x[4])):
        if whole and source == whole[-1][3] and a <= whole[-1][1] + bridge:
            last = whole[-1]
            last[1] = max(last[1], z)
            if n > last[2]:
                last[2], last[4] = n, at
        else:
            whole.append([a, z, n, source, at])
    out: list[dict] = []
    for a, z, n, source, at in sorted((x for x in whole if x[1] - x[0] >= least), key=lambda x: (x[0], -x[1], -x[2], x[3] is not None, x[3])):
        if out and a <= out[-1]["to"] + bridge:
            last = out[-1]
            last["to"] = max(last["to"], z)
            last["sources"].add(source)
            if n > last["matched"]:
                last |= {"matched": n, "source": source, "source_from": at}
        else:
            out.append({"from": a, "to": z, "matched": n, "source": source, "source_from": at, "sources": {source}})
    return out


def passages(words, chains: list[dict], least: int = LEAST, bridge: int = BRIDGE) -> list[dict]:
    """Merged stretches of one document's aligned chains that reach ``least`` words."""
    return merge(stretches(np.asarray(words).tolist(), chains, bridge), least, bridge)


def suspect(pos: list[int], order: list[int], least: int = LEAST) -> list[tuple[int, int]]:
    """Word ranges that may hold a passage: seeds seen in earlier documents (their places and numbers) lie close there.

    A passage word for word has all its seeds seen but for some near its ends, so a run of seen seeds spans 20 of
    50 words at least; a fuzzy one has half of them seen.
    """
    out: list[tuple[int, int]] = []
    span, j, edge = max(1, least - 30), 0, WINDOW + SEED

    def put(a: int, z: int) -> None:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))

    first = 0
    for k in range(len(pos)):
        if k and order[k] - order[k - 1] > 1:
            first = k
        while pos[k] - pos[j] > least - SEED:
            j += 1
        if pos[k] - pos[first] >= span:
            put(max(0, pos[first] - edge), pos[k] + SEED + edge)
        if pos[k] - pos[j] >= span and k - j >= 4 and 2 * (k - j + 1) >= order[k] - order[j] + 1:
            put(max(0, pos[k] + SEED - least - edge), pos[j] + least + edge)
    return out


def uncovered(ranges: list[tuple[int, int]], found: list[tuple[int, int]], n: int, least: int = LEAST) -> np.ndarray:
    """Starts of the windows of ``least`` words in the ranges that no found passage holds whole."""
    start = np.zeros(max(0, n - least + 1), bool)
    for a, z in ranges:
        start[a : max(a, z - least + 1)] = True
    for a, z in found:
        start[a : max(a, z - least + 1)] = False
    return np.flatnonzero(start)


def long_grams(words: np.ndarray, at: np.ndarray, least: int = LEAST, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the long k-mers in the windows of ``least`` words at ``at``; ``words`` are 32-bit hashes."""
    whole = _long(words, least)
    within = np.zeros(len(words) - long + 1, bool)
    for x in at.tolist() if len(at) < 64 else ():
        within[x : x + least - long + 1] = True
    if len(at) >= 64:
        edge = np.zeros(len(within) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + least - long + 1, -1)
        within = np.cumsum(edge)[:-1] > 0
    parts = np.flatnonzero(within)
    return np.concatenate((whole[at], _long(words, long)[parts])), np.concatenate((at, parts))


def _long(words: np.ndarray, k: int) -> np.ndarray:
    return grams(words.view(np.uint32).astype(np.uint64), k) ^ np.uint64(k)


def _long_at(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """``_long`` at the rising places alone: those that lie close are hashed together."""
    if not len(at):
        return np.zeros(0, np.uint64)
    cut = np.flatnonzero(np.diff(at) > k) + 1
    parts = zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])), strict=True)
    return np.concatenate([_long(words[at[x] : at[y - 1] + k], k)[at[x:y] - at[x]] for x, y in parts])


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, tk (a hash of the text; rows that repeat both are one), text."""
    return docs.select("doc_id", text_hash().alias("tk"), text_column().alias("text"))


def _word_slices(batches):
    """(slice of doc_id, tk, text; its Words)."""
    for batch in batches:
        for part in slices([batch]):
            raw, offsets = utf8(part.column(2))
            yield part, Words(raw, offsets, ALNUM, lower=True)


def _seeds(w: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash, place and number within its text of each seed."""
    g = grams(w.hash, SEED)
    long = np.flatnonzero(w.counts >= max(least, SEED))
    at = winnow_all(g, w.first[long], w.first[long + 1] - SEED + 1, WINDOW, robust=True)
    which = np.searchsorted(w.first[long], at, side="right") - 1
    doc = long[which] if len(at) else which
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(at) else doc
    number = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return doc, g[at], at - w.first[doc], number


def first_places(docs: DataFrame, hashed) -> DataFrame:
    """h, sdoc, stk, spos: the first place of each k-mer that more than one document has.

    ``hashed`` gives texts, hashes and places of a slice's k-mers. A task keeps the first place of each in
    blocks of HELD, so that a k-mer which most documents have is shuffled once a block and not once a document.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held, ids, size, base = [], [], 0, 0

        def flush():
            table = pa.Table.from_batches(ids).combine_chunks()
            order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("tk", "ascending")], null_placement="at_start").to_numpy()
            near, far = table.take(order[:-1]), table.take(order[1:])
            same = pc.and_(pc.equal(near["tk"], far["tk"]), pc.or_(pc.fill_null(pc.equal(near["doc_id"], far["doc_id"]), False), pc.and_(pc.is_null(near["doc_id"]), pc.is_null(far["doc_id"])))).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], ~same.astype(bool))))
            doc, h, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            place = rank[doc]
            if (place[1:] < place[:-1]).any():
                by = np.argsort(place, kind="stable")
                doc, h, pos, place = doc[by], h[by], pos[by], place[by]
            # rows are in the order of documents and places: of equal k-mers the smallest row number is the first place
            by = np.argsort(h)
            edge = np.flatnonzero(np.concatenate(([True], h[by[1:]] != h[by[:-1]])))
            first, last = np.minimum.reduceat(by, edge), np.maximum.reduceat(by, edge)
            many = place[first] != place[last]
            # rows of one document side by side, their equal fields together: a shuffle compresses these well
            by = np.argsort(first)
            first, many = first[by], many[by]
            for i in range(0, len(first), 50_000):
                at = first[i : i + 50_000]
                who = table.take(doc[at]).combine_chunks()
                ids_of = (who.column(c).combine_chunks() for c in (0, 1))
                yield pa.RecordBatch.from_arrays([*ids_of, pa.array(many[i : i + 50_000]), pa.array(h[at].view(np.int64)), pa.array(pos[at].astype(np.int32))], ["sdoc", "stk", "many", "h", "spos"])

        for part, w in _word_slices(batches):
            doc, h, pos = hashed(w)
            if len(h):
                held.append((doc + base, h, pos))
                ids.append(pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["doc_id", "tk"]))
                base, size = base + part.num_rows, size + len(h)
            if size >= HELD:
                yield from flush()
                held, ids, size, base = [], [], 0, 0
        if size:
            yield from flush()

    found = map_arrow(_identified(docs), run, f"sdoc {kind}, stk long, many boolean, h long, spos int")
    # one pass in order: a first row that another follows, or that stands for several documents
    same = Window.partitionBy("h").orderBy("sdoc", "stk", "spos")
    found = found.withColumn("before", F.lag("h").over(same)).withColumn("after", F.lead("h").over(same))
    return found.where("before is null and (after is not null or many)").select("h", "sdoc", "stk", "spos")


def seeds(docs: DataFrame, member, least: int = LEAST) -> DataFrame:
    """doc_id, tk, h, pos, i: the seeds that a bitmap lets through, with their places and numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part, w in _word_slices(batches):
            doc, h, pos, i = _seeds(w, least)
            keep = member.value.has(h) if len(h) else np.zeros(0, bool)
            if keep.any():
                doc = pa.array(doc[keep])
                yield pa.RecordBatch.from_arrays([part.column(0).take(doc), part.column(1).take(doc), pa.array(h[keep].view(np.int64)), pa.array(pos[keep].astype(np.int32)), pa.array(i[keep].astype(np.int32))], ["doc_id", "tk", "h", "pos", "i"])

    return map_arrow(_identified(docs), run, f"doc_id {kind}, tk long, h long, pos int, i int")


def _word_hashes(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """d, t (doc_id and tk), 32-bit word hashes of the documents whose tk may be among the keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part, w in _word_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), list_array((w.hash >> np.uint64(32)).astype(np.uint32).view(np.int32), w.counts, pa.int32())], ["d", "t", "words"])

    wanted = flagged(_identified(docs), "tk", keys.select(F.col(key).alias("k")).distinct(), "k", "flag").where("flag").drop("flag")
    return map_arrow(wanted, run, f"d {kind}, t long, words array<int>")


def _chained(anchors: DataFrame) -> DataFrame:
    """doc_id, tk, sdoc, stk, pos, other, ranges: a row per chain of the anchors (doc_id, tk, pos, i, sdoc, stk, spos).

    ``i`` numbers a text's seeds; the ranges, on a text's first row, are those where a passage may be. A text's
    anchors are in one cell, as its words are.
    """
    kind = anchors.schema["doc_id"].dataType.simpleString()
    grouped = anchors.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("sdoc", "stk", "pos", "spos", "i")).alias("anchors"))

    def run(batches):
        for batch in batches:
            rows, sources = [], []
            cell = batch.column(2)
            inner = cell.flatten()
            at = [0, *np.cumsum(pc.list_value_length(cell).to_numpy(zero_copy_only=False)).tolist()]
            stk, pos, spos, number = (inner.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("stk", "pos", "spos", "i"))
            sdoc = inner.field("sdoc").to_pylist()
            for r in range(batch.num_rows):
                per: dict[tuple, list] = {}
                for x in range(at[r], at[r + 1]):
                    per.setdefault((sdoc[x], stk[x]), []).append((pos[x], spos[x]))
                ranges = suspect(*map(list, zip(*sorted({(pos[x], number[x]) for x in range(at[r], at[r + 1])}), strict=True)))
                for (source, key), places in sorted(per.items(), key=lambda x: (x[0][0] is not None, x[0])):
                    places.sort()
                    p, q = [x[0] for x in places], [x[1] for x in places]
                    for part in chain(p, q):
                        rows.append((r, key, [p[i] for i in part], [q[i] for i in part], [{"a": a, "z": z} for a, z in ranges]))
                        sources.append(source)
                        ranges = []
                if len(rows) > 20_000 or r == batch.num_rows - 1:
                    where = pa.array([x[0] for x in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(sources, inner.type.field("sdoc").type), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.list_(pa.int32())), pa.array([x[3] for x in rows], pa.list_(pa.int32())), pa.array([x[4] for x in rows], pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())])))], ["doc_id", "tk", "sdoc", "stk", "pos", "other", "ranges"])
                    rows, sources = [], []

    return map_arrow(grouped, run, f"doc_id {kind}, tk long, sdoc {kind}, stk long, pos array<int>, other array<int>, ranges array<struct<a:int,z:int>>")


def _beside_words(docs: DataFrame, chained: DataFrame) -> DataFrame:
    """doc_id, tk, words, chains, ranges: each text of the written chains with its words and its chains' parts of the sources."""
    low = F.greatest(F.array_min("other") - MARGIN, F.lit(0))
    near = chained.join(_word_hashes(docs, chained, "stk"), F.col("sdoc").eqNullSafe(F.col("d")) & (F.col("stk") == F.col("t")))
    near = near.select("doc_id", "tk", "ranges", F.struct(F.col("sdoc").alias("source"), "pos", "other", low.alias("shift"), F.slice("words", low + 1, F.array_max("other") - low + SEED + MARGIN).alias("words")).alias("c"))
    # own words come by the same grouping as the chains; rows that repeat id and text have equal ones
    own = _word_hashes(docs, chained, "tk").withColumnsRenamed({"d": "doc_id", "t": "tk"})
    both = near.unionByName(own, allowMissingColumns=True).groupBy("doc_id", "tk")
    both = both.agg(F.first("words", ignorenulls=True).alias("words"), F.collect_set("c").alias("chains"), F.flatten(F.collect_set("ranges")).alias("ranges"))
    return both.where(F.size("chains") > 0)


def _aligned(docs: DataFrame, chained: DataFrame, least: int) -> DataFrame:
    """doc_id, tk, parts (stretches), h and pos (long k-mers of the ranges where no passage was found)."""
    both = _beside_words(docs, chained)
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64()), ("n", pa.int64()), ("source", _arrow_type(docs)), ("at", pa.int64())]))

    def run(batches):
        for batch in batches:
            parts, hashes, places = [], [], []
            inner = batch.column(3).flatten()
            source, shift = inner.field("source").to_pylist(), inner.field("shift").to_pylist()
            pos, other, near = (_lists(inner.field(c)) for c in ("pos", "other", "words"))
            edge = [0, *np.cumsum(pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)).tolist()]
            for r in range(batch.num_rows):
                words = np.asarray(batch.column(2)[r].values)
                chains = [{"source": source[x], "shift": shift[x], "pos": pos[x], "other": other[x], "words": near[x]} for x in range(edge[r], edge[r + 1])]
                one = stretches(words.tolist(), chains)
                found = [(x["from"], x["to"]) for x in merge(one, least)]
                at = uncovered([(x["a"], x["z"]) for x in batch.column(4)[r].as_py()], found, len(words), least)
                h, where = long_grams(words, at, least) if len(at) else (np.zeros(0, np.uint64), at)
                parts.append([{"a": a, "z": z, "n": n, "source": s, "at": b} for a, z, n, s, b in one])
                hashes.append(h.view(np.int64))
                places.append(where.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, kinds), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "tk", "parts", "h", "pos"])

    return map_arrow(both, run, f"doc_id {kind}, tk long, parts array<struct<a:bigint,z:bigint,n:bigint,source:{kind},at:bigint>>, h array<long>, pos array<int>")


def _lists(cells: pa.ListArray) -> list[list]:
    """The cells as lists of Python numbers, converted all at once."""
    values = cells.flatten().to_numpy(zero_copy_only=False).tolist()
    edge = [0, *np.cumsum(pc.list_value_length(cells).to_numpy(zero_copy_only=False)).tolist()]
    return [values[a:z] for a, z in zip(edge, edge[1:], strict=False)]


def _arrow_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def repeated_passages(docs: DataFrame, least: int = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, tk, start, n_words, n_matched, source_doc_id, source_start, source_doc_ids: a row per passage.

    A passage is a stretch of at least ``least`` words (LEAST or more) of a document that occurs, word for word
    or nearly, in a document of smaller doc_id (nulls first; among equal ids, of smaller tk). The first occurrence
    has no row, nor has a text of fewer words; repeats within one text are not looked for. Rows that repeat id
    and text are one document. Empty tables and null texts give no rows; other columns aren't read.
    """
    if least < LEAST:
        raise ValueError(f"passages of fewer than {LEAST} words are not sure to have seeds")
    scratch = scratch or Scratch(docs.sparkSession, "chaining")
    kind = docs.schema["doc_id"].dataType.simpleString()
    earlier = ~F.struct("doc_id", "tk").eqNullSafe(F.struct("sdoc", "stk"))
    firsts = scratch.table(first_places(docs, lambda w: _seeds(w, least)[:3]))
    scratch.settle()
    anchors = seeds(docs, scratch.share(BitmapFilter.of(firsts, "h")), least).join(firsts, "h").where(earlier)
    chained = scratch.table(_chained(anchors.select("doc_id", "tk", "pos", "i", "sdoc", "stk", "spos")))
    scratch.settle()
    aligned = scratch.table(_aligned(docs, chained, least))
    scratch.settle()

    # what is left: long k-mers, those of the passage's own length among them
    wanted = aligned.where(F.size("h") > 0).select("doc_id", "tk", F.explode(F.arrays_zip("h", "pos")).alias("x")).select("doc_id", "tk", "x.h", "x.pos")
    member = scratch.share(BitmapFilter.of(wanted.select("h").distinct(), "h"))

    def longs(w: Words):
        words = (w.hash >> np.uint64(32)).astype(np.uint32)
        h = _long(words, LONG)
        at = np.flatnonzero(member.value.has(h))
        if len(at) and least > LONG:
            # a wanted k-mer of ``least`` words begins with a wanted one of LONG
            start = at[at + least <= len(words)]
            whole = _long_at(words, start, least)
            hit = member.value.has(whole)
            at, h, k = np.concatenate((start[hit], at)), np.concatenate((whole[hit], h[at])), np.repeat((least, LONG), (int(hit.sum()), len(at)))
        else:
            h, k = h[at], np.full(len(at), LONG)
        doc = np.searchsorted(w.first, at, side="right") - 1
        inside = (at + k <= w.first[doc + 1]) & (w.counts[doc] >= least)
        return doc[inside], h[inside], at[inside] - w.first[doc[inside]]

    more = wanted.join(first_places(docs, longs), "h").where(earlier)
    # hits on one diagonal that go on are one run; its seeds lie side by side
    side = Window.partitionBy("doc_id", "tk", "sdoc", "stk", F.col("spos") - F.col("pos")).orderBy("pos")
    runs = more.select("doc_id", "tk", "sdoc", "stk", "pos", "spos").distinct().withColumn("new", (F.col("pos") > F.coalesce(F.lag("pos").over(side), F.lit(-9)) + 1).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(side)).groupBy("doc_id", "tk", "sdoc", "stk", (F.col("spos") - F.col("pos")).alias("shift"), "run").agg(F.min("pos").alias("a"), F.max("pos").alias("z"))
    runs = runs.select("doc_id", "tk", "sdoc", "stk", "shift", F.explode(F.sequence("a", F.col("z") + LONG - SEED, F.lit(SEED))).alias("pos"))
    anchors = runs.select("doc_id", "tk", "pos", F.col("pos").alias("i"), "sdoc", "stk", (F.col("pos") + F.col("shift")).cast("int").alias("spos"))
    chained = scratch.table(_chained(anchors).withColumn("ranges", F.array().cast("array<struct<a:int,z:int>>")))
    again = scratch.table(_aligned(docs, chained, least))
    parts = aligned.select("doc_id", "tk", "parts").unionByName(again.select("doc_id", "tk", "parts"))
    parts = parts.groupBy("doc_id", "tk").agg(F.flatten(F.collect_set("parts")).alias("parts"))

    def run(batches):
        for batch in batches:
            id_type = batch.schema.field(2).type.value_type.field("source").type
            rows = []
            for r in range(batch.num_rows):
                for x in merge([(p["a"], p["z"], p["n"], p["source"], p["at"]) for p in batch.column(2)[r].as_py()], least):
                    rows.append((r, x["from"], x["to"] - x["from"], x["matched"], x["source"], x["source_from"], sorted(s for s in x["sources"] if s is not None)))
            at = pa.array([x[0] for x in rows], pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.int64(), id_type, pa.int64(), pa.list_(id_type)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array([x[i + 1] for x in rows], t) for i, t in enumerate(kinds))], ["doc_id", "tk", "start", "n_words", "n_matched", "source_doc_id", "source_start", "source_doc_ids"])

    return map_arrow(parts, run, f"doc_id {kind}, tk long, start long, n_words long, n_matched long, source_doc_id {kind}, source_start long, source_doc_ids array<{kind}>")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (word numbers), each cut up to the next word that stays."""
    raw = text.encode("utf-8", "replace")
    view = np.frombuffer(raw, np.uint8)
    w = Words(view, np.array([0, len(view)]), ALNUM, lower=True, hashes=False)
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(raw[at : int(w.start[a])])
        at = int(w.start[b]) if b < len(w.start) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace").strip()


def remove_repeats(docs: DataFrame, least: int = LEAST, emptied: bool = True) -> DataFrame:
    """``docs`` with repeated passages cut from all texts but their first; n_chars, where there, follows.

    Texts without a passage stay as they are, nulls too; a text that was all passage becomes empty, and its
    row goes if ``emptied`` is false. Repeated rows are cut alike; columns of any name are kept. Only rows that
    a bitmap of the changed texts lets through are joined with their spans.
    """
    scratch = Scratch(docs.sparkSession, "chaining")
    tk, d, t, spans, flag = spare(docs, "_tk", "_d", "_t", "_spans", "_flag")
    found = repeated_passages(docs, least, scratch).groupBy("doc_id", "tk").agg(F.collect_set(F.struct("start", "n_words")).alias(spans))
    found = scratch.table(found.withColumnsRenamed({"doc_id": d, "tk": t}))

    @F.arrow_udf("string")
    def cut(text: pa.Array, cells: pa.Array) -> pa.Array:
        return pa.array([without_spans(x, [(y["start"], y["start"] + y["n_words"]) for y in c]) if c is not None else x for x, c in zip(text.to_pylist(), cells.to_pylist(), strict=True)], pa.string())

    keyed = flagged(docs.withColumn(tk, text_hash()), tk, found, t, flag)
    touched = keyed.where(flag).join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(tk) == F.col(t)), "left")
    touched = touched.withColumn("text", F.when(F.col(spans).isNotNull(), cut(text_column(), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    if not emptied:
        touched = touched.where(F.col(spans).isNull() | (F.col("text") != ""))
    return keyed.where(~F.col(flag)).select(*docs.columns).unionByName(touched.select(*docs.columns))
