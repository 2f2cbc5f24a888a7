"""Best-fit packing of token pieces with certified bounds and repacking between partitions.

Each partition packs its pieces by best-fit decreasing and compares its bin count with lower bounds from
dual-feasible functions. A partition certified by its volume wastes less than a bin: its bins close, but
for the one with most room. One with a gap, or certified only because its large pieces can't share bins,
keeps its full bins and gives the documents of the others to the exchange, where pieces of other
partitions may fill them. What was given is dealt out anew and packed again, until nothing is open or an
exchange saves no bin; what is open then stays as packed, with the bins and the bound of its part beside it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, text_column
from .tokens import bpe

#: Pieces that one task packs at a time.
PART_PIECES = 20_000
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """A row per piece: each text's ids and ``end_id``, cut so that only the first piece may be shorter.

    Null text is empty and gives one piece of the end id alone.
    """

    def run(batches):
        model = bpe(path)
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                a = np.append(model.ids(text), np.uint32(end_id)).astype("<u4")
                at = 0
                for k in range(-(-len(a) // capacity)):
                    stop = (len(a) - 1) % capacity + 1 if k == 0 else at + capacity
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(a[at:stop]))
                    if with_ids:
                        ids.append(a[at:stop].astype(np.int32))
                    at = stop
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", text_column().alias("text")), run, PIECES.format(id=kind) + (", ids array<int>" if with_ids else ""))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """``lower_bound_of`` a list of lengths."""
    sizes, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    return lower_bound_of(sizes, counts, capacity)


def lower_bound_of(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The largest of these bounds on the bins: total size, and two families of dual-feasible functions.

    u(k): x -> x if x * (k + 1) is a multiple of the capacity, else capacity * floor((k + 1) x / capacity) / k.
    v(t): x -> capacity if x > capacity - t, 0 if x < t, else x, for t up to half the capacity.
    """
    if len(sizes) == 0:
        return 0
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 21):  # sums are scaled by k, to stay whole
        scaled = np.where(sizes * (k + 1) % capacity == 0, sizes * k, capacity * (sizes * (k + 1) // capacity))
        best = max(best, -(-int((scaled * counts).sum()) // (capacity * k)))
    for t in np.unique(np.minimum(sizes, capacity - sizes)):
        if 0 < t <= capacity // 2:
            cut = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes))
            best = max(best, -(-int((cut * counts).sum()) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece: largest first, into the fullest bin that has room."""
    order = np.argsort(-np.asarray(lengths), kind="stable")
    out = np.empty(len(order), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0  # bit r of mask: a bin with room r is open
    for i in order.tolist():
        n = int(lengths[i])
        above = mask >> n
        if above:
            r = n + ((above & -above).bit_length() - 1)
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b, used = capacity, used, used + 1
        out[i] = b
        if r > n:
            if not room[r - n]:
                mask |= 1 << (r - n)
            room[r - n].append(b)
    return out


def pack_part(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Bins, offsets, whether each piece's bin closes, and the bound."""
    bins, bound = best_fit_decreasing(lengths, capacity), lower_bound(lengths, capacity)
    n = int(bins.max()) + 1
    fill = np.bincount(bins, lengths, n).astype(np.int64)
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.r_[True, bins[order][1:] != bins[order][:-1]]
    offsets = np.empty(len(bins), np.int64)
    offsets[order] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(bins)]))
    if n == -(-int(lengths.sum()) // capacity):
        closed = np.ones(n, bool)
        if fill.min() < capacity:
            closed[int(np.argmin(fill))] = False
    else:
        closed = fill == capacity
    return bins, offsets, closed[bins], bound


def _packer(capacity: int):
    def run(pieces: pa.Table) -> pa.Table:
        pieces = pieces.combine_chunks().sort_by([("length", "descending"), ("row", "ascending")])
        bins, offsets, closed, bound = pack_part(pieces.column("length").to_numpy(), capacity)
        for name, values in (("bin", bins), ("offset", offsets), ("closed", closed), ("part_bins", np.full(len(bins), bins.max() + 1, np.int64)), ("part_bound", np.full(len(bins), bound, np.int64))):
            pieces = pieces.append_column(name, pa.array(values))
        return pieces

    return run


def pack(pieces: DataFrame, capacity: int = 1024, scratch: Scratch | None = None) -> DataFrame:
    """``pieces`` with sequence_id, offset, and the round, bins and bound of the part that placed them.

    Pieces of full length are sequences already. No piece is dropped or capped; a task never holds more
    than about PART_PIECES pieces. Repeated rows are packed one by one. An exchange follows as long as the last one
    needed fewer bins for its pieces than they had before, and other parts are left to exchange with.
    """
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    pieces = scratch.table(pieces.withColumn("row", F.monotonically_increasing_id()))
    names = [c for c in pieces.columns if c != "row"]
    one = F.lit(1).cast("long")
    # rows of the table have unique places, and so full sequences have unique numbers
    full = pieces.where(F.col("length") == capacity).select(*names, (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("round"), F.lit(0).cast("long").alias("part"), one.alias("part_bins"), one.alias("part_bound"))
    opened, done, k, before = pieces.where(F.col("length") < capacity), [full], 0, None
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*names, "row"]) + ", part long, bin long, offset long, closed boolean, part_bins long, part_bound long"
    run = _packer(capacity)
    while n := opened.count():
        k += 1
        parts = -(-n // PART_PIECES)
        dealt = opened.select(*names, "row", F.pmod(F.xxhash64("row", F.lit(k)), F.lit(parts)).alias("part"))
        packed = scratch.table(dealt.groupBy("part").applyInArrow(run, schema))
        number = F.lit(k << 54) + F.shiftleft(F.col("part"), 20) + F.col("bin")
        placed = lambda rows, number=number, k=k: rows.select(*names, number.alias("sequence_id"), "offset", F.lit(k).alias("round"), "part", "part_bins", "part_bound")
        used = packed.where("offset = 0").agg(F.count("*"), F.count(F.when(~F.col("closed"), 1))).first()
        if parts == 1 or (before is not None and used[0] >= before):
            done.append(placed(packed))
            break
        done.append(placed(packed.where("closed")))
        opened, before = packed.where("not closed").select(*names, "row"), used[1]
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenise, cut and pack all documents; see ``token_pieces`` and ``pack`` for the columns and cases."""
    return pack(token_pieces(docs, path, capacity, end_id), capacity)


def certificate(packed: DataFrame, capacity: int = 1024) -> dict[str, int]:
    """Sequences used against a bound for all pieces together, from the histogram of at most ``capacity`` lengths."""
    used = packed.agg(F.count_distinct("sequence_id")).first()[0]
    histogram = packed.groupBy("length").count().collect()
    lengths = {r["length"]: r["count"] for r in histogram}
    sizes = np.array(sorted(lengths), np.int64)
    return {"sequences": used, "bound": lower_bound_of(sizes, np.array([lengths[s] for s in sizes.tolist()], np.int64), capacity)}
