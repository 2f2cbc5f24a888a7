"""K-d tree sharding: nodes are split at distributed weighted medians along their widest dimension.

Only DataFrame operations. Each tree level needs, for all its nodes together, one aggregation for the
widths and, per digit of the split value, one histogram of at most 2**DIGIT buckets a node, until the bucket
of the cut is small; only these bounded histograms reach the driver. The law is ``bytes``: a node that is to hold k shards is cut at
the row where its bytes reach floor(k/2)/k, so leaves come out near equal whatever the ties are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_column

#: Split values are whole numbers of BITS bits, refined DIGIT bits at a time.
BITS, DIGIT = 30, 10
#: A cut is settled in a bucket of at most this share of a shard's bytes.
SETTLED = 1e-3
#: Rows that one task numbers at a time.
SLOT_ROWS = 8192
_LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"


def _place(name: str) -> Column:
    """A string's place in dictionary order by its first five characters, letters and digits apart, in BITS bits."""
    letter = "coalesce(substring(lower(make_valid_utf8(cast(`{}` as string))), {}, 1), '')"
    # the place of an empty string in another is 1, that of a strange character 0
    codes = [F.expr(f"if({(c := letter.format(name, i + 1))} = '', 0, 1 + locate({c}, '{_LETTERS}'))").cast("long") for i in range(5)]
    return sum((F.shiftleft(c, BITS - 6 * (i + 1)) for i, c in enumerate(codes)), F.lit(0).cast("long"))


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tie, and the dimensions: size (its logarithm), source and language in dictionary order.

    Nulls: null text is empty; a null lang or source comes before all others, as an empty one does; a null doc_id is
    a value of its own. tie orders rows that no dimension tells apart: equal texts lie together, and a group of very
    many is cut by a hash of id and place.
    """
    raw = F.encode(text_column(), "utf-8")
    size = F.octet_length(raw).cast("long") + F.lit(8).cast("long")
    tie = F.shiftleft(F.shiftrightunsigned(F.xxhash64(raw), 64 - BITS + DIGIT), DIGIT) + F.shiftrightunsigned(F.xxhash64("doc_id", F.monotonically_increasing_id()), 64 - DIGIT)
    return docs.select(
        "doc_id",
        size.alias("size"),
        F.crc32(raw).alias("text_crc32"),
        tie.alias("tie"),
        F.least((F.log2(size.cast("double")) * (2 ** (BITS - 6))).cast("long"), F.lit(2**BITS - 1).cast("long")).alias("d0"),
        *[_place(c).alias(f"d{1 + i}") for i, c in enumerate(c for c in ("source", "lang") if c in docs.columns)],
    )


def _case(pairs: list[tuple[int, Column]], default: Column) -> Column:
    """CASE over node numbers, of which there are fewer than shards."""
    out = None
    for node, value in pairs:
        out = F.when(F.col("node") == node, value) if out is None else out.when(F.col("node") == node, value)
    return default if out is None else out.otherwise(default)


def kd_shards(docs: DataFrame, shards: int = 24, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    ``target_bytes`` sets the number of shards from the total instead. Repeated rows are placed one by
    one; an empty table gives an empty result. A value that holds a large share of the rows is cut
    like any other: rows with equal split values are told apart by a hash of the id, then of place.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    rows = scratch.table(metadata(docs))  # a row's place is fixed once written
    dims = [c for c in rows.columns if c[0] == "d" and c[1:].isdigit()]
    if target_bytes:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, round(total / target_bytes))
    rows = rows.withColumn("node", F.lit(0))
    nodes = {0: shards}  # first shard of the node -> number of shards
    whole: dict[str, float] = {}
    while any(k > 1 for k in nodes.values()):
        open_nodes = [n for n, k in nodes.items() if k > 1]
        level = rows.where(F.col("node").isin(open_nodes))
        spans = {r["node"]: r for r in level.groupBy("node").agg(F.sum("size").alias("bytes"), *[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).collect()}
        if not spans:
            break
        if not whole:
            whole = {d: max(1, spans[0][f"hi_{d}"] - spans[0][f"lo_{d}"]) for d in dims}
        widest = {n: max(dims, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / whole[d]) for n, r in spans.items()}
        # the split value: the dimension's bits, then those of the tie-breaker
        dim = _case([(n, F.col(widest[n])) for n in spans], F.lit(0).cast("long"))
        goal = {n: spans[n]["bytes"] * (nodes[n] // 2) / nodes[n] for n in spans}
        known: dict[int, list[int]] = {n: [] for n in spans}  # digits of the cut so far
        below = dict.fromkeys(spans, 0)
        digits = [F.shiftright(dim, s).bitwiseAND(2**DIGIT - 1) for s in range(BITS - DIGIT, -1, -DIGIT)] + [F.shiftright(F.col("tie"), s).bitwiseAND(2**DIGIT - 1) for s in range(BITS - DIGIT, -1, -DIGIT)]
        level = level.where(F.col("node").isin(list(spans))).select("node", "size", *[d.cast("int").alias(f"g{i}") for i, d in enumerate(digits)])
        small = SETTLED * sum(r["bytes"] for r in spans.values()) / sum(nodes[n] for n in spans)
        settled: set[int] = set()
        for i in range(len(digits)):
            if len(settled) == len(spans):
                break
            inside = _case([(n, _all([F.col(f"g{j}") == v for j, v in enumerate(known[n])])) for n in spans if n not in settled], F.lit(False)) if i else F.lit(True)
            counts: dict[int, list] = {n: [] for n in spans}
            for r in level.where(inside).groupBy("node", f"g{i}").agg(F.sum("size").alias("bytes")).collect():
                counts[r["node"]].append((r[f"g{i}"], r["bytes"]))
            for n in spans.keys() - settled:
                for digit, size in sorted(counts[n]):
                    # go on into the bucket that holds the goal; a small one, or the last, is cut at its nearer side
                    if below[n] + size > goal[n] or digit == max(counts[n])[0]:
                        last = i == len(digits) - 1 or size <= small
                        known[n].append(digit + (last and goal[n] - below[n] > size / 2))
                        if last:
                            settled.add(n)
                        break
                    below[n] += size
        value = lambda n: _case_lt(digits, known[n] + [0] * (len(digits) - len(known[n])))
        # written, so that the next level's filters see a column and not the tree so far
        rows = scratch.table(rows.withColumn("node", _case([(n, F.when(value(n), F.lit(n)).otherwise(F.lit(n + nodes[n] // 2))) for n in spans], F.col("node"))))
        nodes = {m: k for n, c in nodes.items() for m, k in (((n, c // 2), (n + c // 2, c - c // 2)) if n in spans else ((n, c),))}
    placed = rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"), "tie")
    return _slots(scratch.table(placed)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _case_lt(digits: list[Column], cut: list[int]) -> Column:
    """Lexicographic digits < cut, as one number of two halves."""
    half = len(digits) // 2
    number = lambda parts: sum((F.shiftleft(p.cast("long"), DIGIT * (len(parts) - 1 - i)) for i, p in enumerate(parts)), F.lit(0).cast("long"))
    value = lambda parts: sum(int(p) << (DIGIT * (len(parts) - 1 - i)) for i, p in enumerate(parts))
    high, low = number(digits[:half]), number(digits[half:])
    return (high < value(cut[:half])) | ((high == value(cut[:half])) & (low < value(cut[half:])))


def _slots(placed: DataFrame) -> DataFrame:
    """Gapless numbers from 0 within each shard, by counts of small hash buckets instead of one sort a shard."""
    per = placed.groupBy("shard").agg(F.count("*").alias("n"))
    most = per.agg(F.max("n")).first()[0] or 0
    buckets = max(1, -(-most // SLOT_ROWS))
    placed = placed.withColumn("bucket", F.pmod(F.col("tie"), F.lit(buckets)).cast("int"))
    starts = (
        placed.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("shard", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("tie", "doc_id")))
    return numbered.join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("before") + F.col("at") - 1).cast("long"))
