"""Merkle manifest of a dataset: digests of rows, trees of fan-out FAN by group, and every row's proof.

Bottom-up build: rows are ranked by one range shuffle, then each level groups runs of FAN neighbours into
their parents and is a written table. Top-down push: the levels are joined again from the root, children to
parents, and each child puts its siblings in front of the proof suffix that its parent inherited. A row of a
level is one run of at most FAN nodes, so no group of any size meets in one task, and the long proofs are
shuffled once for each run of leaves and not for each leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

FAN = 8
#: Rows of one range of the ranking.
RANGE_ROWS = 500_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(*fields: str | Column) -> Column:
    """SHA-256 (hex) of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value as text."""
    parts = []
    for f in fields:
        value = (F.col(f) if isinstance(f, str) else f).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def lowered(name: str = "text") -> Column:
    """The text with A-Z lower-cased; null stays."""
    return F.translate(F.col(name).cast("string"), _UPPER, _LOWER)


def ranked(df: DataFrame, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """``df`` with ``name``, its rows' places from 0 in ascending order (nulls first); rows that repeat get any of theirs.

    One range shuffle; the driver sees a count for each range.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    # the salt deals rows that are equal in all else over many ranges
    by = [F.col(c).asc_nulls_first() for c in order] + [F.col("_salt").asc()]
    dealt = df.withColumn("_salt", F.rand(7)).repartitionByRange(n, *by).sortWithinPartitions(*by)
    rows = scratch.table(dealt.drop("_salt").withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    total, starts = 0, []
    for r in rows.groupBy(part.cast("int").alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect():
        starts.append((r["_part"], total))
        total += r["n"]
    if not starts:
        return rows.select(*df.columns, place.alias(name))
    base = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))
    return rows.withColumn("_part", part.cast("int")).join(base, "_part").select(*df.columns, (F.col("_start") + place).alias(name))


def _fold(nodes: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The levels (tree, n, run, kids, h) of trees whose leaves are ``nodes`` (tree, n, pos, h, item), and their tops (tree, depth, h)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], []
    while True:
        tops.append(nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("depth"), "h"))
        if most <= 1:
            return levels, scratch.table(reduce(DataFrame.unionByName, tops))
        cells = F.struct("pos", "h", *[c for c in nodes.columns if c == "item"])
        runs = nodes.where("n > 1").groupBy("tree", "n", F.expr(f"pos div {FAN}").alias("run")).agg(F.array_sort(F.collect_list(cells)).alias("kids"))
        levels.append(scratch.table(runs.withColumn("h", F.sha2(F.array_join("kids.h", ""), 256))))
        nodes = levels[-1].select("tree", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("run").alias("pos"), "h")
        most = -(-most // FAN)


def _push(levels: list[DataFrame], tops: DataFrame, carried: list[str], scratch: Scratch) -> DataFrame:
    """item, h, steps and the carried columns of the leaves in ``levels``; ``tops`` (tree, depth, steps, carried) begin the suffixes.

    A step is what stands left and right of a node in its run, as joined digests.
    """
    below = None
    for k in range(len(levels) - 1, -1, -1):
        above = tops.where(F.col("depth") == k + 1).select("tree", F.lit(0).cast("long").alias("run"), "steps", *carried)
        if below is not None:
            above = above.unionByName(below)
        runs = levels[k].drop("h", "n").join(above, ["tree", "run"])
        own = F.struct(F.array_join(F.slice("digests", F.lit(1), F.col("i")), "").alias("left"), F.array_join(F.slice("digests", F.col("i") + 2, F.lit(FAN)), "").alias("right"))
        each = runs.withColumn("digests", F.col("kids.h")).select("*", F.posexplode("kids").alias("i", "kid")).withColumn("steps", F.concat(F.array(own), "steps"))
        if k:
            below = scratch.table(each.select("tree", F.col("kid.pos").alias("run"), "steps", *carried))
        else:
            return each.select("kid.item", "kid.h", "steps", *carried)
    return None


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", extra: dict[str, Column] | None = None) -> DataFrame:
    """``order``, ``group``, the ``extra`` columns (computed from the row), leaf, steps, subroot and root of every row.

    Leaves of a group ascend by ``order``; subroots ascend by group, bytewise. Nulls of either come first and a null
    group is one of its own, apart from ""; rows of equal ``order`` ascend by their digests, and rows that repeat are
    leaves each. An empty table has no rows and no root. Only the named columns are read.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    name = F.col(group).cast("string")
    tree = F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name))
    extra = extra or {}
    rows = docs.select(tree.alias("tree"), leaf(*fields).alias("h"), F.col(order).alias("key"), F.struct(F.col(order).alias("order"), F.col(group).alias("group"), *[c.alias(k) for k, c in extra.items()]).alias("item"))
    rows = scratch.table(ranked(scratch.table(rows), ["tree", "key", "h"], "at", scratch).drop("key"))
    trees = scratch.table(rows.groupBy("tree").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    leaves = scratch.table(rows.join(trees, "tree").select("tree", "n", (F.col("at") - F.col("first")).alias("pos"), "h", "item"))
    levels, tops = _fold(leaves, scratch)
    # the subroots are the leaves of one more tree
    n = tops.count()
    heads = ranked(tops.withColumnRenamed("tree", "name"), ["name"], "pos", scratch)
    heads = heads.select(F.lit("").alias("tree"), F.lit(n).cast("long").alias("n"), "pos", "h", F.struct("name", "depth").alias("item"))
    upper, top = _fold(heads, scratch)
    none = F.array().cast("array<struct<left: string, right: string>>")
    top = top.select("tree", "depth", none.alias("steps"), F.col("h").alias("root"))
    if upper:
        begun = _push(upper, top, ["root"], scratch)
    else:  # one group, whose subroot is the root
        begun = heads.join(top.drop("depth"), "tree").select("item", "h", "steps", "root")
    begun = scratch.table(begun.select(F.col("item.name").alias("tree"), "item.depth", "steps", F.col("h").alias("subroot"), "root"))
    lone = leaves.where("n = 1").join(begun, "tree").select("item", "h", "steps", "subroot", "root")
    out = _push(levels, begun, ["subroot", "root"], scratch) if levels else None
    out = lone if out is None else out.unionByName(lone)
    names = [F.col("item.order").alias(order), F.col("item.group").alias(group), *[F.col(f"item.{k}").alias(k) for k in extra]]
    return out.select(*names, F.col("h").alias("leaf"), "steps", "subroot", "root")


def folded(start: Column, steps: str = "steps") -> Column:
    """The root that a leaf's digest and a proof's steps lead to."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(steps: str = "steps") -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def checked(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` with rows tampered with where 3 divides crc32(doc_id): proofs recomputed and verified.

    doc_id, leaf, subroot, root, proof_sha256 of the untampered rows, folded_root, verified. A null doc_id is not tampered with.
    """
    changed = leaf(*FIELDS[:-1], lowered())
    rows = manifest(docs, extra={"tampered": F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changed)})
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
