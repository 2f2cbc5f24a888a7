"""Ranked limits, retention, caches, suppression, search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_unprocessed(files: DataFrame, n: int = 1) -> DataFrame:
    """The newest unprocessed file of the newest folder that has one; names break ties."""
    from ..functions.text import processed

    return files.where(~processed("name")).orderBy(F.col("folder_mtime").desc(), F.col("folder").desc(), F.col("mtime").desc(), "name").limit(n)


def expired(files: DataFrame, most: int) -> DataFrame:
    """Files beyond the newest ``most`` of all; counted per folder first, so that no task ranks more than a folder.

    ``newer`` is the number of files in newer folders: a folder wholly beyond the limit needs no ranking.
    """
    per = files.groupBy("folder").agg(F.count("*").alias("n"))
    per = per.withColumn("newer", F.coalesce(F.sum("n").over(Window.orderBy(F.col("folder").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = files.join(per.where(F.col("newer") + F.col("n") > most).select("folder", "newer"), "folder").withColumn("rank", F.row_number().over(Window.partitionBy("folder").orderBy(F.col("mtime").desc(), "name")) + F.col("newer"))
    return ranked.where(F.col("rank") > most).drop("newer")


def emptied_folders(files: DataFrame, most: int) -> DataFrame:
    """Folders that ``expired`` leaves without a file."""
    gone = expired(files, most).groupBy("folder").agg(F.count("*").alias("gone"))
    return files.groupBy("folder").agg(F.count("*").alias("n")).join(gone, "folder").where("n = gone").select("folder")


def limit_per_class(detections: DataFrame, config: DataFrame, keys: tuple[str, ...] = ("stream_id", "frame_id"), order=("score", "idx")) -> DataFrame:
    """The first max_count of each class in a frame, by score downwards; 0 is no limit, plates have none."""
    w = Window.partitionBy(*keys, "class").orderBy(F.col(order[0]).desc(), *order[1:])
    limit = F.coalesce(F.col("max_count"), F.lit(0))
    return detections.join(F.broadcast(config.select("class", "max_count")), "class", "left").withColumn("rank", F.row_number().over(w)).where((limit == 0) | (F.col("class") == "plate") | (F.col("rank") <= limit)).drop("max_count")


def newest(rows: DataFrame, keys: list[str], depth: int, order: str = "frame_id") -> DataFrame:
    """The newest ``depth`` rows of each key."""
    return rows.withColumn("age", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where(F.col("age") <= depth)


#: Queries and vectors of one block of the search.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 16384


def top_k(queries: DataFrame, vectors: DataFrame, k: int, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, vec_id, score, rank: the k vectors of largest cosine of each query, ties by vec_id.

    Queries and vectors are dealt to blocks by hash; each pair of blocks is one product of matrices, whose k best a query
    go on to the ranking, so a query sends k rows for each block of vectors and nothing is gathered or broadcast. Null
    vectors, those without length and those with a null or not finite entry are like nothing: they have no rows. Repeated
    ids are ranked each.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    usable = lambda df, name: df.select(name, F.transform("embedding", lambda x: x.cast("double")).alias("v"), norm.alias("n")).where((F.col("n") > 0) & (F.col("n") < float("inf")))
    q, v = usable(queries, "query_id"), usable(vectors, "vec_id")
    nq, nv = (max(1, -(-df.count() // size)) for df, size in ((q, query_block), (v, vector_block)))
    block = lambda n, *names: F.pmod(F.xxhash64(*names), F.lit(n)).cast("int")
    # repeated rows of one id are dealt apart by their entries
    q = q.withColumn("q", block(nq, "query_id", "v")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    v = v.withColumn("b", block(nv, "vec_id", "v")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()

    def unit(t: pa.Table) -> np.ndarray:
        cells = t.column("v").combine_chunks()
        return cells.flatten().to_numpy().reshape(len(cells), -1) / t.column("n").to_numpy()[:, None]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([left.column("query_id").slice(0, 0), right.column("vec_id").slice(0, 0), pa.array([], pa.float64())], names)
        s = unit(left) @ unit(right).T
        order = right.column("vec_id").combine_chunks()
        place = np.empty(len(order), np.int64)
        place[pc.array_sort_indices(order).to_numpy()] = np.arange(len(order))
        best = np.stack([np.lexsort((place, -row))[:k] for row in s])
        return pa.table([left.column("query_id").take(pa.array(np.repeat(np.arange(len(s)), best.shape[1]))), right.column("vec_id").take(pa.array(best.ravel())), pa.array(np.take_along_axis(s, best, 1).ravel())], names)

    partial = q.groupBy("q", "b").cogroup(v.groupBy("q", "b")).applyInArrow(run, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
    return partial.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)


def _suppress(group, x, y, w, h, threshold: float, contain: float | None) -> np.ndarray:
    """Which boxes stay, of rows in the order of group and preference: in rounds, the first open box of every group is kept
    and closes those of its group that overlap it too much."""
    kept, open_ = np.zeros(len(group), bool), np.arange(len(group))
    while len(open_):
        g = group[open_]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        k = np.repeat(open_[first], np.diff(np.append(first, len(open_))))
        kept[open_[first]] = True
        rest = np.ones(len(open_), bool)
        rest[first] = False
        i, k = open_[rest], k[rest]
        iw = np.minimum(x[k] + w[k], x[i] + w[i]) - np.maximum(x[k], x[i])
        ih = np.minimum(y[k] + h[k], y[i] + h[i]) - np.maximum(y[k], y[i])
        common = np.where((iw > 0) & (ih > 0), iw * ih, 0.0)
        union = w[k] * h[k] + w[i] * h[i] - common
        over = np.divide(common, union, out=np.zeros_like(common), where=union > 0) > threshold
        if contain is not None:
            over |= (common > contain * w[k] * h[k]) | (common > contain * w[i] * h[i])
        open_ = i[~over]
    return kept


def suppress(detections: DataFrame, threshold: float = 0.45, keys: tuple[str, ...] = ("stream_id", "frame_id"), contain: float | None = None) -> DataFrame:
    """Greedy non-maximum suppression in each frame (with "class" among the keys: in each class).

    Best score first (nulls last), ties by idx; a box goes if its IoU with a kept one exceeds the threshold, or, with
    ``contain``, if their common part exceeds that share of either. Boxes with a null side overlap nothing. One shuffle and
    sort by frame; a task takes many whole frames of an Arrow batch at once, and a frame's boxes are bounded by the network.
    """
    names = ("x", "y", "w", "h")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def settled(table: pa.Table, group: np.ndarray):
            box = [table.column(c).to_numpy().astype(float) for c in names]
            return table.filter(pa.array(_suppress(group, *box, threshold, contain))).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            group = _numbered(table, keys)
            cut = int(np.searchsorted(group, group[-1]))  # the last frame may go on
            if cut:
                yield from settled(table.slice(0, cut), group[:cut])
                held = table.slice(cut).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from settled(table, _numbered(table, keys))

    dealt = detections.repartition(*keys).sortWithinPartitions(*keys, F.col("score").desc_nulls_last(), "idx")
    return dealt.mapInArrow(run, detections.schema)


def _numbered(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Numbers from 0 of the runs of equal keys, nulls equal each other."""
    new = np.zeros(table.num_rows, bool)
    for c in keys:
        near, far = table.column(c).slice(0, table.num_rows - 1), table.column(c).slice(1)
        same = pc.or_(pc.fill_null(pc.equal(near, far), False), pc.and_(pc.is_null(near), pc.is_null(far)))
        new[1:] |= ~same.to_numpy().astype(bool)
    return np.cumsum(new)
