"""Set operations and joins on tracks and detections, and optimal assignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geometry import iou_inclusive


def union_tracks(left: DataFrame, right: DataFrame, key: str = "track_id") -> DataFrame:
    """Union by key; where both have one, the left's row stays."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    return both.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("side"))).where("n = 1").drop("side", "n")


def except_tracks(left: DataFrame, right: DataFrame, key: str = "track_id") -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def distances(tracks: DataFrame, detections: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """1 - IoU of every pair of a, b boxes within equal keys; a frame bounds the pairs."""
    a = tracks.select(*keys, F.col("idx").alias("a_idx"), *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    b = detections.select(*keys, F.col("idx").alias("b_idx"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    box = lambda p: tuple(f"{p}_{c}" for c in ("x1", "y1", "x2", "y2"))
    return a.join(b, list(keys)).select(*keys, "a_idx", "b_idx", (1 - iou_inclusive(box("a"), box("b"))).alias("distance"))


def duplicate_tracks(tracked: DataFrame, lost: DataFrame, keys: tuple[str, ...], limit: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Both sets without the shorter-lived of each near pair; of equal lives the tracked one goes. They have idx and age."""
    near = distances(tracked, lost, keys).where(F.col("distance") < limit)
    near = near.join(tracked.select(*keys, F.col("idx").alias("a_idx"), F.col("age").alias("a_age")), [*keys, "a_idx"]).join(lost.select(*keys, F.col("idx").alias("b_idx"), F.col("age").alias("b_age")), [*keys, "b_idx"])
    drop_lost = near.where("a_age > b_age").select(*keys, F.col("b_idx").alias("idx"))
    drop_tracked = near.where("a_age <= b_age").select(*keys, F.col("a_idx").alias("idx"))
    return tracked.join(drop_tracked, [*keys, "idx"], "left_anti"), lost.join(drop_lost, [*keys, "idx"], "left_anti")


def matched_split(pairs: DataFrame, tracks: DataFrame, detections: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """kind: matched, track or detection left over; ``pairs`` has a_idx and b_idx."""
    a = tracks.select(*keys, F.col("idx").alias("a_idx")).join(pairs.select(*keys, "a_idx"), [*keys, "a_idx"], "left_anti").select(*keys, "a_idx", F.lit(None).cast("int").alias("b_idx"), F.lit("track").alias("kind"))
    b = detections.select(*keys, F.col("idx").alias("b_idx")).join(pairs.select(*keys, "b_idx"), [*keys, "b_idx"], "left_anti").select(*keys, F.lit(None).cast("int").alias("a_idx"), "b_idx", F.lit("detection").alias("kind"))
    return pairs.select(*keys, "a_idx", "b_idx", F.lit("matched").alias("kind")).unionByName(a).unionByName(b)


def capable(requirements: DataFrame, models: DataFrame) -> DataFrame:
    """Pipelines all of whose required models exist (relational division)."""
    have = requirements.join(models.select("model").distinct().withColumn("found", F.lit(1)), "model", "left")
    return have.groupBy("pipeline").agg(F.count("*").alias("required"), F.count("found").alias("found")).where("required = found").select("pipeline", "required")


def solve_assignment(cost: np.ndarray) -> np.ndarray:
    """Columns of a minimum-cost perfect matching of a square matrix: shortest augmenting paths with potentials."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, np.int64)  # row (from 1) of each column; column 0 starts a path
    for i in range(1, n + 1):
        owner[0], column = i, 0
        least, via, done = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64), np.zeros(n + 1, bool)
        while True:
            done[column] = True
            row = owner[column]
            reduced = cost[row - 1] - u[row] - v[1:]
            free = ~done[1:]
            better = free & (reduced < least[1:])
            least[1:][better], via[1:][better] = reduced[better], column
            nxt = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            delta = least[nxt]
            u[owner[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            column = nxt
            if owner[column] == 0:
                break
        while column:
            owner[column] = owner[via[column]]
            column = via[column]
    out = np.empty(n, np.int64)
    out[owner[1:] - 1] = np.arange(n)
    return out


def assign(cost: np.ndarray, limit: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Cheapest one-to-one pairs under ``limit``, and what is left of rows and columns.

    Leaving a row or a column unmatched costs half the limit, so a pair is made only where that pays: rows
    and columns without a pair under the limit stay out, and a pair that is the only one of both is made.
    """
    rows, cols = cost.shape
    pairs: list[tuple[int, int]] = []
    near = cost < limit
    if near.any():
        per_row, per_col = near.sum(1), near.sum(0)
        a, b = np.nonzero(near)
        alone = (per_row[a] == 1) & (per_col[b] == 1)
        pairs = list(zip(a[alone].tolist(), b[alone].tolist(), strict=True))
        a, b = np.unique(a[~alone]), np.unique(b[~alone])
        if len(a):
            full = np.full((len(a) + len(b), len(a) + len(b)), limit / 2)
            part = cost[np.ix_(a, b)]
            full[: len(a), : len(b)] = np.where(part < limit, part, 2 * limit)
            full[len(a) :, len(b) :] = 0
            to = solve_assignment(full)
            pairs += [(int(a[i]), int(b[to[i]])) for i in range(len(a)) if to[i] < len(b) and part[i, to[i]] < limit]
    pairs.sort()
    done, taken = {i for i, _ in pairs}, {j for _, j in pairs}
    return pairs, [i for i in range(rows) if i not in done], [j for j in range(cols) if j not in taken]
