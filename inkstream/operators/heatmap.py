"""Heatmaps in long form (image_id, tile_id, y, x, val): binarise, merge, label, measure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT = 0.1


def hot(value="val", threshold: float = HOT) -> Column:
    """Strictly above the threshold, both as floats of four bytes."""
    return F.col(value) > F.lit(threshold).cast("float")


def binarise(pixels: DataFrame, threshold: float = HOT) -> DataFrame:
    """bit: 255 above the threshold, else 0."""
    return pixels.withColumn("bit", F.when(hot("val", threshold), 255).otherwise(0))


def binarise_normalised(pixels: DataFrame, threshold: float = 0.15) -> DataFrame:
    """As ``binarise``, on values scaled to their image's range; a range under 1e-4 counts as 1."""
    w = Window.partitionBy("image_id")
    low, high = F.min("val").over(w).cast("double"), F.max("val").over(w).cast("double")
    span = F.when(high - low < 1e-4, F.lit(1.0)).otherwise(high - low)
    return pixels.withColumn("bit", F.when((F.col("val").cast("double") - low) / span > threshold, 255).otherwise(0))


def rethreshold(merged: DataFrame, column: str, least: int = 128) -> DataFrame:
    return merged.withColumn("bit", F.when(F.col(column) > least, 255).otherwise(0))


def merge_or(pixels: DataFrame, threshold: float = HOT) -> DataFrame:
    """image_id, y, x of every pixel that is hot in a tile; cold ones go before the shuffle."""
    return pixels.where(hot("val", threshold)).groupBy("image_id", "y", "x").agg(F.lit(255).alias("bit"))


def merge_max(pixels: DataFrame) -> DataFrame:
    """Largest 0..255 level of the tiles, as 0 or 1."""
    level = F.floor(F.least(F.col("val").cast("double"), F.lit(1.0)) * 255).cast("int")
    return pixels.groupBy("image_id", "y", "x").agg(F.max(level).alias("level")).withColumn("bit", F.when(F.col("level") > 128, 1.0).otherwise(0.0))


def merge_mean(pixels: DataFrame) -> DataFrame:
    """Mean over the tiles that cover a pixel; uncovered pixels have no row."""
    return pixels.groupBy("image_id", "y", "x").agg(F.avg(F.col("val").cast("double")).alias("mean"), F.count("*").alias("tiles"))


def statistics(pixels: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and count of each image and of each of its rows (y null: the image) in one pass."""
    return pixels.groupingSets([["image_id"], ["image_id", "y"]], "image_id", "y").agg(F.min("val").cast("double").alias("low"), F.max("val").cast("double").alias("high"), F.avg(F.col("val").cast("double")).alias("mean"), F.count("*").alias("n"))


def first_hot(pixels: DataFrame, threshold: float = 0.5, n: int = 100) -> DataFrame:
    """The first n hot points of each image, row by row."""
    order = Window.partitionBy("image_id").orderBy("y", "x", "tile_id")
    return pixels.where(F.col("val") > F.lit(threshold).cast("float")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def dilate(mask: DataFrame, height: int, width: int) -> DataFrame:
    """3x3 dilation of hot pixels (image_id, y, x), kept inside the picture."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("s")
    moved = mask.select("image_id", "y", "x", step).select("image_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    return moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).distinct()


def erode(mask: DataFrame, height: int, width: int) -> DataFrame:
    """3x3 erosion; what lies outside the picture doesn't wear a pixel away."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("s")
    moved = mask.select("image_id", "y", "x", step).select("image_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    span = lambda v, n: F.least(v + 1, F.lit(n - 1)) - F.greatest(v - 1, F.lit(0)) + 1
    counted = moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).groupBy("image_id", "y", "x").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") == span(F.col("y"), height) * span(F.col("x"), width)).select("image_id", "y", "x")


def _label(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """8-connected components of pixels: runs of each row, joined to the row before; the label is the first pixel's place."""
    order = np.lexsort((x, y))
    ys, xs = y[order], x[order]
    new = np.r_[True, (ys[1:] != ys[:-1]) | (xs[1:] != xs[:-1] + 1)]
    run = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    ry, ra, rz = ys[starts], xs[starts], xs[np.r_[starts[1:], len(xs)] - 1]
    parent = list(range(len(starts)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    j = 0
    for i in range(len(starts)):
        while j < i and (ry[j] < ry[i] - 1):
            j += 1
        k = j
        while k < i and ry[k] == ry[i] - 1:
            if ra[k] <= rz[i] + 1 and ra[i] <= rz[k] + 1:
                a, b = find(k), find(i)
                parent[max(a, b)] = min(a, b)
            if rz[k] > rz[i] + 1:
                break
            k += 1
    out = np.empty(len(y), np.int64)
    out[order] = np.array([find(i) for i in range(len(starts))])[run]
    return out


def _labelled(mask: DataFrame, *keys: str) -> DataFrame:
    """image_id, y, x, label of the regions within each group of the keys: the place of a region's first pixel there."""

    def run(t: pa.Table) -> pa.Table:
        y, x = t.column("y").to_numpy().astype(np.int64), t.column("x").to_numpy().astype(np.int64)
        group = _label(y, x)
        place = y * (1 << 20) + x
        first = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, group, place)
        return t.select(["image_id", "y", "x"]).append_column("label", pa.array(first[group]))

    kind = mask.schema["image_id"].dataType.simpleString()
    return mask.groupBy(*keys).applyInArrow(run, f"image_id {kind}, y int, x int, label long")


def components(mask: DataFrame) -> DataFrame:
    """image_id, y, x, label: connected regions of distinct hot pixels; an image is one task's (``tiled_components`` has no such bound).

    The label is the number of the region's first pixel, row by row, as y * 2**20 + x.
    """
    return _labelled(mask.select("image_id", "y", "x"), "image_id")


def roots(edges: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """keys, node, root: the smallest node that edges (keys, a, b) connect each node with.

    Alternating stars, each round a checkpoint: larger neighbours are linked to a node's smallest, then smaller ones to
    theirs, until nothing changes; the rounds grow with the logarithm of the longest chain.
    """
    from ..session import checkpointed

    both = edges.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = checkpointed(both)  # from larger to smaller
    while True:
        around = links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(least, [*keys, "a"]).where("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = large.join(least, [*keys, "a"])
        small = small.where("b <> m").select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select(*keys, "a", F.col("m").alias("b")))
        after = checkpointed(small.where("a <> b").distinct())
        if after.exceptAll(links).isEmpty() and links.exceptAll(after).isEmpty():
            break
        links = after
    nodes = links.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(links.select(*keys, F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def tiled_components(mask: DataFrame, tile: int = 1024) -> DataFrame:
    """``components`` of pictures of any size: no task holds more than a tile of ``tile`` pixels a side.

    Regions are labelled within tiles; pixels that touch across a border make their labels equal, and only such labels
    meet in the rounds of ``roots``. A label is at most what it was, so the first pixel's place is the smallest.
    """
    from ..session import checkpointed

    cell = lambda v: F.floor(F.col(v) / tile)
    m = mask.select("image_id", "y", "x").withColumns({"_ty": cell("y"), "_tx": cell("x")})
    inside = checkpointed(_labelled(m, "image_id", "_ty", "_tx"))
    border = inside.where((F.pmod("y", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("x", F.lit(tile)).isin(0, tile - 1)))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("s")
    moved = border.select("image_id", F.col("label").alias("a"), "y", "x", steps).withColumns({"y2": F.col("y") + F.col("s.dy"), "x2": F.col("x") + F.col("s.dx")})
    moved = moved.where((F.floor(F.col("y2") / tile) != cell("y")) | (F.floor(F.col("x2") / tile) != cell("x"))).select("image_id", "a", F.col("y2").alias("y"), F.col("x2").alias("x"))
    edges = moved.join(border, ["image_id", "y", "x"]).select("image_id", "a", F.col("label").alias("b"))
    joined = inside.join(roots(edges).withColumnRenamed("node", "label"), ["image_id", "label"], "left")
    return joined.select("image_id", "y", "x", F.coalesce("root", "label").alias("label"))


def component_boxes(labelled: DataFrame, least_pixels: int = 0, least_area: int = 0) -> DataFrame:
    """Half-open boxes, pixel counts; small regions by pixels and by box area are dropped."""
    boxes = labelled.groupBy("image_id", "label").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.count("*").alias("pixels"))
    return boxes.where((F.col("pixels") >= least_pixels) & ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= least_area))


def summed_area(values: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """image_id, y, x and the sums of the named columns over all pixels at or before (y, x) both ways.

    Prefix sums along rows, then along columns, over each image's whole grid: pixels without a row count as 0. Two
    shuffles by row and by column, so no task holds more than a line of a picture.
    """
    grid = values.groupBy("image_id").agg(F.min("y").alias("y1"), F.max("y").alias("y2"), F.min("x").alias("x1"), F.max("x").alias("x2"))
    grid = grid.select("image_id", F.explode(F.sequence("y1", "y2")).alias("y"), "x1", "x2").select("image_id", "y", F.explode(F.sequence("x1", "x2")).alias("x"))
    full = grid.join(values, ["image_id", "y", "x"], "left").fillna(0, list(names))
    for line, along in (("y", "x"), ("x", "y")):
        w = Window.partitionBy("image_id", line).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        full = full.withColumns({n: F.sum(n).over(w) for n in names})
    return full.select("image_id", "y", "x", *names)


def box_confidence(boxes: DataFrame, pixels: DataFrame, threshold: float = HOT) -> DataFrame:
    """Mean value of the hot pixels inside each box that has any: four lookups a box in a summed-area table, so the work is
    that of reading the pixels and the boxes, whatever the boxes' sizes. Boxes may reach beyond the pixels."""
    p = pixels.where(hot("val", threshold)).groupBy("image_id", "y", "x").agg(F.max("val").cast("double").alias("v"), F.lit(1.0).alias("n"))
    table = summed_area(p, ("v", "n"))
    edges = table.groupBy("image_id").agg(F.min("y").alias("_y1"), F.max("y").alias("_y2"), F.min("x").alias("_x1"), F.max("x").alias("_x2"))
    corner = lambda y, x, sign: F.struct(y.cast("int").alias("y"), x.cast("int").alias("x"), F.lit(sign).alias("sign"))
    x1, y1, x2, y2 = F.col("x1") - 1, F.col("y1") - 1, F.least(F.col("x2") - 1, F.col("_x2")), F.least(F.col("y2") - 1, F.col("_y2"))
    # a corner before the first pixel adds nothing and meets no row
    corners = boxes.select("image_id", "label", "x1", "y1", "x2", "y2").join(edges, "image_id").where((x1 < x2) & (y1 < y2))
    corners = corners.select("image_id", "label", F.explode(F.array(corner(y2, x2, 1), corner(F.least(y1, F.col("_y2")), x2, -1), corner(y2, F.least(x1, F.col("_x2")), -1), corner(y1, x1, 1))).alias("c")).select("image_id", "label", "c.*")
    summed = corners.join(table, ["image_id", "y", "x"]).groupBy("image_id", "label").agg(F.sum(F.col("v") * F.col("sign")).alias("v"), F.sum(F.col("n") * F.col("sign")).alias("n"))
    return summed.where("n > 0.5").select("image_id", "label", (F.col("v") / F.col("n")).alias("confidence"))


def resize_nearest(pixels: DataFrame, source: int, target: int) -> DataFrame:
    """Square images resized by nearest neighbour: each target pixel takes its source pixel's value by an equi join."""
    from .geometry import nearest_source

    grid = pixels.sparkSession.range(target * target).select((F.col("id") / target).cast("int").alias("ty"), (F.col("id") % target).cast("int").alias("tx"))
    grid = grid.withColumn("y", nearest_source("ty", source, target)).withColumn("x", nearest_source("tx", source, target))
    return pixels.join(F.broadcast(grid), ["y", "x"]).select("image_id", "tile_id", F.col("ty").alias("y"), F.col("tx").alias("x"), "val")
