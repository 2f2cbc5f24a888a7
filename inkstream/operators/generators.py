"""Operators that make rows: tiles, line windows, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tiles(screens: DataFrame, scale: float = 2.0, overlap: int = 20, width: int = 640, height: int = 480) -> DataFrame:
    """image_id, tile_id, x1, y1, x2, y2: a grid of enlarged network inputs, row by row; the last may overrun."""
    sx, sy, cw, ch = int((width - overlap) * scale), int((height - overlap) * scale), int(width * scale), int(height * scale)
    rows = screens.select("image_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(sy))).alias("y1"))
    rows = rows.select("image_id", "y1", "width", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(sx))).alias("x1"))
    per_row = F.floor((F.col("width") - 1) / sx) + 1
    tile = (F.floor(F.col("y1") / sy) * per_row + F.floor(F.col("x1") / sx)).cast("int")
    return rows.select("image_id", tile.alias("tile_id"), "x1", "y1", (F.col("x1") + cw).alias("x2"), (F.col("y1") + ch).alias("y2"))


def line_windows(boxes: DataFrame, window: int = 320, overlap: int = 48, height: int = 48) -> DataFrame:
    """image_id, sub_idx, start_x, end_x at line height: the whole line is 0, windows of wider lines 1, 2, ...

    Lines of ``height`` or more are scaled to it first; the last window is clipped to the line.
    """
    h, w = F.col("height"), F.col("width")
    scaled = F.when(h >= height, F.greatest((w.cast("double") * (F.lit(float(height)) / h)).cast("int"), F.lit(1))).otherwise(w)
    lines = boxes.select("image_id", scaled.alias("w"))
    step = window - overlap
    cut = lines.where(F.col("w") > window).select("image_id", "w", F.posexplode(F.sequence(F.lit(0), F.col("w"), F.lit(step))).alias("i", "start"))
    cut = cut.where((F.col("start") == 0) | (F.col("start") + overlap < F.col("w")))
    return lines.select("image_id", F.lit(0).alias("sub_idx"), F.lit(0).alias("start_x"), F.col("w").alias("end_x")).unionByName(cut.select("image_id", (F.col("i") + 1).alias("sub_idx"), F.col("start").alias("start_x"), F.least(F.col("start") + window, F.col("w")).alias("end_x")))


def anchor_grid(spark: SparkSession, width: int = 640, height: int = 384, strides: tuple[int, ...] = (8, 16, 32)) -> DataFrame:
    """anchor, stride, gx, gy: cells of each stride, row by row, numbered through."""
    out, before = None, 0
    for s in strides:
        cols, n = width // s, (width // s) * (height // s)
        part = spark.range(n).select((F.col("id") + before).alias("anchor"), F.lit(s).alias("stride"), (F.col("id") % cols).cast("int").alias("gx"), F.floor(F.col("id") / cols).cast("int").alias("gy"))
        out, before = part if out is None else out.unionByName(part), before + n
    return out
