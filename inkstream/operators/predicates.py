"""Filters on detections, frames and readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import c


def valid_crop(x1, y1, x2, y2, width, height) -> Column:
    """Whether something is left of a box after clipping it to the picture."""
    return (F.least(c(x2), c(width)) > F.greatest(c(x1), F.lit(0))) & (F.least(c(y2), c(height)) > F.greatest(c(y1), F.lit(0)))


def wanted(classes: list[str], column: str = "class") -> Column:
    """In the list; an empty list wants everything."""
    return F.col(column).isin(*classes) if classes else F.lit(True)


def inside(x, y, w, h, roi: tuple[float, float, float, float]) -> Column:
    """Wholly in the region x, y, w, h, its edges included."""
    return (c(x) >= roi[0]) & (c(y) >= roi[1]) & (c(x) + c(w) <= roi[0] + roi[2]) & (c(y) + c(h) <= roi[1] + roi[3])


def large_and_sure(detections: DataFrame, config: DataFrame) -> DataFrame:
    """Detections of at least their class's size and confidence; a class without settings passes."""
    d = detections.join(F.broadcast(config.select("class", "min_w", "min_h", "confidence")), "class", "left")
    at_least = lambda v, m: F.coalesce(c(v) >= c(m), F.lit(True))
    return d.where(at_least("w", "min_w") & at_least("h", "min_h") & at_least("score", "confidence")).select(*detections.columns)


def worth_pushing(tracks: DataFrame, config: DataFrame, roi=None) -> DataFrame:
    """Tracks inside the region, of at least their class's size, and of its quality (their score)."""
    t = tracks if roi is None else tracks.where(inside("x", "y", "w", "h", roi))
    t = t.join(F.broadcast(config.select("class", "min_w", "min_h", "quality")), "class")
    return t.where((F.col("w") >= F.col("min_w")) & (F.col("h") >= F.col("min_h")) & (F.col("score") >= F.col("quality"))).select(*tracks.columns)


def black_frames(channels: DataFrame, limit: float = 1.0) -> DataFrame:
    """image_id, black: whether each channel's mean (of image_id, channel, value) is under the limit."""
    means = channels.groupBy("image_id", "channel").agg(F.avg("value").alias("mean"))
    return means.groupBy("image_id").agg(F.bool_and(F.coalesce(F.col("mean") < limit, F.lit(True))).alias("black"))


def correlation(pairs: DataFrame) -> DataFrame:
    """pair_id, correlation of values a and b; frames without variance have none."""
    return pairs.groupBy("pair_id").agg(F.corr("a", "b").alias("correlation"))


def skip_detection(width="width", height="height") -> Column:
    """A picture that already is one line of network size needs no detection."""
    return (c(width) == 320) & (c(height) == 48)
