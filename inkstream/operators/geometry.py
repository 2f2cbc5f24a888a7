"""Row-level geometry: columns in, columns out, all inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(x, low, high) -> Column:
    return F.greatest(c(low), F.least(c(x), c(high)))


def letterbox(width, height, to_width: int, to_height: int) -> tuple[Column, Column, Column, Column]:
    """(new width, new height, left, top): the aspect is kept, sizes are cut to whole pixels, bars are halved."""
    w, h = c(width).cast("double"), c(height).cast("double")
    wide = w / h > F.lit(to_width / to_height)
    new_w = F.when(wide, F.lit(to_width)).otherwise((F.lit(float(to_height)) * (w / h)).cast("int"))
    new_h = F.when(wide, (F.lit(float(to_width)) / (w / h)).cast("int")).otherwise(F.lit(to_height))
    half = lambda whole, part: F.floor((F.lit(whole) - part) / 2).cast("int")
    return new_w.cast("int"), new_h.cast("int"), half(to_width, new_w), half(to_height, new_h)


def letterbox_inverse(x, y, left, top, new_w, new_h, width, height) -> tuple[Column, Column]:
    """A point of the letterbox in the source: bars off, clipped to the picture, scaled back, cut to whole pixels."""
    back = lambda p, bar, new, full: (clamp(c(p) - c(bar), 0, c(new) - 1).cast("double") * (c(full).cast("double") / c(new).cast("double"))).cast("int")
    return back(x, left, new_w, width), back(y, top, new_h, height)


def inverse_clamped(x, y, w, h, left, top, scale, width, height) -> Box:
    """A box of the network's input in the source, its corners clamped to the last pixels: x, y, w, h."""
    x0 = clamp((c(x) - c(left)) / c(scale), 0, c(width) - 1)
    y0 = clamp((c(y) - c(top)) / c(scale), 0, c(height) - 1)
    x1 = clamp((c(x) + c(w) - c(left)) / c(scale), 0, c(width) - 1)
    y1 = clamp((c(y) + c(h) - c(top)) / c(scale), 0, c(height) - 1)
    return x0, y0, x1 - x0, y1 - y0


def expand_by_height(x1, y1, x2, y2, width, height, percent: int = 70) -> Box:
    """All sides go out by half of ``percent`` of the height, in whole numbers, and stop at the picture."""
    p = F.floor(F.floor((c(y2) - c(y1)) * percent / 100) / 2).cast("int")
    return F.greatest(c(x1) - p, F.lit(0)), F.greatest(c(y1) - p, F.lit(0)), F.least(c(x2) + p, c(width)), F.least(c(y2) + p, c(height))


def expand_by_side(x1, y1, x2, y2, share: float = 0.15) -> Box:
    """All sides go out by a share of the shorter side."""
    p = F.least(c(x2) - c(x1), c(y2) - c(y1)) * share
    return c(x1) - p, c(y1) - p, c(x2) + p, c(y2) + p


def expand_by_class(x, y, w, h, share) -> Box:
    """x, y, w, h grown on each side by a class's share of that side's length."""
    return c(x) - c(w) * c(share), c(y) - c(h) * c(share), c(w) * (1 + 2 * c(share)), c(h) * (1 + 2 * c(share))


def snap_for_encoder(x, y, w, h, width, height, least: int = 32) -> tuple[Column, Column, Column, Column, Column]:
    """Crop for an encoder: inside the frame, even, at least ``least`` a side; and whether it fits at all."""
    even = lambda v: F.shiftleft(F.shiftright(v.cast("int"), 1), 1)
    x0, y0 = even(F.greatest(c(x), F.lit(0))), even(F.greatest(c(y), F.lit(0)))
    w0, h0 = F.greatest(even(c(w)), F.lit(least)), F.greatest(even(c(h)), F.lit(least))
    return x0, y0, w0, h0, (x0 + w0 <= c(width)) & (y0 + h0 <= c(height))


def intersection(a: Box, b: Box) -> Box:
    """The common part of two x, y, w, h boxes; no common part is the zero box."""
    x, y = F.greatest(c(a[0]), c(b[0])), F.greatest(c(a[1]), c(b[1]))
    w, h = F.least(c(a[0]) + c(a[2]), c(b[0]) + c(b[2])) - x, F.least(c(a[1]) + c(a[3]), c(b[1]) + c(b[3])) - y
    some = (w > 0) & (h > 0)
    return tuple(F.when(some, v).otherwise(F.lit(0.0)) for v in (x, y, w, h))


def union_box(a: Box, b: Box) -> Box:
    """The smallest x, y, w, h box around both."""
    x, y = F.least(c(a[0]), c(b[0])), F.least(c(a[1]), c(b[1]))
    return x, y, F.greatest(c(a[0]) + c(a[2]), c(b[0]) + c(b[2])) - x, F.greatest(c(a[1]) + c(a[3]), c(b[1]) + c(b[3])) - y


def iou(a: Box, b: Box) -> Column:
    """Intersection over union of x, y, w, h boxes; 0 of two empty ones."""
    _, _, w, h = intersection(a, b)
    common = w * h
    return F.coalesce(F.try_divide(common, c(a[2]) * c(a[3]) + c(b[2]) * c(b[3]) - common), F.lit(0.0))


def iou_inclusive(a: Box, b: Box) -> Column:
    """The tracker's: corners x1, y1, x2, y2 belong to the boxes, so each side is a pixel longer."""
    w = F.least(c(a[2]), c(b[2])) - F.greatest(c(a[0]), c(b[0])) + 1
    h = F.least(c(a[3]), c(b[3])) - F.greatest(c(a[1]), c(b[1])) + 1
    size = lambda q: (c(q[2]) - c(q[0]) + 1) * (c(q[3]) - c(q[1]) + 1)
    return F.when((w > 0) & (h > 0), w * h / (size(a) + size(b) - w * h)).otherwise(F.lit(0.0))


def tlwh_to_tlbr(x, y, w, h) -> Box:
    return c(x), c(y), c(x) + c(w), c(y) + c(h)


def tlbr_to_tlwh(x1, y1, x2, y2) -> Box:
    return c(x1), c(y1), c(x2) - c(x1), c(y2) - c(y1)


def tlwh_to_xyah(x, y, w, h) -> Box:
    """Centre, aspect and height."""
    return c(x) + c(w) / 2, c(y) + c(h) / 2, c(w) / c(h), c(h)


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-c(x)))


def softmax(values) -> Column:
    """Of an array, steadied by its maximum."""
    e = F.transform(c(values), lambda x: F.exp(x.cast("double") - F.array_max(c(values)).cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def argmax(values) -> Column:
    """Place, from 0, of the first largest entry."""
    return (F.array_position(c(values), F.array_max(c(values))) - 1).cast("int")


def expectation(values) -> Column:
    """Expected bin number under the softmax of an array."""
    p = softmax(values)
    return F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)


def anchor_decode(px, py, pw, ph, gx, gy, stride) -> Box:
    """Centre offsets and log sizes at a grid cell to x, y, w, h."""
    w, h = F.exp(c(pw)) * c(stride), F.exp(c(ph)) * c(stride)
    return (c(px) + c(gx)) * c(stride) - w / 2, (c(py) + c(gy)) * c(stride) - h / 2, w, h


def bins_decode(bins, gx, gy, stride, n: int = 8) -> Box:
    """Four runs of n distance bins (left, top, right, bottom) at a cell's centre to x, y, w, h."""
    left, top, right, bottom = (expectation(F.slice(c(bins), 1 + n * i, n)) * c(stride) for i in range(4))
    cx, cy = (c(gx) + 0.5) * c(stride), (c(gy) + 0.5) * c(stride)
    return cx - left, cy - top, left + right, top + bottom


def dequantise(raw, zero_point, scale) -> Column:
    return (c(raw).cast("double") - c(zero_point)) * c(scale)


def raw_threshold(threshold: float, scale: float, zero_point: float) -> float:
    """The smallest raw value whose root of (raw - zero) * scale reaches the threshold: compared as raw, it prunes scans."""
    return threshold * threshold / scale + zero_point


def nhwc_to_nchw(index, height: int, width: int, channels: int) -> Column:
    """Where the entry at a flat NHWC index stands in NCHW."""
    i = c(index)
    pixel = F.floor(i / channels)
    return ((i % channels) * (height * width) + pixel).cast("long")


def crop_fit(x1, y1, x2, y2, width, height, to_width: int, to_height: int) -> dict[str, Column]:
    """Geometry of crop, black padding outside the picture, and letterbox: the part inside and where it lands."""
    w, h = c(x2) - c(x1), c(y2) - c(y1)
    scale = F.least(F.lit(float(to_width)) / w, F.lit(float(to_height)) / h)
    new_w, new_h = (w * scale).cast("int"), (h * scale).cast("int")
    return {
        "in_x1": clamp(x1, 0, width), "in_y1": clamp(y1, 0, height), "in_x2": clamp(x2, 0, width), "in_y2": clamp(y2, 0, height),
        "new_w": new_w, "new_h": new_h, "left": F.floor((F.lit(to_width) - new_w) / 2).cast("int"), "top": F.floor((F.lit(to_height) - new_h) / 2).cast("int"),
    }


def frame_bytes(width, height, form) -> Column:
    """Bytes of a frame: NV12 and NV21 3/2, BGR and RGB 3, BGRA and RGBA 4, gray 1 a pixel."""
    n = c(width).cast("long") * c(height)
    f = F.lower(c(form))
    return F.when(f.isin("nv12", "nv21"), F.floor(n * 3 / 2)).when(f.isin("bgr", "rgb"), n * 3).when(f.isin("bgra", "rgba"), n * 4).otherwise(n).cast("long")


def nearest_source(x, source: int, target: int) -> Column:
    """The source pixel that a target pixel shows under nearest-neighbour resizing."""
    return F.least(F.floor(c(x) * (source / target)).cast("int"), F.lit(source - 1))
