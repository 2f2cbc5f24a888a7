"""Pixels of whole pictures (BGR, row by row): resize, crop, NV12, PNG; numpy inside Arrow-batched functions.

Nearest-neighbour resizing is exact; linear and area resizing follow the usual half-pixel definitions and
don't claim to equal any library bit by bit.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def resize(image: np.ndarray, height: int, width: int, how: str = "linear") -> np.ndarray:
    """H x W x C bytes to another size by "nearest", "linear" or "area"."""
    h, w = image.shape[:2]
    if (h, w) == (height, width):
        return image
    if how == "nearest":
        return image[np.minimum((np.arange(height) * (h / height)).astype(int), h - 1)][:, np.minimum((np.arange(width) * (w / width)).astype(int), w - 1)]
    if how == "area" and height <= h and width <= w:
        return np.rint(_shares(h, height) @ np.einsum("hwc,xw->hxc", image.astype(float), _shares(w, width)).reshape(h, -1)).reshape(height, width, -1).clip(0, 255).astype(np.uint8)
    y, x = _places(h, height), _places(w, width)
    a, b, c, d = (image[i][:, j].astype(float) for i in y[:2] for j in x[:2])
    fy, fx = y[2][:, None, None], x[2][None, :, None]
    return np.rint((a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy).clip(0, 255).astype(np.uint8)


def _places(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.clip((np.arange(m) + 0.5) * (n / m) - 0.5, 0, n - 1)
    low = at.astype(int)
    return low, np.minimum(low + 1, n - 1), at - low


def _shares(n: int, m: int) -> np.ndarray:
    """m x n weights: how much of each source pixel lies in each target pixel, summing to 1."""
    edges = np.arange(m + 1) * (n / m)
    i = np.arange(n)
    over = np.minimum(edges[1:, None], i[None] + 1) - np.maximum(edges[:-1, None], i[None])
    return np.maximum(over, 0) / (n / m)


def letterbox(image: np.ndarray, height: int, width: int, how: str = "linear") -> np.ndarray:
    """Fitted into the target with its aspect kept, black around it."""
    h, w = image.shape[:2]
    wide = w / h > width / height
    nh, nw = (int(width / (w / h)), width) if wide else (height, int(height * (w / h)))
    out = np.zeros((height, width, image.shape[2]), np.uint8)
    top, left = (height - nh) // 2, (width - nw) // 2
    if nh > 0 and nw > 0:
        out[top : top + nh, left : left + nw] = resize(image, nh, nw, how)
    return out


def crop(image: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    """The box, black where it lies outside the picture."""
    h, w = image.shape[:2]
    out = np.zeros((max(y2 - y1, 0), max(x2 - x1, 0), image.shape[2]), np.uint8)
    a, b, c, d = max(x1, 0), max(y1, 0), min(x2, w), min(y2, h)
    if c > a and d > b:
        out[b - y1 : d - y1, a - x1 : c - x1] = image[b:d, a:c]
    return out


def bgr_to_nv12(image: np.ndarray) -> bytes:
    """Luma of each pixel, then chroma pairs of each 2x2 block (its first pixel), in video range."""
    b, g, r = (image[..., i].astype(float) for i in range(3))
    y = 16 + 0.257 * r + 0.504 * g + 0.098 * b
    u = 128 - 0.148 * r - 0.291 * g + 0.439 * b
    v = 128 + 0.439 * r - 0.368 * g - 0.071 * b
    pairs = np.stack([u[::2, ::2], v[::2, ::2]], axis=-1)
    return np.rint(y).clip(0, 255).astype(np.uint8).tobytes() + np.rint(pairs).clip(0, 255).astype(np.uint8).tobytes()


def png(image: np.ndarray, level: int = 3) -> bytes:
    """A PNG file of a BGR or gray picture."""
    h, w = image.shape[:2]
    rgb = image[..., ::-1] if image.ndim == 3 and image.shape[2] == 3 else image.reshape(h, w, 1)
    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgb).reshape(h, -1)], axis=1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if rgb.shape[2] == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes(), level)) + part(b"IEND", b"")


def _pictures(data: pd.Series, height: pd.Series, width: pd.Series):
    for d, h, w in zip(data, height, width, strict=True):
        yield None if d is None else np.frombuffer(d, np.uint8).reshape(int(h), int(w), -1)


def letterboxed(data, height, width, to_height: int, to_width: int, how: str = "linear") -> Column:
    """Picture bytes (as the image source gives them) fitted into a network's input."""

    @F.pandas_udf("binary")
    def run(d: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else letterbox(p, to_height, to_width, how).tobytes() for p in _pictures(d, h, w)], dtype=object)

    return run(data, height, width)


def png_of(data, height, width) -> Column:
    """PNG files of pictures; write them with foreachBatch or as binary cells."""

    @F.pandas_udf("binary")
    def run(d: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else png(p) for p in _pictures(d, h, w)], dtype=object)

    return run(data, height, width)


def nv12_of(data, height, width) -> Column:
    @F.pandas_udf("binary")
    def run(d: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else bgr_to_nv12(p) for p in _pictures(d, h, w)], dtype=object)

    return run(data, height, width)
