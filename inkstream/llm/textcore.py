"""Vectorised words and hashes over the UTF-8 bytes of many texts at once.

A word's hash is the difference of two prefix sums of byte * B**position modulo 2**64, scaled back to
position 0 by the inverse power, then mixed; a k-gram's hash is a polynomial of its word hashes. Texts
are whole and of any length: the sums run over pieces cut between words.
"""

from __future__ import annotations

import re

import numpy as np

U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 1 << 64)
_G = 0xD6E8FEB86659FD93
_PIECE = 1 << 18
_power, _inverse = np.ones(1, U), np.ones(1, U)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: what a byte adds to a word's hash, as it is and lower-cased
_CODE, _FOLDED_CODE = np.arange(1, 257, dtype=U), LOWER.astype(U) + U(1)
#: words of [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
SPACED_RE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_RE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = {c: c + 32 for c in range(65, 91)}


def fold(text: str) -> str:
    """A-Z to a-z; other letters stay."""
    return text.translate(_FOLD)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _tables(n: int) -> None:
    global _power, _inverse
    if len(_power) <= n:
        n = max(n + 1, _PIECE + 1)
        _power, _inverse = np.full(n, _B, U), np.full(n, _B_INVERSE, U)
        _power[0] = _inverse[0] = 1
        _power, _inverse = np.cumprod(_power, dtype=U), np.cumprod(_inverse, dtype=U)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of the byte spans, which are in order and don't overlap."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(int(np.searchsorted(end, start[i] + _PIECE, side="right")), i + 1)
        base, stop = int(start[i]), int(end[j - 1])
        _tables(stop - base)
        sums = np.zeros(stop - base + 1, U)
        piece = np.take(_FOLDED_CODE if lower else _CODE, raw[base:stop])
        piece *= _power[: stop - base]
        np.cumsum(piece, out=sums[1:])
        out[i:j] = (sums[end[i:j] - base] - sums[start[i:j] - base]) * _inverse[start[i:j] - base]
        i = j
    return mix(out + U(_G) * (end - start).astype(U))


class Words:
    """Words of the texts in ``raw``: bounds, hashes, and ``first[d] .. first[d + 1]`` the words of text d."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool, hashes: bool = True):
        inside = kind[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        if len(raw):
            before = np.empty(len(raw), bool)
            before[0] = False
            before[1:] = inside[:-1]
            after = np.empty(len(raw), bool)
            after[-1] = False
            after[:-1] = inside[1:]
            self.start = np.flatnonzero(inside & (~before | edge[:-1]))
            self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.raw, self.offsets = raw, offsets
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.hash = span_hashes(raw, self.start, self.end, lower) if hashes else None

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes; text bounds are the caller's concern."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, size, run, length = np.zeros(len(hashes), U), 0, hashes, 1
    while True:  # runs of 1, 2, 4, ... words; those of k's bits are put together
        if k & length:
            m = len(hashes) - (size + length) + 1
            out = out[:m] * U(pow(_G, length, 1 << 64)) + run[size : size + m]
            size += length
        if size == k:
            return mix(out)
        run = run[: len(run) - length] * U(pow(_G, length, 1 << 64)) + run[length:]
        length *= 2


def gram(hashes: np.ndarray) -> int:
    """The hash of one whole run, as ``grams`` gives it for its length."""
    return int(grams(np.asarray(hashes, U), len(hashes))[0])


def text_words(text: str, lower: bool = True, kind: np.ndarray = ALNUM) -> Words:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return Words(raw, np.array([0, len(raw)]), kind, lower)


def winnow(hashes: np.ndarray, window: int, robust: bool = False) -> np.ndarray:
    """Positions of the smallest hash in each window, the rightmost of equals; of fewer hashes, of all.

    ``robust`` keeps a hash once while windows hold it, so that a text of one repeated word isn't all
    fingerprints; equal texts then still share the hash, but not always its place.
    """
    n = len(hashes)
    return winnow_all(hashes, np.array([0]), np.array([n]), window, robust) if n else np.zeros(0, np.int64)


def winnow_all(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, window: int, robust: bool = False) -> np.ndarray:
    """``winnow`` of many texts at once: their hashes are those from start to end, in order and apart."""
    n = len(hashes)
    chosen = np.zeros(n, bool)
    if n >= window:
        m = n - window + 1
        best, at = hashes[window - 1 :].copy(), np.full(m, window - 1)
        for j in range(window - 2, -1, -1):
            np.copyto(at, j, where=hashes[j : j + m] < best)
            np.minimum(best, hashes[j : j + m], out=best)
        inside = np.zeros(n + 1, np.int64)  # window starts within a text
        long = end - start >= window
        np.add.at(inside, start[long], 1)
        np.add.at(inside, end[long] - window + 1, -1)
        inside = np.cumsum(inside)[:m] > 0
        chosen[(np.arange(m) + at)[inside]] = True
    for a, b in zip(start.tolist(), end.tolist(), strict=True) if (end - start < window).any() else ():
        if 0 < b - a < window:
            chosen[b - 1 - int(np.argmin(hashes[a:b][::-1]))] = True
    out = np.flatnonzero(chosen)
    if robust and len(out) > 1:
        text = np.searchsorted(start, out, side="right")
        same = (hashes[out[1:]] == hashes[out[:-1]]) & (text[1:] == text[:-1])
        if same.any():
            drop, kept = np.zeros(len(out), bool), -1
            for i in (np.flatnonzero(same) + 1).tolist():  # in runs of equal hashes, those near the last kept go
                if not same[i - 2] if i > 1 else True:
                    kept = int(out[i - 1])
                if out[i] - kept < window:
                    drop[i] = True
                else:
                    kept = int(out[i])
            out = out[~drop]
    return out
