"""String, path, time and JSON functions, as columns; and the folds that merge overlapping texts."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.geometry import c

#: Endings of images, and of what the image listing takes.
IMAGE_ENDINGS, LISTED_ENDINGS = ("jpg", "jpeg", "png", "bmp", "tiff", "tif"), (".jpg", ".png", ".JPG", ".PNG")
STAMP = r"(\d{4})-(\d{2})-(\d{2})T(\d{2})-(\d{2})-(\d{2})"


def trim(s) -> Column:
    """Blanks, tabs and line ends off both ends."""
    return F.btrim(c(s), F.lit(" \t\r\n"))


def base_name(path) -> Column:
    return F.regexp_extract(c(path), r"([^/]*)$", 1)


def directory(path) -> Column:
    """Up to the last slash; without one, the dot."""
    return F.when(F.instr(c(path), "/") > 0, F.regexp_extract(c(path), r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def stem(path) -> Column:
    """The name without its last ending."""
    return F.regexp_extract(base_name(path), r"^(.*?)(\.[^.]*)?$", 1)


def ending(path) -> Column:
    """From the last dot of the name; nothing without one."""
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


def processed(name) -> Column:
    """Whether the stem is marked as done: more than the mark, and ending in it."""
    return stem(name).rlike(".+_ocr$")


def done_name(name) -> Column:
    """The name that marks a file as done."""
    return F.concat(stem(name), F.lit("_ocr"), ending(name))


def is_image(name) -> Column:
    return F.lower(F.ltrim(F.regexp_replace(ending(name), r"^\.", ""))).isin(*IMAGE_ENDINGS)


def captured_at(name) -> Column:
    """RFC 3339 time in a file name, at +08:00; null without one."""
    return F.when(c(name).rlike(STAMP), F.regexp_replace(F.regexp_extract(c(name), STAMP, 0), r"^(\d{4}-\d{2}-\d{2}T\d{2})-(\d{2})-(\d{2})$", "$1:$2:$3+08:00"))


def rfc3339(ts) -> Column:
    return F.date_format(c(ts), "yyyy-MM-dd'T'HH:mm:ssXXX")


def file_stamp(ts) -> Column:
    """A time that can stand in a file name: no colons, and the offset with a dash."""
    return F.translate(F.date_format(c(ts), "yyyy-MM-dd'T'HH:mm:ssxxx"), ":", "-")


def date_folder(ts) -> Column:
    return F.date_format(c(ts), "yyyy-MM-dd")


def escape_json(s) -> Column:
    """The inside of a JSON string."""
    quoted = F.to_json(F.struct(c(s).alias("s")))
    return F.substring(quoted, F.lit(7), F.length(quoted) - 8)


def log_level(s) -> Column:
    """none, error, info by name or number; anything else is info."""
    t = F.lower(trim(s))
    return F.when(t.isin("none", "0"), 0).when(t.isin("error", "1"), 1).otherwise(2)


def model_version(name) -> Column:
    """Between V and the ending of a model file; else unknown."""
    v = F.regexp_extract(c(name), r"V(.*)\.axmodel", 1)
    return F.when(v == "", "unknown").otherwise(v)


def hex_bytes(s) -> Column:
    return F.hex(F.encode(c(s), "utf-8"))


def visible_bytes(s) -> Column:
    """Printable bytes as they are, others as [0xNN]."""
    pairs = F.regexp_extract_all(hex_bytes(s), F.lit("(..)"), F.lit(1))
    return F.array_join(F.transform(pairs, lambda p: F.when(p.between("20", "7E"), F.char(F.conv(p, 16, 10).cast("int"))).otherwise(F.concat(F.lit("[0x"), p, F.lit("]")))), "")


def upload_accepted(body) -> Column:
    """Whether a store's answer says that it took the document."""
    return c(body).contains('"ok":true') | c(body).contains('"ok": true') | c(body).contains('"stored"')


def snapshot_header(line) -> Column:
    """ok, size, width and height of a snapshot's header line."""
    return F.from_json(c(line), "ok boolean, size long, width int, height int")


def segment_name(box, segment, several) -> Column:
    """text_003.png, or text_003_2.png where the box has several segments."""
    return F.when(c(several), F.format_string("text_%03d_%d.png", c(box), c(segment))).otherwise(F.format_string("text_%03d.png", c(box)))


def merge_pair(a: str | bytes, b: str | bytes, reach: int = 4):
    """a + b with their overlap once, by one place that a's last and b's first ``reach`` places share, case aside.

    Places of a are tried from its end, then places of b from its start; a ends with the shared place and b
    goes on after its own.
    """
    if not a or not b:
        return a or b
    for i in range(min(reach, len(a))):
        x = a[len(a) - 1 - i : len(a) - i]
        for j in range(min(reach, len(b))):
            y = b[j : j + 1]
            if x == y or (x.isascii() and y.isascii() and x.lower() == y.lower()):
                return a[: len(a) - i] + b[j + 1 :]
    return a + b


def merge_all(texts: list[str | None], mode: str = "chars", reach: int = 4) -> str:
    """Left fold of ``merge_pair`` over texts in order; ``bytes`` compares UTF-8 bytes, as some writers do."""
    out = b"" if mode == "bytes" else ""
    for t in texts:
        if t:
            out = merge_pair(out, t.encode() if mode == "bytes" else t, reach)
    return out.decode("utf-8", "replace") if mode == "bytes" else out


def _doubled(s: str) -> str:
    """Without one copy of the longest part of 2 to 10 places that stands twice in a row."""
    for n in range(10, 1, -1):
        for i in range(len(s) - 2 * n + 1):
            if s[i : i + n] == s[i + n : i + 2 * n]:
                return s[: i + n] + s[i + 2 * n :]
    return s


def merge_strategies(a: str, b: str) -> str:
    """The older merge of neighbouring readings: exact overlaps of 2, 3, 4 and 1 places, then overlaps of 2 with
    one place left off either side, then longer ones, then a doubled part, then plain joining."""
    if not a or not b:
        return a or b
    fits = lambda x, y, n: len(x) >= n and len(y) >= n and x[-n:] == y[:n]
    for n in (2, 3, 4, 1):
        if fits(a, b, n):
            return a + b[n:]
    if fits(a[:-1], b, 2):
        return a[:-1] + b[2:]
    if fits(a, b[1:], 2):
        return a + b[3:]
    for n in range(10, 1, -1):
        if fits(a, b, n):
            return a + b[n:]
    return _doubled(a + b)


#: A fold sets a text's settled part aside once its end is longer than the first, and keeps so many places before what isn't settled.
_LONG, _NEAR = 4096, 64
_TWICE = {n: re.compile(rf"(?s)(.{{{n}}})\1") for n in range(10, 1, -1)}
#: What a part of 4 to 10 places that stands twice in a row has: four places that come again soon.
_FOUR = re.compile(r"(?s)(....).{0,6}\1")


class Merged:
    """A text that grows by ``merge_pair`` or ``merge_strategies``, at the cost of what is added.

    ``end`` is the text without the parts set aside in ``done``. No part of n places that stands twice in a row lies wholly
    before the place ``clear[n]`` of ``end``: only what joins and removals touch is looked at again.
    """

    __slots__ = ("done", "end", "clear")

    def __init__(self, text: str = ""):
        self.done, self.end, self.clear = [], text, dict.fromkeys(_TWICE, 0)

    def whole(self) -> str:
        return "".join(self.done) + self.end if self.done else self.end

    def _touched(self, place: int) -> None:
        """The text was changed from ``place`` on."""
        if max(self.clear.values()) > place:
            self.clear = {n: min(x, place) for n, x in self.clear.items()}

    def _settle(self) -> None:
        """Set aside what is settled, or take back what may be touched again."""
        if len(self.end) > _LONG and (cut := min(self.clear.values()) - _NEAR) > 0:
            self.done.append(self.end[:cut])
            self.end = self.end[cut:]
            self.clear = {n: x - cut for n, x in self.clear.items()}
        while self.done and min(self.clear.values()) < _NEAR // 2:
            part = self.done.pop()
            self.end = part + self.end
            self.clear = {n: x + len(part) for n, x in self.clear.items()}

    def add(self, b: str, reach: int = 4) -> None:
        """``merge_pair`` with b."""
        if len(self.end) > _LONG:
            self.done.append(self.end[:-reach])
            self.end = self.end[-reach:]
        while self.done and len(self.end) < reach:
            self.end = self.done.pop() + self.end
        a = self.end
        x, y = a[-reach:], b[:reach]
        if x and y and x.isascii() and y.isascii():
            y = y.lower()
            for i, z in enumerate(reversed(x.lower())):
                j = y.find(z)
                if j >= 0:
                    self.end = (a[:-i] if i else a) + b[j + 1 :]
                    return
            self.end = a + b
        else:
            self.end = merge_pair(a, b, reach)

    def add_older(self, b: str) -> None:
        """``merge_strategies`` with b."""
        a = self.end
        if not a or not b:
            self.end = a or b
            return
        m, cut, skip = len(b), 0, 0
        if m >= 2 and a.endswith(b[:2]):
            skip = 2
        elif m >= 3 and a.endswith(b[:3]):
            skip = 3
        elif m >= 4 and a.endswith(b[:4]):
            skip = 4
        elif a[-1] == b[0]:
            skip = 1
        elif m >= 2 and a[-3:-1] == b[:2]:
            cut, skip = 1, 2
        elif m >= 3 and a.endswith(b[1:3]):
            skip = 3
        elif m >= 5 and b[0] in a[-10:-4]:
            for n in range(10, 4, -1):
                if m >= n and a.endswith(b[:n]):
                    skip = n
                    break
        self._touched(len(a) - cut)
        if skip:
            self.end = a[: len(a) - cut] + b[skip:]
        else:
            self.end = a + b
            self._undouble()
        if self.done or len(self.end) > _LONG:
            self._settle()

    def _undouble(self) -> None:
        s, clear = self.end, self.clear
        size = len(s)
        low = min(x for n, x in clear.items() if n > 3)
        if low < size and not _FOUR.search(s, max(low - 19, 0)):
            for n in range(10, 3, -1):
                clear[n] = size
        for n, twice in _TWICE.items():
            if clear[n] == size:
                continue
            found = twice.search(s, max(clear[n] - 2 * n + 1, 0))
            if found:
                at = found.start() + n
                clear[n] = at
                self.end = s[:at] + s[at + n :]
                self._joined(at, n)
                return
            clear[n] = size

    def _joined(self, at: int, less: int) -> None:
        """``less`` places were taken out at ``at``: what is clear behind it stays so, unless a part lies across."""
        for n, x in self.clear.items():
            if x > at:
                far = x - less > at + _NEAR and not _TWICE[n].search(self.end, max(at - 2 * n + 1, 0), at + 2 * n - 1)
                self.clear[n] = x - less if far else at


def merged(texts: Iterable[str | None], older: bool = False) -> str:
    """Left fold of ``merge_pair`` or ``merge_strategies`` over texts in order; null and empty ones are passed over."""
    out = Merged()
    add = out.add_older if older else out.add
    for t in texts:
        if t:
            add(t)
    return out.whole()


def merged_readings_older(readings: Iterable[tuple[int | None, str | None, float | None]]) -> list[tuple[int | None, str, float | None]]:
    """``merge_readings_older`` of one array."""
    rows, current = [], None
    for idx, text, confidence in readings:
        text = text or ""
        if current is not None and current[0] is not None:
            at, so_far, sure = current
            if idx is not None and at <= idx <= at + 1 and so_far.end and text:
                so_far.add_older(text)
                current = at, so_far, None if sure is None or confidence is None else (sure + confidence) / 2
                continue
            rows.append((at, so_far.whole(), sure))
        current = idx, Merged(text), confidence
    if current is not None and current[0] is not None:
        rows.append((current[0], current[1].whole(), current[2]))
    return rows


def _strings(column: pa.Array) -> list[str | None]:
    """The strings of a column; bytes that are no UTF-8 are replaced."""
    try:
        return column.to_numpy(zero_copy_only=False).tolist()
    except (UnicodeDecodeError, pa.ArrowException):
        return [x if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _numbers(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy().tolist()


def _bounds(column: pa.ListArray) -> list[tuple[int, int] | None]:
    """Where each list lies in the flat values that ``column.values`` has; nothing for a null list."""
    at = column.offsets.to_pylist()
    return [None if null else (a, b) for a, b, null in zip(at[:-1], at[1:], column.is_null().to_pylist(), strict=True)]


def _folds(older: bool):
    def fold(column: pa.Array) -> pa.Array:
        flat = _strings(column.values)
        return pa.array([None if x is None else merged(flat[x[0] : x[1]], older) for x in _bounds(column)], pa.string())

    return F.arrow_udf(fold, "string")


def merge_texts(texts) -> Column:
    """``merge_all`` of an array column. A fold's step needs the one before, so rows are folded in Arrow batches."""
    return _folds(False)(texts)


def merge_texts_older(texts) -> Column:
    """Fold of ``merge_strategies`` over an array column."""
    return _folds(True)(texts)


def merge_readings_older(readings) -> Column:
    """The older merge of an array of (idx, text, confidence) in order, as an array of the same.

    A reading goes on the one before if both have texts and its index is the index of the merged one or the next; then
    the texts are merged and the confidence is the mean of the merged one's so far and its own. Others begin a row.
    """
    kind = pa.list_(pa.struct([("idx", pa.int64()), ("text", pa.string()), ("confidence", pa.float64())]))

    def fold(column: pa.Array) -> pa.Array:
        idx, text, confidence = column.values.flatten()
        flat = list(zip(_numbers(idx), _strings(text), _numbers(confidence), strict=True))
        return pa.array([None if x is None else [{"idx": i, "text": t, "confidence": c} for i, t, c in merged_readings_older(flat[x[0] : x[1]])] for x in _bounds(column)], kind)

    plain = F.transform(readings, lambda r: F.struct(r["idx"].cast("long").alias("idx"), r["text"].alias("text"), r["confidence"].cast("double").alias("confidence")))
    return F.arrow_udf(fold, "array<struct<idx:bigint,text:string,confidence:double>>")(plain)
