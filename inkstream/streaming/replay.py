"""Keyed state machines that run in event time, whatever the order of arrival.

A machine sees its key's rows in the order of their time and may act by itself at times it names. As a stream,
rows wait in list state until the watermark has passed them; machines live in map and value state, and one timer
a key wakes the next of them. As a batch, rows are sorted and the same machines run over them; both forms give
the same rows. A key's waiting rows and machines are all that a task holds at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegralType, StructType


class Machine:
    """State of one key: ``items`` by an integer, each a tuple of ITEM's fields, and one text ``memo``.

    ``row`` and ``wake`` yield tuples of OUT's fields; times are whole microseconds.
    """

    #: the rows' fields beside the key, with ``us`` their time; equal times are ordered by the fields in turn
    ROW: str
    ITEM: str
    OUT: str

    def __init__(self) -> None:
        self.items: dict[int, tuple] = {}
        self.memo: str | None = None

    def row(self, us: int, row: tuple) -> Iterator[tuple]:
        raise NotImplementedError

    def due(self) -> int | None:
        """When it will act by itself next."""
        return None

    def wake(self, us: int) -> Iterator[tuple]:
        """What is due at ``us``, which ``due`` named."""
        return iter(())

    def until(self, us: float) -> Iterator[tuple]:
        """All that is due before ``us``."""
        while (at := self.due()) is not None and at < us:
            yield from self.wake(at)


def _sort_key(row: tuple):
    return tuple((x is not None, x) if not isinstance(x, bool) else (True, int(x)) for x in row)


def _plain(row, whole: list[bool]) -> tuple:
    """A row of pandas as plain values; where a column has nulls, pandas makes its whole numbers floats."""
    out = []
    for x, is_whole in zip(row, whole, strict=True):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            out.append(None)
        else:
            out.append(int(x) if is_whole else x.item() if hasattr(x, "item") else x)
    return tuple(out)


def _whole(schema: StructType) -> list[bool]:
    return [isinstance(f.dataType, IntegralType) for f in schema]


class ReplayProcessor(StatefulProcessor):
    """The streaming form of a machine, for ``transformWithStateInPandas`` in event time."""

    def __init__(self, make: Callable[[], Machine], keys: list[str]):
        self.make, self.keys = make, keys

    def init(self, handle) -> None:
        machine = self.make()
        self.names = [x.split()[0] for x in machine.ROW.split(", ")]
        self.whole = [x.split()[1] in ("int", "long") for x in machine.ROW.split(", ")]
        self.out = [*self.keys, *[x.split()[0] for x in machine.OUT.split(", ")]]
        self.handle = handle
        self.waiting = handle.getListState("waiting", machine.ROW)
        self.items = handle.getMapState("items", "item long", machine.ITEM)
        self.memo = handle.getValueState("memo", "memo string")
        self.timer = handle.getValueState("timer", "ms long")

    def _set_timer(self, us: int | None, fired: int | None = None) -> None:
        """Wake up once the watermark has passed ``us``; one timer a key."""
        ms = None if us is None else us // 1000 + 1
        old = self.timer.get()[0] if self.timer.exists() else None
        if ms == old:
            return
        if old is not None and old != fired:
            self.handle.deleteTimer(old)
        if ms is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues):
        fresh = [_plain(r, self.whole) for pdf in rows for r in pdf[self.names].itertuples(index=False)]
        if fresh:
            self.waiting.appendList(fresh)
            first = min(r[0] for r in fresh)
            old = self.timer.get()[0] if self.timer.exists() else None
            if old is None or first // 1000 + 1 < old:
                self._set_timer(first)
        yield pd.DataFrame(columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready, rest = sorted((r for r in rows if r[0] < now), key=_sort_key), [r for r in rows if r[0] >= now]
        machine = self.make()
        machine.memo = self.memo.get()[0] if self.memo.exists() else None
        before = {k[0]: tuple(v) for k, v in self.items.iterator()}
        machine.items = dict(before)
        out = []
        for r in ready:
            out += machine.until(r[0])
            out += machine.row(r[0], r[1:])
        out += machine.until(now)
        if ready:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        for k in before.keys() - machine.items.keys():
            self.items.removeKey((k,))
        for k, v in machine.items.items():
            if before.get(k) != v:
                self.items.updateValue((k,), v)
        if machine.memo is None:
            self.memo.clear()
        else:
            self.memo.update((machine.memo,))
        times = [x for x in (machine.due(), min((r[0] for r in rest), default=None)) if x is not None]
        self._set_timer(min(times, default=None), expiredTimerInfo.getExpiryTimeInMs())
        yield pd.DataFrame([(*key, *r) for r in out], columns=self.out)

    def close(self) -> None:
        pass


def _schema(rows: DataFrame, keys: list[str], make: Callable[[], Machine]) -> StructType:
    return StructType([rows.schema[k] for k in keys] + StructType.fromDDL(make().OUT).fields)


def replay_stream(rows: DataFrame, keys: list[str], make: Callable[[], Machine]) -> DataFrame:
    """The machines' output over a watermarked stream of keys, ROW's fields and the watermarked time.

    What an input says is known when the watermark passes it, so rows come out as late as the watermark lags; rows
    later than the watermark are dropped by Spark. Needs the RocksDB state store.
    """
    return rows.groupBy(*keys).transformWithStateInPandas(ReplayProcessor(make, keys), _schema(rows, keys, make), "Append", "EventTime")


def replay_batch(rows: DataFrame, keys: list[str], make: Callable[[], Machine]) -> DataFrame:
    """The same over a table, as if time went on forever after its last row; a task reads sorted batches of whole keys."""
    machine = make()
    names = [x.split()[0] for x in machine.ROW.split(", ")]
    out = [*keys, *[x.split()[0] for x in machine.OUT.split(", ")]]
    dealt = rows.select(*keys, *names).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *names)
    whole = _whole(dealt.schema)

    def run(frames):
        key, machine = None, make()
        for pdf in frames:
            made = []
            for r in pdf.itertuples(index=False):
                r = _plain(r, whole)
                if r[: len(keys)] != key:
                    if key is not None:
                        made += [(*key, *x) for x in machine.until(float("inf"))]
                    key, machine = r[: len(keys)], make()
                us = r[len(keys)]
                made += [(*key, *x) for x in machine.until(us)]
                made += [(*key, *x) for x in machine.row(us, r[len(keys) + 1 :])]
            yield pd.DataFrame(made, columns=out)
        if key is not None:
            yield pd.DataFrame([(*key, *x) for x in machine.until(float("inf"))], columns=out)

    return dealt.mapInPandas(run, _schema(rows, keys, make))
