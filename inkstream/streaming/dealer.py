"""Dealing with tracks: which snapshots of a track are pushed and when, when a track is over, and when a frame may go.

One rule for batches and streams, in event time. Of each track the most confident item since its last push is kept.
FAST pushes a new track at once and then one item an interval; INTERVAL waits an interval first; both push at most
``most`` items, at the moment they fall due, whether or not the track is seen then, and forget the track at its next
update after the last. BEST pushes the best item when the track dies, if it was updated often enough. A track not
updated for longer than the idle time dies. Settings come as rows too: a change of how pushing works forgets all
tracks at that moment, a change of sizes or quality does not.

Tracks of a stream and class are dealt to BUCKETS keys by their numbers, so no stream, however busy, is one task's.
"""

from __future__ import annotations

import dataclasses
import functools
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.geometry import expand_by_class
from .replay import Machine, replay_batch, replay_stream

MODES = ("FAST", "INTERVAL", "BEST")
BUCKETS = 16
KEYS = ["stream_id", "class", "bucket"]


@dataclasses.dataclass(frozen=True)
class PushSettings:
    """How pushing works; ``classes`` has (class, least width, least height, least score, least crop width and height).

    A face is judged by its crop's size and not by its score; other classes by their score.
    """

    version: int = 0
    enabled: bool = True
    mode: str = "BEST"
    interval_ms: int = 2000
    most: int = 1
    same_frame: bool = False
    idle_ms: int = 5000
    least: int = 2
    roi: tuple[float, float, float, float] | None = None
    classes: tuple[tuple[str, float, float, float, float, float], ...] = ()

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"push mode {self.mode!r}")

    @staticmethod
    def of(text: str) -> PushSettings:
        d = json.loads(text)
        roi = d.get("roi")
        return PushSettings(**d | {"roi": tuple(roi) if roi else None, "classes": tuple(tuple(c) for c in d.get("classes", ()))})

    def text(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    def restarts(self, old: PushSettings) -> bool:
        """Whether tracks followed under ``old`` are forgotten."""
        how = lambda s: (s.mode, s.interval_ms, s.most, s.same_frame)
        return not self.enabled or how(self) != how(old)

    def admits(self, kind: str, score: float, x: float, y: float, w: float, h: float) -> bool:
        """Inside the region, of the class's least size, and of its quality."""
        if self.roi is not None:
            left, top, right, bottom = self.roi[0], self.roi[1], self.roi[0] + self.roi[2], self.roi[1] + self.roi[3]
            if not (left <= x <= right and left <= x + w <= right and top <= y <= bottom and top <= y + h <= bottom):
                return False
        for name, min_w, min_h, quality, crop_w, crop_h in self.classes:
            if name == kind:
                fine = w >= crop_w and h >= crop_h if kind == "face" else score >= quality
                return fine and w >= min_w and h >= min_h
        return True


class Dealer(Machine):
    """The tracks of one key."""

    ROW = "us long, settings string, frame_id long, track_id long, state string, kind string, score double, x double, y double, w double, h double"
    #: the item kept, then the track's own
    ITEM = "frame_id long, us long, score double, x double, y double, w double, h double, state string, kind string, updates long, pushes long, updated long, pushed long"
    OUT = "track_id long, event string, at long, frame_id long, us long, score double, x double, y double, w double, h double, state string, updates long, pushes long, version int"

    def __init__(self, settings: str, uses: bool = False) -> None:
        super().__init__()
        self.first, self.uses, self.read = settings, uses, None

    @property
    def settings(self) -> PushSettings:
        text = self.memo or self.first
        if self.read is None or self.read[0] != text:
            self.read = text, PushSettings.of(text)
        return self.read[1]

    def _told(self, track: int, event: str, at: int, t: dict) -> tuple:
        return (track, event, at, t["frame_id"], t["us"], t["score"], t["x"], t["y"], t["w"], t["h"], t["state"], t["updates"], t["pushes"], self.settings.version)

    def _track(self, track: int) -> dict | None:
        v = self.items.get(track)
        return None if v is None else dict(zip(_FIELDS, v, strict=True))

    def _keep(self, track: int, t: dict) -> None:
        self.items[track] = tuple(t[f] for f in _FIELDS)

    def _forget(self, track: int, at: int) -> Iterator[tuple]:
        t = self._track(track)
        del self.items[track]
        if self.uses:
            yield self._told(track, "DROP", at, t)

    def _wanted(self, t: dict) -> bool:
        return t["score"] > 0 and self.settings.admits(t["kind"], t["score"], t["x"], t["y"], t["w"], t["h"])

    def _times(self, t: dict) -> tuple[float, float]:
        """When an item of the track is to be pushed, and when the track is over, if nothing else comes."""
        s, never = self.settings, float("inf")
        push = never
        if s.mode != "BEST" and self._wanted(t):
            if s.mode == "FAST" and t["state"] == "NEW":
                push = t["updated"] if t["pushes"] == 0 else never
            else:
                push = max(t["pushed"] + s.interval_ms * 1000, t["us"])
        over = t["updated"] if s.mode == "BEST" and t["state"] == "DIE" else t["updated"] + s.idle_ms * 1000 + 1000
        return push, over

    def due(self) -> int | None:
        return min((int(min(self._times(self._track(k)))) for k in self.items), default=None)

    def wake(self, us: int) -> Iterator[tuple]:
        for track in sorted(self.items):
            yield from self._finish(track, us)

    def _finish(self, track: int, now: int) -> Iterator[tuple]:
        t = self._track(track)
        push, over = self._times(t)
        if push <= now:
            t["pushes"] += 1
            yield self._told(track, "SELECT", now, t)
            t |= {"pushed": now, "score": 0.0}
            self._keep(track, t)
        if over <= now:
            s = self.settings
            if s.mode == "BEST" and t["updates"] >= s.least and self._wanted(t):
                t["pushes"] += 1
                yield self._told(track, "SELECT", now, t)
            else:
                yield self._told(track, "DIE", now, t)
            yield from self._forget(track, now)

    def row(self, us: int, row: tuple) -> Iterator[tuple]:
        settings, frame, track, state, kind, score, x, y, w, h = row
        if settings is not None:
            new = PushSettings.of(settings)
            if new.restarts(self.settings):
                for k in sorted(self.items):
                    yield from self._forget(k, us)
            self.memo = settings
            for k in sorted(self.items):  # what other sizes or times make due
                yield from self._finish(k, us)
            return
        s, t = self.settings, self._track(track)
        if not s.enabled or state not in ("NEW", "UPDATE", "DIE") or (t is None and state != "NEW"):
            return
        score = 0.0 if score is None else score
        if s.mode != "BEST" and t is not None and (state == "DIE" or (state == "UPDATE" and t["pushes"] >= s.most)):
            yield from self._forget(track, us)
            return
        item = {"frame_id": frame, "us": us, "score": score, "x": x or 0.0, "y": y or 0.0, "w": w or 0.0, "h": h or 0.0, "kind": kind}
        fresh = t is None or state == "NEW" or score > t["score"]
        if self.uses and fresh and t is not None:
            yield self._told(track, "DROP", us, t)
        if t is None:
            t = {"updates": 1, "pushes": 0, "pushed": us}
        elif state == "NEW":
            t["pushed"] = us if s.mode == "INTERVAL" else t["pushed"]
        else:
            t["updates"] += 1
        t = t | (item if fresh else {}) | {"state": state, "updated": us}
        self._keep(track, t)
        if self.uses and fresh:
            yield self._told(track, "HOLD", us, t)
        yield from self._finish(track, us)


_FIELDS = [x.split()[0] for x in Dealer.ITEM.split(", ")]


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def _rows(items: DataFrame, control: DataFrame | None, classes: list[str] | None, streams: list[int] | None) -> DataFrame:
    """Rows of the machine, keyed; a row of settings goes to every key of the classes and streams."""
    number = lambda n: F.col(n).cast("double").alias(n)
    rows = items.select(
        "stream_id", "class", F.pmod("track_id", F.lit(BUCKETS)).cast("int").alias("bucket"), "ts", _micros("ts").alias("us"), F.lit(None).cast("string").alias("settings"),
        F.col("frame_id").cast("long").alias("frame_id"), F.col("track_id").cast("long").alias("track_id"), "state", F.col("class").alias("kind"), *[number(n) for n in ("score", "x", "y", "w", "h")],
    )
    if control is None:
        return rows
    names = F.explode(F.array(*[F.lit(c) for c in classes]))
    keyed = control.select("ts", "settings", F.explode(F.array(*[F.lit(s) for s in streams])).alias("stream_id")).withColumn("stream_id", F.col("stream_id").cast(rows.schema["stream_id"].dataType))
    keyed = keyed.select("*", names.alias("class")).select("*", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket"))
    told = keyed.select("stream_id", "class", "bucket", "ts", _micros("ts").alias("us"), "settings", *[F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in rows.columns[6:]])
    return rows.unionByName(told)


def _shown(out: DataFrame) -> DataFrame:
    return out.drop("bucket").withColumns({"at": F.timestamp_micros("at"), "ts": F.timestamp_micros("us")}).drop("us")


def deal(items: DataFrame, settings: PushSettings, control: DataFrame | None = None, classes: list[str] | None = None, streams: list[int] | None = None, uses: bool = False) -> DataFrame:
    """What becomes of the tracks' items (stream_id, class, track_id, frame_id, ts, state, score, x, y, w, h), as a table.

    A row for each push (event SELECT, at the time ``at``, of the item of ``ts``) and each track that died without one then
    (DIE); with ``uses`` also the frames that tracks begin and cease to need (HOLD, DROP). ``control`` has ts and
    settings (``PushSettings.text``), for the classes and streams named, before items of the same time. Items of
    unknown states, and updates of tracks never seen as new, are passed over; a null score is 0, which isn't pushed.
    """
    return _shown(replay_batch(_rows(items, control, classes, streams), KEYS, functools.partial(Dealer, settings.text(), uses)))


def deal_stream(items: DataFrame, settings: PushSettings, control: DataFrame | None = None, classes: list[str] | None = None, streams: list[int] | None = None, uses: bool = False) -> DataFrame:
    """The same on streams, each watermarked on ``ts``."""
    return _shown(replay_stream(_rows(items, control, classes, streams), KEYS, functools.partial(Dealer, settings.text(), uses)))


def as_items(events: DataFrame, idle: str = "5 seconds") -> DataFrame:
    """Sightings without states as items: the first of a track and the first after a longer gap than ``idle`` are NEW."""
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id", "class", "track_id").orderBy("ts", "frame_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    return events.withColumn("state", F.when(gap <= F.expr(f"INTERVAL {idle}"), "UPDATE").otherwise("NEW"))


# --- frames


class Frame(Machine):
    """A frame: which tracks need it; it goes when the last of them has let it go."""

    ROW = "us long, action int, track_id long"
    ITEM = "since long"
    OUT = "at long, cause string, uses long"

    def __init__(self, patience_ms: int) -> None:
        super().__init__()
        self.patience = patience_ms * 1000

    def row(self, us: int, row: tuple) -> Iterator[tuple]:
        action, track = row
        count, last = json.loads(self.memo) if self.memo else (0, us)
        if action == _HOLD:
            self.items[track] = (us,)
            count += 1
        elif self.items.pop(track, None) is None:
            return
        if self.items:
            self.memo = json.dumps([count, us])
        else:
            self.memo = None
            yield (us, "released", count)

    def due(self) -> int | None:
        return json.loads(self.memo)[1] + self.patience + 1000 if self.items else None

    def wake(self, us: int) -> Iterator[tuple]:
        count, _ = json.loads(self.memo)
        self.items.clear()
        self.memo = None
        yield (us, "abandoned", count)


#: In the order in which those of one time count: a frame that passes from one track to another stays.
_HOLD, _LET_GO = 0, 1


def _frame_rows(dealt: DataFrame, acks: DataFrame | None) -> DataFrame:
    uses = dealt.where(F.col("event").isin("HOLD", "DROP")).select("stream_id", "frame_id", F.col("at").alias("ts"), F.when(F.col("event") == "HOLD", _HOLD).otherwise(_LET_GO).alias("action"), "track_id")
    if acks is not None:
        uses = uses.unionByName(acks.select("stream_id", "frame_id", "ts", F.lit(_LET_GO).alias("action"), F.col("track_id").cast("long").alias("track_id")))
    return uses.withColumn("us", _micros("ts"))


def released_frames(dealt: DataFrame, acks: DataFrame | None = None, patience_ms: int = 60_000) -> DataFrame:
    """stream_id, frame_id, at, cause, uses: when each frame that tracks of ``dealt`` (with uses) held may be deleted.

    A frame is released when no track needs it: tracks let go by a better item or their end, or by an ack (stream_id,
    frame_id, track_id, ts) of the consumer who has their snapshots; an ack of what isn't held is passed over. It is abandoned when
    nothing came for longer than ``patience_ms``, so the state of frames is bounded by the frames of that time.
    """
    out = replay_batch(_frame_rows(dealt, acks), ["stream_id", "frame_id"], functools.partial(Frame, patience_ms))
    return out.withColumn("at", F.timestamp_micros("at"))


def released_frames_stream(dealt: DataFrame, acks: DataFrame | None = None, patience_ms: int = 60_000) -> DataFrame:
    """The same on streams: ``dealt`` watermarked on ``at``, ``acks`` on ``ts``."""
    out = replay_stream(_frame_rows(dealt, acks), ["stream_id", "frame_id"], functools.partial(Frame, patience_ms))
    return out.withColumn("at", F.timestamp_micros("at"))


# --- snapshots


def crops(pushed: DataFrame, config: DataFrame, width: int, height: int) -> DataFrame:
    """``pushed`` with the crop (left, top, right, bottom) of its item, widened by its class's share and cut at the frame."""
    d = pushed.join(F.broadcast(config.select("class", "expand")), "class", "left").withColumn("expand", F.coalesce("expand", F.lit(0.0)))
    x, y, w, h = expand_by_class("x", "y", "w", "h", "expand")
    cut = lambda v, m: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(m)))
    return d.withColumns({"left": cut(x, width), "top": cut(y, height), "right": cut(x + w, width), "bottom": cut(y + h, height)}).drop("expand")


def attach_stream(pushed: DataFrame, frames: DataFrame, panorama: bool = True, keep: str = "60 seconds") -> DataFrame:
    """Pushes of a stream (watermarked on ``at``) with their frame's panorama (of frames watermarked on ``ts``).

    An outer join of two streams: a frame may come before or after the pushes that share it and waits for ``keep`` at most; a
    push whose frame never comes, or any push with panoramas off, has none.
    """
    if not panorama:
        return pushed.withColumn("panorama", F.lit(None).cast("binary"))
    f = frames.select(F.col("stream_id").alias("_stream"), F.col("frame_id").alias("_frame"), F.col("ts").alias("_ts"), "panorama")
    near = (F.col("stream_id") == F.col("_stream")) & (F.col("frame_id") == F.col("_frame")) & (F.col("_ts") <= F.col("at")) & (F.col("_ts") >= F.col("at") - F.expr(f"INTERVAL {keep}"))
    return pushed.join(f, near, "left_outer").drop("_stream", "_frame", "_ts")
