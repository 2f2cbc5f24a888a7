"""Multi-object tracking by association: boxes are followed by a constant-velocity Kalman filter and matched
to sure detections first, to unsure ones next. State is kept per stream; classes never match each other.

A new track is shown at once and followed like any other, but it must be seen again in the next frame, else it is
forgotten without a word. A track seen twice that is lost comes back by a sure detection, or is removed after a while.
Frame numbers without detections are frames without detections: they age what is lost."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tracks import assign
from ..session import checkpointed

#: Score of sure detections and of new tracks; limits of the two matchings; frames that a lost track is kept;
#: distance of duplicates.
SURE, START, FIRST, SECOND, KEEP, SAME = 0.5, 0.3, 0.8, 0.5, 30, 0.15
POSITION, VELOCITY = 1 / 20, 1 / 160
OUTPUT = "stream_id int, frame_id long, track_id long, class string, state string, x double, y double, w double, h double, score double"


@dataclass
class Kalman:
    """Centre, aspect, height and their velocities; noise grows with the height, less for surer measurements."""

    mean: np.ndarray
    cov: np.ndarray

    @staticmethod
    def start(z: np.ndarray) -> "Kalman":
        h = z[3]
        std = np.array([2 * POSITION * h, 2 * POSITION * h, 1e-2, 2 * POSITION * h, 10 * VELOCITY * h, 10 * VELOCITY * h, 1e-5, 10 * VELOCITY * h])
        return Kalman(np.r_[z, np.zeros(4)], np.diag(std**2))

    @staticmethod
    def predict(all_of: list["Kalman"]) -> None:
        """One step of each: with F = [[1, 1], [0, 1]] in blocks, F cov F' is sums of blocks."""
        if not all_of:
            return
        mean, cov = np.stack([k.mean for k in all_of]), np.stack([k.cov for k in all_of])
        h = mean[:, 3].copy()
        mean[:, :4] += mean[:, 4:]
        cov[:, :4] += cov[:, 4:]
        cov[:, :, :4] += cov[:, :, 4:]
        std = np.repeat(h[:, None], 8, 1) * np.array([POSITION, POSITION, 0, POSITION, VELOCITY, VELOCITY, 0, VELOCITY]) + np.array([0, 0, 1e-2, 0, 0, 0, 1e-5, 0])
        cov[:, np.arange(8), np.arange(8)] += std**2
        for i, k in enumerate(all_of):
            k.mean, k.cov = mean[i], cov[i]

    def update(self, z: np.ndarray, score: float) -> None:
        h = self.mean[3]
        std = (1 - score) * np.array([POSITION * h, POSITION * h, 1e-1, POSITION * h])
        s = self.cov[:4, :4] + np.diag(std**2 + 1e-12)
        gain = np.linalg.solve(s, self.cov[:4, :]).T
        self.mean = self.mean + gain @ (z - self.mean[:4])
        self.cov = self.cov - gain @ s @ gain.T


@dataclass
class Track:
    id: int
    kind: str
    filter: Kalman | None  # made at the first match: a new track has no velocity yet
    box: tuple[float, ...]  # x, y, w, h of the last detection
    score: float
    start: int
    frame: int
    state: str = "New"

    def corners(self) -> tuple[float, ...]:
        """x1, y1, x2, y2 of where the filter has the track."""
        cx, cy, a, h = self.filter.mean[:4].tolist() if self.filter else _z(self.box)
        return cx - a * h / 2, cy - h / 2, cx + a * h / 2, cy + h / 2


def _z(b: tuple[float, ...]) -> tuple[float, ...]:
    return b[0] + b[2] / 2, b[1] + b[3] / 2, b[2] / max(b[3], 1e-6), b[3]


def _distance(a: list[tuple[float, ...]], b: list[tuple[float, ...]]) -> np.ndarray:
    """1 - IoU of corner boxes, pixels included."""
    if not a or not b:
        return np.zeros((len(a), len(b)))
    a, b = np.array(a), np.array(b)
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]) + 1
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]) + 1
    size = lambda q: (q[:, 2] - q[:, 0] + 1) * (q[:, 3] - q[:, 1] + 1)
    common = np.where((w > 0) & (h > 0), w * h, 0.0)
    return 1 - common / (size(a)[:, None] + size(b)[None, :] - common)


def _apart(a: list[tuple[float, ...]], b: list[tuple[float, ...]]) -> bool:
    """Whether no two of a few boxes have a common part, so that no distance is under a limit of 1; many aren't tried."""
    if len(a) * len(b) > 64:
        return False
    for p in a:
        for q in b:
            if p[2] + 1 > q[0] and q[2] + 1 > p[0] and p[3] + 1 > q[1] and q[3] + 1 > p[1]:
                return False
    return True


def _matched(a: list[tuple[float, ...]], b: list[tuple[float, ...]], limit: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """``assign`` by distance; boxes that all lie apart need none."""
    if _apart(a, b):
        return [], list(range(len(a))), list(range(len(b)))
    return assign(_distance(a, b), limit)


@dataclass
class ClassTracker:
    """The tracks of one class of one stream."""

    kind: str
    tracked: list[Track] = field(default_factory=list)
    lost: list[Track] = field(default_factory=list)

    def update(self, frame: int, boxes: list[tuple[float, ...]], scores: list[float], new_id) -> list[Track]:
        """The tracks to show of a frame with these boxes (x, y, w, h), the removed ones last."""
        corners = [(x, y, x + w, y + h) for x, y, w, h in boxes]
        sure, unsure = [d for d, s in enumerate(scores) if s >= SURE], [d for d, s in enumerate(scores) if s < SURE]
        pool = self.tracked + self.lost
        Kalman.predict([t.filter for t in pool if t.filter])
        where = lambda ts: [t.corners() for t in ts]

        def take(t: Track, d: int) -> None:
            if t.filter is None:
                t.filter = Kalman.start(np.array(_z(t.box)))
                Kalman.predict([t.filter])
            t.filter.update(np.array(_z(boxes[d])), scores[d])
            t.box, t.score, t.frame, t.state = boxes[d], scores[d], frame, "Tracked"

        pairs, rest, over = _matched(where(pool), [corners[d] for d in sure], FIRST) if pool and sure else ([], range(len(pool)), range(len(sure)))
        for a, b in pairs:
            take(pool[a], sure[b])
        second = [pool[a] for a in rest if pool[a].state == "Tracked"]
        pairs, rest2, _ = _matched(where(second), [corners[d] for d in unsure], SECOND) if second and unsure else ([], range(len(second)), ())
        for a, b in pairs:
            take(second[a], unsure[b])
        lost_now = {second[a].id for a in rest2}
        for a in rest2:
            second[a].state = "Lost"
        self.tracked = [t for t in self.tracked if t.state != "New"]  # new ones not seen again are forgotten
        for b in over:
            d = sure[b]
            if scores[d] >= START:
                self.tracked.append(Track(new_id(), self.kind, None, boxes[d], scores[d], frame, frame))
        everything = {t.id: t for t in [*self.tracked, *self.lost]}
        gone = {t.id for t in everything.values() if t.state == "Lost" and t.id not in lost_now and frame - t.frame > KEEP}
        out = []
        for i in gone:
            everything[i].state = "Removed"
            out.append(everything.pop(i))
        self.tracked = [t for t in everything.values() if t.state in ("New", "Tracked")]
        self.lost = [t for t in everything.values() if t.state == "Lost"]
        if self.tracked and self.lost and not _apart(one_of := where(self.tracked), two_of := where(self.lost)):
            drop_t, drop_l = set(), set()
            for a, b in np.argwhere(_distance(one_of, two_of) < SAME).tolist():
                one, two = self.tracked[a], self.lost[b]
                if one.frame - one.start > two.frame - two.start:
                    drop_l.add(b)
                else:
                    drop_t.add(a)
            self.tracked = [t for i, t in enumerate(self.tracked) if i not in drop_t]
            self.lost = [t for i, t in enumerate(self.lost) if i not in drop_l]
        return [t for t in self.tracked if t.frame == frame] + out


class StreamTracker:
    """All classes of one stream; ids count through the stream."""

    def __init__(self):
        self.classes: dict[str, ClassTracker] = {}
        self.count, self.last = 0, None

    def _next(self) -> int:
        self.count += 1
        return self.count

    def frame(self, number: int, kinds: np.ndarray, boxes: list[tuple[float, ...]], scores: list[float]) -> list[tuple]:
        """One frame's tracks; detections come by class, best first."""
        out = []
        edge = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1], True]) if len(kinds) else np.zeros(1, int)
        groups = {kinds[a]: slice(a, z) for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)}
        for kind in sorted({*self.classes, *groups}):
            tracker = self.classes.setdefault(kind, ClassTracker(kind))
            at = groups.get(kind, slice(0, 0))
            if kind in groups or tracker.tracked or tracker.lost:
                out += [(number, t.id, kind, t.state, *t.box, t.score) for t in sorted(tracker.update(number, boxes[at], scores[at], self._next), key=lambda t: t.id)]
        return out

    def rows(self, part: pd.DataFrame) -> list[tuple]:
        """The tracks of the frames of ``part``, sorted by frame, class, score downwards and idx; and of those between."""
        out = []
        numbers, kinds = part["frame_id"].to_numpy(np.int64), part["class"].to_numpy(object)
        boxes, scores = [tuple(b) for b in part[["x", "y", "w", "h"]].to_numpy(float).tolist()], part["score"].to_numpy(float).tolist()
        edge = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1], True])
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            number = int(numbers[a])
            if self.last is not None:
                for empty in range(self.last + 1, number):
                    if not any(c.tracked or c.lost for c in self.classes.values()):
                        break
                    out += self.frame(empty, kinds[:0], boxes[:0], scores[:0])
            out += self.frame(number, kinds[a:z], boxes[a:z], scores[a:z])
            self.last = number
        return out


_COLUMNS = ["frame_id", "track_id", "class", "state", "x", "y", "w", "h", "score"]
_INPUT = ["stream_id", "frame_id", "idx", "class", "x", "y", "w", "h", "score"]
_ORDER = {"frame_id": True, "class": True, "score": False, "idx": True}
#: Rows of a class's tracker: ``track`` counts through the class; the stateless ones tell of births that are not shown and of the last detection.
_CLASS_ROWS = "stream_id int, class string, frame_id long, track long, born boolean, ends boolean, state string, x double, y double, w double, h double, score double"


class _ClassRuns:
    """Trackers of streams' classes, one after the other, over detections sorted by stream, class, frame and so on."""

    def __init__(self):
        self.key, self.number, self.boxes, self.scores, self.out = None, 0, [], [], []

    def _shown(self, number: int, boxes: list, scores: list) -> None:
        stream, kind = self.key
        born = self.count
        shown = self.tracker.update(number, boxes, scores, self._next)
        for t in shown:
            self.out.append((stream, kind, number, t.id, t.start == number, False, t.state, *t.box, t.score))
        for i in {*range(born + 1, self.count + 1)} - {t.id for t in shown} if self.count > born else ():
            self.out.append((stream, kind, number, i, True, False, *[None] * 6))

    def _next(self) -> int:
        self.count += 1
        return self.count

    def _alive(self) -> bool:
        return bool(self.tracker.tracked or self.tracker.lost)

    def _frame(self, until: int | None) -> None:
        """The frame at hand, and those without detections up to ``until``, or for as long as there are tracks."""
        self._shown(self.number, self.boxes, self.scores)
        number = self.number + 1
        while self._alive() and (until is None or number < until):
            self._shown(number, [], [])
            number += 1

    def end(self) -> None:
        if self.key is not None:
            self._frame(None)
            self.out.append((*self.key, self.number, None, False, True, *[None] * 6))

    def take(self, batch: pa.RecordBatch) -> None:
        numbers = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float).tolist()
        boxes = zip(*map(numbers, ("x", "y", "w", "h")), strict=True)
        for stream, kind, number, box, score in zip(batch.column("stream_id").to_pylist(), batch.column("class").to_pylist(), batch.column("frame_id").to_pylist(), boxes, numbers("score"), strict=True):
            if (stream, kind) != self.key:
                self.end()
                self.key, self.tracker, self.count = (stream, kind), ClassTracker(kind), 0
                self.number, self.boxes, self.scores = number, [], []
            elif number != self.number:
                self._frame(number)
                self.number, self.boxes, self.scores = number, [], []
            self.boxes.append(box)
            self.scores.append(score)

    def rows(self) -> pa.RecordBatch:
        """What has come out since the last call."""
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), *[pa.float64()] * 5]
        columns = list(zip(*self.out, strict=True)) if self.out else [[] for _ in kinds]
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _CLASS_ROWS.split(", ")])


def track(detections: DataFrame) -> DataFrame:
    """Tracks of all streams (stream_id, frame_id, idx, class, x, y, w, h, score), frames in order within each stream.

    Classes never match each other, so a class of a stream is one task's, as each frame needs the one before; it is sorted
    and passed through in batches, with only its tracker held. Tracks count through their class there. Then the births of
    a stream are ranked by frame, class and place, in runs of frames whose counts are summed up, which gives the ids
    that count through the stream. Rows without a stream, frame or class are left out.
    """
    keyed = detections.select(*_INPUT).where("stream_id is not null and frame_id is not null and class is not null")
    # a fixed number of partitions: small classes are not put together in one task
    dealt = keyed.repartition(max(64, int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "stream_id", "class")
    sorted_ = dealt.sortWithinPartitions("stream_id", "class", "frame_id", F.col("score").desc(), "idx")

    def run(batches):
        runs = _ClassRuns()
        for batch in batches:
            runs.take(batch)
            yield runs.rows()
        runs.end()
        yield runs.rows()

    rows = checkpointed(sorted_.mapInArrow(run, _CLASS_ROWS))
    # lost tracks are removed up to the stream's last frame, which another class may have
    last = rows.where("ends").groupBy("stream_id").agg(F.max("frame_id").alias("last"))
    births = rows.where("born").select("stream_id", "class", "track", "frame_id", F.shiftright("frame_id", 10).alias("run"))
    before = Window.partitionBy("stream_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = births.groupBy("stream_id", "run").count().select("stream_id", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("stream_id", "run").orderBy("frame_id", "class", "track"))
    ids = births.withColumn("place", place).join(counts, ["stream_id", "run"]).select("stream_id", "class", "track", (F.col("before") + F.col("place")).alias("track_id"))
    shown = rows.where("state is not null").join(F.broadcast(last), "stream_id").where("frame_id <= last")
    return shown.join(ids, ["stream_id", "class", "track"]).select("stream_id", *_COLUMNS)


def track_stream(detections: DataFrame) -> DataFrame:
    """The same on a stream: a stream's tracker is its state; frames of a batch are put in order first."""
    import pickle

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, parts, state: GroupState):
        tracker = pickle.loads(state.get[0]) if state.exists else StreamTracker()
        rows = tracker.rows(pd.concat(list(parts)).sort_values(list(_ORDER), ascending=list(_ORDER.values())))
        state.update((pickle.dumps(tracker),))
        out = pd.DataFrame(rows, columns=_COLUMNS)
        out.insert(0, "stream_id", key[0])
        yield out

    return detections.select(*_INPUT).groupBy("stream_id").applyInPandasWithState(run, OUTPUT, "tracker binary", "append", GroupStateTimeout.NoTimeout)


def assign_frames(distances: DataFrame, keys: tuple[str, ...], limit: float) -> DataFrame:
    """Cheapest pairs (keys, a_idx, b_idx, distance) under ``limit`` of every frame; only near pairs reach a task of a frame."""
    distances = distances.where(F.col("distance") < limit)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.astype({"a_idx": int, "b_idx": int}).pivot(index="a_idx", columns="b_idx", values="distance").fillna(2 * limit)
        pairs, _, _ = assign(m.to_numpy(float), limit)
        out = pd.DataFrame({k: pd.Series([pdf[k].iloc[0]] * len(pairs), dtype=object if isinstance(pdf[k].iloc[0], str) else pdf[k].dtype) for k in keys})
        return out.assign(a_idx=np.array([m.index[a] for a, _ in pairs], np.int32), b_idx=np.array([m.columns[b] for _, b in pairs], np.int32), distance=np.array([m.iat[a, b] for a, b in pairs], float))

    kind = {f.name: f.dataType.simpleString() for f in distances.schema}
    return distances.groupBy(*keys).applyInPandas(run, ", ".join(f"`{c}` {kind[c]}" for c in [*keys, "a_idx", "b_idx", "distance"]))
