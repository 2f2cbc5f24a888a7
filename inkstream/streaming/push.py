"""Choosing which snapshots of a track to push: the best of a life, or one each interval.

As batches these are windows over whole tracks; as streams, keyed state with timers (``PushProcessor``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("stream_id", "class", "track_id")
#: A best snapshot is pushed only of tracks with so many updates; a track is over after so many ms without one.
LEAST_UPDATES, IDLE_MS, INTERVAL_MS, MOST = 2, 5000, 2000, 1


def item_state(state) -> Column:
    """The item state that a track state shows as; lost tracks show none."""
    return F.when(F.col(state) == "New", "NEW").when(F.col(state) == "Tracked", "UPDATE").when(F.col(state) == "Removed", "DIE") if isinstance(state, str) else F.when(state == "New", "NEW").when(state == "Tracked", "UPDATE").when(state == "Removed", "DIE")


def lives(events: DataFrame, idle: str = "5 seconds") -> DataFrame:
    """stream_id, class, track_id, began, ended, updates: a track's life ends after ``idle`` without an update."""
    s = events.groupBy(*KEY, F.session_window("ts", idle).alias("w")).agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("updates"))
    return s.drop("w")


def best_of_sessions(events: DataFrame, idle: str = "5 seconds", least: int = LEAST_UPDATES) -> DataFrame:
    """The most confident update of each life with at least ``least`` updates; the first of equals."""
    first = F.struct(F.col("score"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), (-F.col("frame_id")).alias("f"))
    s = events.groupBy(*KEY, F.session_window("ts", idle).alias("w")).agg(F.max_by(F.struct("frame_id", "ts", "score"), first).alias("best"), F.count("*").alias("updates"))
    return s.where(F.col("updates") >= least).select(*KEY, "best.*", "updates")


def _paced(pdf: pd.DataFrame, interval_ms: int, most: int, first_waits: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["ts", "frame_id"], kind="stable")
    last, n, keep = None, 0, []
    for i, ts in enumerate(pdf["ts"]):
        if last is None and first_waits:
            last = ts
            continue
        if n < most and (last is None or (ts - last).total_seconds() * 1000 >= interval_ms):
            keep.append(i)
            last, n = ts, n + 1
    return pdf.iloc[keep].assign(push=range(1, len(keep) + 1))


def paced(events: DataFrame, interval_ms: int = INTERVAL_MS, most: int = MOST, first_waits: bool = False) -> DataFrame:
    """Updates to push: the first at once (or, with ``first_waits``, only after an interval), then one an interval, ``most`` a track."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _paced(pdf, interval_ms, most, first_waits)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", push int"
    return events.groupBy(*KEY).applyInPandas(run, schema)


def attach_snapshots(pushed: DataFrame, frames: DataFrame) -> DataFrame:
    """Pushed tracks with their frame's panorama; a frame is stored once and shared by its tracks. State SELECT."""
    return pushed.join(frames.select("stream_id", "frame_id", "panorama"), ["stream_id", "frame_id"], "left").withColumn("state", F.lit("SELECT"))


def push_stream(events: DataFrame, mode: str = "BEST", interval_ms: int = INTERVAL_MS, most: int = MOST, idle_ms: int = IDLE_MS, least: int = LEAST_UPDATES) -> DataFrame:
    """The same on a stream (event time ``ts``, watermarked): one state per track, dropped when the track is over.

    BEST pushes when the watermark passes the idle time after the last update; FAST at once and then each
    interval; INTERVAL only after each interval.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    if mode not in ("BEST", "FAST", "INTERVAL"):
        raise ValueError(f"push mode {mode!r}")

    def run(key, frames, state: GroupState):
        best, score, updates, last, pushed = state.get if state.exists else (None, -1.0, 0, None, 0)
        out = []
        if state.hasTimedOut:
            state.remove()
            if mode == "BEST" and updates >= least:
                out.append((*key, best, score, "DIE"))
        else:
            newest = 0
            for pdf in frames:
                for row in pdf.sort_values(["ts", "frame_id"]).itertuples():
                    ms = int(row.ts.value // 1_000_000)
                    newest, updates = max(newest, ms), updates + 1
                    if mode == "BEST":
                        if row.score > score:
                            best, score = int(row.frame_id), float(row.score)
                    elif last is None and mode == "INTERVAL":
                        last = ms
                    elif pushed < most and (last is None or ms - last >= interval_ms):
                        out.append((*key, int(row.frame_id), float(row.score), "NEW" if last is None else "UPDATE"))
                        last, pushed = ms, pushed + 1
            state.update((best, score, updates, last, pushed))
            state.setTimeoutTimestamp(max(newest + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[*KEY, "frame_id", "score", "state"])

    schema = "stream_id int, class string, track_id int, frame_id long, score double, state string"
    return events.groupBy(*KEY).applyInPandasWithState(run, schema, "best long, score double, updates long, last long, pushed int", "append", GroupStateTimeout.EventTimeTimeout)
