"""Frames that differ from the last one kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIMILAR = 0.95


def correlation(a, b) -> float:
    """Pearson correlation; frames without variance are like each other only when equal. Null and empty frames, and those of
    other sizes, are like nothing."""
    if a is None or b is None or len(a) == 0 or len(a) != len(b):
        return 0.0
    a, b = np.asarray(a, float), np.asarray(b, float)
    da, db = a - a.mean(), b - b.mean()
    n = np.sqrt((da * da).sum() * (db * db).sum())
    return float((da * db).sum() / n) if n > 0 else float(np.array_equal(a, b))


def keep_changed(frames: DataFrame, limit: float = SIMILAR) -> DataFrame:
    """stream_id, frame_id of the frames (stream_id, frame_id, pixels) that aren't like the last kept one of their stream.

    Streams are read in sorted batches; a task holds the last kept frame and a batch, however long a stream is.
    """

    def run(parts):
        stream, last, begun = None, None, False
        for pdf in parts:
            kept = []
            for s, frame, pixels in pdf.itertuples(index=False):
                if not begun or s != stream:
                    stream, last, begun = s, None, True
                    fresh = True
                else:
                    fresh = correlation(last, pixels) < limit
                if fresh:
                    kept.append((s, frame))
                    last = pixels
            yield pd.DataFrame(kept, columns=["stream_id", "frame_id"])

    kind = {f.name: f.dataType.simpleString() for f in frames.schema}
    dealt = frames.where("stream_id is not null and frame_id is not null").select("stream_id", "frame_id", "pixels").repartition("stream_id").sortWithinPartitions("stream_id", "frame_id")
    return dealt.mapInPandas(run, f"stream_id {kind['stream_id']}, frame_id {kind['frame_id']}")


def keep_changed_stream(frames: DataFrame, limit: float = SIMILAR) -> DataFrame:
    """The same on a stream: the last kept frame is the state of its stream."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, parts, state: GroupState):
        last, keep = (list(state.get[0]) if state.exists else None), []
        pdf = pd.concat(list(parts)).sort_values("frame_id")
        for frame, pixels in pdf[["frame_id", "pixels"]].itertuples(index=False):
            if last is None or correlation(last, pixels) < limit:
                keep.append(int(frame))
                last = [float(x) for x in pixels] if pixels is not None else []
        state.update((last,))
        yield pd.DataFrame({"stream_id": [key[0]] * len(keep), "frame_id": keep})

    kind = frames.schema["stream_id"].dataType.simpleString()
    return frames.groupBy("stream_id").applyInPandasWithState(run, f"stream_id {kind}, frame_id long", "last array<double>", "append", GroupStateTimeout.NoTimeout)
