import numpy as np
import pandas as pd
import pytest
from inkstream.streaming import dedup, push, tracker
from pyspark.sql import functions as F

EVENTS = "stream_id int, class string, track_id int, frame_id long, ts timestamp, score double"


def events():
    t = pd.Timestamp("2026-01-01")
    s = lambda x: (t + pd.Timedelta(seconds=x)).to_pydatetime()
    rows = [(0, "body", 1, i, s(i), sc) for i, sc in enumerate([0.5, 0.9, 0.9, 0.2])]
    rows += [(0, "body", 1, 20, s(20), 0.4), (0, "face", 2, 3, s(3), 0.8)]
    return rows


def test_best_of_lives(spark):
    r = push.best_of_sessions(spark.createDataFrame(events(), EVENTS), "5 seconds").collect()
    assert [(x.track_id, x.frame_id, x.score, x.updates) for x in r] == [(1, 1, 0.9, 4)]
    assert push.lives(spark.createDataFrame(events(), EVENTS)).count() == 3


def test_paced(spark):
    df = spark.createDataFrame(events(), EVENTS).where("class = 'body'")
    assert [x.frame_id for x in push.paced(df, 2000, 9).orderBy("ts").collect()] == [0, 2, 20]
    assert [x.frame_id for x in push.paced(df, 2000, 9, first_waits=True).orderBy("ts").collect()] == [2, 20]
    assert push.paced(df, 2000, 1).count() == 1


@pytest.mark.parametrize(("mode", "frames"), [("BEST", [1]), ("FAST", [0, 2])])
def test_push_stream(spark, tmp_path, mode, frames):
    late = [(9, "body", 9, 99, pd.Timestamp("2026-01-01 01:00").to_pydatetime(), 0.1), (9, "body", 9, 100, pd.Timestamp("2026-01-01 02:00").to_pydatetime(), 0.1)]
    rows = [x for x in events() if x[3] < 20]
    for k, part in enumerate((rows, late[:1], late[1:])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withWatermark("ts", "1 second")
    q = push.push_stream(stream, mode, most=2).writeStream.format("memory").queryName(f"push_{mode}").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = spark.table(f"push_{mode}").where("stream_id = 0 and class = 'body'").orderBy("frame_id").collect()
    assert [x.frame_id for x in r] == frames


def test_keep_changed(spark):
    rows = [(1, 1, [1.0, 2.0, 3.0]), (1, 2, [1.0, 2.0, 3.1]), (1, 3, [3.0, 2.0, 1.0]), (1, 4, [1.0, 2.0, 3.0]), (2, 1, [5.0, 5.0, 5.0]), (2, 2, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "stream_id int, frame_id long, pixels array<double>")
    assert sorted((r.stream_id, r.frame_id) for r in dedup.keep_changed(df).collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]


def walk(n=12, seed=0):
    """Two boxes that move steadily and one that appears once."""
    rng, rows = np.random.default_rng(seed), []
    for f in range(n):
        rows += [(0, f, 0, "body", 100.0 + 5 * f + rng.normal(), 100.0, 50.0, 100.0, 0.9), (0, f, 1, "body", 600.0 - 5 * f, 300.0, 60.0, 120.0, 0.8 if f != 5 else 0.4)]
    rows.append((0, 3, 2, "body", 900.0, 900.0, 40.0, 40.0, 0.7))
    return rows


DETECTIONS = "stream_id int, frame_id long, idx int, class string, x double, y double, w double, h double, score double"


def test_tracks_keep_their_ids(spark):
    r = tracker.track(spark.createDataFrame(walk(), DETECTIONS)).toPandas()
    seen = r[r.state != "Removed"].groupby("track_id").frame_id.nunique().sort_values(ascending=False)
    assert list(seen) == [12, 12, 1]
    assert r[r.state == "Removed"].empty  # the box that appears once is forgotten: only lost tracks are removed


def test_lives_of_tracks(spark):
    """A hand-worked trace: new, tracked, lost over frames without detections, found again, lost for good and removed."""
    box = ("body", 100.0, 100.0, 50.0, 100.0, 0.9)
    rows = [(0, f, 0, *box) for f in (0, 1, 2, 10, 11)]  # 3 to 9 have no detection in any class
    rows += [(0, 5, 0, "face", 500.0, 500.0, 20.0, 20.0, 0.9), (0, 60, 0, "face", 900.0, 100.0, 20.0, 20.0, 0.9)]
    rows += [(0, 1, 1, "body", 700.0, 700.0, 50.0, 50.0, 0.4)]  # unsure: starts no track
    got = [(r.frame_id, r["class"], r.track_id, r.state) for r in tracker.track(spark.createDataFrame(rows, DETECTIONS)).orderBy("frame_id", "track_id").collect()]
    assert got == [(0, "body", 1, "New"), (1, "body", 1, "Tracked"), (2, "body", 1, "Tracked"), (5, "face", 2, "New"), (10, "body", 1, "Tracked"), (11, "body", 1, "Tracked"), (42, "body", 1, "Removed"), (60, "face", 3, "New")]
    unsure = [(0, 0, 0, *box), (0, 1, 0, *box), (0, 2, 0, "body", 100.0, 100.0, 50.0, 100.0, 0.3), (0, 3, 0, *box)]
    got = [(r.frame_id, r.track_id, r.state) for r in tracker.track(spark.createDataFrame(unsure, DETECTIONS)).orderBy("frame_id").collect()]
    assert got == [(0, 1, "New"), (1, 1, "Tracked"), (2, 1, "Tracked"), (3, 1, "Tracked")]


def test_batches_do_not_matter(spark):
    """Streams cut into Arrow batches of three rows: the same tracks."""
    rows = [(s, *r[1:]) for s in range(3) for r in walk(20, s)]
    df = spark.createDataFrame(rows, DETECTIONS)
    key = lambda: sorted(tuple(r) for r in tracker.track(df).collect())
    want = key()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert key() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_track_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(walk(), DETECTIONS)
    for k, (a, b) in enumerate([(0, 4), (4, 9), (9, 99)]):
        df.where(F.col("frame_id").between(a, b - 1)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = tracker.track_stream(stream).writeStream.format("memory").queryName("tracks").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: sorted((r.frame_id, r.track_id, r.state) for r in d.collect())
    assert key(spark.table("tracks")) == key(tracker.track(df))


def test_classes_of_a_stream_are_tasks_of_their_own(spark, monkeypatch):
    """One stream of three classes: more than one task follows it, and its tracks, their ids among them, are those of one tracker frame by frame."""
    rng, rows = np.random.default_rng(3), []
    for f in sorted({*range(0, 3000, 2), *range(700, 760), *range(5000, 5090)}):
        for k, kind in enumerate(("body", "face", "plate")):
            if f > 5030 and kind != "face":  # the others' lost tracks are removed while only faces go on
                continue
            for j in range(int(rng.integers(0, 4))):
                rows.append((0, f, 4 * k + j, kind, 100.0 * float(rng.integers(0, 4)) + float(rng.normal()), 50.0, 60.0 + k, 80.0, float(rng.choice([0.3, 0.6, 0.9, np.nan], p=[0.3, 0.3, 0.35, 0.05]))))
    df, dealt = spark.createDataFrame(rows, DETECTIONS), []
    monkeypatch.setattr(tracker, "checkpointed", lambda d, f=tracker.checkpointed: dealt.append(f(d)) or dealt[0])
    got = sorted(tuple(r)[1:] for r in tracker.track(df).collect())
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTIONS.split(", ")]).sort_values(["frame_id", "class", "score", "idx"], ascending=[True, True, False, True])
    assert got == sorted(tracker.StreamTracker().rows(frame))
    assert {"New", "Tracked", "Removed"} == {r[3] for r in got}
    assert dealt[0].select(F.spark_partition_id()).distinct().count() > 1
