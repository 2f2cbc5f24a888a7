"""Dealing with tracks, frames and snapshots: streams against batches, and both against a replay of every millisecond."""

import dataclasses
import random
from datetime import UTC, datetime, timedelta

import pytest
from inkstream.streaming import dealer
from inkstream.streaming.dealer import PushSettings
from pyspark.sql import functions as F

ITEMS = "stream_id int, class string, track_id long, frame_id long, ts timestamp, state string, score double, x double, y double, w double, h double"
EPOCH = datetime(2026, 1, 1, tzinfo=UTC)
SETTINGS = PushSettings(interval_ms=7, idle_ms=20, most=2, classes=(("body", 10, 10, 0.3, 0, 0), ("face", 5, 5, 0.9, 20, 20)))


def at(ms):
    return EPOCH + timedelta(milliseconds=ms)


def ms(t):
    return round((t.replace(tzinfo=UTC) - EPOCH) / timedelta(milliseconds=1))


def items(seed, n=60, span=150):
    """Tracks of two classes seen at some frames, a few at equal times; (stream, class, track, frame, ms, state, score, w)."""
    r, out = random.Random(seed), []
    for track in range(6):
        t = r.randrange(span)
        out.append((0, r.choice(("body", "face")), track, t, t, "NEW"))
        for _ in range(r.randrange(n // 6)):
            t += r.choice((0, 1, 2, 3, 5, 9, 15, 25))
            out.append((0, out[-1][1], track, 1000 + t + len(out), t, r.choice(("UPDATE",) * 12 + ("DIE", "NEW", "LOST"))))
    return [(*x, round(r.random(), 2), r.choice((4, 15, 30))) for x in out]


def frame(spark, rows):
    return spark.createDataFrame([(s, c, k, f, at(t), state, score, 1.0, 1.0, float(w), 40.0) for s, c, k, f, t, state, score, w in rows], ITEMS)


def replayed(rows, settings, control=()):
    """(track, event, at, frame, score, pushes, version) by asking every track at every millisecond."""
    size = {c[0]: c for c in settings.classes}
    tracks, out = {}, []
    rows = sorted(rows, key=lambda x: (x[4], x[3]))

    def admitted(t):
        _, min_w, _, quality, crop, _ = size[t["class"]]
        return t["score"] > 0 and t["w"] >= min_w and (t["w"] >= crop if t["class"] == "face" else t["score"] >= quality)

    def ask(k, now):
        t = tracks[k]
        push = lambda: out.append((k, "SELECT", now, t["frame"], t["score"], t["pushes"], settings.version))
        if settings.mode != "BEST" and admitted(t):
            first = settings.mode == "FAST" and t["state"] == "NEW"
            if (t["pushes"] == 0) if first else now - t["pushed"] >= settings.interval_ms:
                t["pushes"] += 1
                push()
                t["pushed"], t["score"] = now, 0.0
        if now - t["updated"] > settings.idle_ms or (settings.mode == "BEST" and t["state"] == "DIE"):
            if settings.mode == "BEST" and t["updates"] >= settings.least and admitted(t):
                t["pushes"] += 1
                push()
            else:
                out.append((k, "DIE", now, t["frame"], t["score"], t["pushes"], settings.version))
            del tracks[k]

    for now in range(600):
        for when, new in control:
            if when == now:
                if new.restarts(settings):
                    tracks.clear()
                settings = new
                size = {c[0]: c for c in settings.classes}
                for k in list(tracks):
                    ask(k, now)
        for _, kind, k, f, when, state, score, w in rows:
            if when != now or state not in ("NEW", "UPDATE", "DIE") or not settings.enabled:
                continue
            if k not in tracks:
                if state != "NEW":
                    continue
                tracks[k] = {"updates": 1, "pushes": 0, "pushed": now, "score": -1.0}
            else:
                t = tracks[k]
                if settings.mode != "BEST" and (state == "DIE" or (state == "UPDATE" and t["pushes"] >= settings.most)):
                    del tracks[k]
                    continue
                if state == "NEW":
                    t["pushed"] = now if settings.mode == "INTERVAL" else t["pushed"]
                else:
                    t["updates"] += 1
            t = tracks[k]
            if state == "NEW" or score > t["score"]:
                t |= {"frame": f, "score": score, "w": w, "class": kind}
            t |= {"state": state, "updated": now}
            ask(k, now)
        for k in list(tracks):
            ask(k, now)
    return sorted(out)


def got(df):
    return sorted((r.track_id, r.event, ms(r["at"]), r.frame_id, r.score, r.pushes, r.version) for r in df.collect())


def streamed(spark, path, parts, make, schema, watermark="ts", delay="40 milliseconds", name=None):
    """The rows of a stream that reads ``parts`` one by one, then rows of far later to let the watermark pass."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/in/{k:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*").withWatermark(watermark, delay)
    q = make(source).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.read.schema(q.lastProgress and make(source).schema).parquet(f"{path}/out"), q


def later(n):
    """An item of another stream, far later."""
    return (9, "body", 0, 0, at(100_000 * (n + 1)), "UPDATE", 0.5, 1.0, 1.0, 30.0, 40.0)


@pytest.mark.parametrize("mode", dealer.MODES)
@pytest.mark.parametrize("seed", range(4))
def test_deal_is_the_replay(spark, mode, seed):
    s = dataclasses.replace(SETTINGS, mode=mode)
    rows = items(seed)
    assert got(dealer.deal(frame(spark, rows), s)) == replayed(rows, s)


@pytest.mark.parametrize("mode", dealer.MODES)
def test_stream_is_the_replay_for_any_arrival(spark, tmp_path, mode):
    """Rows in small files, up to 40 ms out of order across files, equal times among them."""
    s = dataclasses.replace(SETTINGS, mode=mode)
    rows = items(11)
    r = random.Random(5)
    order = sorted(rows, key=lambda x: x[4] + r.uniform(0, 39))
    parts = [[(a, c, k, f, at(t), state, score, 1.0, 1.0, float(w), 40.0) for a, c, k, f, t, state, score, w in order[i : i + 12]] for i in range(0, len(order), 12)]
    df, q = streamed(spark, tmp_path, [*parts, [later(0)], [later(1)]], lambda x: dealer.deal_stream(x, s), ITEMS)
    assert got(df.where("stream_id = 0")) == replayed(rows, s)
    assert sum(p["numRowsTotal"] for p in q.lastProgress["stateOperators"]) <= 4  # nothing of the finished tracks stays


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    s = dataclasses.replace(SETTINGS, mode="FAST")
    new = lambda k, t: (0, "body", k, t, at(t), "NEW", 0.9, 1.0, 1.0, 30.0, 40.0)
    df, _ = streamed(spark, tmp_path, [[new(1, 0)], [new(2, 500)], [new(3, 501)], [new(4, 10)], [later(0)], [later(1)]], lambda x: dealer.deal_stream(x, s), ITEMS)
    assert {r.track_id for r in df.where("event = 'SELECT'").collect()} == {1, 2, 3}


def control(spark, changes):
    return spark.createDataFrame([(at(t), s.text()) for t, s in changes], "ts timestamp, settings string")


CHANGES = [(60, dataclasses.replace(SETTINGS, mode="INTERVAL", version=1)), (90, dataclasses.replace(SETTINGS, mode="INTERVAL", version=2, classes=(("body", 1, 1, 0.0, 0, 0), ("face", 1, 1, 0.0, 1, 1)))), (120, dataclasses.replace(SETTINGS, enabled=False, version=3)), (150, dataclasses.replace(SETTINGS, mode="FAST", version=4))]


@pytest.mark.parametrize("seed", range(3))
def test_settings_change_in_mid_track(spark, seed):
    """Another mode forgets the tracks at its moment; other sizes don't, and make due what they admit; off is off."""
    s = dataclasses.replace(SETTINGS, mode="FAST")
    rows = items(20 + seed)
    df = dealer.deal(frame(spark, rows), s, control(spark, CHANGES), ["body", "face"], [0, 9])
    want = replayed(rows, s, CHANGES)
    assert got(df) == want and len({x[-1] for x in want}) > 1


def test_settings_change_of_a_stream(spark, tmp_path):
    s = dataclasses.replace(SETTINGS, mode="FAST")
    rows = items(31)
    parts = [[(a, c, k, f, at(t), state, score, 1.0, 1.0, float(w), 40.0) for a, c, k, f, t, state, score, w in sorted(rows, key=lambda x: x[4])[i::3]] for i in range(3)]
    settings = spark.createDataFrame([(at(t), x.text()) for t, x in CHANGES], "ts timestamp, settings string").coalesce(1)
    settings.write.parquet(f"{tmp_path}/settings/0")
    spark.createDataFrame([(at(400_000), CHANGES[-1][1].text())], settings.schema).coalesce(1).write.parquet(f"{tmp_path}/settings/1")
    told = spark.readStream.schema(settings.schema).parquet(f"{tmp_path}/settings/*").withWatermark("ts", "1 second")
    df, _ = streamed(spark, tmp_path, [*parts, [later(0)], [later(1)]], lambda x: dealer.deal_stream(x, s, told, ["body", "face"], [0]), ITEMS, delay="1 second")
    assert got(df.where("stream_id = 0")) == replayed(rows, s, CHANGES)


def test_settings_text():
    s = PushSettings(mode="FAST", roi=(0, 0, 10, 10), classes=(("body", 1, 2, 0.5, 0, 0),))
    assert PushSettings.of(s.text()) == s
    assert s.admits("body", 0.5, 0, 0, 10, 10) and not s.admits("body", 0.5, 1, 0, 10, 10) and not s.admits("body", 0.4, 0, 0, 10, 10) and s.admits("cycle", 0.0, 0, 0, 1, 1)
    with pytest.raises(ValueError, match="SLOW"):
        PushSettings(mode="SLOW")


def test_edges(spark):
    s = dataclasses.replace(SETTINGS, mode="FAST")
    assert dealer.deal(spark.createDataFrame([], ITEMS), s).count() == 0
    rows = [(0, "body", 1, 1, at(0), "NEW", None, None, None, None, None), (0, "body", 1, 2, at(5), None, 0.9, 1.0, 1.0, 30.0, 30.0), (0, "body", 2, 1, at(0), "NEW", 0.9, 1.0, 1.0, 30.0, 30.0), (0, "body", 2, 1, at(0), "NEW", 0.9, 1.0, 1.0, 30.0, 30.0)]
    df = spark.createDataFrame(rows, ITEMS).withColumns({"event": F.lit("clash"), "bucket": F.lit(1), "us": F.lit(2)})
    assert [x[:4] for x in got(dealer.deal(df, s))] == [(1, "DIE", 21, 1), (2, "DIE", 21, 1), (2, "SELECT", 0, 1)]


# --- frames


def held_frames(uses, acks, patience):
    """(frame, at, cause, uses) by hand: holders of each frame in the order of time, holds before what lets go."""
    rows = sorted([(t, 0 if e == "HOLD" else 1, f, k) for f, k, e, t in uses] + [(t, 1, f, k) for f, k, t in acks])
    out, held = [], {}
    for f in {r[2] for r in rows}:
        holders, count, last = set(), 0, None
        for t, action, _, k in [r for r in rows if r[2] == f]:
            if holders and t > last + patience + 1:
                out.append((f, last + patience + 1, "abandoned", count))
                holders, count = set(), 0
            if action == 0:
                holders.add(k)
                count, last = count + 1, t
            elif k in holders:
                holders.discard(k)
                last = t
                if not holders:
                    out.append((f, t, "released", count))
                    count = 0
        if holders:
            out.append((f, last + patience + 1, "abandoned", count))
    del held
    return sorted(out)


def frames_of(df):
    return sorted((r.frame_id, ms(r["at"]), r.cause, r.uses) for r in df.collect())


@pytest.mark.parametrize("mode", dealer.MODES)
def test_frames_go_with_their_last_track(spark, mode):
    s = dataclasses.replace(SETTINGS, mode=mode)
    dealt = dealer.deal(frame(spark, items(3)), s, uses=True).cache()
    rows = dealt.collect()
    uses = [(r.frame_id, r.track_id, r.event, ms(r["at"])) for r in rows if r.event in ("HOLD", "DROP")]
    acks = [(r.frame_id, r.track_id, ms(r["at"]) + 2) for r in rows if r.event == "SELECT"] + [(77, 1, 5)]
    df = spark.createDataFrame([(0, f, k, at(t)) for f, k, t in acks], "stream_id int, frame_id long, track_id long, ts timestamp")
    want = held_frames(uses, acks, 30)
    assert frames_of(dealer.released_frames(dealt, df, 30)) == want and want
    assert {x[0] for x in want} == {u[0] for u in uses}  # every frame goes


def test_frames_of_a_stream(spark, tmp_path):
    """Two streams of holds and acks in any order; the state is empty once all frames are gone."""
    dealt_schema = "stream_id int, frame_id long, track_id long, event string, at timestamp"
    r = random.Random(2)
    uses = [(f, k, "HOLD", 3 * f + k) for f in range(40) for k in range(r.randrange(1, 4))]
    drops = [(f, k, "DROP", t + r.randrange(1, 30)) for f, k, _, t in uses if r.random() < 0.5]
    acks = [(f, k, t + 9) for f, k, _, t in uses if r.random() < 0.6 and (f, k) not in {x[:2] for x in drops}]
    every = uses + drops
    r.shuffle(every)
    rows = [(0, f, k, e, at(t)) for f, k, e, t in every]
    parts = [rows[i::4] for i in range(4)] + [[(9, 0, 0, "HOLD", at(10**6 * i))] for i in (1, 2)]
    ack_schema = "stream_id int, frame_id long, track_id long, ts timestamp"
    for i, part in enumerate(([(0, f, k, at(t)) for f, k, t in acks], [(9, 1, 0, at(3 * 10**6))])):
        spark.createDataFrame(part, ack_schema).coalesce(1).write.parquet(f"{tmp_path}/acks/{i}")
    told = spark.readStream.schema(ack_schema).parquet(f"{tmp_path}/acks/*").withWatermark("ts", "10 seconds")
    df, q = streamed(spark, tmp_path, parts, lambda x: dealer.released_frames_stream(x, told, 50), dealt_schema, "at", "10 seconds")
    assert frames_of(df.where("stream_id = 0")) == held_frames(uses + drops, acks, 50)
    assert sum(p["numRowsTotal"] for p in q.lastProgress["stateOperators"]) <= 4


# --- snapshots


def test_attached_snapshots(spark, tmp_path):
    """Pushes and frames that come in any order: the batch join's rows; a missing frame gives none."""
    pushed = [(0, f, k, at(10 * f + 5), 0.5) for f in range(20) for k in range(2)]
    frames = [(0, f, at(10 * f), f"p{f}".encode()) for f in range(20) if f % 5]
    r = random.Random(1)
    r.shuffle(pushed)
    r.shuffle(frames)
    far = lambda i: at(10**6 * (i + 1))
    for i in range(3):
        spark.createDataFrame(frames[i::3], "stream_id int, frame_id long, ts timestamp, panorama binary").coalesce(1).write.parquet(f"{tmp_path}/frames/{i}")
    for i in (3, 4):
        spark.createDataFrame([(9, 0, far(i), b"x")], "stream_id int, frame_id long, ts timestamp, panorama binary").coalesce(1).write.parquet(f"{tmp_path}/frames/{i}")
    source = spark.readStream.schema("stream_id int, frame_id long, ts timestamp, panorama binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/frames/*").withWatermark("ts", "10 seconds")
    parts = [pushed[i::3] for i in range(3)] + [[(9, 1, 0, far(i), 0.1)] for i in (3, 4)]
    df, _ = streamed(spark, tmp_path, parts, lambda x: dealer.attach_stream(x, source), "stream_id int, frame_id long, track_id long, at timestamp, score double", "at", "10 seconds")
    found = sorted((r.frame_id, r.track_id, r.panorama and bytes(r.panorama)) for r in df.where("stream_id = 0").collect())
    assert found == sorted((f, k, f"p{f}".encode() if f % 5 else None) for _, f, k, _, _ in pushed)


def test_panoramas_off_and_crops(spark):
    pushed = spark.createDataFrame([(0, "face", 10.0, 10.0, 40.0, 40.0), (0, "none", 1.0, 2.0, 3.0, 4.0)], "stream_id int, class string, x double, y double, w double, h double")
    assert [r.panorama for r in dealer.attach_stream(pushed, None, panorama=False).collect()] == [None, None]
    config = spark.createDataFrame([("face", 0.5)], "class string, expand double")
    cut = {r["class"]: (r.left, r.top, r.right, r.bottom) for r in dealer.crops(pushed, config, 60, 1000).collect()}
    assert cut == {"face": (0.0, 0.0, 60.0, 70.0), "none": (1.0, 2.0, 4.0, 6.0)}
