import zlib

import numpy as np
import pytest
from inkstream.operators import pixels
from inkstream.plans import pipelines as pl
from inkstream.plans.fixtures import Inputs
from pyspark.sql import functions as F


def test_settings_are_typed():
    s = pl.Settings.read({"track_disable": True, "body_confidence": 0.7, "face_max_count": 2, "push_strategy": "FAST"})
    assert s.track_disable and s.classes["body"].confidence == 0.7 and s.classes["face"].max_count == 2
    for bad in ({"nothing": 1}, {"track_disable": 1}, {"push_strategy": "SOME"}, {"body_confidence": "x"}):
        with pytest.raises(pl.ConfigError):
            pl.Settings.read(bad)


def test_follow_and_push(spark, folder):
    d = Inputs(spark, folder).detection()
    s = pl.Settings.read({"push_disable": False, "push_strategy": "FAST", "body_max_count": 1})
    items = pl.follow(d, s)
    assert items.where("state not in ('NEW', 'UPDATE', 'DIE')").count() == 0 and items.count() > 0
    per = pl.filtered(d, s).where("class = 'body'").groupBy("stream_id", "frame_id").count()
    assert per.agg(F.max("count")).first()[0] == 1
    out = pl.pushed(d, s)
    assert out.count() == out.select("stream_id", "class", "track_id").distinct().count() > 0
    assert pl.follow(d, pl.Settings(track_disable=True)).where("track_id is not null").count() == 0
    with pytest.raises(pl.ConfigError):
        pl.pushed(d, pl.Settings())


def test_observe(spark):
    heat = spark.createDataFrame([(1, 0, y, x, 0.9) for y in range(3) for x in range(5)] + [(1, 1, 8, 8, 0.9)], "image_id int, tile_id int, y int, x int, val float")
    readings = spark.createDataFrame([(1, 0, "hello", 0.5, True), (1, 1, "", 0.1, True)], "image_id int, ord int, text string, confidence double, success boolean")
    screens = spark.createDataFrame([(1, 20, 10)], "image_id int, width int, height int")
    o = pl.observe(heat, readings, screens, least_pixels=2).first().observation
    assert o.ocr.text == "hello" and o.ocr.blocks[0].bbox == [0, 0, 6, 4] and o.ocr.confidence == 0.5


def test_pixels():
    a = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    assert (pixels.resize(a, 2, 3, "nearest") == a[::2, ::2]).all()
    assert (pixels.resize(a, 2, 3, "area") == np.rint(a.reshape(2, 2, 3, 2, 3).astype(float).mean((1, 3)))).all()
    assert pixels.resize(np.full((5, 7, 3), 9, np.uint8), 11, 3).tolist() == np.full((11, 3, 3), 9).tolist()
    box = pixels.letterbox(np.full((1080, 1920, 3), 255, np.uint8), 480, 640, "nearest")
    assert not box[:60].any() and box[60:420].all() and not box[420:].any()
    assert pixels.crop(a, -1, -1, 2, 2)[0].sum() == 0 and (pixels.crop(a, -1, -1, 2, 2)[1:, 1:] == a[:2, :2]).all()
    assert len(pixels.bgr_to_nv12(a)) == 36
    raw = pixels.png(a)
    at = raw.index(b"IDAT")
    data = zlib.decompress(raw[at + 4 : raw.index(b"IEND") - 8])
    assert np.frombuffer(data, np.uint8).reshape(4, 19)[:, 1:].reshape(4, 6, 3)[..., ::-1].tolist() == a.tolist()


def test_pixels_in_spark(spark):
    df = spark.createDataFrame([(bytes(range(24)), 2, 4), (None, 2, 4)], "data binary, h int, w int")
    r = df.select(pixels.letterboxed("data", "h", "w", 4, 4, "nearest"), pixels.png_of("data", "h", "w"), pixels.nv12_of("data", "h", "w")).collect()
    assert len(r[0][0]) == 48 and r[0][1][:4] == b"\x89PNG" and len(r[0][2]) == 12 and r[1][0] is None


def test_settings_of_several_parts():
    """All keys of the tracking pipeline, by their customary names."""
    s = pl.Settings.read(
        {
            "track_disable": False, "push_disable": False, "push_strategy": {"mode": "INTERVAL", "interval_ms": 500, "counts": 3, "same_frame": True}, "target_config": ["body", "face"],
            "body_max_target_count": 3, "vehicle_max_target_count": 2, "cycle_max_target_count": 1, **{f"{c}_confidence": 0.6 for c in pl.CLASSES}, **{f"{c}_min_size": (10, 20) for c in pl.CLASSES},
            "detect_roi": {"enable": True, "rect": [0, 0, 100, 50]}, "crop_encoder": 0.2, "crop_encoder_qpLevel": 70, "resize_panorama_encoder_config": {"enable": True, "size": [960, 540]}, "push_panorama": {"enable": True, "quality": 80},
            "push_quality_body": 0.1, "push_quality_vehicle": 0.2, "push_quality_cycle": 0.3, "push_quality_face": {"width": 40, "height": 50, "pitch": 30, "yaw": 20, "roll": 10, "blur": 0.5}, "push_quality_plate": 0.4,
        }
    )
    assert (s.push_strategy, s.push_interval_ms, s.push_counts, s.push_same_frame, s.target_config, s.detect_roi) == ("INTERVAL", 500, 3, True, ("body", "face"), (0, 0, 100, 50))
    assert (s.push_panorama, s.panorama_quality, s.panorama_size, s.crop_quality) == (True, 80.0, (960, 540), 70.0)
    face, body = s.classes["face"], s.classes["body"]
    assert (face.crop_w, face.crop_h, face.pitch, face.yaw, face.roll, face.blur, face.min_w, face.min_h) == (40, 50, 30, 20, 10, 0.5, 10, 20)
    assert (body.max_count, body.confidence, body.quality, body.expand) == (3, 0.6, 0.1, 0.2)
    p = s.push_settings(4)
    assert p.enabled and p.version == 4 and p.most == 3 and not p.admits("face", 1.0, 0, 0, 39, 50) and p.admits("face", 0.0, 0, 0, 40, 50)
    assert pl.Settings.read({"detect_roi": {"enable": False}}, s).detect_roi is None
    for bad in ({"body_min_size": 5}, {"detect_roi": {"side": 1}}, {"push_strategy": {"mode": "SLOW"}}, {"push_counts": True}, {"target_config": "body"}, {"face_max_size": 3}):
        with pytest.raises(pl.ConfigError):
            pl.Settings.read(bad)


def test_pipeline_reads_and_changes_its_settings(spark):
    from datetime import datetime

    from inkstream import errors
    from inkstream.streaming.dealer import PushSettings

    p = pl.Pipeline()
    assert p.get_config("track_disable", "push_disable", "body_confidence") == {"track_disable": False, "push_disable": True, "body_confidence": 0.55}
    p.set_config({"push_disable": False, "push_strategy": "FAST"})
    with pytest.raises(pl.ConfigError):
        p.set_config({"push_counts": 5, "nothing": 1})
    assert p.get_config("push_counts", "push_strategy") == {"push_counts": 1, "push_strategy": "FAST"} and p.version == 1
    row = p.control(spark, datetime(2026, 1, 1)).first()
    assert PushSettings.of(row.settings).mode == "FAST" and PushSettings.of(row.settings).version == 1
    p.close()
    with pytest.raises(errors.InvalidHandle):
        p.get_config()
    assert len({e.name for e in errors.EngineError.__subclasses__()}) == len(errors.EngineError.__subclasses__()) == 12


def test_limit_of_tracks_and_dealing(spark, folder):
    items = spark.createDataFrame([(0, 1, t, c) for t, c in ((5, "body"), (3, "body"), (9, "body"), (1, "face"), (2, "face"))], "stream_id int, frame_id long, track_id long, class string")
    s = pl.Settings.read({"body_max_target_count": 2, "face_max_count": 1})
    assert sorted(x.track_id for x in pl.limit_tracks(items, s).collect()) == [1, 2, 3, 5]
    d = Inputs(spark, folder).detection()
    out = pl.dealt(d, pl.Settings.read({"push_disable": False, "push_strategy": "FAST"})).cache()
    tracks = pl.follow(d, pl.Settings()).where("state = 'NEW'").count()
    assert out.where("event = 'SELECT'").count() > 0 and out.select("stream_id", "class", "track_id").distinct().count() <= tracks
    assert pl.dealt(d, pl.Settings()).count() == 0
