import json
import socket
import threading

from inkstream.sources import files, sinks, snapshots


def test_settings():
    text = '# c\n; d\n[x]\nsocket = "/tmp/a b" # why\ninterval_s= 3 ; s\nbad line\nsimilarity = 0.9\n'
    assert files.settings(text) == {"socket": "/tmp/a b", "interval_s": "3", "similarity": "0.9"}
    c = files.Capture.read(text)
    assert (c.socket, c.interval_s, c.similarity, c.max_images) == ("/tmp/a b", 3, 0.9, 1000)


def test_dictionary_and_listing(spark, tmp_path):
    (tmp_path / "d.txt").write_text("a\n\nb\r\n  c\n")
    assert [tuple(r) for r in files.dictionary(spark, f"file://{tmp_path}/d.txt").orderBy("dict_idx").collect()] == [(0, "a"), (1, "b"), (2, "  c")]
    (tmp_path / "2026-01-01").mkdir()
    for n in ("a.jpg", "b.PNG", "c.jpeg", "det_V1.2.axmodel"):
        (tmp_path / "2026-01-01" / n).write_bytes(b"x")
    assert sorted(r.name for r in files.listing(spark, f"file://{tmp_path}/2026-01-01").collect()) == ["a.jpg", "b.PNG"]
    assert [(r.model, r.version) for r in files.models(spark, f"file://{tmp_path}/2026-01-01", ("det", "rec")).collect()] == [("det", "1.2")]


def test_frames_and_memory(spark, tmp_path):
    (tmp_path / "f.nv12").write_bytes(bytes(range(24)))
    r = files.frame_files(spark, f"file://{tmp_path}/f.nv12", 4, 4).first()
    assert [len(p) for p in r.planes] == [16, 8]
    assert {r.name for r in files.memory(spark).collect()} == {"VmRSS", "VmPeak", "VmSize"}


def test_snapshot_source(spark, tmp_path):
    path = str(tmp_path / "s.sock")
    server = socket.socket(socket.AF_UNIX)
    server.bind(path)
    server.listen()

    def serve():
        for _ in range(2):
            c, _ = server.accept()
            c.recv(1000)
            c.sendall(json.dumps({"ok": True, "size": 5, "width": 2, "height": 1}).encode() + b"\nhel")
            c.sendall(b"lo")
            c.close()

    threading.Thread(target=serve, daemon=True).start()
    snapshots.register(spark)
    r = spark.read.format("snapshot").option("path", path).load().first()
    assert (r.ok, r.size, bytes(r.content), r.error) == (True, 5, b"hello", None)
    bad = spark.read.format("snapshot").option("path", str(tmp_path / "none")).load().first()
    assert not bad.ok and bad.error


def test_sinks(spark, tmp_path):
    b = spark.createDataFrame([(1, 0, 192, 108, 960, 540)], "image_id int, box_idx int, x1 int, y1 int, x2 int, y2 int")
    r = {x.space: (x.x1, x.y2) for x in sinks.detection_spaces(b, 0.5, 0.5).collect()}
    assert r["network"] == (96.0, 270.0) and abs(r["share"][0] - 0.1) < 1e-9
    sinks.write_detections(b, f"file://{tmp_path}/out", 0.5, 0.5)
    assert spark.read.json(f"file://{tmp_path}/out").count() == 3
