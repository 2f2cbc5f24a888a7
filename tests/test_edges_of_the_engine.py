"""Sources, sinks, streams and the command line at work on files, servers and folders of their own."""

import http.server
import json
import threading

import numpy as np
import pytest
from inkstream.functions import observations
from inkstream.operators import pixels
from inkstream.sources import files, sinks, snapshots
from inkstream.streaming import dedup
from pyspark.sql import functions as F


def serve(answer):
    """A server on a free port; ``answer(method, body)`` gives status and body. Its requests are kept."""
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def _do(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            seen.append((self.command, body))
            status, out = answer(self.command, body)
            self.send_response(status)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = _do

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_address[1]}/", seen


def pictures(folder):
    for day, names in (("2026-01-01", ("a.png", "b.txt")), ("2026-01-02", ("c.png",))):
        (folder / day).mkdir(parents=True)
        for n in names:
            (folder / day / n).write_bytes(pixels.png(np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)) if n.endswith("png") else b"no picture")


def test_images_and_folders(spark, tmp_path):
    pictures(tmp_path)
    got = files.images(spark, f"file://{tmp_path}").collect()
    assert [(r.height, r.width, r.nChannels, bytes(r.data)) for r in got] == [(4, 6, 3, bytes(range(72)))] * 2
    assert sorted(r.folder.rpartition("/")[2] for r in files.folders(spark, f"file://{tmp_path}").collect()) == ["2026-01-01", "2026-01-02"]


def test_polled_folder_gives_each_file_once(spark, tmp_path):
    pictures(tmp_path / "in")
    seen = []
    stream = files.poll(spark, f"file://{tmp_path}/in", "*.png")
    for k in range(2):
        q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda df, _: seen.append([r.path.rpartition("/")[2] for r in df.collect()])).start()
        q.processAllAvailable()
        q.stop()
        if not k:
            (tmp_path / "in" / "2026-01-02" / "d.png").write_bytes(b"x")
    assert sorted(sum(seen, [])) == ["a.png", "c.png", "d.png"] and all(len(b) <= 1 for b in seen)


def test_frames_of_producers(spark, tmp_path):
    spark.createDataFrame([(0, 1), (0, 2)], "stream_id int, frame_id long").write.parquet(f"{tmp_path}/in/0")
    q = files.frames(spark, "stream_id int, frame_id long", f"{tmp_path}/in/*").writeStream.format("memory").queryName("frames_of").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.frame_id for r in spark.table("frames_of").collect()) == [1, 2]


def test_tensors(spark):
    t = files.model_tensors(spark, [("m", "in", [1, 720, 960, 1], "NHWC", "u8"), ("m", "out", [2, 3], "NCHW", "f32"), ("m", "wide", [2], "NCHW", "f64")])
    assert {r.name: r.bytes for r in t.collect()} == {"in": 691200, "out": 24, "wide": 16}


def test_http_snapshots(spark):
    """A server that fails once is asked again; one that isn't there is a row with an error."""
    tries = []

    def answer(*_):
        tries.append(1)
        return (500, b"") if len(tries) == 1 else (200, b"picture")

    server, url, _ = serve(answer)
    snapshots.register(spark)
    r = spark.read.format("snapshot").option("url", url).load().first()
    assert (r.ok, r.size, bytes(r.content), r.error) == (True, 7, b"picture", None) and len(tries) == 2
    server.shutdown()
    server.server_close()
    bad = spark.read.format("snapshot").option("url", url).option("timeout", "1").load().first()
    assert not bad.ok and bad.error


def documents(spark):
    blocks = spark.createDataFrame([(1, 0, 0, 1, 2, 3, 4, "one", 0.5), (2, 0, 0, 1, 1, 2, 2, "two", 0.25), (2, 1, 2, 5, 5, 6, 6, "é", 1.0)], "image_id int, ord int, sub_idx int, x1 int, y1 int, x2 int, y2 int, text string, confidence double")
    return blocks, spark.createDataFrame([(1, 10, 10), (2, 10, 10), (3, 10, 10)], "image_id int, width int, height int")


def test_uploads(spark, tmp_path):
    """Documents with blocks are posted; the answer decides; a refused connection is a no."""
    server, url, seen = serve(lambda _, body: (200, b'{"ok": true}' if "one" in body else b'{"ok":false}'))
    blocks, screens = documents(spark)
    o = spark.createDataFrame([(i, (json.dumps({"n": n}), n)) for i, n in ((1, 1), (2, 0), (3, 2))], "image_id int, x struct<t:string,n:int>")
    observed = o.select("image_id", F.struct(F.struct(F.col("x.n").alias("block_count"), F.when(F.col("image_id") == 1, "one").otherwise("two").alias("text")).alias("ocr")).alias("observation"))
    assert {r.image_id: r.accepted for r in sinks.upload(observed, url).collect()} == {1: True, 3: False}
    assert len(seen) == 2 and all(m == "POST" and json.loads(b)["ocr"]["block_count"] for m, b in seen)
    server.shutdown()
    server.server_close()
    assert {r.accepted for r in sinks.upload(observed, url).collect()} == {False}


def test_text_results(spark, tmp_path):
    blocks, _ = documents(spark)
    lines = observations.text_lines(blocks.withColumnRenamed("ord", "box_idx"))
    assert [r.line for r in lines.orderBy("image_id", "line").collect()] == ["Box 0: [1, 2, 3, 4] one 0.5000", "Box 0: [1, 1, 2, 2] two 0.2500", "Box 1_2: [5, 5, 6, 6] é 1.0000"]
    sinks.write_lines(lines, f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").count() == 3


def test_timings_append(spark, tmp_path):
    for k in range(2):
        sinks.append_timings(spark.createDataFrame([(k, "detect", 5)], "run int, stage string, ms int"), f"file://{tmp_path}/log")
    assert sorted(r.run for r in spark.read.csv(f"file://{tmp_path}/log", header=True, inferSchema=True).collect()) == [0, 1]
    newest = sinks.newest_of_batch(spark.range(10).withColumnRenamed("id", "frame_id"), 3)
    assert sorted(r.frame_id for r in newest.collect()) == [7, 8, 9]


def test_changed_frames_of_a_stream_are_those_of_the_table(spark, tmp_path):
    r = np.random.default_rng(4)
    rows, last = [], r.random(5)
    for f in range(30):
        last = last if r.random() < 0.5 else r.random(5)
        rows.append((f % 2, f, (last + r.normal(0, 0.001, 5)).tolist()))
    schema = "stream_id int, frame_id long, pixels array<double>"
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = dedup.keep_changed_stream(stream).writeStream.format("memory").queryName("changed").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.select("stream_id", "frame_id").collect()))
    assert key(spark.table("changed")) == key(dedup.keep_changed(spark.createDataFrame(rows, schema)))


def test_command_line(spark, folder, tmp_path, capsys):
    from inkstream.__main__ import main

    assert main(["list"]) == 0
    assert "dealt_best" in capsys.readouterr().out.split()
    assert main(["query", "tile_grid", folder, "--out", f"{tmp_path}/grid"]) == 0
    assert spark.read.parquet(f"{tmp_path}/grid").count() > 0
    with pytest.raises(SystemExit):
        main(["nothing"])
    (tmp_path / "s.json").write_text('{"track_disable": true}')
    d = [(0, 1, 0, "body", 0.0, 0.0, 50.0, 50.0, 0.9), (0, 1, 1, "none", 0.0, 0.0, 50.0, 50.0, 0.1)]
    spark.createDataFrame(d, "stream_id int, frame_id long, idx int, class string, x double, y double, w double, h double, score double").write.parquet(f"{tmp_path}/d")
    assert main(["follow", f"{tmp_path}/d", f"{tmp_path}/items", "--config", str(tmp_path / "s.json")]) == 0
    assert [r["class"] for r in spark.read.parquet(f"{tmp_path}/items").collect()] == ["body"]


def test_changed_frames_across_batches_and_nulls(spark):
    rows = [(s, f, None if f % 7 == 3 else [] if f % 7 == 5 else [float(x) for x in np.random.default_rng(f // 2).random(4)]) for s in (0, 1, None) for f in range(40)]
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(x.stream_id, x.frame_id) for x in dedup.keep_changed(spark.createDataFrame(rows, "stream_id int, frame_id int, pixels array<double>")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    want, last = set(), {}
    for s, f, p in rows:
        if s is not None and (not p or not last.get(s) or np.corrcoef(last[s], p)[0, 1] < 0.95):
            want.add((s, f))
            last[s] = p
    assert got == want
