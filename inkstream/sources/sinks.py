"""Where results go: JSON and text files, an HTTP store, processed marks, logs."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.observations import to_json
from ..functions.recognition import character_rows


def write_observations(observations: DataFrame, path: str) -> None:
    """One JSON document a line."""
    observations.select(to_json().alias("value")).write.mode("append").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("append").text(path)


def write_characters(readings: DataFrame, dictionary: DataFrame, path: str) -> None:
    """image, place, character and confidence, with tabs between."""
    character_rows(readings, dictionary).select("image_id", "pos", "token", F.round("score", 4).alias("score")).write.mode("append").csv(path, sep="\t")


def write_detections(boxes: DataFrame, path: str, scale_x: float, scale_y: float) -> None:
    """Boxes in the picture's and the network's pixels and as shares of the picture."""
    detection_spaces(boxes, scale_x, scale_y).write.mode("append").json(path)


def detection_spaces(boxes: DataFrame, scale_x: float, scale_y: float) -> DataFrame:
    """image_id, box_idx, space, x1, y1, x2, y2 in three spaces."""
    c = lambda n, f: (F.col(n) * f).cast("double").alias(n)
    space = lambda name, fx, fy: boxes.select("image_id", "box_idx", F.lit(name).alias("space"), c("x1", fx), c("y1", fy), c("x2", fx), c("y2", fy))
    return space("picture", 1.0, 1.0).unionByName(space("network", scale_x, scale_y)).unionByName(space("share", 1 / 1920, 1 / 1080))


def post(url: str, timeout: float = 5.0) -> Callable[[str], str]:
    def send(body: str) -> str:
        r = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(r, timeout=timeout) as answer:
            return answer.read().decode("utf-8", "replace")

    return send


def upload(observations: DataFrame, url: str) -> DataFrame:
    """image_id, accepted: each document with blocks posted by the executors; documents without are skipped."""
    rows = observations.where("observation.ocr.block_count > 0").select("image_id", to_json().alias("body"))
    kind = rows.schema["image_id"].dataType.simpleString()

    def run(frames):
        send = post(url)
        for pdf in frames:
            done = []
            for body in pdf["body"]:
                try:
                    a = send(body)
                    done.append('"ok":true' in a or '"ok": true' in a or '"stored"' in a)
                except OSError:
                    done.append(False)
            yield pdf[["image_id"]].assign(accepted=done)

    return rows.mapInPandas(run, f"image_id {kind}, accepted boolean")


def upload_stream(observations: DataFrame, url: str, checkpoint: str):
    """Uploads of a stream of documents; the checkpoint is what marks a picture as done."""
    return observations.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: upload(df, url).write.format("noop").mode("overwrite").save()).start()


def append_timings(times: DataFrame, path: str) -> None:
    """run, stages and totals appended to a log of CSV files."""
    times.write.mode("append").csv(path, header=True)


def newest_of_batch(df: DataFrame, depth: int, order: str = "frame_id") -> DataFrame:
    """What a queue of ``depth`` that drops its oldest would still hold of a batch."""
    return df.orderBy(F.col(order).desc()).limit(depth)
