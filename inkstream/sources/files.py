"""Images, listings, dictionaries, settings, models, and process memory as tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LISTED_ENDINGS, base_name, directory, ending, model_version


def images(spark: SparkSession, path: str) -> DataFrame:
    """origin, height, width, nChannels, mode, data (BGR, row by row); files that aren't images are left out."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")


def listing(spark: SparkSession, path: str, endings: tuple[str, ...] = LISTED_ENDINGS) -> DataFrame:
    """folder, name, folder_mtime, mtime, length of files with exactly these endings; contents aren't read.

    A folder's time is that of its newest file: stores of objects have no other.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("mtime"), "length")
    files = files.where(ending("path").isin(*endings)).select(directory("path").alias("folder"), base_name("path").alias("name"), "mtime", "length")
    newest = files.groupBy("folder").agg(F.max("mtime").alias("folder_mtime"))
    return files.join(newest, "folder").select("folder", "name", "folder_mtime", "mtime", "length")


def folders(spark: SparkSession, path: str) -> DataFrame:
    """Folders with files, newest first."""
    return listing(spark, path, LISTED_ENDINGS).select("folder", "folder_mtime").distinct().orderBy(F.col("folder_mtime").desc(), "folder")


def poll(spark: SparkSession, path: str, glob: str = "*.jpg", files_per_trigger: int = 1) -> DataFrame:
    """A stream of new files, the newest first; start it with a trigger of 5 seconds to poll as often."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("latestFirst", True).option("maxFilesPerTrigger", files_per_trigger).load(path)


def frames(spark: SparkSession, schema: str, path: str, files_per_trigger: int = 20) -> DataFrame:
    """Frames or detections written by producers as Parquet files; the trigger's bound is the queue's depth."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def frame_files(spark: SparkSession, path: str, width: int, height: int, form: str = "nv12") -> DataFrame:
    """path, form, planes (raw bytes by plane) of files of raw frames; files of another size are an error."""
    from ..operators.geometry import frame_bytes

    size = frame_bytes(F.lit(width), F.lit(height), F.lit(form))
    f = spark.read.format("binaryFile").load(path)
    checked = F.when(F.col("length") == size, F.col("content")).otherwise(F.raise_error(F.format_string("frame of %d bytes", F.col("length"))).cast("binary"))
    luma = width * height
    planes = F.array(F.substring(checked, 1, luma), F.substring(checked, luma + 1, luma // 2)) if form.lower() in ("nv12", "nv21") else F.array(checked)
    return f.select("path", F.lit(form).alias("form"), planes.alias("planes"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """dict_idx (from 0), token: lines without their ends, empty ones left out. A dictionary is small, so its order is made on the driver."""
    lines = [x.value.strip("\r\n") for x in spark.read.text(path, wholetext=False).collect()]
    return spark.createDataFrame([(i, t) for i, t in enumerate(x for x in lines if x)], "dict_idx int, token string")


def settings(text: str) -> dict[str, str]:
    """key = value lines; # and ; begin comments, quotes around values go."""
    out = {}
    for line in text.splitlines():
        line = line.strip(" \t\r\n")
        if line and line[0] not in "#;[" and "=" in line:
            key, _, value = line.partition("=")
            value = value.strip()
            if not value.startswith('"'):
                for mark in "#;":
                    value = value.split(mark, 1)[0].strip()
            out[key.strip()] = value.split('"')[1] if value.startswith('"') and value.count('"') >= 2 else value.replace('"', "")
    return out


@dataclass
class Capture:
    """Settings of a capture job, with what holds where a key is missing."""

    socket: str = "/tmp/snapshot.sock"
    output: str = "shots"
    interval_s: int = 10
    similarity: float = 0.95
    max_images: int = 1000

    @staticmethod
    def read(text: str) -> "Capture":
        values = settings(text)
        return Capture(**{f.name: type(f.default)(values[f.name]) for f in fields(Capture) if f.name in values})


def models(spark: SparkSession, path: str, keywords: tuple[str, ...]) -> DataFrame:
    """model, file, version: the first file, by name, of each keyword."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(base_name("path").alias("file"))
    wanted = spark.createDataFrame([(k,) for k in keywords], "model string")
    return files.join(F.broadcast(wanted), F.col("file").contains(F.col("model"))).groupBy("model").agg(F.min("file").alias("file")).withColumn("version", model_version("file"))


def model_tensors(spark: SparkSession, rows: list[tuple[str, str, list[int], str, str]]) -> DataFrame:
    """Descriptors of model inputs and outputs: model, name, shape, layout, type, and bytes; an NV12 height is two thirds of the tensor's."""
    t = spark.createDataFrame(rows, "model string, name string, shape array<int>, layout string, type string")
    size = F.when(F.col("type").isin("u8", "s8"), 1).when(F.col("type").isin("u16", "s16"), 2).when(F.col("type") == "f64", 8).otherwise(4)
    return t.withColumn("bytes", F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x) * size)


def memory(spark: SparkSession, path: str = "/proc/self/status") -> DataFrame:
    """name, kb of the driver process's resident, peak and virtual memory; such files have no size, so Spark's readers see none."""
    found = re.findall(r"^(VmRSS|VmPeak|VmSize):\s*(\d+)", Path(path).read_text(), re.M)
    return spark.createDataFrame([(k, int(v)) for k, v in found], "name string, kb long")
