"""Observation documents: one JSON object per screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import captured_at

#: Constants of version 1 of the document.
VERSION, KIND, LANGUAGE = 1, "screen_text", "zh"
SCHEMA = """schema_version int, type string, captured_at string, source struct<kind:string,device:string,engine:string>,
 screen struct<image_path:string,width:int,height:int>, context struct<app_name:string,title:string>, event struct<type:string,reason:string>,
 ocr struct<language:string,text:string,confidence:double,block_count:int,blocks:array<struct<id:int,text:string,bbox:array<int>,confidence:double>>>, tags array<string>"""


def observations(blocks: DataFrame, screens: DataFrame, device: str = "camera", engine: str = "ocr") -> DataFrame:
    """image_id, observation (a struct) for every screen, from blocks (image_id, ord, text, x1, y1, x2, y2, confidence).

    Blocks are numbered from 1 in order; the text joins theirs with blanks; the confidence is their mean, 0 of none.
    """
    kept = blocks.where(F.col("text") != "")
    listed = kept.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text", F.array("x1", "y1", "x2", "y2").alias("bbox"), F.round("confidence", 4).alias("confidence")))).alias("b"), F.avg("confidence").alias("mean"))
    s = screens.join(listed, "image_id", "left")
    numbered = F.transform(F.coalesce("b", F.array().cast(listed.schema["b"].dataType)), lambda x, i: F.struct((i + 1).alias("id"), x["text"].alias("text"), x["bbox"].alias("bbox"), x["confidence"].alias("confidence")))
    path = F.col("image_path") if "image_path" in screens.columns else F.lit(None).cast("string")
    doc = F.struct(
        F.lit(VERSION).alias("schema_version"),
        F.lit("observation").alias("type"),
        captured_at(path).alias("captured_at"),
        F.struct(F.lit(KIND).alias("kind"), F.lit(device).alias("device"), F.lit(engine).alias("engine")).alias("source"),
        F.struct(path.alias("image_path"), F.col("width"), F.col("height")).alias("screen"),
        F.struct(F.lit("").alias("app_name"), F.lit("").alias("title")).alias("context"),
        F.struct(F.lit("screen").alias("type"), F.lit("capture").alias("reason")).alias("event"),
        F.struct(F.lit(LANGUAGE).alias("language"), F.array_join(F.transform(numbered, lambda x: x["text"]), " ").alias("text"), F.coalesce("mean", F.lit(0.0)).alias("confidence"), F.size(numbered).alias("block_count"), numbered.alias("blocks")).alias("ocr"),
        F.array(F.lit("ocr"), F.lit("screen")).alias("tags"),
    )
    return s.select("image_id", doc.alias("observation"))


def to_json(observation="observation") -> Column:
    """The document's JSON with every field of the schema, nulls too."""
    return F.to_json(F.col(observation), {"ignoreNullFields": "false"})


def results_json(rows: DataFrame) -> DataFrame:
    """The older document: total_regions and results with position and size."""
    item = F.struct("ord", F.struct(F.col("ord").alias("index"), F.struct((F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height")).alias("size"), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("position"), "confidence", "text").alias("v"))
    listed = rows.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("results"))
    return listed.select("image_id", F.to_json(F.struct(F.size("results").alias("total_regions"), "results")).alias("json"))


def text_lines(rows: DataFrame) -> DataFrame:
    """A line per block: its number (and sub-number, where not 0), corners, text and confidence."""
    name = F.when(F.col("sub_idx") > 0, F.format_string("Box %d_%d", "box_idx", "sub_idx")).otherwise(F.format_string("Box %d", "box_idx"))
    return rows.select("image_id", F.concat(name, F.format_string(": [%d, %d, %d, %d] ", "x1", "y1", "x2", "y2"), F.col("text"), F.format_string(" %.4f", "confidence")).alias("line"))
