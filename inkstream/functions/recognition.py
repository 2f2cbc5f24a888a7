"""From class scores per time step to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.geometry import argmax


def best_classes(logits: DataFrame) -> DataFrame:
    """image_id, t, k, score: the first largest class of each step."""
    return logits.select("image_id", "t", argmax("scores").alias("k"), F.array_max("scores").cast("double").alias("score"))


def collapse(best: DataFrame) -> DataFrame:
    """Without blanks (class 0) and repeats of the step before; dict_idx is the class less the blank."""
    before = F.lag("k").over(Window.partitionBy("image_id").orderBy("t"))
    return best.withColumn("before", before).where((F.col("k") > 0) & (F.col("before").isNull() | (F.col("k") != F.col("before")))).select("image_id", "t", (F.col("k") - 1).alias("dict_idx"), "score")


def characters(logits: DataFrame, dictionary: DataFrame) -> DataFrame:
    """image_id, t, dict_idx, score, token; classes beyond the dictionary are dropped. The dictionary is a model's, so it is broadcast."""
    return collapse(best_classes(logits)).join(F.broadcast(dictionary), "dict_idx")


def read(logits: DataFrame, dictionary: DataFrame) -> DataFrame:
    """image_id, text, confidence, char_conf, char_idx, success for every image; without a character, empty and 0."""
    found = characters(logits, dictionary).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("t", "token", "score", "dict_idx"))).alias("c"))
    found = found.select("image_id", F.array_join(F.transform("c", lambda x: x["token"]), "").alias("text"), F.transform("c", lambda x: x["score"]).alias("char_conf"), F.transform("c", lambda x: x["dict_idx"]).alias("char_idx"))
    out = logits.select("image_id").distinct().join(found, "image_id", "left")
    conf = F.coalesce("char_conf", F.array().cast("array<double>"))
    return out.select("image_id", F.coalesce("text", F.lit("")).alias("text"), mean_confidence(conf).alias("confidence"), conf.alias("char_conf"), F.coalesce("char_idx", F.array().cast("array<int>")).alias("char_idx"), F.lit(True).alias("success"))


def mean_confidence(values) -> Column:
    """Mean of an array; nothing counts 0."""
    n = F.size(values)
    return F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n).otherwise(F.lit(0.0))


def valid(success="success", text="text", confidence=None) -> Column:
    """A reading that counts: it succeeded and has text; where asked, with confidence above 0."""
    ok = F.col(success) & (F.col(text) != "")
    return ok & (F.col(confidence) > 0) if confidence else ok


def character_rows(readings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """image_id, pos, token, score, dict_idx: readings opened into characters."""
    rows = readings.select("image_id", F.posexplode(F.arrays_zip(F.col("char_idx").alias("dict_idx"), F.col("char_conf").alias("score"))).alias("pos", "x"))
    return rows.select("image_id", "pos", "x.dict_idx", "x.score").join(F.broadcast(dictionary), "dict_idx")


def confidence_range(readings: DataFrame) -> DataFrame:
    """Largest, smallest and mean character confidence of each reading that has characters."""
    return readings.where(F.size("char_conf") > 0).select("image_id", F.array_max("char_conf").alias("high"), F.array_min("char_conf").alias("low"), mean_confidence(F.col("char_conf")).alias("mean"))
