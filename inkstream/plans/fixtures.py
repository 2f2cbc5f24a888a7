"""Model outputs derived from the driver's tables: the inputs of the queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

CLASSES = ("body", "vehicle", "cycle", "face", "plate")
#: class, min_w, min_h, confidence, quality, max_count, expand
CLASS_CONFIG = [("body", 30, 30, 0.55, 0.0, 3, 0.1), ("vehicle", 30, 30, 0.5, 0.0, 2, 0.1), ("cycle", 30, 30, 0.5, 0.0, 1, 0.1), ("face", 30, 30, 0.5, 0.0, 0, 0.25), ("plate", 30, 30, 0.5, 0.0, 0, 1.0)]


def cut(text) -> Column:
    """Overlapping windows over a whole text, as an array: 16 characters and the next 4."""
    # found one after another: by place, or by the piece after, a window could cost the whole text
    parts = [F.regexp_extract_all(text, F.lit("(?s)(.{1,16})(?=(.{0,4}))"), F.lit(k)) for k in (1, 2)]
    return F.zip_with(*parts, lambda a, b: F.concat(a, b))


class Inputs:
    """The driver's tables of a folder and what is derived from them, each read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def logits(self) -> DataFrame:
        """image_id, t, scores: 40 time steps of 64 class scores an image."""
        return self.table("embeddings").select(F.floor(F.col("vec_id") / 40.0).cast("long").alias("image_id"), (F.col("vec_id") % 40).cast("int").alias("t"), F.col("embedding").alias("scores"))

    def dictionary(self) -> DataFrame:
        """dict_idx, token: 63 printable characters."""
        return self.spark.range(63).select(F.col("id").cast("int").alias("dict_idx"), F.char(F.col("id") + 33).alias("token"))

    def detection(self) -> DataFrame:
        """stream_id, frame_id, ts, idx, class, x, y, w, h, score: 16 boxes a frame."""
        kind = F.when(F.col("event_type") == "view", "body").when(F.col("event_type") == "click", "vehicle").when(F.col("event_type") == "purchase", "cycle").when(F.col("event_type") == "signup", "plate").otherwise("face")
        e = F.col("event_id")
        return self.table("events").select(
            (F.col("user_id") % 4).cast("int").alias("stream_id"),
            F.floor(e / 16.0).cast("long").alias("frame_id"),
            "ts",
            (e % 16).cast("int").alias("idx"),
            kind.alias("class"),
            ((e * 37) % 1800).cast("double").alias("x"),
            ((e * 53) % 1000).cast("double").alias("y"),
            (20 + (e * 17) % 200).cast("double").alias("w"),
            (20 + (e * 29) % 200).cast("double").alias("h"),
            (((e * 71) % 1000).cast("double") / 1000).alias("score"),
        )

    def heat(self) -> DataFrame:
        """image_id, tile_id, y, x, val in image coordinates: four overlapping 8x8 tiles of a 14x14 image."""
        flat = self.table("embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
        tile = F.col("vec_id") % 4
        return flat.select(
            F.floor(F.col("vec_id") / 4.0).cast("long").alias("image_id"),
            tile.cast("int").alias("tile_id"),
            (F.floor(F.col("p") / 8.0) + 6 * F.floor(tile / 2.0)).cast("int").alias("y"),
            (F.col("p") % 8 + 6 * (tile % 2)).cast("int").alias("x"),
            F.abs("v").alias("val"),
        )

    def texts(self) -> DataFrame:
        """box_idx, text: the texts that have windows."""
        return self.table("documents").where("text <> ''").select(F.col("doc_id").alias("box_idx"), "text")

    def segments(self) -> DataFrame:
        """box_idx, sub_idx, text: the windows one by one."""
        # every text has a window; a plain posexplode would have Spark ask for that first, and cut each text again for it
        return self.texts().select("box_idx", F.posexplode_outer(cut("text")).alias("sub_idx", "text"))

    def segment_counts(self) -> DataFrame:
        """box_idx, n: so many windows has a document's text; their places follow from the number."""
        return self.table("documents").where("text <> ''").select(F.col("doc_id").alias("box_idx"), F.ceil(F.length("text") / 16).cast("int").alias("n"))

    def files(self) -> DataFrame:
        """folder, name, folder_mtime, mtime: a listing of screenshots, a third of them processed."""
        day = F.to_date("ts")
        return self.table("events").select(
            F.concat(F.lit("/shots/"), day.cast("string")).alias("folder"),
            F.concat(F.lit("shot_"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "_ocr").otherwise(""), F.lit(".jpg")).alias("name"),
            F.max("ts").over(Window.partitionBy(day)).alias("folder_mtime"),
            F.col("ts").alias("mtime"),
        )

    def stages(self) -> DataFrame:
        """run_id, step, name, ts: steps of runs."""
        return self.table("events").select(F.col("user_id").alias("run_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).cast("int").alias("step"), F.col("event_type").alias("name"), "ts")

    def class_config(self) -> DataFrame:
        return self.spark.createDataFrame(CLASS_CONFIG, "class string, min_w int, min_h int, confidence double, quality double, max_count int, expand double")

    def screens(self) -> DataFrame:
        """image_id, width, height: screens of many shapes."""
        k = F.col("c_custkey")
        return self.table("customer").select(k.alias("image_id"), (40 + (k * 37) % 3000).cast("int").alias("width"), (20 + (k * 53) % 2000).cast("int").alias("height"))

    def boxes(self) -> DataFrame:
        """image_id, box_idx, x1, y1, x2, y2: whole boxes, some of them turned inside out."""
        e = F.col("event_id")
        return self.table("events").select(
            F.floor(e / 16.0).cast("long").alias("image_id"), (e % 16).cast("int").alias("box_idx"), ((e * 37) % 1900).cast("int").alias("x1"), ((e * 53) % 1060).cast("int").alias("y1"), ((e * 37) % 1900 + (e * 17) % 230 - 20).cast("int").alias("x2"), ((e * 53) % 1060 + (e * 29) % 90 - 8).cast("int").alias("y2")
        )


#: The same for DuckDB, by name.
SQL = {
    "logits": "SELECT CAST(floor(vec_id / 40.0) AS BIGINT) AS image_id, CAST(vec_id % 40 AS INT) AS t, embedding AS scores FROM embeddings",
    "dictionary": "SELECT CAST(range AS INT) AS dict_idx, chr(CAST(33 + range AS INT)) AS token FROM range(63)",
    "detection": """SELECT CAST(user_id % 4 AS INT) AS stream_id, CAST(floor(event_id / 16.0) AS BIGINT) AS frame_id, ts, CAST(event_id % 16 AS INT) AS idx,
 CASE event_type WHEN 'view' THEN 'body' WHEN 'click' THEN 'vehicle' WHEN 'purchase' THEN 'cycle' WHEN 'signup' THEN 'plate' ELSE 'face' END AS class,
 CAST((event_id * 37) % 1800 AS DOUBLE) AS x, CAST((event_id * 53) % 1000 AS DOUBLE) AS y, CAST(20 + (event_id * 17) % 200 AS DOUBLE) AS w,
 CAST(20 + (event_id * 29) % 200 AS DOUBLE) AS h, CAST((event_id * 71) % 1000 AS DOUBLE) / 1000 AS score FROM events""",
    "heat": """SELECT CAST(floor(vec_id / 4.0) AS BIGINT) AS image_id, CAST(vec_id % 4 AS INT) AS tile_id,
 CAST(floor(p / 8.0) + 6 * floor((vec_id % 4) / 2.0) AS INT) AS y, CAST(p % 8 + 6 * ((vec_id % 4) % 2) AS INT) AS x, abs(v) AS val
 FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)""",
    "segments": "SELECT box_idx, CAST(k AS INT) AS sub_idx, substring(text, k * 16 + 1, 20) AS text FROM (SELECT doc_id AS box_idx, text, unnest(range((length(text) + 15) // 16)) AS k FROM documents)",
    "files": """SELECT concat('/shots/', CAST(CAST(ts AS DATE) AS VARCHAR)) AS folder,
 concat('shot_', CAST(event_id AS VARCHAR), CASE WHEN event_id % 3 = 0 THEN '_ocr' ELSE '' END, '.jpg') AS name,
 max(ts) OVER (PARTITION BY CAST(ts AS DATE)) AS folder_mtime, ts AS mtime FROM events""",
    "stages": "SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) AS INT) AS step, event_type AS name, ts FROM events",
    "class_config": "SELECT * FROM (VALUES " + ", ".join(f"('{c[0]}', {c[1]}, {c[2]}, CAST({c[3]} AS DOUBLE), CAST({c[4]} AS DOUBLE), {c[5]}, CAST({c[6]} AS DOUBLE))" for c in CLASS_CONFIG) + ") AS c(class, min_w, min_h, confidence, quality, max_count, expand)",
    "screens": "SELECT c_custkey AS image_id, CAST(40 + (c_custkey * 37) % 3000 AS INT) AS width, CAST(20 + (c_custkey * 53) % 2000 AS INT) AS height FROM customer",
    "boxes": """SELECT CAST(floor(event_id / 16.0) AS BIGINT) AS image_id, CAST(event_id % 16 AS INT) AS box_idx, CAST((event_id * 37) % 1900 AS INT) AS x1,
 CAST((event_id * 53) % 1060 AS INT) AS y1, CAST((event_id * 37) % 1900 + (event_id * 17) % 230 - 20 AS INT) AS x2, CAST((event_id * 53) % 1060 + (event_id * 29) % 90 - 8 AS INT) AS y2 FROM events""",
}


def sql(query: str, *names: str) -> str:
    """A query with the named inputs as common table expressions."""
    own = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    if query.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {own},\n{query[15:]}" if own else query
    if query.startswith("WITH "):
        return f"WITH {own},\n{query[5:]}" if own else query
    return f"WITH {own}\n{query}" if own else query
