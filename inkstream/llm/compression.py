"""A compression classifier: dictionaries from good and from bad text, and the difference they make.

A text is compressed in blocks with either dictionary; the size difference over the text's size becomes a
score by logistic calibration on labelled rows that the dictionaries haven't seen.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, slices, text_column, text_hash

#: Bounds of the fitting sample, for each class: labelled rows for the dictionaries and for the calibration, and the
#: bytes that these rows' whole texts have together. PIECE: size of the samples that dictionaries are trained on.
FIT_ROWS, CALIBRATION_ROWS, FIT_BYTES, PIECE = 4000, 4000, 24 << 20, 1500
DICTIONARY_BYTES, BLOCK, LEVEL = 64 << 10, 4096, 3


def dictionary(texts: list[str]) -> tuple[bytes, bool]:
    """Trained on all pieces of the texts; where they are too few to train on, their plain content (second value false)."""
    pieces = [b[i : i + PIECE] for b in (t.encode("utf-8", "replace") for t in texts) for i in range(0, len(b), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(pieces), False


class Sizer:
    """Compressed sizes under one dictionary."""

    def __init__(self, data: bytes, trained: bool):
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        d = zstandard.ZstdCompressionDict(data, dict_type=kind) if len(data) >= 8 else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, data: bytes) -> int:
        return sum(len(self.compressor.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK))


def feature(text: str, good: Sizer, bad: Sizer) -> float:
    """(bad - good) / size; 0 of an empty text."""
    data = text.encode("utf-8", "replace")
    return (bad.size(data) - good.size(data)) / max(1, len(data))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Constant and slope by Newton steps."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
    return w


class Model:
    """Dictionaries and calibration; ``score`` of a feature is the probability of label 1."""

    def __init__(self, good: tuple[bytes, bool], bad: tuple[bytes, bool]):
        self.good, self.bad = good, bad
        self.mean, self.scale, self.weights = 0.0, 1.0, np.zeros(2)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling; with one class only, its smoothed rate."""
        if len(x):
            self.mean, self.scale = float(x.mean()), max(float(x.std()), 1e-9)
        if len(set(y.tolist())) == 2:
            self.weights = logistic((x - self.mean) / self.scale, y)
        else:
            rate = (y.sum() + 1) / (len(y) + 2)
            self.weights = np.array([math.log(rate / (1 - rate)), 0.0])

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + (x - self.mean) / self.scale * self.weights[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def of(self, texts: pa.Array, good: Sizer, bad: Sizer) -> np.ndarray:
        return self.score(np.fromiter((feature(t or "", good, bad) for t in texts.to_pylist()), float, len(texts)))


def remainder():
    """crc32 of the id as text modulo 4; null ids have none and are not held out."""
    return F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).cast("int"), F.lit(-1))


def _scored(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns and the score of ``text``."""
    fitted = rows.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", score double"

    def run(batches):
        model = fitted.value
        good, bad = Sizer(*model.good), Sizer(*model.bad)
        for batch in slices(batches):
            score = model.of(batch.column(len(keep)), good, bad)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(score)], [*keep, "score"])

    return map_arrow(rows.select(*keep, text_column().alias("text")), run, schema)


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, in one pass over the texts and without a join.

    Null texts score as empty ones, invalid UTF-8 as with its replacement; repeated rows fare alike; columns of
    any name are kept.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))
    valid = docs.select(*[F.make_valid_utf8(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in docs.schema])
    at = docs.columns.index("text")

    def run(batches):
        model = fitted.value
        good, bad = Sizer(*model.good), Sizer(*model.bad)
        for batch in batches:
            yield batch.filter(pa.array(model.of(batch.column(at), good, bad) >= threshold))

    return map_arrow(valid, run, docs.schema)


def settled(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y, part of the labelled ids; ids with both labels, with others than 0 and 1 or held out are left out."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    return rows.withColumn("part", remainder()).where("part <> 2")


def sampled(docs: DataFrame, rows: DataFrame, bounds: dict[tuple[int, bool], int], scratch: Scratch) -> dict[tuple[int, bool], DataFrame]:
    """doc_id, tk, y, text of a bounded sample of each class and use (label, whether for calibration), in one pass.

    The first labelled ids by a hash: at most ``bounds`` of them, as many different rows of theirs, and so many of
    those as have FIT_BYTES together. Texts are whole, and none longer than FIT_BYTES is taken.
    """
    rows = rows.withColumn("calibrates", F.col("part") == 3)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    one = {key: rows.where((F.col("y") == key[0]) & (F.col("calibrates") == key[1])).orderBy(*order).limit(n) for key, n in bounds.items()}
    chosen = functools.reduce(DataFrame.unionByName, one.values()).select("doc_id", "y", "calibrates")
    # at most the bounds together, so this broadcast is bounded
    found = docs.select("doc_id", text_hash().alias("tk"), text_column().alias("text")).join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= FIT_BYTES)
    found = scratch.table(found)
    out = {}
    for (y, calibrates), n in bounds.items():
        mine = found.where((F.col("y") == y) & (F.col("calibrates") == calibrates)).select("doc_id", "tk", "y", "text")
        listed = mine.select("doc_id", "tk", F.octet_length("text").alias("bytes")).distinct().orderBy(*order, "tk").limit(n)
        listed = listed.withColumn("sum", F.sum("bytes").over(Window.orderBy(*order, "tk"))).where(F.col("sum") <= FIT_BYTES).select("doc_id", "tk")
        out[y, calibrates] = mine.join(F.broadcast(listed), ["doc_id", "tk"]).dropDuplicates(["doc_id", "tk"]).select("doc_id", "tk", "y", "text")
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fitted on a bounded sample of the labelled rows that aren't held out; see ``settled`` and ``sampled``."""
    rows = settled(labels, label)
    scratch = Scratch(docs.sparkSession, "compression")
    parts = sampled(docs, rows, {(1, False): FIT_ROWS, (0, False): FIT_ROWS, (0, True): CALIBRATION_ROWS, (1, True): CALIBRATION_ROWS}, scratch)
    order = [("doc_id", "ascending"), ("tk", "ascending")]
    model = Model(*(dictionary(parts[y, False].toArrow().sort_by(order).column("text").to_pylist()) for y in (1, 0)))
    measured = _features(parts[0, True].unionByName(parts[1, True]), model).toArrow().sort_by(order)
    x, y = measured.column("x").to_numpy(), measured.column("y").to_numpy().astype(float)
    model.calibrate(x, y)
    # each class has its own sample, so the constant is set back to the classes' true shares
    shares = {r["y"]: r["count"] for r in rows.where("part = 3").groupBy("y").count().collect()}
    if len(shares) == 2 and 0 < y.sum() < len(y):
        model.weights[0] += math.log(shares[1] / shares[0]) - math.log(y.sum() / (len(y) - y.sum()))
    scratch.drop()
    scratch.settle()
    return model


def _features(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, tk, y and the feature x of the texts."""
    fitted = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        good, bad = Sizer(*fitted.value.good), Sizer(*fitted.value.bad)
        for batch in slices(batches):
            x = np.fromiter((feature(t, good, bad) for t in batch.column(3).to_pylist()), float, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(x)], ["doc_id", "tk", "y", "x"])

    return map_arrow(rows, run, f"doc_id {kind}, tk long, y int, x double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; only the text makes the score.

    Null texts score as empty ones; repeated rows get equal results; without labels every score is the
    smoothed rate of no rows, 0.5; an empty table gives no rows.
    """
    rows = _scored(docs, fit(docs, labels, label), ["doc_id"])
    return rows.select("doc_id", (remainder() == 2).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
