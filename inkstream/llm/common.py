"""Shared plumbing: scratch tables in the shared folder, Arrow kernels, bounded broadcast filters.

Every intermediate that must survive the loss of an executor is a Parquet table in the folder that
``spark.checkpoint.dir`` names (any Hadoop file system); nothing is kept on one machine only.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A bitmap filter has 16 bits or more for each entry, and between these powers of two (the most: 16 MB).
FILTER_BITS = (16, 27)
#: Rows and bytes in one Arrow batch where the session has Spark's own defaults; documents may be long.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20
_own_scratch: str | None = None
_shipped: str | None = None


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once, so that they need no installation of it."""
    global _shipped
    context = spark.sparkContext
    if _shipped != context.applicationId:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped = context.applicationId


def arrow_rows(spark: SparkSession) -> None:
    """Lower Spark's defaults of 10,000 rows and 64 MB an Arrow batch, which long texts make too large."""
    ship(spark)
    for key, default, value in (("maxRecordsPerBatch", "10000", ARROW_ROWS), ("maxBytesPerBatch", "67108864b", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, str(value))


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers, and what they hold, for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` in batches of bounded size by workers that give their memory back as a task ends."""
    arrow_rows(df.sparkSession)

    def frugal(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(frugal, schema)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that ``df`` has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates; one of our own only where none is set and Spark is local."""
    global _own_scratch
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if _own_scratch is None:
        _own_scratch = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return _own_scratch


def settle(spark: SparkSession) -> None:
    """Collect in the driver between steps: Spark's cleaner then deletes the shuffle files of finished writes, and the heap
    that large plans left behind shrinks; also give back what the driver's Python has freed. Python goes first: frames and
    functions in reference cycles keep their plans, and so the shuffles, alive in the JVM. So does Spark's listener thread
    that of the last query until it hears of another: an empty one."""
    gc.collect()
    spark.range(0).write.format("noop").mode("overwrite").save()
    spark._jvm.java.lang.System.gc()
    give_back()


class Scratch:
    """Written intermediates and broadcasts of one operator call; deleted by ``drop``, or as the JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.shared: list = []
        _opened.append(self)
        for mine in _collecting:
            mine.append(self)

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: cuts the lineage, fixes nondeterminism, gives real sizes."""
        if not self.count:
            path, system = self._folder()
            system.mkdirs(path)
            system.deleteOnExit(path)
        self.count += 1
        path = f"{self.path}/{self.count}"
        # small row groups: a task holds one in memory while it writes
        df.write.option("compression", "lz4").option("parquet.block.size", 16 << 20).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self) -> None:
        settle(self.spark)

    def share(self, value):
        """A broadcast that ``drop`` ends."""
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def drop(self) -> None:
        """Delete what was written; for callers that have consumed the result."""
        for x in self.shared:
            x.destroy()
        self.shared.clear()
        path, system = self._folder()
        system.delete(path, True)
        if self in _opened:
            _opened.remove(self)


_opened: list[Scratch] = []
_collecting: list[list[Scratch]] = []


@contextlib.contextmanager
def collecting():
    """The scratches opened inside, for a caller that knows when their results have been written."""
    mine: list[Scratch] = []
    _collecting.append(mine)
    try:
        yield mine
    finally:
        _collecting.pop(next(i for i, x in enumerate(_collecting) if x is mine))


def drop_scratch() -> None:
    """Delete the intermediates of all operator calls so far; their results must have been written."""
    for s in list(_opened):
        s.drop()


def text_column(name: str = "text") -> Column:
    """The text as a string, null as empty; invalid UTF-8 is replaced so that Arrow accepts it."""
    return F.coalesce(F.make_valid_utf8(F.col(name).cast("string")), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets (from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches, rows: int = 256, name: str = "text", most: int = 1 << 20):
    """Cut Arrow batches so that a slice has at most ``rows`` rows and, but for one long text, ``most`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(name)))
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
            j = min(max(j, i + 1), i + rows, batch.num_rows)
            yield batch.slice(i, j - i)
            i = j


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of ``lengths`` entries each, from the values in order."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _slot(column: Column, power: int) -> tuple[Column, Column]:
    """Word and bit of a hash in a bitmap of 2**power bits."""
    slot = F.shiftrightunsigned(column, 64 - power)
    return F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))


def bitmap_words(hashes: DataFrame, column: str) -> tuple[DataFrame, int]:
    """word, bits of the bitmap of a column of longs, and the power of two that is its size."""
    power = min(max((16 * hashes.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    word, bit = _slot(F.col(column), power)
    return hashes.where(F.col(column).isNotNull()).select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), power


class BitmapFilter:
    """Set membership for 64-bit hashes in a bitmap of bounded size: no false negatives; what it lets through is joined."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(64 - (len(bits).bit_length() + 5))

    @staticmethod
    def of(hashes: DataFrame, column: str) -> "BitmapFilter":
        """Built by Spark from a column of longs, best of a written table; only the bitmap's words reach the driver."""
        words, power = bitmap_words(hashes, column)
        words = words.toArrow()
        bits = np.zeros(1 << (power - 6), np.uint64)
        bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.int64).view(np.uint64)
        return BitmapFilter(bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> self.shift
        return ((self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def text_hash(name: str = "text") -> Column:
    """With doc_id the identity of a document: rows that repeat both are one document."""
    return F.xxhash64(text_column(name))


def flagged(docs: DataFrame, column: str, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """``docs`` with the boolean ``flag``: false where no key of the written table ``keys`` equals the long column.

    A join with the words of a bitmap, which its bounded size lets Spark broadcast, and no Python.
    """
    words, power = bitmap_words(keys, key)
    w, bits = spare(docs, "_word", "_bits")
    word, bit = _slot(F.col(column), power)
    joined = docs.withColumn(w, word).join(F.broadcast(words.withColumnsRenamed({"word": w, "bits": bits})), w, "left")
    return joined.select(*docs.columns, F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False)).alias(flag))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the documents ``dropped`` (doc_id, tk), which must be a written table.

    Texts are shuffled only of rows that a bitmap of the dropped ones can't clear. Its size is bounded: of
    more than about 10**8 dropped documents most texts are shuffled. Null ids and texts are compared like
    others; rows that repeat id and text go together; columns of any name are kept.
    """
    tk, d, t, flag = spare(docs, "_tk", "_d", "_t", "_flag")
    keyed = flagged(docs.withColumn(tk, text_hash()), tk, dropped, "tk", flag)
    out = dropped.select(F.col("doc_id").alias(d), F.col("tk").alias(t)).distinct()
    rest = keyed.where(flag).join(out, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(tk) == F.col(t)), "left_anti")
    return keyed.where(~F.col(flag)).unionByName(rest).select(*docs.columns)
