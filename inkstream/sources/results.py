"""Results of a running stream: delivered once, called back, and pulled in order.

A stream's micro-batches become tables of their own by batch number, each complete once its mark is there. A
batch that Spark runs again after a failure finds its mark and does nothing, or replaces what the failed try left, so no
row is delivered twice. A cursor reads the batches in their order and keeps its place beside them.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..errors import QueueEmpty


class _Folder:
    """A folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._new = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
        self.system = self._new(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        return self.system.exists(self._new(f"{self.path}/{name}"))

    def names(self, sub: str) -> list[str]:
        at = self._new(f"{self.path}/{sub}")
        return [x.getPath().getName() for x in self.system.listStatus(at)] if self.system.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self._new(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: by another name first."""
        temporary, final = self._new(f"{self.path}/{name}.new"), self._new(f"{self.path}/{name}")
        stream = self.system.create(temporary, True)
        stream.write(text.encode())
        stream.close()
        if self.system.exists(final):
            self.system.delete(final, False)
        if not self.system.rename(temporary, final):
            raise OSError(f"{name} was not written")


def accept(batch: DataFrame, number: int, path: str, callback: Callable[[int, DataFrame], None] | None = None) -> bool:
    """Deliver a numbered batch; false if it was before. ``callback`` gets the written rows before the mark is set:

    should it fail, or the driver be lost then, the batch comes again, so what it does must bear a repetition.
    """
    spark = batch.sparkSession
    folder = _Folder(spark, path)
    if folder.has(f"done/{number:012d}"):
        return False
    batch.write.mode("overwrite").parquet(f"{folder.path}/rows/{number:012d}")
    if callback is not None:
        callback(number, spark.read.schema(batch.schema).parquet(f"{folder.path}/rows/{number:012d}"))
    folder.write(f"done/{number:012d}", batch.schema.json())
    return True


def deliver(stream: DataFrame, path: str, checkpoint: str, callback: Callable[[int, DataFrame], None] | None = None, **trigger) -> StreamingQuery:
    """Start a query that delivers the stream's batches to ``path``; ``trigger`` as for ``DataStreamWriter.trigger``."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: accept(df, n, path, callback) and None)
    return (writer.trigger(**trigger) if trigger else writer).start()


class Cursor:
    """Pulls the delivered batches of a folder in order. Cursors of other names have places of their own.

    The place moves on when the next batch is asked for, or by ``done``: a consumer that dies over a batch gets it again.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "default", wait: float = 0.1):
        self.spark, self.folder, self.name, self.wait = spark, _Folder(spark, path), name, wait
        self.at: int | None = None

    def place(self) -> int:
        """The number of the last batch that is done; -1 before the first."""
        return int(self.folder.read(f"cursors/{self.name}")) if self.folder.has(f"cursors/{self.name}") else -1

    def done(self) -> None:
        if self.at is not None:
            self.folder.write(f"cursors/{self.name}", str(self.at))
            self.at = None

    def pull(self, timeout: float | None = None) -> DataFrame:
        """The next batch's rows. Waits up to ``timeout`` seconds (None: forever; 0: not at all), then raises ``QueueEmpty``."""
        self.done()
        last, until = self.place(), None if timeout is None else time.monotonic() + timeout
        while True:
            ready = sorted(int(n) for n in self.folder.names("done") if n.isdigit() and int(n) > last)
            if ready:
                self.at = ready[0]
                schema = StructType.fromJson(json.loads(self.folder.read(f"done/{self.at:012d}")))
                return self.spark.read.schema(schema).parquet(f"{self.folder.path}/rows/{self.at:012d}")
            if until is not None and time.monotonic() >= until:
                raise QueueEmpty(f"no result after batch {last}")
            time.sleep(self.wait if until is None else max(0.0, min(self.wait, until - time.monotonic())))
