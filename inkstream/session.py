"""A Spark session with the settings that the engine is tested with."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "inkstream", **settings: str) -> SparkSession:
    """Adaptive execution, UTC, Arrow, and the state store that keyed machines need; a running session is used as it is."""
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    return SparkSession.builder.appName(name).config(map=conf | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder of ``spark.checkpoint.dir``, without its lineage: it outlives lost executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()
