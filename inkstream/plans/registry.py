"""Registered queries: a function of the inputs, and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Inputs, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(text: str | None, *inputs: str):
    """Register a function of ``Inputs``; ``text`` may use the named inputs as tables."""

    def register(function: Callable[[Inputs], DataFrame]):
        QUERIES[function.__name__] = lambda spark, folder: function(Inputs(spark, folder))
        if text:
            ORACLE[function.__name__] = sql(text.strip(), *inputs)
        return function

    return register
