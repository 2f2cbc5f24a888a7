"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame to
be written as Parquet and reread as the next one's ``docs``. Every stage keeps rows that repeat, columns of any name and null ids;
a null text is an empty one to it, ties go to the smaller doc_id, and an empty table gives an empty table of the same columns.

What a stage writes in the shared folder for its own use belongs to its call: ``run`` deletes it once the stage's
result is written, but for the last stage's, which the result of ``run`` reads. Where stages are called one by one, a stage
deletes what the stage before it wrote as it begins, unless its ``docs`` still read it.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from inkstream.llm import chaining, common, compression, minhash, packing, queries, winnowing

_spent: dict[str, list[common.Scratch]] = {}


def _stage(before: str | None):
    """A stage whose scratch is kept until the stage named as following it begins; the first stages of all follow none."""

    def wrap(function):
        @functools.wraps(function)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            done = _spent.pop(before, [])
            names = [x.path.rpartition("/")[2] for x in done]
            if done and any(n in f.split("/") for f in docs.inputFiles() for n in names):
                _spent[before], done = done, []
            for x in done:
                x.drop()
            common.settle(spark)
            with common.collecting() as mine:
                out = function(spark, docs, sf_dir)
            _spent.setdefault(function.__name__, []).extend(mine)
            return out

        run.bare = function
        return run

    return wrap


@_stage(None)
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is at least 0.7."""
    return compression.accepted(docs, queries.table(spark, sf_dir, "labels"))


@_stage("classify")
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest doc_id."""
    dropped = common.Scratch(spark, "dropped").table(minhash.near_duplicates(docs).where("not kept").select("doc_id", "tk"))
    return common.without(docs, dropped)


@_stage("deduplicate")
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has; emptied ones go."""
    return chaining.remove_repeats(docs, emptied=False)


@_stage("cut_repeats")
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark window of 10 words."""
    hit = winnowing.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))
    return common.without(docs, common.Scratch(spark, "dropped").table(hit.where("contaminated").select("doc_id", "tk")))


@_stage("decontaminate")
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of 1024 tokens."""
    packed = packing.pack_documents(docs, queries.vocabulary(), queries.CONTEXT)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", classify),
    ("MinHash near-dedup", deduplicate),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: Learned scores, sketches and tokens are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. Results of several runs in a session stay readable until the session ends."""
    out, last = common.Scratch(spark, "pipeline"), None
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        common.settle(spark)
        with common.collecting() as mine:
            docs = out.table(stage.bare(spark, docs, sf_dir))
        for x in mine:
            x.drop()
        if last is not None:
            last.drop()
        out, last = common.Scratch(spark, "pipeline"), out
    common.settle(spark)
    return STAGES[-1][1].bare(spark, docs, sf_dir)
