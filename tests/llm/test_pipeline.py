import corpus_pipeline
from inkstream.llm import compression, minhash, winnowing
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        was = {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= was
        if k < 4:
            assert docs.columns == names
        if k == 0:
            assert ids == {r.doc_id for r in compression.classify(before, spark.read.parquet(f"{FOLDER}/labels.parquet")).where("predicted = 1").collect()}
        if k == 1:
            assert ids == {r.doc_id for r in minhash.near_duplicates(before).where("kept").collect()}
        if k == 2:
            assert all(r.n_chars == len(r.text) for r in docs.join(before.select("doc_id", F.col("text").alias("t")), "doc_id").where("text <> t").collect())
        if k == 3:
            assert ids == {r.doc_id for r in winnowing.decontaminate(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).where("not contaminated").collect()}
        if k == 4:
            assert ids == was
    assert sizes[0] > sizes[1] > 0 and corpus_pipeline.run(spark, FOLDER).count() == sizes[-1]


def test_edge_tables(docs, empty, spark):
    for table in (docs, empty):
        out = table
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, FOLDER).cache()
            out.count()


def test_results_of_two_runs_stay_readable(spark):
    """A second run deletes nothing that the first one's result reads."""
    first = corpus_pipeline.run(spark, FOLDER)
    second = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))


def test_stages_in_a_row_without_writing(spark):
    """A stage whose input still reads what the one before wrote deletes nothing of it."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    one = corpus_pipeline.deduplicate(spark, docs, FOLDER)
    two = corpus_pipeline.cut_repeats(spark, one, FOLDER)
    assert 0 < two.count() <= one.count() <= 60
