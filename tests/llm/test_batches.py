import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stages_of_the_pipeline_get_small_batches(spark, monkeypatch):
    docs = spark.range(3_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"))
    before = spark.conf.get(_BATCH)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    # each stage's own operator gives way to one that tells the sizes of its batches
    for module, name in (("language", "accepted"), ("ngram_join", "representatives"), ("decontaminate", "clean"), ("pii", "redact"), ("bpe", "digests")):
        monkeypatch.setattr(getattr(corpus_pipeline, module), name, lambda docs, *_: docs.mapInArrow(sizes, "n long"))
    monkeypatch.setattr(type(spark.read), "parquet", lambda *_: docs)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(_BATCH, 10_000)
            got = [r.n for r in stage(spark, docs, "").collect()]
            assert sum(got) == 3_000 and max(got) <= 1_000
        for kept, wanted in ((100, "100"), (0, "1000"), (10_000, "1000")):
            spark.conf.set(_BATCH, kept)
            corpus_pipeline.small_batches(spark)
            assert spark.conf.get(_BATCH) == wanted
    finally:
        spark.conf.set(_BATCH, before)
