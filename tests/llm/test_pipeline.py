import corpus_pipeline
from isohypse.llm import queries


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert set(out.columns) == set(docs.columns)
        assert 0.5 * left < out.count() <= left
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 100 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_each_operator_has_a_query(spark, sf_dir):
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
