import numpy as np

from isohypse.llm import toxicity as T


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = T.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted for r in out if r.toxic) / sum(r.toxic for r in out)
    false = sum(r.predicted for r in out if not r.toxic) / sum(not r.toxic for r in out)
    assert hit > 0.88 and false < 0.02


def test_edge_cases(documents, rows, spark, sf_dir, empty):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = T.score(documents, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert T.score(documents, labels.limit(0)).count() == len(rows)
    assert T.score(empty, labels).count() == 0


def test_label_model_finds_accurate_and_correlated_voters():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.2
    votes = np.stack([np.where(truth, np.where(rng.random(4000) < a, 1, -1), np.where(rng.random(4000) < a, -1, 1)) for a in (0.95, 0.9, 0.7)] + [np.zeros(4000, int)], 1)
    votes[:, 3] = votes[:, 2]
    post, accuracy, rest = T.label_model(votes)
    assert ((post > 0.5) == truth).mean() > 0.93
    assert accuracy[0] > accuracy[2] and rest[2, 3] > 0.9
