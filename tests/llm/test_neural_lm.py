import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from isohypse.llm import neural_lm as L

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)), ""]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(rows):
    """The columns that don't need the model."""
    counts = Counter()
    for i, t in rows:
        if not held_out(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    return sorted(((i, held_out(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t in rows for w in [tokens(t)]), key=repr)


def base_of(out):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=repr)


def test_base_equals_brute_force_with_edge_cases(documents, rows):
    for shape in (L.Shape(), L.Shape(words=50, classes=7, sent=1e-3, piece=16, shard=20_000)):
        out = L.score(documents, shape).collect()
        assert base_of(out) == brute(rows)
        assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_probabilities_of_all_known_words_and_one_unseen_in_each_class_add_up_to_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts, vocab, model = L.fit(docs, L.Shape(words=100, classes=16, sent=1e-4, shard=10_000))
    m = len(vocab.noise)
    for first, second in ((0, 0), (3, 101), (110, 5)):
        p = np.exp(model.log_probabilities(np.full(m, first), np.full(m, second), np.arange(m)))
        assert p.sum() == pytest.approx(1, abs=1e-5)
        total = p[0]
        for r in counts.where("word <> ''").collect():
            w = r.word.encode()
            at, kind, others = vocab.encode([w])
            share = vocab.share[at[0]] if at[0] >= 0 else math.log10(r.n + 1) - vocab.rest[kind[0]]
            assert others == ([w] if at[0] < 0 else [])
            total += p[kind[0]] * 10**share
        total += sum(p[k] * 10 ** -vocab.rest[k] for k in range(101, m))
        assert total == pytest.approx(1, abs=1e-4)


def test_score_is_the_sum_of_its_tokens_probabilities(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts, vocab, model = L.fit(docs, L.Shape(words=100, classes=16, sent=1e-4))
    known = {r.word.encode(): r.n for r in counts.collect()}
    rows = [(1, "The the of unheardofword und\x0bdie THE of"), (2, None), (3, "x " * 5000)]
    got = {r.doc_id: r for r in L.scored(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "false AS held_out"), vocab, model, block=64).collect()}
    for i, text in rows:
        before, want = [0, 0], 0.0
        for w in [*L.words_of(text), b""]:
            at, kind, _ = vocab.encode([w])
            want += model.log_probabilities(np.array(before[:1]), np.array(before[1:]), kind)[0] / math.log(10)
            want += 0 if kind[0] <= 100 else -vocab.rest[kind[0]] + (math.log10(known[w] + 1) if at[0] >= 0 else 0)
            before = [before[1], int(kind[0])]
        assert got[i].score == pytest.approx(want, rel=1e-5) and got[i].n_tokens == len(L.words_of(text)) + 1
    assert {x.word: x.times for x in got[1].others} == {"unheardofword": 1}


def test_model_beats_the_base_on_held_out_documents(spark):
    out = L.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    n = sum(r.n_tokens for r in out)
    assert sum(r.score for r in out) / n > sum(r.base_score for r in out) / n + 0.1


def test_training_is_the_same_in_any_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = [L.fit(d, L.Shape(words=50, classes=8, shard=10_000))[2].rows() for d in (docs, docs.repartition(5, "text"))]
    assert (got[0] == got[1]).all()


def test_no_training_rows_and_no_rows(spark, empty):
    only = next(i for i in range(100) if held_out(i))
    (r,) = L.score(spark.createDataFrame([(only, "Some text")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(r.score)
    assert L.score(empty).count() == 0
