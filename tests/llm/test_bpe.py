import hashlib
import random
import time
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import functions as F

from isohypse.llm import bpe
from isohypse.llm._arrow import _ROWS

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_ids_and_round_trip_equal_the_library(documents, rows):
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH).tokens)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    for epoch_words in (300_000, 50):
        got = bpe.digests(documents, PATH, public_tokenizers.PATTERN, epoch_words).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_overlapping_pairs_of_equal_ids(spark):
    texts = ["a" * n for n in range(1, 40)] + ["ab" * 30, "=" * 77, "-=" * 21, "!!!!!?????"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH).tokens)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.text: list(r.ids) for r in out.collect()} == {t: own.encode_ordinary(t) for t in texts}


def test_every_token_has_one_canonical_pair():
    merges = bpe.read_ranks(PATH)
    assert not merges.odd and len(merges.pairs) == len(merges.tokens) - 256
    assert all(a < t and b < t or a < 256 or b < 256 for a, b, t in merges.pairs)


def test_all_code_points_and_long_pieces(spark):
    rng = random.Random(3)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} " for c in points[k : k + 400]) for k in range(0, len(points), 400)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "\u65e5" * 3000, "ab" * 5000]
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH).tokens)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bpe.encode(docs, PATH, public_tokenizers.PATTERN).withColumn("back", bpe.decode(F.col("ids"), PATH))
    for r in got.collect():
        assert list(r.ids) == own.encode_ordinary(texts[r.doc_id]) and bytes(r.back).decode() == texts[r.doc_id]


def test_long_texts_cost_in_proportion(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)), "ab cde " * 200_000]
    began = time.perf_counter()
    out = bpe.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, public_tokenizers.PATTERN).collect()
    assert len(out) == 2 and time.perf_counter() - began < 60


def test_columns_with_helpers_names_are_passed_on(spark):
    docs = spark.createDataFrame([("hello world", 1, "x", 2.0), (None, 2, "y", 3.0)], "text string, codes int, kept string, epoch double")
    out = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert out.columns == ["text", "codes", "kept", "epoch", "ids"]
    assert sorted((r.codes, r.kept, r.epoch, len(r.ids)) for r in out.collect()) == [(1, "x", 2.0, 2), (2, "y", 3.0, 0)]


def test_empty_table(empty):
    assert bpe.digests(empty, PATH, public_tokenizers.PATTERN).count() == 0


def _batches(texts):
    return iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["kept", "text"])])


def test_words_met_again_are_not_folded_again():
    merges = bpe.read_ranks(PATH)
    ranks = SimpleNamespace(value=({t.decode(): i for i, t in enumerate(merges.tokens) if t.isascii()}, merges.tokens))
    common = [f" qzxw{chr(97 + i)}jk" for i in range(20)]
    # each slice of rows has the common words twice and fills the list with rare ones
    texts = ["".join(common) * 2 + "".join(f" vrare{chr(97 + k)}zq{chr(97 + j)}x" for j in range(20)) if i == 0 else None for k in range(6) for i in range(_ROWS)]
    out = list(bpe._cut(public_tokenizers.PATTERN, ranks, 40)(_batches(texts)))
    folded = [w for b in out for row in b.column(3).to_pylist() for w in row]
    assert [folded.count(w) for w in common] == [1] * 20 and len(folded) == 20 + 6 * 20
    assert sum(h is not None for b in out for h in b.column(1).to_pylist()) == 5


def test_tasks_are_few(spark):
    docs = spark.range(64).repartition(64).selectExpr("id AS doc_id", "'some text' AS text")
    few = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    assert bpe.digests(docs, PATH, public_tokenizers.PATTERN).select(F.spark_partition_id().alias("k")).distinct().count() <= few


def test_latin_texts_are_cut_by_the_faster_engine_alike():
    fast, slow = bpe._latin(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    points = [chr(c) for c in range(256)]
    texts = [f"a{x}1{y} {x}'s{y}{x}\n {y}  {x}" for x in points for y in points]
    assert all(fast(t) == slow(t) for t in texts)
    assert bpe._latin(r"(?i:'s)|\p{L}+") is None and bpe._latin(r"\p{Lu}+") is None and bpe._latin(r"[^\S\r]+") is None
    assert bpe._finder(public_tokenizers.PATTERN)("日本 ٠") == slow("日本 ٠")
