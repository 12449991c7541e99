"""A training-data pipeline of five stages over `documents`.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again as the next one's docs.  Texts without a sure
language go; of each group of near copies the document with the smallest id stays;
contaminated documents go; personal data is masked; the last stage gives the token ids'
digests of what is left.

The stages share executors, whose heap is full after the first ones.  What comes on top are
Arrow batches: two steps of a task each hold one beside the heap, up to three times while
it grows, and their Python workers another.  So each stage first sets the session to
batches of `BATCH_ROWS` rows at most; a smaller setting stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from isohypse.llm import bpe, decontaminate, language, ngram_join, pii
from isohypse.llm._session import checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most from here on; 0 and less is without a limit."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def _in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)  # stays set: the stage's rows are made when they are written
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language", _in_small_batches(identify_language)),
    ("near_copies", _in_small_batches(drop_near_copies)),
    ("decontamination", _in_small_batches(drop_contaminated)),
    ("personal_data", _in_small_batches(mask_personal_data)),
    ("tokens", _in_small_batches(encode)),
]

#: Compression, the field and the byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            out.write.parquet(f"{base}/{k}-{name}")
            out = spark.read.parquet(f"{base}/{k}-{name}")
        docs = out
    return docs
