"""Sorting many small fixed-size records by a hash, without a row for each in the JVM.

Tasks pack records into arrays, cut these by the hash's upper bits into buckets and send a
compressed block for each bucket.  The receiving tasks unpack their blocks and sort.  The
number of buckets follows `spark.sql.shuffle.partitions`, which follows the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Buckets for each receiving task, so that hashing buckets to tasks evens out.
_PER_TASK = 8


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(spark: SparkSession) -> int:
    return _PER_TASK * tasks(spark)


def packed(key: np.ndarray, columns: list[np.ndarray], n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, block) of records, sorted by key; blocks of one call have one layout."""
    if not len(key):
        return
    bucket = ((key >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    bucket = bucket[order]
    arrays = [key[order], *(c[order] for c in columns)]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    pack = zstandard.ZstdCompressor(level=1)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        raw = b"".join([np.uint32(b - a).tobytes(), *(_planes(x[a:b]) for x in arrays)])
        yield int(bucket[a]), pack.compress(raw)


def _planes(x: np.ndarray) -> bytes:
    """The array's bytes by place, so that equal upper bytes stand together."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes()


def unpacked(blocks: list[bytes], kinds: list[type]) -> list[np.ndarray]:
    """The columns of all blocks together; kinds of the key and the columns."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    unpack = zstandard.ZstdDecompressor()
    for block in blocks:
        raw = unpack.decompress(block)
        n, at = int(np.frombuffer(raw, np.uint32, 1)[0]), 4
        for k, kind in enumerate(kinds):
            width = np.dtype(kind).itemsize
            planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
            parts[k].append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
            at += n * width
    return [np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, kinds, strict=True)]


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow where fn yields dicts of columns."""
    out = T.StructType.fromDDL(schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for got in fn(it):
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def gathered(blocks: DataFrame, fn: Callable[[list[bytes]], Iterator[dict]], schema: str) -> DataFrame:
    """Deals (bucket, block) rows by bucket and calls fn once for each bucket."""
    n = tasks(blocks.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        by: dict[int, list[bytes]] = {}
        for batch in it:
            for k, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(k, []).append(block)
        for k in sorted(by):
            yield from fn(by.pop(k))

    return mapped(blocks.select("bucket", "block").repartition(n, "bucket"), run, schema)
