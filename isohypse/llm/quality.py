"""Quality rules with cross-document line frequency.

Base rules look at one text: word and symbol counts, repeated lines, repeated five-word
windows.  The cross-document rule hashes each normalised line, counts in how many
different documents of a host (the source) it stands, and takes a line as boilerplate
where that number reaches both `min_docs` and `max_share` of the host's documents.  A
document of which less than `min_left` of the words is left without such lines is
rejected.  Exact copies within a host count as one document, so that a text isn't its own
boilerplate.

The lines' hashes are counted with partial sums before the shuffle.  Boilerplate lines
are sent to all tasks while there are at most `max_sent`; beyond that they are joined.

Cases: a null text has no words and fails the base rules; a very long one is read whole; a null source is a host of its
own; repeated rows are judged alike; an empty table gives an empty table; columns that
the operator doesn't name are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import lists, map_batches
from ._session import cut

_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"
_FOLD = bytes(48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ALL = 0  # stands for the host's documents among the hashes of lines


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return 0, 0, 0, 0, 0
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACES)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes], size: int = 5) -> int:
    """Words inside windows that stand twice or more in the list."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for k in range(size):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n]
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(keys, twice)).tolist()
    real = Counter(tuple(words[i : i + size]) for i in at)  # hashes only choose what to compare
    hit = np.zeros(len(words), bool)
    for i in at:
        if real[tuple(words[i : i + size])] > 1:
            hit[i : i + size] = True
    return int(hit.sum())


def line_hashes(text: str | None) -> tuple[list[int], list[int]]:
    """The hash and the number of words of each line that has words."""
    hashes, sizes = [], []
    for line in (text or "").encode().translate(_FOLD).split(b"\n"):
        words = line.split()
        if words:
            hashes.append(xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63) or 1)
            sizes.append(len(words))
    return hashes, sizes


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", min_docs: int = 50, max_share: float = 0.05) -> DataFrame:
    """(host, line): hashes of lines above the limits of their host."""

    def rows(batch: pa.RecordBatch) -> dict:
        hosts, texts = lists(batch, "host", "text")
        first = {(h, xxhash.xxh64_intdigest(t or "") - (1 << 63)): t for h, t in zip(hosts, texts, strict=True)}
        return {"host": [h for h, _ in first], "content": [c for _, c in first], "lines": [[_ALL, *set(line_hashes(t)[0])] for t in first.values()]}

    of_text = map_batches(docs.select(F.col(host).alias("host"), F.col(text).alias("text")), rows, "host string, content bigint, lines array<bigint>")
    one = of_text.groupBy("host", "content").agg(F.first("lines").alias("lines"))
    counts = one.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    counts = cut(counts.where((F.col("n") >= min_docs) | (F.col("line") == _ALL)))
    hosts = counts.where(F.col("line") == _ALL).select(F.col("host").alias("of"), F.col("n").alias("docs"))
    return counts.where(F.col("line") != _ALL).join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") >= F.greatest(F.lit(min_docs), F.col("docs") * max_share)).select("host", "line")


_BASE = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def judge(docs: DataFrame, host: str = "source", min_docs: int = 50, max_share: float = 0.05, min_left: float = 0.3, max_sent: int = 500_000) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, left_words and kept."""
    common = cut(boilerplate(docs, host, "text", min_docs, max_share))
    of = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(host).alias("host"), "text")
    if common.count() <= max_sent:
        sent = docs.sparkSession.sparkContext.broadcast({(r.host, r.line) for r in common.collect()})

        def rows(batch: pa.RecordBatch) -> dict:
            ids, hosts, texts = lists(batch, "doc_id", "host", "text")
            got = [base(t) for t in texts]
            left = []
            for h, t, g in zip(hosts, texts, got, strict=True):
                left.append(g[0] - sum(n for x, n in zip(*line_hashes(t), strict=True) if (h, x) in sent.value) if sent.value else g[0])
            return {"doc_id": ids, **dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), map(list, zip(*got, strict=True)), strict=True)), "left_words": left}

        out = map_batches(of, rows, _BASE + ", left_words bigint")
    else:
        out = _joined(of, common)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("left_words") >= min_left * F.col("n_words")))


def _joined(of: DataFrame, common: DataFrame) -> DataFrame:
    """The same by a join: for more boilerplate lines than can be sent to all tasks."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def stats(batch: pa.RecordBatch) -> dict:
        ids, hosts, texts = lists(batch, "doc_id", "host", "text")
        got, by = [base(t) for t in texts], [Counter() for _ in texts]
        for t, c in zip(texts, by, strict=True):
            for x, n in zip(*line_hashes(t), strict=True):
                c[x] += n
        return {"doc_id": ids, "host": hosts, "content": [xxhash.xxh128_hexdigest(t or "") for t in texts], **dict(zip(names, map(list, zip(*got, strict=True)), strict=True)), "lines": [[{"line": x, "n": n} for x, n in c.items()] for c in by]}

    rows = map_batches(of, stats, _BASE.replace("doc_id bigint", "doc_id bigint, host string, content string") + ", lines array<struct<line: bigint, n: int>>")
    rows = rows.groupBy("doc_id", "host", "content", *names).agg(F.first("lines").alias("lines"), F.count("*").alias("times"))
    key = ["doc_id", "host", "content"]
    each = rows.select(*key, F.explode("lines").alias("x")).select(*key, "x.line", "x.n")
    gone = each.join(common.select(F.col("host").alias("h"), F.col("line").alias("l")), F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
    gone = gone.groupBy(*key).agg(F.sum("n").alias("gone")).select(*(F.col(k).alias(f"g_{k}") for k in key), "gone")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"g_{k}"))
    out = rows.drop("lines").join(gone, same, "left").withColumn("left_words", F.col("n_words") - F.coalesce("gone", F.lit(0)))
    out = out.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return out.select("doc_id", *names, "left_words")


def without_boilerplate(docs: DataFrame, host: str = "source", max_sent: int = 500_000, **limits) -> DataFrame:
    """The texts with boilerplate lines removed (all columns kept): the operator's text output.

    Up to `max_sent` boilerplate lines are sent to all tasks once; beyond that each text is
    joined to those of its own lines that go, never to all lines of its host.
    """
    common = cut(boilerplate(docs, host, "text", **limits))
    kinds = docs.schema
    if common.count() <= max_sent:
        sent = docs.sparkSession.sparkContext.broadcast({(r.host, r.line) for r in common.collect()})
        of = kinds.fieldNames().index(host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [_left(t, lambda x, h=h: (h, x) in sent.value) for t, h in zip(*lists(batch, "text", kinds.fieldNames()[of]), strict=True)]
                yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

        return docs.mapInArrow(run, kinds)
    h, content, gone = (f"{k}_{uuid.uuid4().hex}" for k in ("host", "content", "gone"))  # names that no column of the input has
    keyed = docs.withColumn(content, F.sha2(F.coalesce("text", F.lit("")), 256))

    def own(batch: pa.RecordBatch) -> dict:
        hosts, keys, texts = lists(batch, "host", "content", "text")
        return {"host": hosts, "content": keys, "lines": [list(set(line_hashes(t)[0])) for t in texts]}

    lines = map_batches(keyed.select(F.col(host).alias("host"), F.col(content).alias("content"), "text").dropDuplicates(["host", "content"]), own, "host string, content string, lines array<bigint>")
    lines = lines.select(F.col("host").alias(h), F.col("content").alias("_key"), F.explode("lines").alias("_line"))
    met = lines.join(common, F.col(h).eqNullSafe(F.col("host")) & (F.col("_line") == F.col("line"))).groupBy(h, "_key").agg(F.collect_list("line").alias(gone))
    joined = keyed.join(met, docs[host].eqNullSafe(F.col(h)) & (F.col(content) == F.col("_key")), "left").select(*[keyed[c] for c in docs.columns], gone)
    wide = joined.schema

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_left(t, set(g or ()).__contains__) for t, g in zip(*lists(batch, "text", gone), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return joined.mapInArrow(kept, wide).drop(gone)


def _left(text: str | None, goes) -> str | None:
    """A text without the lines whose hashes go; lines without words stay."""
    return None if text is None else "\n".join(x for x in text.split("\n") if not any(map(goes, line_hashes(x)[0])))
