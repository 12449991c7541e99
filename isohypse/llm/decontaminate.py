"""Benchmark decontamination with an Aho-Corasick automaton.

The words of every benchmark item give windows of 13 consecutive words (a shorter item is
one window).  One automaton holds all windows; every document is normalised once and
scanned once, and the matches' offsets are mapped back to words and to the original text.

The automaton's size is bounded: the items' total size is read first, and if it exceeds
`block_bytes`, items are dealt into blocks, each with an automaton of its own and a scan
of its own; the hits of the scans are then merged per row.

Cases: a null or empty text has no words; a very long one is scanned whole, in one go; an item without words has no windows; repeated
documents are judged alike, each row by itself; repeated items and items with the same
window all count; an empty benchmark leaves all documents clean; columns that the
operator doesn't name are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import lists, map_batches, slices

#: Bytes that are no part of a word become spaces, A-Z become a-z.
_TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in the original, where A-Z are still there

_automata: dict[str, tuple] = {}


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return (text or "").encode().translate(_TABLE).split()


def windows(item: list[bytes], size: int) -> list[bytes]:
    """The windows of an item, with a space before, between and after their words."""
    if not item:
        return []
    return [b" %b " % b" ".join(item[i : i + size]) for i in range(max(1, len(item) - size + 1))]


def _automaton(key: str, items: list[tuple[str, str]], size: int):
    """Built once in each Python worker; the last one is kept."""
    if key not in _automata:
        owners: dict[str, tuple[int, set[str]]] = {}
        for item_id, text in items:
            own = words(text)
            for w in windows(own, size):
                owners.setdefault(w.decode("latin-1"), (min(size, len(own)), set()))[1].add(item_id)
        found = ahocorasick.Automaton()
        for w, (n, ids) in owners.items():
            found.add_word(w, (len(w), n, frozenset(ids)))
        if owners:
            found.make_automaton()
        _automata.clear()
        _automata[key] = (found, bool(owners))
    return _automata[key]


def scan(text: str | None, automaton, any_window: bool) -> tuple[int, list[int], set[str]]:
    """Number of words, sorted indexes of hit words, ids of items with an occurring window."""
    own = words(text)
    if not own or not any_window:
        return len(own), [], set()
    line = b" %b " % b" ".join(own)
    spaces, hit, ids = None, None, set()
    for end, (length, n, items) in automaton.iter(line.decode("latin-1")):
        if hit is None:
            spaces, hit = np.flatnonzero(np.frombuffer(line, np.uint8) == 32), np.zeros(len(own), bool)
        first = int(np.searchsorted(spaces, end - length + 1))
        hit[first : first + n] = True
        ids |= items
    return len(own), [] if hit is None else np.flatnonzero(hit).tolist(), ids


def spans(text: str, hit: list[int]) -> list[tuple[int, int]]:
    """The stretches of the original text (code points) that runs of hit words cover."""
    if not hit:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    out: list[tuple[int, int]] = []
    for k, i in enumerate(hit):
        if k and hit[k - 1] == i - 1:
            out[-1] = (out[-1][0], at[i][1])
        else:
            out.append(at[i])
    return out


_SCANNED = "doc_id bigint, text_hash string, n_words bigint, hit array<int>, items array<string>"


def _blocks(spark: SparkSession, benchmark: DataFrame, size: int, block_bytes: int) -> list:
    """The items, sent to the workers in blocks of about `block_bytes`."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, out = max(1, -(-total // block_bytes)), []
    for k in range(n):
        own = [(r.item_id, r.text) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)).collect()]
        out.append(spark.sparkContext.broadcast((hashlib.sha256(repr((size, sorted(own))).encode()).hexdigest(), own)))
    return out


def scanned(docs: DataFrame, blocks: list, size: int = 13) -> DataFrame:
    """Per document row and block: its words, hit word indexes and items."""
    out = None
    for sent in blocks:

        def found(batch, sent=sent, single=len(blocks) == 1):
            automaton, any_window = _automaton(*sent.value, size)
            ids, texts = lists(batch, "doc_id", "text")
            got = [scan(t, automaton, any_window) for t in texts]
            return {
                "doc_id": ids,
                "text_hash": [None if single else hashlib.sha256((t or "").encode()).hexdigest() for t in texts],
                "n_words": [g[0] for g in got],
                "hit": [g[1] for g in got],
                "items": [sorted(g[2]) for g in got],
            }

        part = map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), found, _SCANNED)
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit (word indexes), items."""
    sent = _blocks(docs.sparkSession, benchmark, size, block_bytes)
    rows = scanned(docs, sent, size)
    if len(sent) > 1:  # the scans of a row meet; equal rows have equal results, and their number is kept
        rows = rows.groupBy("doc_id", "text_hash").agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
            (F.count("*") / len(sent)).cast("int").alias("times"),
        )
        rows = rows.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    n_hit = F.size("hit").cast("bigint")
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "hit",
        "items",
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    sent = _blocks(docs.sparkSession, benchmark, size, block_bytes)
    if len(sent) == 1:  # one pass, without a shuffle
        one = sent[0]

        def kept(batches):
            for batch in slices(batches):
                automaton, any_window = _automaton(*one.value, size)
                got = [scan(t, automaton, any_window) for t in lists(batch, "text")[0]]
                yield batch.filter(pa.array([not (h and 20 * len(h) >= n) for n, h, _ in got], pa.bool_()))

        return docs.mapInArrow(kept, docs.schema)
    rows = scanned(docs, sent, size).groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("n_hit"))
    dirty = rows.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    of, digest = f"doc_{uuid.uuid4().hex}", f"hash_{uuid.uuid4().hex}"  # names that no column of the input has
    dirty = dirty.select(F.col("doc_id").alias(of), F.col("text_hash").alias(digest))
    return docs.join(dirty, docs["doc_id"].eqNullSafe(F.col(of)) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == F.col(digest)), "left_anti")
