"""Jaccard self-join of documents on word shingles, with token-combination prefixes.

A document's tokens are the hashes of its distinct five-word shingles.  Documents with the
same set are one class from the start; only classes are compared.

1. A sketch of fixed size (one array of counters, summed over all tasks) estimates in how
   many classes each token stands.  Tokens are ordered by that estimate, rare ones first;
   any order gives right results, a good one gives few candidates.
2. Two sets with overlap c share one of the first n - c + 1 tokens of each (the prefix), and
   g + 1 of the first n - c + 1 + g.  Rare tokens of the prefix are indexed singly.  Frequent
   tokens are indexed in pairs out of the prefix that is longer by g: dealt into g groups by
   their hashes, two of the g + 1 shared ones stand in one group, so that only pairs within
   groups are needed, and their number is in proportion to the prefix.  g follows the set's
   size in powers of two; sets near a step use both values, so that partners meet.
3. In each posting list, classes are linked to the most common one of a similar size (its
   prefix holds the most frequent tokens, so that it is a centre of its group).  Candidates
   are ruled out first by two exact bounds: a rare token of a prefix that no other class
   lists can't be shared with a set whose prefix reaches further; and bits of one set's
   bitmap that the other lacks are tokens that aren't shared.  The rest is verified against
   the texts.
4. Components of these links are found by label propagation.  In each list, every class is
   then compared with the one of another component that by its bitmap is nearest; and what is
   still apart, and what the bounds leave, is verified in full.  The largest component's
   members aren't compared with each other, so that a group of copies doesn't cost its square.

Cases: a null text, or one without words, has no tokens, n_shingles 0 and a component of
its own; one to four words are one token; a null doc_id has a null component unless its
class has other ids; repeated rows are in one class; among equally common classes the
smallest is the centre, which doesn't change the result; a very long text is one set of
whatever size; an empty table gives an empty table; columns that the operator doesn't name
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _hashing as H
from ._arrow import give_back, lists
from ._packed import buckets, mapped, packed, tasks, unpacked
from ._session import cut

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SKETCH = 24  # bits: counters of the sketch
_CHUNKS = 16


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    n = len(words) - size + 1
    if n <= 1:
        return H.ranges(H.prefix(data), np.zeros(1, np.int64), ends[-1:])
    starts = np.r_[0, ends[: n - 1] + 1]
    return np.unique(H.ranges(H.prefix(data), starts, ends[size - 1 :]))


def signature(tokens: np.ndarray) -> int:
    """The id of a set: a signed hash of its tokens."""
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)


def _least_overlap(n: int) -> int:
    """Tokens that any set with Jaccard similarity of 0.8 shares with a set of n tokens."""
    return -(-4 * n // 5)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 80 * (len(a) + len(b) - common)


_SETS = "kind int, doc_id bigint, n bigint, class bigint, chunk int, block binary"


def _sets(docs: DataFrame) -> DataFrame:
    """One pass: a row for each document (kind 0) and each task's part of the sketch (kind 1)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts, seen, part, waiting = np.zeros(1 << _SKETCH, np.uint8), set(), [], 0

        def count() -> None:
            slots, n = np.unique(np.concatenate(part), return_counts=True)
            counts[slots] = np.minimum(counts[slots].astype(np.int64) + n, 255)
            part.clear()

        for batch in _slices(it):
            ids, texts = lists(batch, "doc_id", "text")
            ns, classes = [], []
            for t in texts:
                tokens = shingles(t)
                ns.append(len(tokens))
                classes.append(signature(tokens) if len(tokens) else None)
                if len(tokens) and classes[-1] not in seen:
                    seen.add(classes[-1])
                    part.append(tokens & np.uint64((1 << _SKETCH) - 1))
                    waiting += len(tokens)
                    if waiting > 1_000_000:
                        count()
                        waiting = 0
            none = [None] * len(ids)
            yield {"kind": [0] * len(ids), "doc_id": ids, "n": ns, "class": classes, "chunk": none, "block": none}
        if part:
            count()
        size, pack = len(counts) // _CHUNKS, zstandard.ZstdCompressor(level=1)
        own = [(k, pack.compress(x.tobytes())) for k in range(_CHUNKS) if (x := counts[k * size : k * size + size]).any()]
        none = [None] * len(own)
        if own:
            yield {"kind": [1] * len(own), "doc_id": none, "n": none, "class": none, "chunk": [k for k, _ in own], "block": [b for _, b in own]}
        give_back()

    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, _SETS)


def _sketch(sets: DataFrame) -> tuple[np.ndarray, int]:
    """Estimates as levels (a byte for each counter), and the level from which tokens are frequent."""
    size = (1 << _SKETCH) // _CHUNKS

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        totals: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in it:
            for k, b in zip(*lists(batch, "chunk", "block"), strict=True):
                totals.setdefault(k, np.zeros(size, np.uint32))
                totals[k] += np.frombuffer(unpack.decompress(b), np.uint8)
        for k, x in totals.items():
            yield {"chunk": [k], "total": [int(x.sum())], "levels": [np.minimum(255, 8 * np.log2(1.0 + x)).astype(np.uint8).tobytes()]}

    levels, total = np.zeros(1 << _SKETCH, np.uint8), 0
    parts = mapped(sets.where("kind = 1").select("chunk", "block").repartition(_CHUNKS, "chunk"), run, "chunk int, total bigint, levels binary")
    for r in parts.collect():  # _CHUNKS rows, a byte for each counter in all
        levels[r.chunk * size : r.chunk * size + size] = np.frombuffer(r.levels, np.uint8)
        total += r.total
    mean = total / (1 << _SKETCH)
    return levels, int(8 * np.log2(1 + 64 + 4 * mean))


def _groups(n: int) -> tuple[int, ...]:
    """The numbers of groups that a set of n tokens and its partners may use: powers of two near n / 10."""
    return tuple(sorted({1 << max(0, (size // 10).bit_length() - 1) for size in (4 * n // 5, n, -(-5 * n // 4))}))


def indexed(tokens: np.ndarray, levels: np.ndarray, frequent: int) -> tuple[np.ndarray, int, int, int]:
    """The keys under which a set is indexed: first those of rare tokens, then those of pairs.

    With the number of rare tokens, the place of the prefix's last token in the order of all
    tokens, and how common the prefix is (0 to 255).
    """
    n = len(tokens)
    rank = levels[tokens & np.uint64((1 << _SKETCH) - 1)]
    p = n - _least_overlap(n) + 1
    order = np.lexsort((tokens, rank))
    first = tokens[order[:p]][rank[order[:p]] < frequent]
    out = [H.mixed(first)]
    for g in _groups(n):
        reach = order[: p + g]
        own = tokens[reach][rank[reach] >= frequent]
        if len(own) > 1:
            own = own[np.lexsort((own, own >> np.uint64(40) & np.uint64(g - 1)))]
            group = own >> np.uint64(40) & np.uint64(g - 1)
            for d in range(1, int(np.unique(group, return_counts=True)[1].max())):
                same = group[d:] == group[:-d]
                out.append(H.mixed(own[:-d][same] * np.uint64(0x9E3779B97F4A7C15) + own[d:][same]))
    pairs = np.unique(np.concatenate(out[1:])) if len(out) > 1 else np.zeros(0, np.uint64)
    end = order[p - 1]
    return np.r_[out[0], pairs], len(first), int(rank[end]) << 55 | int(tokens[end]) >> 9, int(rank[order[:p]].mean())


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python objects at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


_FOUND = "kind int, key bigint, a bigint, b bigint, n bigint, last bigint, bits binary"
_STAR, _LIST, _TWO, _CLASS = range(4)


def _postings(docs: DataFrame, levels, frequent: int) -> DataFrame:
    """What the posting lists give.

    kind 0: a and b are to be compared; kind 1: class a (n tokens) stands in the list of key,
    of three classes and more; kind 2: a and b are alone in n lists of rare tokens; kind 3:
    class a has n tokens, b of them rare ones of its prefix, with `last` and a bitmap.
    Kind 1 with b = 1 is a list of a rare token.
    """
    spark = docs.sparkSession
    sent, n_buckets = spark.sparkContext.broadcast(levels), buckets(spark)

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen, keys, columns, classes, held = set(), [], [[], [], [], []], [], 0

        def flush() -> Iterator[dict]:
            got = list(packed(np.concatenate(keys), [np.concatenate(c) for c in columns], n_buckets))
            yield {"bucket": [k for k, _ in got], "kind": [_LIST] * len(got), "block": [b for _, b in got]}
            name = np.array([c[0] for c in classes], np.int64)
            more = [np.array([c[k] for c in classes], kind) for k, kind in ((1, np.uint32), (2, np.uint32), (3, np.int64))]
            got = list(packed(H.mixed(name.view(np.uint64)), [name, *more, *np.array([c[4] for c in classes]).T], n_buckets))
            yield {"bucket": [k for k, _ in got], "kind": [_CLASS] * len(got), "block": [b for _, b in got]}
            for x in (keys, classes, *columns):
                x.clear()

        for t in (t for part in _slices(it) for t in lists(part, "text")[0]):
            tokens = shingles(t)
            if not len(tokens) or (c := signature(tokens)) in seen:
                continue
            seen.add(c)
            own, rare, last, common = indexed(tokens, sent.value, frequent)
            keys.append(own)
            kinds = np.zeros(len(own), np.uint8)
            kinds[:rare] = 1
            for into, x in zip(columns, (np.full(len(own), c, np.int64), np.full(len(own), len(tokens), np.uint32), kinds, np.full(len(own), common, np.uint8)), strict=True):
                into.append(x)
            classes.append((c, len(tokens), rare, last, bitmap(tokens)))
            held += len(own)
            if held > 500_000:
                yield from flush()
                held = 0
        if keys:
            yield from flush()
        give_back()

    def empty_but(size: int, **columns) -> dict:
        none = [None] * size
        return {k: columns.get(k, none) for k in ("kind", "key", "a", "b", "n", "last", "bits")}

    def classes_of(blocks: list[bytes]) -> Iterator[dict]:
        _, name, n, rare, last, *bits = unpacked(blocks, [np.uint64, np.int64, np.uint32, np.uint32, np.int64] + [np.int64] * _WORDS)
        name, at = np.unique(name, return_index=True)
        own = np.ascontiguousarray(np.stack(bits, 1)[at])
        yield empty_but(len(name), kind=[_CLASS] * len(name), a=name, b=rare[at].astype(np.int64), n=n[at].astype(np.int64), last=last[at], bits=[x.tobytes() for x in own])

    def meet(blocks: list[bytes]) -> Iterator[dict]:
        key, cls, n, rare, common = unpacked(blocks, [np.uint64, np.int64, np.uint32, np.uint8, np.uint8])
        order = np.lexsort((cls, n, key))
        key, cls, n, rare, common = (x[order] for x in (key, cls, n, rare, common))
        new = np.r_[True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]
        key, cls, n, rare, common = (x[new] for x in (key, cls, n.astype(np.int64), rare, common))
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        size = np.diff(edges)
        two = edges[:-1][size == 2]
        if len(two):
            pairs, times = np.unique(np.stack([np.minimum(cls[two], cls[two + 1]), np.maximum(cls[two], cls[two + 1]), ]), axis=1, return_inverse=True)
            k = np.bincount(times.ravel(), weights=rare[two], minlength=pairs.shape[1]).astype(np.int64)
            yield empty_but(pairs.shape[1], kind=[_TWO] * pairs.shape[1], a=pairs[0], b=pairs[1], n=k)
        links, known = [], set()
        for i in np.flatnonzero(size > 2).tolist():
            a, b = int(edges[i]), int(edges[i + 1])
            own, sizes = cls[a:b], n[a:b]
            if (name := own.tobytes()) in known:  # the same classes under another key
                continue
            known.add(name)
            at = 0
            while at < len(own):  # those of similar size, and the most common of them
                end = int(np.searchsorted(sizes, sizes[at] * 5 // 4, "right"))
                if end > at + 1:
                    hub = at + int(np.argmax(common[a + at : a + end]))
                    links.append(np.stack([np.full(end - at - 1, own[hub]), np.delete(own[at:end], hub - at)]))
                at = max(end, at + 1)
        if links:
            pairs = np.unique(np.sort(np.concatenate(links, 1), 0), axis=1)
            yield empty_but(pairs.shape[1], kind=[_STAR] * pairs.shape[1], a=pairs[0], b=pairs[1])
        many = np.repeat(size > 2, size)
        if many.any():
            yield empty_but(int(many.sum()), kind=[_LIST] * int(many.sum()), key=key[many].view(np.int64), a=cls[many], b=rare[many].astype(np.int64), n=n[many])

    blocks = mapped(docs.select("text"), send, "bucket int, kind int, block binary")

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        by: dict[tuple[int, int], list[bytes]] = {}
        for batch in it:
            for k, kind, block in zip(*lists(batch, "bucket", "kind", "block"), strict=True):
                by.setdefault((k, kind), []).append(block)
        for k, kind in sorted(by):
            yield from (classes_of if kind == _CLASS else meet)(by.pop((k, kind)))

    return mapped(blocks.repartition(tasks(spark), "bucket"), each, _FOUND)


def _judged(found: DataFrame) -> DataFrame:
    """class, n, alone, last, bits: `alone` rare tokens of its prefix are in no other class's."""
    met = found.where(f"kind = {_LIST} AND b = 1").select(F.col("a").alias("class"), F.lit(1).cast("bigint").alias("k"))
    two = found.where(f"kind = {_TWO} AND n > 0").select(F.explode(F.array("a", "b")).alias("class"), F.col("n").alias("k"))
    met = met.union(two).groupBy("class").agg(F.sum("k").alias("k"))
    own = found.where(f"kind = {_CLASS}").select(F.col("a").alias("class"), "n", F.col("b").alias("rare"), "last", "bits")
    return own.join(met, "class", "left").select("class", "n", (F.col("rare") - F.coalesce("k", F.lit(0))).alias("alone"), "last", "bits")


_WORDS = 16  # of 64 bits: a set's bitmap


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A set's bits: a token sets one of them."""
    bits = np.zeros(64 * _WORDS, np.uint8)
    bits[(tokens >> np.uint64(20)) & np.uint64(64 * _WORDS - 1)] = 1
    return np.packbits(bits).view(np.int64)


def can_link(n, m, alone_n, alone_m, last_n, last_m) -> np.ndarray:
    """Whether sizes and prefixes leave room for a link (nine times the overlap is at least four times both sizes)."""
    left, right = n - alone_n, m - alone_m
    most = np.where(last_n < last_m, left, np.where(last_n > last_m, right, np.maximum(left, right)))
    most = np.minimum(most, np.minimum(n, m))
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * most >= 4 * (n + m))


def room(n, m, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What bitmaps leave of a link, negative if none: each bit of one set alone is a token that isn't shared."""
    lost = lambda x, y: np.bitwise_count(x & ~y).sum(1).astype(np.int64)
    return 9 * np.minimum(n - lost(p, q), m - lost(q, p)) - 4 * (n + m)


def _words(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(-1, _WORDS)


_JUDGED = ("n", "alone", "last", "bits")


def _possible(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """The pairs (a, b) that both bounds leave."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in it:
            if not batch.num_rows:
                continue
            col = {k: batch.column(batch.schema.get_field_index(k)) for k in batch.schema.names}
            num = {k: col[k].to_numpy(zero_copy_only=False) for k in col if not k.endswith("bits")}
            good = can_link(num["n"], num["m_n"], num["alone"], num["m_alone"], num["last"], num["m_last"])
            good &= room(num["n"], num["m_n"], *(_words(col[k].to_pylist()) for k in ("bits", "m_bits"))) >= 0
            yield {"a": num["a"][good], "b": num["b"][good]}

    both = pairs.join(judged.withColumnRenamed("class", "a"), "a")
    both = both.join(judged.select(F.col("class").alias("b"), *[F.col(k).alias(f"m_{k}") for k in _JUDGED]), "b")
    return mapped(both, run, "a bigint, b bigint")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, block: compressed texts of the wanted classes, one of each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen, pack = set(), zstandard.ZstdCompressor(level=3)
        for batch in _slices(it):
            classes, blocks = [], []
            for t in lists(batch, "text")[0]:
                tokens = shingles(t)
                if len(tokens) and (c := signature(tokens)) not in seen:
                    seen.add(c)
                    classes.append(c)
                    blocks.append(pack.compress(t.encode()))
            yield {"class": classes, "block": blocks}
        give_back()

    all_texts = mapped(docs.select("text"), run, "class bigint, block binary")
    return all_texts.join(wanted, "class", "left_semi").dropDuplicates(["class"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        unpack, sets = zstandard.ZstdDecompressor(), {}

        def tokens(c: int, block: bytes) -> np.ndarray:
            if c not in sets:
                if len(sets) > 500:
                    sets.clear()
                sets[c] = shingles(unpack.decompress(block).decode())
            return sets[c]

        for batch in it:
            rows = zip(*lists(batch, "a", "b", "left", "right"), strict=True)
            good = [(a, b) for a, b, x, y in rows if linked(tokens(a, x), tokens(b, y))]
            yield {"a": [a for a, _ in good], "b": [b for _, b in good]}

    both = pairs.join(texts.select(F.col("class").alias("a"), F.col("block").alias("left")), "a")
    both = both.join(texts.select(F.col("class").alias("b"), F.col("block").alias("right")), "b")
    return mapped(both.select("a", "b", "left", "right"), run, "a bigint, b bigint")


def connected(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, by label propagation with shortcuts."""
    links = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    roots = cut(links.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("root")).withColumnRenamed("u", "node"))
    while True:
        near = links.join(roots, links["v"] == roots["node"]).groupBy("u").agg(F.min("root").alias("near"))
        step = roots.join(near, roots["node"] == near["u"]).select("node", "root", F.least("root", "near").alias("next"))
        jump = roots.select(F.col("node").alias("via"), F.col("root").alias("far"))
        step = step.join(jump, step["next"] == jump["via"], "left").select("node", F.least("next", F.coalesce("far", "next")).alias("new"), "root")
        step = cut(step)
        changed = step.where("new <> root").limit(1).count()
        roots = step.select("node", F.col("new").alias("root"))
        if not changed:
            return roots


_ROWS = 64  # of a list's classes that are compared with all others at once
_PAIRS = 100_000  # of which bitmaps are compared at once


def _open_pairs(lists_: DataFrame, judged: DataFrame, roots: DataFrame, best: bool) -> DataFrame:
    """Pairs of one list in different components that both bounds leave, each once.

    A list's largest component is on one side only.  A class without a component is one of
    its own.  With `best`, each class gives one pair a list, that with the most room.
    """
    post = lists_.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    many = post.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    post = post.join(many, "key", "left_semi").join(judged, "class")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts, bits = [], []
        for b in it:
            if b.num_rows:
                parts.append([x.to_numpy(zero_copy_only=False) for x in b.columns[:6]])
                bits.append(_words(b.column(6).to_pylist()))
        if not parts:
            return
        key, cls, root, n, alone, last = (np.concatenate([p[k] for p in parts]) for k in range(6))
        bits = np.concatenate(bits)
        order = np.argsort(key, kind="stable")
        key, cls, root, n, alone, last = (x[order] for x in (key, cls, root, n, alone, last))
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        found, held = [], 0

        def once() -> dict:
            pairs = np.unique(np.concatenate(found, 1), axis=1)
            found.clear()
            return {"a": pairs[0], "b": pairs[1]}

        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            names, size = np.unique(root[a:b], return_counts=True)
            outside = a + np.flatnonzero(root[a:b] != names[np.argmax(size)])
            for at in range(0, len(outside), _ROWS):
                i = outside[at : at + _ROWS, None]
                j = np.arange(a, b)[None, :]
                ok = (root[i] != root[j]) & can_link(n[i], n[j], alone[i], alone[j], last[i], last[j])
                x, y = np.nonzero(ok)
                x, y = i[x, 0], a + y
                left = np.concatenate([np.zeros(0, np.int64), *(room(n[x[k : k + _PAIRS]], n[y[k : k + _PAIRS]], bits[order[x[k : k + _PAIRS]]], bits[order[y[k : k + _PAIRS]]]) for k in range(0, len(x), _PAIRS))])
                x, y, left = x[left >= 0], y[left >= 0], left[left >= 0]
                if best and len(x):
                    by = np.lexsort((-left, x))
                    by = by[np.r_[True, x[by][1:] != x[by][:-1]]]
                    x, y = x[by], y[by]
                found.append(np.stack([np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])]))
                held += len(x)
            if held > 500_000:
                yield once()
                held = 0
        if found:
            yield once()

    post = post.select("key", "class", "root", "n", "alone", "last", "bits").repartition(tasks(lists_.sparkSession), "key")
    return mapped(post, run, "a bigint, b bigint").distinct()


def _joined(docs: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with classes, verified links, and components of linked classes.

    The links are enough for the components; with `whole` they are all there are.
    """
    sets = cut(_sets(docs))
    levels, frequent = _sketch(sets)
    found = cut(_postings(docs, levels, frequent))
    judged = cut(_judged(found))
    pairs = found.where(f"kind IN ({_STAR}, {_TWO})").select("a", "b").distinct()
    pairs = cut(_possible(pairs, judged))
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    links = cut(_verified(pairs, cut(_texts(docs, ends(pairs)))))
    roots = connected(links)
    lists_ = found.where(f"kind = {_LIST}").select("key", F.col("a").alias("class"))
    # first each class's nearest one of other components, then all pairs between those still apart
    for best in (False,) if whole else (True, False):
        # with no roots each class counts as a component of its own, so that no pair is left out
        rest = _open_pairs(lists_, judged, roots.limit(0) if whole else roots, best)
        rest = cut(rest.join(pairs, ["a", "b"], "left_anti"))
        if not rest.limit(1).count():
            break
        pairs = cut(pairs.union(rest))
        more = cut(_verified(rest, cut(_texts(docs, ends(rest)))))
        if more.limit(1).count():
            links = cut(links.union(more)) if whole else cut(_contracted(links, more, roots))
            roots = connected(links)
    return sets.where("kind = 0").select("doc_id", "n", "class"), links, roots


def _contracted(links: DataFrame, more: DataFrame, roots: DataFrame) -> DataFrame:
    """The links, and of the new ones one between each two components."""
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    met = more.join(named("a"), "a", "left").join(named("b"), "b", "left")
    met = met.withColumn("x", F.coalesce("root_a", "a")).withColumn("y", F.coalesce("root_b", "b"))
    one = met.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(F.struct("a", "b")).alias("m"))
    return links.union(one.select("m.a", "m.b"))


def components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, class."""
    rows, _, roots = _joined(docs)
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("low"))
    by_root = classes.join(roots, classes["class"] == roots["node"], "left").withColumn("root", F.coalesce("root", "class"))
    lowest = by_root.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = by_root.join(lowest, "root").select(F.col("class").alias("of"), "component_id")
    out = rows.join(by_class, rows["class"] == by_class["of"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "class")


def link_counts(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class, n_links: the number of other classes (sets of shingles) that its own is linked to.

    All candidates are verified, also those within a component, so that the cost grows
    with the number of links.
    """
    rows, links, _ = _joined(docs, whole=True)
    degree = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("n_links"))
    out = rows.join(degree, rows["class"] == degree["c"], "left")
    return out.select("doc_id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def representatives(docs: DataFrame, max_sent: int = 2_000_000) -> DataFrame:
    """Of each component the document with the smallest doc_id, with all columns."""
    judged = cut(components(docs).select("doc_id", "component_id"))
    gone = judged.where("doc_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct()
    repeated = judged.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.limit(1).count():  # rows that share an id: of those with one text one stays
        twice = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
        docs = docs.join(repeated, "doc_id", "left_anti").select(docs.columns).union(twice)
    if gone.count() > max_sent:
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.doc_id for r in gone.collect()], np.int64)))

    def kept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = lists(batch, "doc_id")[0]
            known = np.array([x or 0 for x in ids], np.int64)
            stays = ~np.isin(known, sent.value) | np.array([x is None for x in ids])
            yield batch.filter(pa.array(stays))

    return docs.mapInArrow(kept, docs.schema)
