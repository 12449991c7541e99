"""Removal of repeated byte strings: prefix-free parsing with suffix arrays of the dictionary.

Texts are byte strings; every byte that a string of `width` (50) bytes covers which also
starts in a document with a smaller doc_id is removed.

1. Triggers.  Each window of 50 bytes is named by its trigger, the smallest rolling hash of
   24 bytes inside it.  Equal windows have equal triggers, and neighbouring windows mostly
   share one, so that triggers cut a text into phrases (runs of windows of one trigger).
   Phrases overlap by 49 bytes, so no string to be compared reaches beyond its phrase.
2. Triggers are counted by row.  Only phrases whose trigger stands in two rows or more can
   repeat; the others are left where they are.
3. The phrases that are left make the dictionary, each with the smallest doc_id it stands
   in; their places in the texts are the parse.  The dictionary is cut by trigger, and each
   part's suffix array (of suffixes of 50 bytes and more) puts equal strings side by side:
   in each group of strings with 50 bytes in common, every doc_id but the smallest repeats.
   The parse carries the answers back to the texts.  Since phrases hold whole windows, the
   order among equal 50-byte prefixes never matters, and the parse's own suffix array,
   which would settle it, isn't needed.

Texts are dealt into buckets by their total size (`_BUCKET` bytes each), so that what a task
sorts at once doesn't grow with the input.  Within a bucket distinct phrases are sorted in
parts of one range of triggers.  Records are sent in blocks, in which each row is named once.
Rows are named by 64-bit hashes of doc_id and content; where a row's answer is used, its
doc_id is compared too.  The bits of a trigger that are sent follow the input's size; fewer
bits only let more phrases through.

Before each shuffle, rows of a task that have the same trigger or phrase are combined (two
rows, or the smallest doc_id, are sent; the others' answer is known and passed on), so that
a text with any number of copies sends a bounded number of records from each task.

Cases: a null text is empty; a very long text is cut into phrases like any other, and only
its own task holds it whole; ties (equal strings of one smallest doc_id) are all kept; a row with a null doc_id is left whole and removes nothing;
rows that share a doc_id don't remove from each other; texts under 50 bytes are left whole;
an empty table gives an empty table; columns that the operator doesn't name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _hashing as H
from ._arrow import lists
from ._packed import mapped, tasks

_TRIGGER = 24
_ROWS = "bucket int, kind int, row bigint, doc_id bigint, block binary"
_TRIGGERS, _SHARED, _TEXT, _PHRASES, _MASKS = range(5)
_FLUSH = 1_000_000
_BUCKET = 24 << 20  # bytes of text for each bucket
_PART = 1_500_000  # strings of 50 bytes that are sorted at once
_TAG = 3  # bytes by which a row tells its triggers apart


def triggers(data: np.ndarray, width: int) -> np.ndarray:
    """The trigger of each window of that many bytes: sliding minima of rolling hashes, mixed."""
    low = H.rolling(H.prefix(data), _TRIGGER)
    span = width - _TRIGGER + 1
    if len(low) < span:
        return np.zeros(0, np.uint64)
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = span - size
    # minima crowd at the low end: mixed, they spread evenly over buckets
    return H.mixed(np.minimum(low[:-rest], low[rest:]) if rest else low)


def row_key(doc_id: int, data: bytes) -> int:
    """Names a row by its content, so that it can be found again after any retry."""
    return xxhash.xxh64_intdigest(data, seed=doc_id & ((1 << 63) - 1)) - (1 << 63)


def _slices(it: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that fewer texts are Python objects at once."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _row_bucket(row: np.ndarray, n: int) -> np.ndarray:
    return _bucket(row.view(np.uint64), n)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers by their places, so that equal upper bytes stand together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _blocks(bucket: np.ndarray, row: np.ndarray, doc: np.ndarray, arrays: list[np.ndarray], level: int = 1, tails: list[bytes] | None = None) -> Iterator[tuple[int, bytes]]:
    """Records, sorted by bucket already, as a block for each: its rows once, then arrays by byte places."""
    if not len(bucket):
        return
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    pack = zstandard.ZstdCompressor(level=level)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        names, at, which = np.unique(row[a:b], return_index=True, return_inverse=True)
        raw = [np.array([b - a, len(names)], np.uint32).tobytes(), _planes(names), _planes(doc[a:b][at]), _planes(which.astype(np.uint32))]
        raw += [_planes(np.ascontiguousarray(x[a:b])) for x in arrays]
        yield int(bucket[a]), pack.compress(b"".join(raw + (tails[a:b] if tails else [])))


def _unpack(block: bytes, widths: tuple[int, ...]) -> tuple[list[np.ndarray], bytes]:
    """Row, doc and the arrays of a block as unsigned numbers, and what follows them."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, t = np.frombuffer(raw, np.uint32, 2).tolist()
    at, out = 8, []

    def take(size: int, width: int) -> np.ndarray:
        nonlocal at
        at += size * width
        return _wide(np.frombuffer(raw, np.uint8, size * width, at - size * width).reshape(width, size).T)

    names, docs, which = take(t, 8), take(t, 8), take(n, 4).astype(np.int64)
    out = [names[which], docs[which].view(np.int64), *(take(n, w) for w in widths)]
    return out, raw[at:]


def _gathered(blocks: list[bytes], widths: tuple[int, ...]) -> list[np.ndarray]:
    parts = [_unpack(b, widths)[0] for b in blocks]
    return [np.concatenate([p[k] for p in parts]) for k in range(2 + len(widths))]


def _wide(x: np.ndarray) -> np.ndarray:
    """Little-endian bytes, one row a number, as unsigned numbers."""
    out = np.zeros((len(x), 8), np.uint8)
    out[:, : x.shape[1]] = x
    return out.view(np.uint64).reshape(len(x))


def _narrow(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8)[:, :width]


def _sent(kind: int, blocks: list[tuple[int, bytes]]) -> dict:
    none = [None] * len(blocks)
    return {"bucket": [k for k, _ in blocks], "kind": [kind] * len(blocks), "row": none, "doc_id": none, "block": [b for _, b in blocks]}


# ---- triggers ----------------------------------------------------------------------------


def _tag(key: np.ndarray) -> np.ndarray:
    """Some bits of a trigger, all of them sent, by which a row tells its triggers apart."""
    return key >> np.uint64(24) & np.uint64((1 << 8 * _TAG) - 1)


def _shared(row: np.ndarray, tag: np.ndarray, n: int) -> dict:
    """Says to rows which of their triggers are shared: (row, tag)."""
    order = np.lexsort((tag, row, _row_bucket(row, n)))
    row, tag = row[order], tag[order]
    return _sent(_SHARED, list(_blocks(_row_bucket(row, n), row, np.zeros(len(row), np.int64), [_narrow(tag, _TAG)])))


def _passed(sent: dict, n: int) -> dict:
    """An answer that is known already, on its way by a bucket of the exchange: `row` holds its own."""
    return sent | {"bucket": [(k * 7 + 3) % n for k in sent["bucket"]], "row": sent["bucket"]}


def _send_triggers(width: int, n: int, key_bytes: int):
    drop = np.uint64(8 * (8 - key_bytes))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        keys, rows, held = [], [], 0

        def flush() -> Iterator[dict]:
            key, row = np.concatenate(keys) >> drop << drop, np.concatenate(rows)
            keys.clear(), rows.clear()
            order = np.lexsort((row, key))
            key, row = key[order], row[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]
            key, row = key[new], row[new]
            begin = np.r_[True, key[1:] != key[:-1]]
            place = np.arange(len(key)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
            known = place >= 2  # two rows are enough for the others to be told of
            kept = key[~known]
            yield _sent(_TRIGGERS, list(_blocks(_bucket(kept, n), row[~known], np.zeros(len(kept), np.int64), [_narrow(kept >> drop, key_bytes)])))
            if known.any():
                yield _passed(_shared(row[known], _tag(key[known]), n), n)

        for batch in _slices(it):
            for doc_id, text in zip(*lists(batch, "doc_id", "text"), strict=True):
                if doc_id is None or not text:
                    continue
                data = text.encode()
                own = np.unique(triggers(np.frombuffer(data, np.uint8), width))
                if len(own):
                    keys.append(own)
                    rows.append(np.full(len(own), row_key(doc_id, data), np.int64))
                    held += len(own)
                    if held > _FLUSH:
                        yield from flush()
                        held = 0
        if keys:
            yield from flush()

    return run


def _find_shared(n: int, key_bytes: int):
    """Triggers of two rows or more."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        by: dict[int, list[bytes]] = {}
        for batch in it:
            for bucket, kind, to, block in zip(*lists(batch, "bucket", "kind", "row", "block"), strict=True):
                if kind == _SHARED:
                    yield _sent(_SHARED, [(to, block)])
                else:
                    by.setdefault(bucket, []).append(block)
        for bucket in sorted(by):
            row, _, key = _gathered(by.pop(bucket), (key_bytes,))
            order = np.argsort(key, kind="stable")
            key, row = key[order] << np.uint64(8 * (8 - key_bytes)), row[order]
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            low, high = np.minimum.reduceat(row, edges[:-1]), np.maximum.reduceat(row, edges[:-1])
            shared = np.repeat(low != high, np.diff(edges))
            if shared.any():
                yield _shared(row[shared].view(np.int64), _tag(key[shared]), n)

    return run


# ---- phrases -----------------------------------------------------------------------------


def _texts(docs: DataFrame, n: int) -> DataFrame:
    """The texts, compressed, each to the bucket of its row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in _slices(it):
            ids, texts = lists(batch, "doc_id", "text")
            data = [(t or "").encode() for t in texts]
            rows = [row_key(i or 0, d) for i, d in zip(ids, data, strict=True)]
            bucket = _row_bucket(np.array(rows, np.int64), n)
            yield {"bucket": bucket.astype(np.int64).tolist(), "kind": [_TEXT] * len(ids), "row": rows, "doc_id": ids, "block": [pack.compress(d) for d in data]}

    return mapped(docs, run, _ROWS)


def _by_bucket(it: Iterator[pa.RecordBatch], passed: int | None) -> Iterator[tuple[int, list]]:
    """(bucket, [(kind, row, doc_id, block)]); first, as (-1, ...), what is only passed on."""
    by: dict[int, list] = {}
    for batch in it:
        for bucket, *rest in zip(*lists(batch, "bucket", "kind", "row", "doc_id", "block"), strict=True):
            if rest[0] == passed:
                yield -1, rest
            else:
                by.setdefault(bucket, []).append(rest)
    for bucket in sorted(by):
        yield bucket, by.pop(bucket)


def _send_phrases(width: int, n: int):
    """Of each row's shared triggers the phrases: the dictionary's entries and their places."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        entries: dict[tuple[int, bytes], list] = {}  # (trigger, phrase) -> [smallest doc_id, [(row, place)]]
        masks: list[tuple[int, int, int, int]] = []  # (row, doc_id, place, windows) of what a smaller doc_id is known for
        unpack = zstandard.ZstdDecompressor()

        def flush() -> Iterator[dict]:
            rows = [(trigger, doc_id, r, p, phrase) for (trigger, phrase), (doc_id, places) in entries.items() for r, p in places]
            entries.clear()
            if rows:
                yield from _phrase_blocks(rows, n)
            if masks:
                yield _passed(_mask_blocks(*(np.array([m[k] for m in masks], kind) for k, kind in enumerate((np.int64, np.int64, np.uint32, np.uint64))), n), n)
                masks.clear()

        held = 0
        for _, own in _by_bucket(it, None):
            told = [b for kind, _, _, b in own if kind == _SHARED]
            if not told:
                continue
            rows, _, low = _gathered(told, (_TAG,))
            rows = rows.view(np.int64)
            order = np.argsort(rows, kind="stable")
            rows, low = rows[order], low[order]
            done = set()
            for kind, row, doc_id, block in own:
                if kind != _TEXT or doc_id is None or (row, doc_id) in done:
                    continue
                done.add((row, doc_id))
                a, b = np.searchsorted(rows, row, "left"), np.searchsorted(rows, row, "right")
                if a == b:
                    continue
                data = unpack.decompress(block)
                m = triggers(np.frombuffer(data, np.uint8), width)
                on = np.isin(_tag(m), low[a:b])
                edges = np.flatnonzero(np.r_[True, m[1:] != m[:-1], True])
                for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if not on[s]:
                        continue
                    # a long stretch of one trigger (a repeated byte) is cut, so that masks fit 64 bits
                    for at in range(s, e, 64):
                        end = min(e, at + 64)
                        phrase, full = data[at : end + width - 1], (1 << (end - at)) - 1
                        got = entries.setdefault((int(m[s]), phrase), [doc_id, []])
                        if doc_id == got[0]:
                            got[1].append((row, at))
                        elif doc_id > got[0]:
                            masks.append((row, doc_id, at, full))
                        else:
                            masks.extend((r, got[0], p, full) for r, p in got[1])
                            got[0], got[1] = doc_id, [(row, at)]
                        held += 1
                if held > 160_000:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def _phrase_blocks(rows: list[tuple], n: int) -> Iterator[dict]:
    """Phrases by bucket of their trigger, in the order of 16 bits of it, which are sent."""
    key, doc, row, place = (np.array([r[k] for r in rows], kind) for k, kind in enumerate((np.uint64, np.int64, np.int64, np.uint32)))
    order = np.argsort(key, kind="stable")
    key, doc, row, place = (x[order] for x in (key, doc, row, place))
    text = [rows[i][4] for i in order.tolist()]
    sizes = np.array([len(t) for t in text], np.uint8)
    yield _sent(_PHRASES, list(_blocks(_bucket(key, n), row, doc, [place, sizes, _narrow(_part(key), 2)], 3, text)))


def _part(key: np.ndarray) -> np.ndarray:
    """The part of a bucket in which a trigger's phrases are sorted."""
    return key >> np.uint64(8) & np.uint64(0xFFFF)


def _mask_blocks(row, doc, place, mask, n: int) -> dict:
    order = np.lexsort((place, row, _row_bucket(row, n)))
    row, doc, place, mask = row[order], doc[order], place[order], mask[order]
    return _sent(_MASKS, list(_blocks(_row_bucket(row, n), row, doc, [place, mask])))


def repeated(phrases: list[bytes], docs: np.ndarray, width: int) -> np.ndarray:
    """For each phrase a mask of the windows that also stand with a smaller doc_id.

    The suffix array of the dictionary's part: all suffixes of `width` bytes and more, in
    the order of their first `width` bytes.
    """
    data = np.frombuffer(b"".join(phrases), np.uint8)
    sizes = np.array([len(p) for p in phrases])
    counts = sizes - width + 1
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    owner = np.repeat(np.arange(len(phrases), dtype=np.int32), counts)
    offset = (np.arange(counts.sum()) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)).astype(np.uint8)
    heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, width)[first[owner] + offset]).view(f"S{width}").reshape(-1)
    array = np.argsort(heads, kind="stable").astype(np.int32)
    ordered = heads[array]
    edges = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    del heads, ordered
    held = docs[owner[array]]
    lowest = np.minimum.reduceat(held, edges)
    again = held > np.repeat(lowest, np.diff(np.r_[edges, len(array)]))
    bits = np.where(again, np.uint64(1) << offset[array].astype(np.uint64), np.uint64(0))
    out = np.zeros(len(phrases), np.uint64)
    np.bitwise_or.at(out, owner[array], bits)
    return out


def _sort_suffixes(width: int, n: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for bucket, own in _by_bucket(it, _MASKS):
            if bucket < 0:
                yield _sent(_MASKS, [(own[1], own[3])])
                continue
            columns, phrases = [], []
            for _, _, _, block in own:
                got, text = _unpack(block, (4, 1, 2))
                columns.append(got)
                ends = np.cumsum(got[3].astype(np.int64)).tolist()
                phrases += [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            row, doc, place, size, part = (np.concatenate([c[k] for c in columns]) for k in range(5))
            row, place = row.view(np.int64), place.astype(np.uint32)
            order = np.argsort(part, kind="stable")
            work = np.cumsum(size[order].astype(np.int64) - width + 1)
            at = 0
            while at < len(order):  # whole parts, of about as many strings as are sorted at once
                end = int(np.searchsorted(work, (work[at - 1] if at else 0) + _PART, "right"))
                end = len(order) if end >= len(order) else max(end, at + 1)
                while end < len(order) and part[order[end]] == part[order[end - 1]]:
                    end += 1
                sent = order[at:end]
                at = end
                # the dictionary: each distinct phrase once, with its smallest doc_id
                number: dict[bytes, int] = {}
                which = np.array([number.setdefault(phrases[i], len(number)) for i in sent.tolist()])
                lowest = np.full(len(number), np.iinfo(np.int64).max)
                np.minimum.at(lowest, which, doc[sent])
                mask = repeated(list(number), lowest, width)[which]
                full = (np.uint64(1) << (size[sent] - np.uint64(width - 1))) - np.uint64(1)
                full[size[sent] == width + 63] = np.uint64(0xFFFFFFFFFFFFFFFF)
                mask = np.where(doc[sent] > lowest[which], full, mask)
                on = mask > 0
                if on.any():
                    yield _mask_blocks(row[sent][on], doc[sent][on], place[sent][on], mask[on], n)

    return run


# ---- the texts again ---------------------------------------------------------------------

_OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _remove(width: int, with_kept: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        unpack = zstandard.ZstdDecompressor()
        for _, own in _by_bucket(it, None):
            told = [b for kind, _, _, b in own if kind == _MASKS]
            rows, docs, place, mask = _gathered(told, (4, 8)) if told else [np.zeros(0, np.uint64)] * 4
            rows = rows.view(np.int64)
            order = np.argsort(rows, kind="stable")
            rows, docs, place, mask = rows[order], docs[order].view(np.int64), place[order].astype(np.int64), mask[order]
            out: dict = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for kind, row, doc_id, block in own:
                if kind != _TEXT:
                    continue
                data = unpack.decompress(block)
                a, b = int(np.searchsorted(rows, row, "left")), int(np.searchsorted(rows, row, "right"))
                spans, kept = 0, data
                if a < b and doc_id is not None:
                    mine = docs[a:b] == doc_id
                    bits = (mask[a:b][mine, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) > 0
                    which, bit = np.nonzero(bits)
                    edge = np.zeros(len(data) + 1, np.int32)
                    starts = np.unique(place[a:b][mine][which] + bit)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + width, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for name, x in zip(out, (doc_id, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None), strict=True):
                    out[name].append(x)
            if out["doc_id"]:
                yield out

    return run


def dedup(docs: DataFrame, width: int = 50, with_kept: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes)."""
    if not _TRIGGER < width <= 128:
        raise ValueError(f"width must be over {_TRIGGER} and at most 128")
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total = own.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n = p = max(tasks(docs.sparkSession), -(-total // _BUCKET))  # one bucket is sorted at a time
    key_bytes = min(8, max(5, -(-(max(1, total // 14).bit_length() + 8) // 8)))
    deal = lambda df: df.repartition(p, "bucket")
    shared = mapped(deal(mapped(own, _send_triggers(width, n, key_bytes), _ROWS)), _find_shared(n, key_bytes), _ROWS)
    phrases = mapped(deal(shared.union(_texts(own, n))), _send_phrases(width, n), _ROWS)
    masks = mapped(deal(phrases), _sort_suffixes(width, n), _ROWS)
    out = mapped(deal(masks.union(_texts(own, n))), _remove(width, with_kept), _OUT)
    return out if with_kept else out.drop("kept")
