"""Byte-level BPE encoding and decoding; Spark higher-order functions fold the merges.

A text is cut into pieces by the tokenizer's pattern.  A piece that is a token is looked up
in the vocabulary.  Of the others, each task lists the distinct ones as it meets them; an
expression turns each into an array of byte ids, and ``aggregate`` folds ranked merges over
the array: every step looks up the rank of each adjacent pair in a literal table and merges
all occurrences of the lowest-ranked pair.  The next step of the same task puts the folded
words' ids back in the places of the pieces.  Decoding concatenates the byte strings of the
ids.  All this is one pass without a shuffle; the tables that are sent are the vocabulary's
own, of a size that doesn't depend on the input.

Two facts make the fold exact.  (1) A token has one *canonical* pair of parts: the state
of its bytes after all lower-ranked merges.  Whenever two neighbours join to that token
while its rank is the lowest in the piece, they are that pair, so one table entry per
token is enough.  (2) Both parts of a canonical pair have lower ranks than the token, so
merging never creates a pair of lower or equal rank, and all occurrences of the lowest
pair can be merged in one step, from left to right.

The rank table is a row-displacement table: the entry of the pair (x, y) stands at
``base[x] + y`` and holds x with the rank, so that a lookup is two array reads.

A task's list of words starts anew after a number of words (an epoch), so that its memory is
bounded; words met again in an epoch go on in the next one and are not folded again.  Both
steps see the rows of a task in one order, so that a word's number in its epoch names it; a
task that runs again numbers its words again.

Cases: null text is the empty text (no tokens; the hash of the empty string); repeated rows
give repeated results, and there are no ties, as each row is coded by itself; an empty table
gives an empty table; other columns, of any name, are passed on by `encode` and not read by
`digests`.  A very long text costs in proportion to its length.  A long piece without a
break is cut first, between bytes that no token holds together; the fold of a part takes
steps in proportion to its merges.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import slices


@dataclass(frozen=True)
class Merges:
    """Ranks of a vocabulary: byte ids, canonical pairs and the tokens no merge reaches."""

    tokens: tuple[bytes, ...]  # by id
    byte_ids: tuple[int, ...]
    pairs: tuple[tuple[int, int, int], ...]  # left id, right id, merged id
    odd: tuple[bytes, ...]  # whole pieces that are tokens but that merges don't reach


def _canonical(word: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@lru_cache(maxsize=4)
def read_ranks(path: str) -> Merges:
    """Reads a .tiktoken file of base64 tokens and ranks."""
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    tokens = [b""] * (max(ranks.values()) + 1)
    pairs, odd = [], []
    for token, rank in ranks.items():
        tokens[rank] = token
        if len(token) > 1:
            parts = _canonical(token, ranks, rank)
            if len(parts) == 2:
                pairs.append((ranks[parts[0]], ranks[parts[1]], rank))
            else:
                odd.append(token)
    return Merges(tuple(tokens), tuple(ranks[bytes([b])] for b in range(256)), tuple(pairs), tuple(odd))


def _literal(values: list, kind: str) -> Column:
    """A literal array: the optimizer folds the call into a constant."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False, separators=(",", ":"))), f"array<{kind}>")


_SHIFT = 20  # bits of a rank beside the left id


def displaced(pairs: tuple[tuple[int, int, int], ...], n_ids: int) -> tuple[list[int | None], list[int | None]]:
    """base and table: the rank of (x, y) is table[base[x] + y] ^ (x << 20), if that is under 2^20.

    What is missing (a token that begins no pair, a free place) is null and beyond the end.
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    for a, b, t in pairs:
        rows.setdefault(a, []).append((b, t))
    base: list[int | None] = [None] * n_ids
    window = 8192
    used = np.zeros(4 * (len(pairs) + n_ids) + window, bool)
    table: list[int | None] = [None] * len(used)
    first = 0
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        own = np.array([b for b, _ in row])
        while used[first]:
            first += 1
        at = max(0, first - int(own.min()))
        while True:  # the first place where all the row's entries are free
            taken = np.zeros(window, bool)
            for b in own.tolist():
                taken |= used[at + b : at + b + window]
            if not taken.all():
                at += int(np.argmin(taken))
                break
            at += window
        base[a] = at
        used[at + own] = True
        for b, t in row:
            table[at + b] = (a << _SHIFT) | t
    return base, table[: int(np.flatnonzero(used).max()) + 1]


def _hash(key: str) -> int:
    """Spark's xxhash64 of a string, as an unsigned number."""
    return xxhash.xxh64_intdigest(key.encode(), seed=42)


def _let(value: Column, then) -> Column:
    """Computes a value once for several uses."""
    return F.get(F.transform(F.array(value), then), 0)


_HELD = 19  # bits of a hash: the map of texts inside tokens
_LONG = 48  # bytes from which on a piece is cut before it is folded


class Folding:
    """The ids of words by a fold of ranked merges, as expressions over literal tables of one vocabulary."""

    def __init__(self, merges: Merges) -> None:
        base, table = displaced(merges.pairs, len(merges.tokens))
        self.base, self.table = _literal(base, "int"), _literal(table, "bigint")
        twin: list[int | None] = [None] * len(merges.tokens)
        for a, b, t in merges.pairs:
            if a == b:
                twin[t] = a
        self.twin, self.bytes = _literal(twin, "int"), _literal(list(merges.byte_ids), "int")
        held = {t for t in merges.tokens if len(t) == 2}
        for t in merges.tokens:
            held.update(t[i : i + 3] for i in range(len(t) - 2))
        bits = np.zeros(1 << _HELD, np.uint8)
        bits[[_hash(t.decode("latin-1")) & ((1 << _HELD) - 1) for t in held]] = 1
        self.held = _literal(np.packbits(bits, bitorder="little").view(np.int32).tolist(), "int")

    def byte_ids(self, chars: Column) -> Column:
        """The ids of bytes given as characters of Latin-1."""
        return F.transform(F.split(chars, ""), lambda x: F.get(self.bytes, F.ascii(x)))

    @staticmethod
    def _step(base: Column, table: Column, s: Column, merged) -> Column:
        """The state with the lowest-ranked pair merged; -1 at the end says that nothing is left to merge."""
        ranks = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.get(table, F.get(base, x) + y).bitwiseXOR(F.shiftleft(x.cast("bigint"), _SHIFT)))
        done = F.concat(s, F.array(F.lit(-1)))
        return _let(ranks, lambda r: _let(F.array_min(r), lambda t: F.when(t < F.lit(1 << _SHIFT), merged(r, t)).otherwise(done)))

    def _steps(self, tables: tuple[Column, Column], n: Column, s: Column, merged) -> Column:
        return F.aggregate(n, s, lambda s, _: F.when(F.element_at(s, -1) == -1, s).otherwise(self._step(*tables, s, lambda r, t: merged(s, r, t))))

    def fold(self, tables: tuple[Column, Column], chars: Column) -> Column:
        """The ids of a short string of bytes: a step merges one occurrence, the first of the lowest rank."""

        def one(s: Column, ranks: Column, t: Column) -> Column:
            return _let(F.array_position(ranks, t).cast("int"), lambda p: F.concat(F.slice(s, 1, p - 1), F.array(t.cast("int")), F.slice(s, p + 2, F.size(s))))

        return F.array_remove(_let(self.byte_ids(chars), lambda ids: self._steps(tables, F.slice(ids, 2, F.size(ids)), ids, one)), -1)

    def fold_long(self, tables: tuple[Column, Column], chars: Column) -> Column:
        """The ids of any string of bytes: a step merges all occurrences of the lowest rank.

        Steps go in rounds, so that those after the last merge, each of which copies the
        state, are few.
        """

        def every(s: Column, ranks: Column, t: Column) -> Column:
            out = F.transform(s, lambda x, i: F.when(F.get(ranks, i) == t, t).when(F.get(ranks, i - 1) == t, -1).otherwise(x))
            # a pair of equal ids can overlap itself: replace() goes from left to right
            x = F.get(self.twin, t.cast("int")).cast("string")
            text = F.array_join(F.transform(s, lambda x: F.concat(F.lit("<"), x.cast("string"), F.lit(">"))), "")
            pair = F.concat(F.lit("<"), x, F.lit("><"), x, F.lit(">"))
            twin = F.split(F.regexp_replace(F.replace(text, pair, F.concat(F.lit("<"), t.cast("string"), F.lit(">"))), "^<|>$", ""), "><").cast("array<int>")
            return F.when(x.isNull(), F.array_remove(out, -1).cast("array<int>")).otherwise(twin)

        def folded(ids: Column) -> Column:
            rounds = F.array_repeat(F.lit(0), F.ceil(F.sqrt(F.size(ids))).cast("int"))
            return _let(rounds, lambda n: F.aggregate(n, ids, lambda s, _: F.when(F.element_at(s, -1) == -1, s).otherwise(self._steps(tables, n, s, every))))

        return F.array_remove(_let(self.byte_ids(chars), folded), -1)

    def _held(self, texts: Column) -> Column:
        """1 for each text that may be a token of two bytes or three bytes of a token: a bit by the text's hash."""
        slot = lambda x: F.xxhash64(x).bitwiseAND(F.lit((1 << _HELD) - 1)).cast("int")
        return F.transform(F.transform(texts, lambda x: F.when(x.isNotNull(), slot(x))), lambda h: F.getbit(F.get(self.held, F.shiftright(h, 5)), h.bitwiseAND(F.lit(31))))

    def parts(self, chars: Column) -> Column:
        """A string of bytes, cut between two bytes that no token of two bytes and no three bytes of a token hold together."""

        def cut(c: Column, two: Column, three: Column) -> Column:
            held = lambda i: (F.get(two, i) == 1) | (F.get(three, i) == 1) | (F.get(three, i - 1) == 1)
            return F.transform(c, lambda x, i: F.when(held(i), x).otherwise(F.concat(x, F.lit("\u0100"))))

        joined = lambda x, y: F.concat(x, y)
        marked = _let(
            F.split(chars, ""),
            lambda c: _let(
                F.zip_with(c, F.slice(c, 2, F.size(c)), joined),
                lambda two: _let(
                    self._held(F.zip_with(two, F.slice(c, 3, F.size(c)), joined)),
                    lambda three: _let(self._held(two), lambda known: cut(c, known, three)),
                ),
            ),
        )
        return F.array_remove(F.split(F.array_join(marked, ""), "\u0100"), "")

    def words(self, words: Column) -> Column:
        """The ids of each word of an array."""

        def ids(tables: tuple[Column, Column], word: Column, chars: Column) -> Column:
            long = F.flatten(F.transform(self.parts(chars), lambda part: self.fold_long(tables, part)))
            return F.when(F.octet_length(word) > _LONG, long).otherwise(self.fold(tables, chars))

        # bound by lambdas, the tables stand in the plan, and in each task, once
        def each(tables: tuple[Column, Column]) -> Column:
            return F.transform(words, lambda w: _let(F.decode(F.encode(w, "UTF-8"), "ISO-8859-1"), lambda c: ids(tables, w, c)))

        return _let(self.base, lambda base: _let(self.table, lambda table: each((base, table))))


class _Known(dict):
    """Codes of pieces; a piece without one gets the next, and is listed as new."""

    def __init__(self, whole: dict[str, int], first: int, words: list[str]) -> None:
        super().__init__(whole)
        self.shift, self.new = first - len(whole), []
        for w in words:
            self[w] = self.shift + len(self)

    def __missing__(self, piece: str) -> int:
        code = self[piece] = self.shift + len(self)
        self.new.append(piece)
        return code


@lru_cache(maxsize=4)
def _latin(pattern: str):
    """findall by the faster engine, for texts in Latin-1; None for patterns with escapes or flags beyond these."""
    if re.search(r"\\(?!p\{[LN]\}|[sS])|\(\?[^!=:]|\[[^\]]*(\[|\\S|&&|--|\|\||~~)", pattern):
        return None
    every = "".join(map(chr, range(256)))
    spans = lambda kind: "".join(f"\\x{ord(m[0][0]):02x}-\\x{ord(m[0][-1]):02x}" for m in regex.finditer(kind + "+", every))
    out, inside = [], False
    for part in re.split(r"(\\p\{[LN]\}|\\[sS]|[\[\]])", pattern):
        inside = part == "[" or inside and part != "]"
        if part == "\\S":
            part = "[^" + spans(r"\s") + "]"
        elif part.startswith("\\"):
            part = spans(part) if inside else "[" + spans(part) + "]"
        out.append(part)
    return re.compile("".join(out)).findall


def _finder(pattern: str):
    """The pattern's pieces of a text."""
    general, latin = regex.compile(pattern).findall, _latin(pattern)

    def find(text: str) -> list[str]:
        if latin:
            with suppress(UnicodeEncodeError):
                text.encode("latin-1")
                return latin(text)
        return general(text)

    return find


def _cut(pattern: str, ranks, epoch_words: int):
    """Rows with their pieces' codes: a token's id, or from the number of tokens on a word's number in its epoch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, whole, first = _finder(pattern), ranks.value[0], len(ranks.value[1])
        known, met = _Known(whole, first, []), np.zeros(0, np.int64)
        for part in slices(batches):
            stays = None
            if len(known) - len(whole) >= epoch_words:
                # a new epoch goes on with the words met again, at most half of a list: the most met, then the oldest
                again = np.flatnonzero(met > 1)
                stays = np.sort(again[np.argsort(-met[again], kind="stable")[: epoch_words // 2]])
                words = list(islice(known, len(whole), None))
                words, known = [words[i] for i in stays], None  # the old list goes before the new one is made
                known, met = _Known(whole, first, words), np.ones(len(stays), np.int64)
            codes, fresh = [], []
            for text in part.column(1).to_pylist():
                known.new = []
                codes.append(array("i", map(known.__getitem__, find(text or ""))).tobytes())
                fresh.append(known.new)
            seen = np.frombuffer(b"".join(codes), np.int32)
            count = np.bincount(seen[seen >= first] - first, minlength=len(known) - len(whole))
            count[: len(met)] += met
            met = count
            held = [stays.astype(np.int32).tobytes() if stays is not None else None] + [None] * (part.num_rows - 1)
            columns = [part.column(0), pa.array(held, pa.binary()), pa.array(codes, pa.binary()), pa.array(fresh, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["kept", "held", "codes", "words"])

    return run


def _filled(ranks, finish, names: list[str]):
    """The rows with the folded words' ids in their places; finish turns a row's lists of ids into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = finish(ranks.value[1])
        for batch in slices(batches):
            folded, out = batch.column(3), []
            ends, inner = np.asarray(folded.offsets), folded.values
            at = ends[0]
            bounds = np.asarray(inner.offsets)[at : ends[-1] + 1].tolist()
            flat = np.asarray(inner.values)[bounds[0] : bounds[-1]].tolist()
            for k, (held, codes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if held is not None:
                    words.keep(np.frombuffer(held, np.int32).tolist())
                for w in range(ends[k] - at, ends[k + 1] - at):
                    words.add(flat[bounds[w] - bounds[0] : bounds[w + 1] - bounds[0]])
                out.append(words.row(np.frombuffer(codes, np.int32).tolist()))
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(finish.kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return run


def _only(values: list, first: int, held: list[int]) -> list:
    return values[:first] + [values[first + i] for i in held]


class _Ids:
    """Finishes a row as its array of ids; words by number, first the tokens."""

    kinds = (pa.list_(pa.int32()),)

    def __init__(self, tokens: tuple[bytes, ...]) -> None:
        self.first, self.ids = len(tokens), [[i] for i in range(len(tokens))]

    def keep(self, held: list[int]) -> None:
        self.ids = _only(self.ids, self.first, held)

    def add(self, ids: list[int]) -> None:
        self.ids.append(ids)

    def row(self, codes: list[int]) -> tuple:
        return (list(chain.from_iterable(map(self.ids.__getitem__, codes))),)


class _Digests:
    """Finishes a row as the number of its ids and the digests of the ids and of their bytes."""

    kinds = (pa.int64(), pa.string(), pa.string())

    def __init__(self, tokens: tuple[bytes, ...]) -> None:
        self.first, self.texts, self.bytes = len(tokens), [b"%d" % i for i in range(len(tokens))], list(tokens)

    def keep(self, held: list[int]) -> None:
        self.texts, self.bytes = _only(self.texts, self.first, held), _only(self.bytes, self.first, held)

    def add(self, ids: list[int]) -> None:
        texts, own = self.texts, self.bytes  # ids are tokens, which come first in both
        self.texts.append(b" ".join([texts[i] for i in ids]))
        self.bytes.append(b"".join([own[i] for i in ids]))

    def row(self, codes: list[int]) -> tuple:
        ids = b" ".join(map(self.texts.__getitem__, codes))
        data = b"".join(map(self.bytes.__getitem__, codes))
        return ids.count(b" ") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest()


def _coded(kept: Column, text: Column, docs: DataFrame, ranks_path: str, pattern: str, finish, schema: str, epoch_words: int) -> DataFrame:
    """`kept` and the columns that finish gives, for each row."""
    merges = read_ranks(ranks_path)
    whole = {}
    for rank, token in enumerate(merges.tokens):
        with suppress(UnicodeDecodeError):  # a part of a character is no piece
            whole[token.decode()] = rank
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast((whole, merges.tokens))  # the vocabulary
    # each task folds its words anew: fewer and longer tasks fold less
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    rows = docs.select(kept.alias("kept"), text.cast("string").alias("text")).coalesce(tasks)
    kind = rows.schema["kept"].dataType
    cut = T.StructType([T.StructField("kept", kind)] + T.StructType.fromDDL("held binary, codes binary, words array<string>").fields)
    out = T.StructType([T.StructField("kept", kind)] + T.StructType.fromDDL(schema).fields)
    pieces = rows.mapInArrow(_cut(pattern, ranks, epoch_words), cut)
    folded = pieces.select("kept", "held", "codes", Folding(merges).words(F.col("words")).alias("folded"))
    return folded.mapInArrow(_filled(ranks, finish, out.names), out)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", epoch_words: int = 600_000) -> DataFrame:
    """Adds the ids of every whole text; `epoch_words` bounds a task's list of words."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _coded(row, F.col(text), docs, ranks_path, pattern, _Ids, "ids array<int>", epoch_words).select("kept.*", F.col("ids").alias(ids))


def decode(ids: Column, ranks_path: str) -> Column:
    """The bytes of an array of ids: their tokens' bytes, concatenated."""
    tokens = _literal([t.hex() for t in read_ranks(ranks_path).tokens], "string")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(tokens, i)), ""))


def digests(docs: DataFrame, ranks_path: str, pattern: str, epoch_words: int = 600_000) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = _coded(F.col("doc_id"), F.col("text"), docs, ranks_path, pattern, _Digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", epoch_words)
    return out.withColumnRenamed("kept", "doc_id")
