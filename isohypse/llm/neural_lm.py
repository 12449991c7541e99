"""Language-model scores of texts: a log-bilinear model trained by noise-contrastive estimation.

Tokens are the words of the lower-cased text (A-Z only) and one end.  The base score is the
add-one unigram score.  The model predicts a token's type from the two tokens before it:
the types are the end, the most frequent `words` words, and `classes` classes that hold the
other words by their last two bytes.  With feature vectors r and q, position weights c and
biases b, the prediction is p = c1 * r(w1) + c2 * r(w2), the score of type t is p.q(t) + b(t),
and its probability is normalised over all types.  A word of a class has the class's
probability times its own share of the class, (count + 1) / (sum of them + 1); the 1 is for
words that training never saw.

1. Count the words of all training documents: partial counts by task, summed by word.
2. Write all training texts as short ids, in pieces of at most `piece` tokens, dealt by
   hash into shards of about `shard` tokens; the number of shards follows the corpus.
3. Train.  The pieces are dealt into as many parts as there are rounds, so that each piece
   is seen once.  In a round each shard starts from the common parameters and runs through
   its part in shuffled minibatches: all examples of a batch share noise tokens from the
   unigram distribution, and each batch is a few matrix products in numpy.  The shards'
   parameters are averaged by tokens, in whole numbers, so that the order of the tasks
   doesn't matter.
4. Score.  A task looks up words in a table of the words that make up at least `sent` of
   all tokens (so there are at most 1 / sent of them); the normalisers come from batched
   matrix products, a row for each different context of a block.  Words outside of the
   table are joined to the counts.

The driver holds the table of frequent words and the parameters, both of a bounded size.

Cases: a null text is empty and has the end only; a null doc_id is for training; repeated
rows are documents of their own; frequent words with equal counts go by the word; words
over 64 bytes are never in the sent table; very long texts are read whole, in pieces that
know the two tokens before them; without training documents no word is known, the base
score is 0 and the model knows its classes only; an empty table gives an empty table;
columns that the operator doesn't name are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import cut

_END = ""  # no word is empty
_LONGEST = 64
_FIXED = 1 << 24  # parameters are averaged as whole numbers of this fraction


@dataclass(frozen=True)
class Shape:
    """Sizes and rates; all of them hold at every size of the corpus."""

    words: int = 1000
    classes: int = 128
    size: int = 24
    noise: int = 64
    batch: int = 1024
    rate: float = 0.2
    rounds: int = 2
    sent: float = 5e-7
    piece: int = 8192
    shard: int = 4_000_000


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-2:]) % classes


def count_words(docs: DataFrame, held: int = 300_000, read: int = 1 << 27) -> DataFrame:
    """(word, n) over all texts; the end is the empty word.  A task holds that many words, or the words of so many characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        size = 0
        for batch in batches:
            for x in batch.column(0):
                text = x.as_py() or ""
                counts.update(words_of(text))
                counts[b""] += 1
                size += len(text)
                if len(counts) > held or size > read:
                    yield from _counted(counts)
                    counts, size = Counter(), 0
        yield from _counted(counts)

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> Iterator[pa.RecordBatch]:
    words, n = list(counts), list(counts.values())
    for a in range(0, len(words), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 50_000], pa.binary()).cast(pa.string()), pa.array(n[a : a + 50_000], pa.int64())], names=["word", "n"])


@dataclass
class Vocabulary:
    """What tasks need of the counts: the sent words with their numbers, types and shares."""

    shape: Shape
    tokens: int  # N
    types: int  # V
    number: dict[bytes, int]  # of the sent words
    kind: np.ndarray  # type by number
    base: np.ndarray  # log10 base probability by number
    share: np.ndarray  # log10 share in its class by number
    rest: np.ndarray  # log10 of a class's denominator, by type
    noise: np.ndarray  # unigram distribution of types
    unseen: float  # log10 of the base's denominator
    end: bool = field(default=True)  # training has an end

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Numbers (-1 if not sent) and types of the words, and the words that aren't sent."""
        get = self.number.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        kinds = self.kind[at]
        missing = np.flatnonzero(at < 0)
        others = [words[i] for i in missing.tolist()]
        first, n = self.shape.words + 1, self.shape.classes
        kinds[missing] = [first + class_of(w, n) for w in others]
        return at, kinds, others


def vocabulary(counts: DataFrame, shape: Shape) -> Vocabulary:
    """From (word, n): collects the sent words and one sum for each class."""
    last = F.expr("substring(encode(word, 'utf-8'), -2)")
    words = counts.where(F.col("word") != _END)
    sums = words.groupBy((F.crc32(last) % shape.classes).cast("int").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    end = counts.where(F.col("word") == _END).agg(F.sum("n")).first()[0] or 0
    tokens, types = int(sum(r.n for r in sums) + end), int(sum(r.types for r in sums)) + (end > 0)
    rows = words.where((F.octet_length("word") <= _LONGEST) & (F.col("n") >= shape.sent * tokens)).collect()  # at most 1 / sent
    rows.sort(key=lambda r: (-r.n, r.word))
    own, total, m = rows[: shape.words], np.zeros(shape.classes), shape.words + 1 + shape.classes
    for r in sums:
        total[r.k] = r.n + r.types  # sum of count + 1
    for r in own:
        total[class_of(r.word.encode(), shape.classes)] -= r.n + 1
    rest = np.concatenate([np.zeros(shape.words + 1), np.log10(total + 1)])
    number = {b"": 0} | {r.word.encode(): i for i, r in enumerate(rows, 1)}
    n = np.array([end, *(r.n for r in rows)], np.float64)
    kind = np.arange(len(n))
    kind[shape.words + 1 :] = [shape.words + 1 + class_of(r.word.encode(), shape.classes) for r in rows[shape.words :]]
    share = np.where(kind > shape.words, np.log10(n + 1) - rest[kind], 0.0)
    mass = np.zeros(m)
    mass[: len(own) + 1] = n[: len(own) + 1] + 1
    mass[shape.words + 1 :] = total + 1
    unseen = float(np.log10(tokens + types + 1))
    # one more entry, for the index -1: not sent
    return Vocabulary(shape, tokens, types, number, np.append(kind, 0).astype(np.int64), np.append(np.log10(n + 1) - unseen, -unseen), np.append(share, 0.0), rest, mass / mass.sum(), unseen, end > 0)


class Model:
    """The parameters: vectors of contexts, vectors and biases of targets, weights of the two positions."""

    def __init__(self, shape: Shape, noise: np.ndarray) -> None:
        m, rng = len(noise), np.random.default_rng(1)
        self.context = (rng.standard_normal((m, shape.size)) * 0.3).astype(np.float32)
        self.target = np.zeros((m, shape.size), np.float32)
        self.position = np.full((2, shape.size), 0.7, np.float32)
        self.bias = np.log(np.maximum(noise, 1e-30)).astype(np.float32)

    def rows(self) -> np.ndarray:
        """All parameters as one table, a row per vector."""
        m, size = self.context.shape
        bias = np.zeros((-(-m // size), size), np.float32)
        bias.reshape(-1)[:m] = self.bias
        return np.concatenate([self.context, self.target, self.position, bias])

    @classmethod
    def of(cls, shape: Shape, rows: np.ndarray) -> Model:
        self, m = cls.__new__(cls), shape.words + 1 + shape.classes
        rows = rows.astype(np.float32)
        self.context, self.target, self.position = rows[:m].copy(), rows[m : 2 * m].copy(), rows[2 * m : 2 * m + 2].copy()
        self.bias = rows[2 * m + 2 :].reshape(-1)[:m].copy()
        return self

    def predicted(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.position[0] * self.context[first] + self.position[1] * self.context[second]

    def log_probabilities(self, first: np.ndarray, second: np.ndarray, target: np.ndarray, rows: int = 1024) -> np.ndarray:
        """Natural logarithms of the targets' probabilities, normalised over all types for each different context."""
        m = len(self.bias)
        codes, at = np.unique(first * m + second, return_inverse=True)
        p = self.predicted(codes // m, codes % m)
        z = np.empty(len(codes))
        for a in range(0, len(codes), rows):
            scores = p[a : a + rows] @ self.target.T
            scores += self.bias
            top = scores.max(1, keepdims=True)
            scores -= top
            z[a : a + rows] = np.log(np.exp(scores, out=scores).sum(1, dtype=np.float64)) + top[:, 0]
        out = np.empty(len(target))
        for a in range(0, len(target), 1 << 15):
            i, t = at[a : a + (1 << 15)], target[a : a + (1 << 15)]
            out[a : a + (1 << 15)] = np.einsum("ij,ij->i", p[i], self.target[t]) + self.bias[t] - z[i]
        return out

    def train(self, first: np.ndarray, second: np.ndarray, target: np.ndarray, noise: np.ndarray, shape: Shape, rng: np.random.Generator, squares: list[np.ndarray]) -> None:
        """One pass of noise-contrastive estimation over examples in random order; squares are Adagrad's sums."""
        m, size = self.context.shape
        cumulative = np.cumsum(noise)
        expected = np.log(np.maximum(noise, 1e-30) * shape.noise).astype(np.float32)
        column = np.arange(size)

        def spread(at: np.ndarray, gradient: np.ndarray) -> np.ndarray:
            return np.bincount((at[:, None] * size + column).ravel(), gradient.ravel(), m * size).reshape(m, size)

        order = rng.permutation(len(target))
        for a in range(0, len(order), shape.batch):
            pick = order[a : a + shape.batch]
            u, v, t = first[pick], second[pick], target[pick]
            w = np.minimum(np.searchsorted(cumulative, rng.random(shape.noise)), m - 1)
            ru, rv, qt, qw = self.context[u], self.context[v], self.target[t], self.target[w]
            p = self.position[0] * ru + self.position[1] * rv
            real = 1 / (1 + np.exp(np.einsum("ij,ij->i", p, qt) + self.bias[t] - expected[t]))  # 1 - P(real)
            false = -1 / (1 + np.exp(expected[w] - self.bias[w] - p @ qw.T))  # -P(real) of noise
            gp = real[:, None] * qt + false @ qw
            g_target = spread(np.concatenate([t, w]), np.concatenate([real[:, None] * p, false.T @ p]))
            g_context = spread(np.concatenate([u, v]), np.concatenate([gp * self.position[0], gp * self.position[1]]))
            g_bias = np.bincount(np.concatenate([t, w]), np.concatenate([real, false.sum(0)]), m)
            g_position = np.stack([(gp * ru).sum(0), (gp * rv).sum(0)])
            scale = len(pick) ** -0.5
            for value, s, g in zip((self.context, self.target, self.position, self.bias), squares, (g_context, g_target, g_position, g_bias), strict=True):
                g = (g * scale).astype(np.float32)
                s += g * g
                value += shape.rate * g / np.sqrt(s)


def pieces(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(key, ids): texts as types in pieces, each after the two types before it."""
    shape = vocab.shape
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, kinds, _ = sent.value.encode(words_of(text.as_py()))
                line = np.concatenate([[0, 0], kinds, [0]]).astype("<i2")
                for n, a in enumerate(range(0, len(line) - 2, shape.piece)):
                    ids.append(line[a : a + shape.piece + 2].tobytes())
                    keys.append(xxhash.xxh64_intdigest(f"{doc} {n}") - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], names=["key", "ids"])

    return docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "key bigint, ids binary")


def averaged(shards: DataFrame, model: Model, vocab: Vocabulary, part: int) -> Model:
    """The model after one round over that part of the pieces."""
    shape, spark = vocab.shape, shards.sparkSession
    sent = spark.sparkContext.broadcast((model.rows(), vocab.noise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, noise = sent.value
        own, seen, held, buffer = Model.of(shape, start), 0, 0, []
        rng = np.random.default_rng(TaskContext.get().partitionId())
        squares = [np.full(x.shape, 0.1, np.float32) for x in (own.context, own.target, own.position, own.bias)]

        def learn() -> None:
            first, second, target = (np.concatenate([x[k : len(x) - 2 + k] for x in buffer]).astype(np.int64) for k in range(3))
            own.train(first, second, target, noise, shape, rng, squares)

        for batch in batches:
            for x in batch.column(0):
                ids = np.frombuffer(x.as_py(), "<i2")
                buffer.append(ids)
                held += len(ids) - 2
                if held >= 1 << 18:
                    learn()
                    seen, held, buffer = seen + held, 0, []
        if buffer:
            learn()
            seen += held
        if seen:
            fixed = np.rint(own.rows().astype(np.float64) * _FIXED).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(fixed), dtype=np.int32)), pa.array(np.full(len(fixed), seen)), pa.FixedSizeListArray.from_arrays(pa.array(fixed.ravel()), shape.size).cast(pa.list_(pa.int64()))], names=["row", "tokens", "x"])

    of_part = shards.where(F.pmod("key", F.lit(shape.rounds)) == part).select("ids")
    trained = of_part.mapInArrow(run, "row int, tokens bigint, x array<bigint>")
    wide = F.col("tokens").cast("decimal(19,0)")
    sums = trained.groupBy("row").agg(F.sum("tokens").alias("tokens"), *(F.sum(F.col("x")[k].cast("decimal(19,0)") * wide).alias(f"x{k}") for k in range(shape.size)))
    rows = model.rows().astype(np.float64)
    for r in sums.collect():  # as many as the model has vectors
        rows[r.row] = [float(int(r[f"x{k}"]) / r.tokens / _FIXED) for k in range(shape.size)]
    return Model.of(shape, rows)


def fit(training: DataFrame, shape: Shape = Shape()) -> tuple[DataFrame, Vocabulary, Model]:  # noqa: B008
    """The counts of all words, what tasks need of them, and the trained model."""
    counts = cut(count_words(training))
    vocab = vocabulary(counts, shape)
    model = Model(shape, vocab.noise)
    shards = pieces(training, vocab).repartition(max(1, -(-vocab.tokens // shape.shard)), "key").sortWithinPartitions("key", "ids")
    shards = cut(shards)
    for part in range(shape.rounds):
        model = averaged(shards, model, vocab, part)
    return counts, vocab, model


def score(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:  # noqa: B008
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts, vocab, model = fit(docs.where(~is_held_out()), shape)
    found = cut(scored(docs.withColumn("held_out", is_held_out()), vocab, model).withColumn("row", F.monotonically_increasing_id()))
    others = found.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.times")
    others = others.join(counts.where(F.col("word") != _END), "word", "left")
    gain = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)
    others = others.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"), F.sum(gain).alias("gain"))
    found = found.join(others, "row", "left")
    more = F.coalesce("gain", F.lit(0.0))
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("bigint").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def scored(docs: DataFrame, vocab: Vocabulary, model: Model, block: int = 1 << 20) -> DataFrame:
    """Scores without the counts of words that aren't sent, and these words (others) with their times."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = sent.value
        for batch in batches:
            total, others = np.zeros((4, batch.num_rows)), []
            todo, held = [], 0  # (row, numbers, types with the two before them)
            for row, x in enumerate(batch.column(1)):
                at, kinds, rare = v.encode([*words_of(x.as_py()), b""])
                others.append(Counter(rare))
                line = np.concatenate([[0, 0], kinds])
                for a in range(0, len(at), block):
                    todo.append((row, at[a : a + block], line[a : a + block + 2]))
                    held += len(todo[-1][1])
                    if held >= block:
                        _add(total, todo, v, m)
                        todo, held = [], 0
            _add(total, todo, v, m)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in others])]).astype(np.int32)
            words = pa.array([w for x in others for w in x], pa.binary()).cast(pa.string())
            times = pa.array([n for x in others for n in x.values()], pa.int64())
            rare_words = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([words, times], ["word", "times"]))
            counts = [pa.array(x.astype(np.int64)) for x in total[:2]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *counts, *map(pa.array, total[2:]), rare_words], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "others"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, others array<struct<word: string, times: bigint>>")


def _add(total: np.ndarray, todo: list[tuple], v: Vocabulary, m: Model) -> None:
    """Adds tokens, known tokens, base and model scores of the pieces to their rows."""
    if not todo:
        return
    sizes = np.array([len(at) for _, at, _ in todo])
    row, at = np.repeat([r for r, _, _ in todo], sizes), np.concatenate([at for _, at, _ in todo])
    first, second, target = (np.concatenate([x[k : len(x) - 2 + k] for _, _, x in todo]) for k in range(3))
    model = m.log_probabilities(first, second, target) / np.log(10) + np.where(at < 0, -v.rest[target], v.share[at])
    for out, x in zip(total, (None, ((at > 0) | (at == 0) & v.end).astype(float), v.base[at], model), strict=True):
        out += np.bincount(row, x, len(out))
