"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Voters.  Some are fixed lexicons and patterns; the others are mined: words, beginnings
   and endings of words that stand in toxic training documents and hardly elsewhere are
   dealt by kind into lexicons, each of which is a voter ("toxic", "not toxic", or no vote).
2. Label model.  Without looking at labels, expectation maximisation over the votes of a
   sample estimates the share of toxic documents and each voter's accuracies; correlations
   that remain given the label are estimated too, and correlated voters share one weight.
3. Classifier.  A logistic regression over the mined features and the voters' patterns is
   trained on the posterior labels and scores every whole text.

Labels are read only in rows for training (crc32(doc_id as text) mod 5 isn't 0), and of
these at most `sample` rows, chosen by a hash of doc_id: everything that is fitted is
fitted on that bounded sample, and only ids of that number are sent to the tasks.

Cases: null and empty texts get the classifier's score for no features at all; repeated
rows are judged alike; without training rows or with one class only, scores come from the
fixed lexicon alone; an empty table gives an empty table; columns that the operator
doesn't name are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import lists, map_batches

_WORD = re.compile(r"[^\W\d_]+")
#: Fixed lexicon of insults in the four languages, and fixed patterns.
LEXICON = frozenset("idiot idiots moron stupid scum trash worthless pathetic disgusting loser clown dumb imbecile retard idiota estúpido imbécil basura asqueroso idiote stupide connard ordure minable dégoûtant dumm dummkopf abschaum ekelhaft wertlos versager".split())
PATTERNS = tuple(re.compile(p) for p in (r"\byou(?:'re| are)? (?:a |an |such )*(?:idiot|moron|loser|clown)", r"\b(?:shut up|go away|drop dead)\b", r"[a-z]\*{2,}[a-z]"))
_STARTS, _ENDS = range(4, 8), range(5, 7)


def parts(word: str):
    """A word and its beginnings and endings, as features."""
    yield "w" + word
    for k in _STARTS:
        if len(word) > k:
            yield f"{k}{word[:k]}"
    for k in _ENDS:
        if len(word) > k:
            yield f"e{word[-k:]}"


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


class Scorer:
    """Mined features with their lexicon, and the classifier's weights."""

    def __init__(self, features: dict[str, int]) -> None:
        self.features = features  # feature -> number; its lexicon is number % LEXICONS
        self.size = max(features.values(), default=-1) + 1
        self.weights: np.ndarray | None = None

    LEXICONS = 8

    def found(self, text: str | None) -> tuple[Counter, np.ndarray]:
        """Mined features with counts, and counts for each voter."""
        words, hits = words_of(text), Counter()
        get = self.features.get
        for w, n in words.items():
            if len(w) > 2:
                for f in parts(w):
                    k = get(f)
                    if k is not None:
                        hits[k] += n
        votes = np.zeros(self.LEXICONS + 1 + len(PATTERNS))
        for k, n in hits.items():
            votes[k % self.LEXICONS] += n
        votes[self.LEXICONS] = sum(n for w, n in words.items() if w in LEXICON)
        low = (text or "").lower()
        for i, p in enumerate(PATTERNS):
            votes[self.LEXICONS + 1 + i] = p.search(low) is not None
        return hits, votes

    def row(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """The classifier's features: which mined ones are there, then by voter log counts."""
        hits, votes = self.found(text)
        return sorted(hits), np.concatenate([np.log1p(votes), votes >= 2])

    def score(self, text: str | None) -> float:
        on, dense = self.row(text)
        if self.weights is None:
            return 0.9 if dense[self.LEXICONS] > 0 else 0.1
        n = self.size
        z = self.weights[-1] + self.weights[on].sum() + dense @ self.weights[n:-1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def mine(toxic: list[Counter], other: list[Counter], least: int = 4, most: int = 4000) -> dict[str, int]:
    """Features of toxic documents: in at least `least` of them, and much rarer elsewhere."""
    a, b = Counter(), Counter()
    for docs, into in ((toxic, a), (other, b)):
        for words in docs:
            into.update({f for w in words if len(w) > 2 for f in parts(w)})
    ratio = max(1, len(other)) / max(1, len(toxic))
    strong = [(n * ratio / (b[f] + 0.5), n, f) for f, n in a.items() if n >= least and n * ratio > 20 * (b[f] + 0.5)]
    chosen = sorted(strong, key=lambda x: (-x[1], x[2]))[:most]
    kinds: dict[str, list[str]] = defaultdict(list)
    for _, _, f in chosen:
        kinds["w" if f[0] == "w" else "e" if f[0] == "e" else "s"].append(f)
    # lexicons 0-2 take words, 3-5 beginnings, 6-7 endings, dealt in the order of their frequency
    out, used = {}, [0] * Scorer.LEXICONS
    for kind, own, lexicons in (("w", kinds["w"], (0, 1, 2)), ("s", kinds["s"], (3, 4, 5)), ("e", kinds["e"], (6, 7))):
        for i, f in enumerate(own):
            k = lexicons[i % len(lexicons)]
            out[f] = used[k] * Scorer.LEXICONS + k
            used[k] += 1
    # numbers without gaps would break number % LEXICONS; the gaps cost a few unused weights
    return out


def label_model(votes: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """votes: 1, -1 or 0 (none), by document and voter.  Returns posteriors, accuracies, correlations."""
    n, m = votes.shape
    kinds = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    share, p = 0.15, np.zeros((2, m, 3))
    weight, rest = np.ones(m), np.zeros((m, m))
    post = np.clip(0.5 + 0.5 * votes.sum(1) / np.maximum(1, np.abs(votes).sum(1)), 0.02, 0.98)  # the voters' mean, to begin with
    for _ in range(rounds):
        share = float(np.clip(post.mean(), 1e-4, 1 - 1e-4))
        for c, w in ((0, 1 - post), (1, post)):
            p[c] = (np.einsum("n,nmk->mk", w, kinds) + 0.5) / (w.sum() + 1.5)
        # what voters still have in common, given the label: such voters share a weight
        expected = np.outer(1 - post, p[0] @ [-1, 0, 1]) + np.outer(post, p[1] @ [-1, 0, 1])
        left = votes - expected
        scale = np.sqrt((left**2).mean(0)) + 1e-9
        rest = (left.T @ left) / n / np.outer(scale, scale)
        weight = 1 / np.where(np.abs(rest) > 0.1, np.abs(rest), 0).clip(0, 1).sum(1).clip(1)
        logs = np.einsum("nmk,cmk->cnm", kinds, np.log(p)) @ weight
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - share) / share), -30, 30)))
    return post, p[1, :, 2] / (p[1, :, 2] + p[0, :, 2] * (1 - share) / share), rest


def train(rows: list[tuple[list[int], np.ndarray]], target: np.ndarray, n: int, passes: int = 40) -> np.ndarray:
    """Logistic regression on soft labels, AdaGrad over shuffled blocks."""
    wide = n + len(rows[0][1]) + 1
    w, steps, rng = np.zeros(wide), np.full(wide, 1e-3), np.random.default_rng(3)
    at = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    flat = np.array([k for r in rows for k in r[0]], int)
    dense = np.array([np.append(r[1], 1.0) for r in rows])
    for _ in range(passes):
        for own in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
            cols = [flat[at[i] : at[i + 1]] for i in own]
            z = dense[own] @ w[n:] + np.array([w[c].sum() for c in cols])
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[own]
            g = 1e-4 * w
            g[n:] += dense[own].T @ e / len(own)
            for c, x in zip(cols, e, strict=True):
                g[c] += x / len(own)
            steps += g * g
            w -= 0.2 * g / np.sqrt(steps)
    return w


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> Scorer:
    """Learns from at most about `sample` labelled rows for training."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).select("doc_id", "toxic")
    n = own.count()
    if not n:
        return Scorer({})
    share = min(1.0, sample / n)
    bound = min((1 << 63) - 1, int(-(1 << 63) + share * ((1 << 64) - 1)))
    chosen = own.where(F.xxhash64(F.col("doc_id").cast("string"), F.lit(29)) <= bound).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    wanted = {r.doc_id: r.toxic for r in chosen.collect()}
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def picked(batch: pa.RecordBatch) -> dict:
        ids, texts = lists(batch, "doc_id", "text")
        rows = [(sent.value[i], t) for i, t in zip(ids, texts, strict=True) if i in sent.value]
        return {"toxic": [x for x, _ in rows], "text": [t for _, t in rows]}

    rows = map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), picked, "toxic int, text string")
    # a text that stands there often is one example
    got = rows.groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text").toLocalIterator(prefetchPartitions=True)
    toxic_texts, other_texts, all_rows = [], [], []
    for r in got:
        all_rows.append((r.toxic, r.text))
        (toxic_texts if r.toxic else other_texts).append(words_of(r.text))
    if not toxic_texts or not other_texts:
        return Scorer({})
    scorer = Scorer(mine(toxic_texts, other_texts))
    texts = [t for _, t in all_rows]
    found = [scorer.found(t)[1] for t in texts]
    votes = np.array([np.where(v >= 2, 1, np.where(v == 1, 0, -1)) for v in found])
    votes[:, Scorer.LEXICONS + 1 :] = np.where(np.array(found)[:, Scorer.LEXICONS + 1 :] > 0, 1, 0)
    post, _, _ = label_model(votes)
    rows_of = [scorer.row(t) for t in texts]
    scorer.weights = train(rows_of, post, scorer.size)
    return scorer


def score(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **limits))

    def rows(batch: pa.RecordBatch) -> dict:
        ids, held, texts = lists(batch, "doc_id", "held_out", "text")
        got = [sent.value.score(t) for t in texts]
        return {"doc_id": ids, "held_out": held, "score": got, "predicted": [int(s >= 0.5) for s in got]}

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text"), rows, "doc_id bigint, held_out boolean, score double, predicted int")
