"""Personal data: fixed patterns, and a skip-chain conditional random field on top.

The patterns find e-mail addresses, IP addresses, card and phone numbers.  The field then
labels the tokens around anything with a digit or an at sign: a chain links neighbours,
and skip edges link each token to the next one in the document that is the same or has
the same digits, however far away.  Loopy belief propagation over both kinds of edges
makes a document's labels agree, so that a number written once in full and later without
its prefix is found both times.  Runs of tokens that the field is sure about become spans
of the same four kinds, unless they touch a span of the patterns.

The field's weights are learnt from the patterns' own spans in a bounded sample of
documents (`sample` rows, chosen by a hash of doc_id): unary weights by logistic
regression, the chain's and skips' weights from how often linked tokens agree.

Cases: a null text is empty; a very long one is read whole; repeated rows are judged alike;
spans go by kind, then by start; an empty table gives an empty table; offsets are code
points; columns that the operator doesn't name are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import lists, map_batches, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match always begins at the first digit of a run: without this, long runs of digits are tried from each digit
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, over = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        while m and start > over and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            over = m.end()
            yield start, over
        at = text.find("@", max(at + 1, over))


def base_spans(text: str | None) -> list[Span]:
    """The patterns' spans, by kind and then by start."""
    out: list[Span] = []
    if not text:
        return out
    out += [(0, s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


# ---- the field ---------------------------------------------------------------------------

_TOKEN = re.compile(r"\S+")
_SEED = re.compile(r"[0-9@]\S*")
_WINDOW = 2
_HASHED = 1 << 14
_LABELS = 1 + len(KINDS)
_STRIP = ".,;:!?\"'#*$%&<>|"


def _shape(word: str) -> str:
    s = re.sub(r"[0-9]", "d", word)
    s = re.sub(r"[^\Wd_]+", "a", s)
    return re.sub(r"(.)\1{4,}", lambda m: m[1] * 4 + "+", s)


def tokens_of(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, bare word, whether it begins a new stretch) of the tokens near digits and at signs."""
    if not _SEED.search(text):
        return []
    spans = [m.span() for m in _TOKEN.finditer(text)]
    begins = [s for s, _ in spans]
    near: dict[int, None] = {}
    for m in _SEED.finditer(text):
        k = bisect_right(begins, m.start()) - 1
        near.update(dict.fromkeys(range(max(0, k - _WINDOW), min(len(spans), k + _WINDOW + 1))))
    out, last, first = [], -2, True
    for k in sorted(near):
        first, last = first or k != last + 1, k
        s, e = spans[k]
        word = text[s:e].strip(_STRIP)
        if word:
            s += text[s:e].index(word)
            out.append((s, s + len(word), word, first))
            first = False
    return out


def _features(tokens: list[tuple[int, int, str, bool]], i: int) -> list[int]:
    word = tokens[i][2]
    before = tokens[i - 1][2] if i and not tokens[i][3] else "<"
    after = tokens[i + 1][2] if i + 1 < len(tokens) and not tokens[i + 1][3] else ">"
    digits = sum(c.isdigit() for c in word)
    names = ("bias", f"s:{_shape(word)}", f"n:{min(digits, 20)}", f"p:{_shape(word[:3])}", f"e:{_shape(word[-4:])}", f"dots:{min(word.count('.'), 5)}", f"at:{'@' in word}", f"plus:{word[0] == '+'}", f"b:{_shape(before)}", f"a:{_shape(after)}", f"sb:{_shape(before)}|{_shape(word)}", f"luhn:{digits if 13 <= digits <= 19 and digits == len(word) and luhn(word) else 0}")
    return [xxhash.xxh32_intdigest(n) & (_HASHED - 1) for n in names]


def _links(tokens: list[tuple[int, int, str, bool]]) -> list[tuple[int, int]]:
    """Each token with a digit or an at sign and the next one that is the same or has the same digits."""
    last: dict[str, int] = {}
    out: set[tuple[int, int]] = set()
    for i, (_, _, word, _) in enumerate(tokens):
        digits = "".join(c for c in word if c.isdigit())
        keys = [f"w{word.lower()}"] if digits or "@" in word else []
        if len(digits) >= 4:
            keys.append(f"d{digits[-10:]}")
        for k in keys:
            if k in last:
                out.add((last[k], i))
            last[k] = i
    return sorted(out)


def _tagged(tokens: list[tuple[int, int, str, bool]], spans: list[Span]) -> list[int]:
    """0 for tokens outside the spans, else 1 + the kind."""
    ordered, out, k = sorted((s, e, kind) for kind, s, e in spans), [], 0
    for s, e, _, _ in tokens:
        while k < len(ordered) and ordered[k][1] <= s:
            k += 1
        out.append(1 + ordered[k][2] if k < len(ordered) and ordered[k][0] < e else 0)
    return out


class Field:
    """Unary weights by feature, and two tables of pair potentials (logarithms)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 10) -> None:
        self.unary, self.chain, self.skip, self.rounds = unary, chain, skip, rounds

    def marginals(self, tokens: list[tuple[int, int, str, bool]]) -> np.ndarray:
        """Loopy belief propagation, all messages at once, damped."""
        own = np.array([self.unary[_features(tokens, i)].sum(0) for i in range(len(tokens))])
        chain = [(i - 1, i) for i in range(1, len(tokens)) if not tokens[i][3]]
        skip = _links(tokens)
        if not chain and not skip:
            return _soft(own)
        pairs = np.array(chain + skip)
        table = np.array([self.chain] * len(chain) + [self.skip] * len(skip))
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        n = len(pairs)
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        sent = np.zeros((2 * n, _LABELS))
        for _ in range(self.rounds):
            belief = own.copy()
            np.add.at(belief, target, sent)
            given = belief[source] - sent[back]
            new = np.logaddexp.reduce(given[:, :, None] + table, axis=1)
            new -= new.max(1, keepdims=True)
            if np.abs(new - sent).max() < 1e-4:
                break
            sent = 0.5 * sent + 0.5 * new
        belief = own.copy()
        np.add.at(belief, target, sent)
        return _soft(belief)


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learn(docs: list[tuple[list[list[int]], list[int], list[tuple[int, int]], list[tuple[int, int]]]], passes: int = 12) -> Field:
    """docs: features, labels, chain edges and skip edges of each document."""
    width = 12
    rows = [(f, y) for feats, labels, _, _ in docs for f, y in zip(feats, labels, strict=True)]
    unary = np.zeros((_HASHED, _LABELS))
    if not rows:
        return Field(unary, np.zeros((_LABELS, _LABELS)), np.zeros((_LABELS, _LABELS)))
    x, y = np.array([f for f, _ in rows]).reshape(-1, width), np.array([y for _, y in rows])
    steps, rng = np.full((_HASHED, _LABELS), 1e-6), np.random.default_rng(5)
    # part of the features is left out at random, so that no single sign (such as a plus) carries a label alone
    for _ in range(passes):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
            on = rng.random((len(at), width)) > 0.3
            p = _soft(np.einsum("ijk,ij->ik", unary[x[at]], on))
            p[np.arange(len(at)), y[at]] -= 1
            g = np.zeros_like(unary)
            np.add.at(g, x[at].ravel(), (p[:, None, :] * on[:, :, None]).reshape(-1, _LABELS))
            g = g / len(at) + 1e-6 * unary
            steps += g * g
            unary -= 0.3 * g / np.sqrt(steps)

    def table(edges: list[tuple[int, int]], most: float) -> np.ndarray:
        seen = np.full((_LABELS, _LABELS), 1.0)
        for a, b in edges:
            seen[a, b] += 1
        joint = seen / seen.sum()
        return np.clip(np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True))), -most, most)

    chain = table([(labels[a], labels[b]) for _, labels, edges, _ in docs for a, b in edges], 2.0)
    skip = table([(labels[a], labels[b]) for _, labels, _, edges in docs for a, b in edges], 4.0)
    return Field(unary, chain, skip + 1.5 * np.eye(_LABELS))


def fit(docs: DataFrame, sample: int = 2000) -> Field:
    """Learns from the patterns' spans in at most `sample` documents with digits or at signs."""
    own = docs.where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(23)).alias("lot"))
    n = max(1, own.count())
    # about twice the sample by a bound on the lot, so that no task sends more than its share
    bound = min((1 << 63) - 1, int(-(1 << 63) + min(1.0, 2 * sample / n) * ((1 << 64) - 1)))
    part = own.where(F.col("lot") <= bound).orderBy("lot").limit(sample).select("text")

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict = {"x": [], "y": [], "chain": [], "skip": []}
        for t in lists(batch, "text")[0]:
            tokens = tokens_of(t)
            out["x"].append([f for i in range(len(tokens)) for f in _features(tokens, i)])
            out["y"].append(_tagged(tokens, base_spans(t)))
            out["chain"].append([i for i in range(1, len(tokens)) if not tokens[i][3]])
            out["skip"].append([i for pair in _links(tokens) for i in pair])
        return out

    got = map_batches(part, rows, "x array<int>, y array<int>, chain array<int>, skip array<int>", sliced=True).collect()
    return learn([([r.x[i : i + 12] for i in range(0, len(r.x), 12)], r.y, [(i - 1, i) for i in r.chain], list(zip(r.skip[::2], r.skip[1::2], strict=True))) for r in got])


#: What a run of tokens needs to become a span of its kind: digits from, to.
_NEEDS = {0: (0, 99), 1: (4, 12), 2: (13, 19), 3: (7, 15)}


def all_spans(text: str | None, field: Field, sure: float = 0.9) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and these with the field's own ones, both by kind and start."""
    base = base_spans(text)
    tokens = tokens_of(text) if text else []
    if not tokens:
        return base, base
    p = field.marginals(tokens)
    best = p.argmax(1)
    taken, added, i = sorted((s, e) for _, s, e in base), [], 0
    while i < len(tokens):
        j, kind = i + 1, int(best[i])
        while j < len(tokens) and best[j] == kind and not tokens[j][3] and kind in (3, 4):
            j += 1
        if kind and p[i:j, kind].min() >= sure:
            s, e = tokens[i][0], tokens[j - 1][1]
            digits = sum(c.isdigit() for c in text[s:e])
            low, high = _NEEDS[kind - 1]
            if low <= digits <= high and ("@" in text[s:e]) == (kind == 1) and not any(a < e and s < b for a, b in taken):
                added.append((kind - 1, s, e))
        i = j
    return base, sorted(base + added)


def find(docs: DataFrame, **limits) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, **limits))

    def rows(batch: pa.RecordBatch) -> dict:
        ids, texts = lists(batch, "doc_id", "text")
        out: dict = {"doc_id": ids, **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
        write = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
        for t in texts:
            base, spans = all_spans(t, sent.value)
            for k, name in enumerate(KINDS):
                out[f"n_{name}"].append(sum(x[0] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(write(base).encode()).hexdigest())
            out["spans"].append(write(spans))
        return out

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), rows, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with a mark in place of each span; of overlapping spans the first counts."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        elif e > at:
            out.append(f"<{KINDS[k].upper()}>")
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, **limits) -> DataFrame:
    """All documents and columns, with marks in the texts in place of personal data."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, **limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [redacted(t, all_spans(t, sent.value)[1]) for t in lists(batch, "text")[0]]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
