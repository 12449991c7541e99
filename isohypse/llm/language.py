"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of labelled texts.  A text
is folded to letters and single spaces, compressed with each dictionary, and gets the
language whose dictionary leaves the fewest bytes.  A long text is compressed in blocks,
each with the whole dictionary, so that its own repeats don't outweigh the dictionaries.
The margin is the distance to the next language, in relation to the text's own size; texts
with a narrow margin are rejected (`sure` is false), as are texts without letters (`und`).

Short texts can tie to the byte.  Ties are told apart by the compressed size of the text
written several times over with the words in other orders, then by the language's share
of the training rows, then by name.

The dictionaries are fitted on a bounded sample: at most `sample` rows a language, chosen
by a hash of doc_id, of which `dictionary` bytes are kept.

Cases: null text and texts without a letter give `und`, score 0; repeated rows are
judged alike; with no labelled row at all every text is `und`; an empty table gives an
empty table; columns that the operator doesn't name are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import give_back, lists

_OTHER = re.compile(r"[\W\d_]+")
_BLOCK = 32_768  # bytes at most that are compressed at once


def folded(text: str | None) -> str:
    """Lower-case letters, single spaces."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


class Model:
    """The languages with their dictionaries; compressors are made where the model is used."""

    def __init__(self, dictionaries: dict[str, bytes], shares: dict[str, float], level: int = 3) -> None:
        self.dictionaries, self.shares, self.level = dictionaries, shares, level
        self._made: list | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_made": None}

    def _compressors(self) -> list:
        if self._made is None:
            self._made = []
            for lang in sorted(self.dictionaries):
                raw = zstandard.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                fast, fine = raw, zstandard.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                fast.precompute_compress(level=self.level)
                fine.precompute_compress(level=19)
                kinds = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
                self._made.append((lang, zstandard.ZstdCompressor(level=self.level, dict_data=fast, **kinds), zstandard.ZstdCompressor(level=19, dict_data=fine, **kinds)))
        return self._made

    def close(self) -> None:
        self._made = None

    def sizes(self, text: bytes) -> dict[str, float]:
        made = self._compressors()
        if len(text) >= 2000:
            parts = -(-len(text) // _BLOCK)
            ends = [len(text) * k // parts for k in range(parts + 1)]  # even blocks, so that none is short
            blocks = [text[a:b] for a, b in zip(ends, ends[1:])]
            return {lang: sum(len(fast.compress(x)) for x in blocks) for lang, fast, _ in made}
        # a short text: the finest level, and three word orders, for sizes between whole bytes
        words = text.split()
        forms = [text, b" ".join(words[::-1]), b" ".join(words[1::2] + words[::2])]
        return {lang: sum(len(fine.compress(b" " + x + b" ")) for x in forms) / len(forms) for lang, _, fine in made}

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the margin is wide enough."""
        plain = folded(text)
        if not plain or not self.dictionaries:
            return "und", 0.0, False
        raw = plain.encode()
        ranked = sorted((size, -self.shares[lang], lang) for lang, size in self.sizes(raw).items())
        best = ranked[0]
        margin = (ranked[1][0] - best[0]) / max(1.0, best[0]) if len(ranked) > 1 else 1.0
        return best[2], 0.5 + 0.5 * min(1.0, 4 * margin), margin >= self.narrow

    narrow = 0.0


def fit(docs: DataFrame, sample: int = 400, dictionary: int = 96_000, narrow: float = 0.002) -> Model:
    """Learns from text and non-null lang of all rows given (the caller leaves held-out rows out)."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(17))
    wanted = F.lit(False)
    for lang, n in counts.items():
        share = min(1.0, 2 * sample / n)
        wanted = wanted | ((F.col("lang") == lang) & (order <= min((1 << 63) - 1, int(-(1 << 63) + share * ((1 << 64) - 1)))))
    # at most about twice the sample of each language, equal rows once
    part = rows.where(wanted).select("lang", order.alias("at"), "text").groupBy("lang", "at").agg(F.first("text").alias("text"))
    found: dict[str, list[tuple[int, str]]] = {}
    for r in part.collect() if counts else []:
        found.setdefault(r.lang, []).append((r["at"], r.text))
    made = {}
    for lang, own in found.items():
        texts = [t.encode() for t in dict.fromkeys(folded(t) for _, t in sorted(own)[:sample])]
        size = max(200, 2 * dictionary // max(1, len(texts)))
        # a stretch of each text in turn, then a second one, until the dictionary is full
        stretches = sorted((k // size, i) for i, t in enumerate(texts) for k in range(0, len(t), size))
        raw, room = [], dictionary
        for k, i in stretches:
            if room <= 0:
                break
            piece = texts[i][k * size : (k + 1) * size]
            raw.append(piece[:room])
            room -= len(piece) + 1
        if any(raw):
            made[lang] = b" " + b" ".join(raw) + b" "
    total = sum(counts.values()) or 1
    model = Model(made, {k: v / total for k, v in counts.items()})
    model.narrow = narrow
    return model


def held_out(doc_id: str = "doc_id"):
    """True for rows that take no part in learning; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


_ROWS = 256  # texts that are Python objects at once


def _predicted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with their texts' predictions; the compressors go with the task."""
    try:
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                yield part, [model.predict(t) for t in lists(part, "text")[0]]
    finally:
        model.close()
        give_back()


def identify(docs: DataFrame, **limits) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, sure."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out()), **limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in _predicted(batches, model.value):
            columns = [part.column(0), part.column(1), *(pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "sure"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, sure boolean")


def accepted(docs: DataFrame, **limits) -> DataFrame:
    """The documents with a sure language, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out()), **limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in _predicted(batches, model.value):
            yield part.filter(pa.array([lang != "und" and sure for lang, _, sure in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
