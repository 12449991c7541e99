import hashlib
import random

import numpy as np
import pyarrow as pa

from isohypse.llm import suffix_dedup as S


def brute(rows, width=50):
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        if i is not None:
            for k in range(len(b) - width + 1):
                w = b[k : k + width]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1 if i is not None else 0):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_equals_brute_force(documents, rows):
    want = brute(rows)
    assert sum(x[2] for x in want) > 0
    assert result(S.dedup(documents)) == want


def test_hard_repeats(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("ab\u00e9 ") for _ in range(400))
    rows = [(1, "a" * 500), (2, "a" * 300 + "b"), (3, base), (4, "q" + base[30:81] + "zz" + base[200:249] + "y" + base[100:260]), (None, base), (3, base), (3, base[:100] + "!"), (5, "ab" * 200), (6, "ab" * 300), (-9, base[50:101]), (7, base[:49]), (8, "\0" * 120), (9, "\0" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(S.dedup(docs)) == brute(rows)


def test_every_window_has_a_trigger_of_its_own_content():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 400).astype(np.uint8)
    m = S.triggers(data, 50)
    assert len(m) == 351
    again = S.triggers(np.r_[rng.integers(0, 3, 37).astype(np.uint8), data[100:200]], 50)
    assert (again[37:] == m[100:151]).all()


def test_rows_whose_names_agree_in_their_lower_bits(spark, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(k, base[k : 200 + k] + str(k) * 60) for k in range(8)]
    real = S.row_key
    monkeypatch.setattr(S, "row_key", lambda i, d: (real(i, d) >> 48 << 48) | 5)
    names = [S.row_key(i, t.encode()) for i, t in rows]
    sent = list(S._send_triggers(50, 1, 5)(iter([pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})])))
    blocks = [b for x in sent for b in x["block"]]
    batch = pa.RecordBatch.from_pydict({"bucket": [0] * len(blocks), "kind": [k for x in sent for k in x["kind"]], "row": [0] * len(blocks), "block": blocks})
    told = set()
    for x in S._find_shared(1, 5)(iter([batch])):
        for b in x["block"]:
            told |= set(S._unpack(b, (S._TAG,))[0][0].view(np.int64).tolist())
    assert len(set(names)) == len(rows) and told == set(names)


def test_parts_and_buckets_do_not_change_the_result(spark, monkeypatch):
    rng = random.Random(10)
    base = ["".join(rng.choice("abcd ") for _ in range(400)) for _ in range(4)]
    rows = []
    for k in range(60):
        own, at = base[rng.randrange(4)], rng.randrange(200)
        rows.append((rng.randrange(50), own[at : at + rng.randrange(200)] + str(k) * rng.randrange(3) + own[:90]))
    rows.append((99, base[0] * 2500))  # 1 MB
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert result(S.dedup(docs)) == want
    monkeypatch.setattr(S, "_BUCKET", 20_000)
    assert result(S.dedup(docs)) == want


def test_empty_table(empty):
    assert S.dedup(empty).count() == 0
