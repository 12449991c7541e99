import hashlib
import re

from isohypse.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in rows:
        w, hit, ids = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    ids |= own
        out.append((str(doc), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_equals_brute_force_in_one_block_and_in_many(spark, documents, rows, sf_dir):
    more = [(900, "A b C d"), (901, None), (902, "..."), (903, "A b C d"), (None, "zz")]
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame(more, "item_id long, text string"))
    items = [(r.item_id, r.text) for r in benchmark.collect() if r.item_id is not None]
    want = brute(rows, items)
    assert any(x[5] for x in want)
    assert result(D.decontaminate(documents, benchmark)) == want
    assert result(D.decontaminate(documents, benchmark, block_bytes=2000)) == want


def test_clean_keeps_the_columns_and_the_clean_rows(spark, documents, rows, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = sum(x[5] for x in brute(rows, [(r.item_id, r.text) for r in benchmark.collect()]))
    for block in (4 << 20, 2000):
        out = D.clean(documents, benchmark, block_bytes=block)
        assert out.columns == documents.columns and out.count() == len(rows) - bad


def test_spans_are_places_in_the_original():
    text = "Foo, BAR-baz qux"
    assert [text[a:b] for a, b in D.spans(text, [0, 2, 3])] == ["Foo", "baz qux"]


def test_empty_tables(documents, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(documents, none).where("contaminated OR n_items > 0").count() == 0
    assert D.decontaminate(empty, none).count() == 0
