"""One text of over a megabyte, with what is looked for at its end; ties and copies of it."""

import pytest

from isohypse.llm import decontaminate, pii, quality, secrets, urls

PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen"
LONG = "lorem ipsum dolor " * 60_000 + PASSAGE + " mail me at a.b@example.org or use 0123456789abcdef01"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "s"), (2, LONG, "s"), (2, LONG, "s"), (3, "x" * 1_200_000, "s"), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'clash' AS n_words", "0 AS spans", "1 AS kind")


def by_id(df):
    out = {}
    for r in df.collect():
        assert out.setdefault(r.doc_id, r) == r
    return out


def test_decontamination(docs, spark):
    out = by_id(decontaminate.decontaminate(docs, spark.createDataFrame([(7, PASSAGE), (8, PASSAGE)], "item_id long, text string")))
    assert (out[1].n_words, out[1].n_hit, out[1].n_items, out[1].contaminated) == (180_000 + 13 + 10, 13, 2, False)
    assert out[2].n_hit == 13 and (out[3].n_words, out[3].n_hit) == (1, 0) and out[4].n_words == 0


def test_quality(docs):
    out = by_id(quality.judge(docs))
    assert (out[1].n_words, out[1].n_dup_lines, out[1].base_failed) == (180_000 + 13 + 7, 0, True)
    assert (out[3].n_words, out[3].word_chars) == (1, 1_200_000) and out[4].n_words == 0


def test_personal_data(docs):
    out = by_id(pii.find(docs))
    start = LONG.index("a.b@")
    assert out[1].n_email == 1 and f"email:{start}:{start + 15}" in out[1].spans.split(",") and out[1].spans == out[2].spans
    assert out[3].n_email == 0 and out[4].n_email == 0


def test_secrets(docs):
    out = by_id(secrets.scan(docs))
    start = LONG.index("0123456789abcdef01")
    assert out[1].n_hex == 1 and f"hex:{start}:{start + 18}" in out[1].spans.split(",") and out[3].n_hex == 0


def test_urls(spark):
    long = "https://Example.COM/en/" + "7" * 1_000_000
    pages = spark.createDataFrame([(1, long), (2, "x" * 1_000_000), (3, None)], "page_id long, url string").selectExpr("*", "'c' AS host", "'c' AS verdict")
    out = {r.page_id: r for r in urls.judge(pages).collect()}
    assert (out[1].host, len(out[1].path), out[1].rule, out[1].verdict) == ("example.com", 1_000_004, "example.com/en/7", "allow")
    assert (out[2].host, out[2].path) == ("", "") and (out[3].host, out[3].path) == ("", "")
