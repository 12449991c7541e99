import re
from collections import Counter

import pytest

from isohypse.llm import quality as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_base_counts(rows):
    for _, text in [*rows, (0, "a b c d e a b c d e"), (0, "x\nx\n\x0b\nx y\u3000z\u2028w <|>"), (0, "q " * 9)]:
        assert Q.base(text) == brute(text)


def test_judged_with_and_without_a_join(documents, rows):
    got = [sorted(map(str, Q.judge(documents, min_docs=3, max_share=0.02, max_sent=n).select("doc_id", "n_words", "left_words", "base_failed", "kept").collect())) for n in (1000, -1)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    for r in Q.judge(documents).collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


@pytest.fixture(scope="module")
def hosts(spark):
    shared = "Same Footer line 12 here again"
    rows = [(i, f"own text {chr(97 + i % 26) * (i + 1)} with some words of its own kind and more of it\n{shared}", "h1") for i in range(40)]
    rows += [(100 + i, f"{shared}\nunique {i}\n{shared.upper()} \t\nsame footer  line 34 here again", "h1") for i in range(2)]
    rows += [(200, f"{shared}\nlone words in another host that has no such line elsewhere", "h2"), (201, "lines of one text " * 2, "h1"), (202, "lines of one text " * 2, "h1"), (203, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_a_hosts_boilerplate_is_found_and_depletes(hosts):
    assert Q.boilerplate(hosts, min_docs=20, max_share=0.5).count() == 1
    out = {r.doc_id: r for r in Q.judge(hosts, min_docs=20, max_share=0.5).collect()}
    assert out[0].kept and out[0].left_words == out[0].n_words - 6
    assert not out[100].kept and out[100].left_words == 2
    assert out[200].kept and not out[203].kept
    left = {r.doc_id: r.text for r in Q.without_boilerplate(hosts, min_docs=20, max_share=0.5).collect()}
    assert left[100] == "unique 0" and left[203] is None and "Footer" in left[200]
    joined = Q.without_boilerplate(hosts, max_sent=-1, min_docs=20, max_share=0.5)
    assert joined.columns == hosts.columns and {r.doc_id: r.text for r in joined.collect()} == left


def test_copies_of_a_text_are_not_its_boilerplate(spark):
    docs = spark.createDataFrame([(i, "one text that stands here many times over and over again", "h") for i in range(60)], "doc_id long, text string, source string")
    assert Q.judge(docs, min_docs=10, max_share=0.1).where("kept").count() == 60


def test_empty_table(empty):
    assert Q.judge(empty).count() == 0
