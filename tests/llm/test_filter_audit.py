import re
from collections import Counter
from itertools import permutations

import pytest

from isohypse.llm import filter_audit as A


def failing(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(w) < 100 else set()
    out |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
    return out | ({"D"} if re.search(r"[#$%&*|]", text) else set())


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, bad = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    rows = [(lang or "", failing(t) | ({"E"} if d is not None and d > least[t or ""] else set()), d in good, d in bad) for d, t, lang in docs]
    counts = Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                row = [0] * 6
                for p, failed, g, b in rows:
                    if p == part:
                        earlier = bool(failed & set(order[:k]))
                        removed = f in failed and not earlier
                        for i, x in enumerate((f not in failed and not earlier, removed, f in failed and earlier, failed == {f}, removed and g, removed and b)):
                            row[i] += x
                counts[part, "".join(order), k + 1] = row
    total = Counter()
    for (part, order, step), row in counts.items():
        total[part, order[step - 1]] += row[1]
    return sorted((*k, *row, total[k[0], k[1][k[2] - 1]]) for k, row in counts.items())


LONG = " ".join(f"word{i}" for i in range(120))
DOCS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "de"), (None, LONG, "en"), (3, None, None), (4, "", "en"), (5, None, ""),
    (6, "SHOUT " * 150, "en"), (7, LONG + " #tag", "de"), (8, "a　b c\x0bd\x0ce \x1c", "de"), (9, LONG + " " + "Q" * 90, "en"),
    (9, LONG, "en"), (10, "x" * 200_000 + " " + LONG, "fr"), (-5, LONG, "fr"), (11, "É" * 30 + "A B C", "fr"), (12, LONG + " 100%", "de"), (12, LONG + " 100%", "de"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (6, None, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1), (9, 1, 0), (12, 1, 0)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string").selectExpr("*", "'x' AS part", "1 AS failed", "2 AS n", "true AS good", "'y' AS content")
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "'z' AS text", "0 AS part")


def test_equals_brute_force_with_edge_cases(tables):
    got = sorted(tuple(r) for r in A.audit(*tables).collect())
    assert got == brute(DOCS, LABELS) and len(got) == 4 * 600


def test_lattice_has_80_edges(tables, spark):
    found = A.edges(A.failures(*tables))
    assert {r.n for r in found.groupBy("part").count().selectExpr("count AS n").collect()} == {80}
    assert A.steps(spark).count() == 600


def test_every_order_keeps_the_same_documents(documents, spark, sf_dir):
    out = A.audit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {r.n for r in out.where("step = 5").groupBy("part").agg({"kept": "max"}).join(out.where("step = 5").groupBy("part").agg({"kept": "min"}), "part").selectExpr("`max(kept)` - `min(kept)` AS n").collect()} == {0}


def test_empty_tables(tables):
    docs, labels = tables
    assert A.audit(docs.limit(0), labels).count() == 0
    assert A.audit(docs, labels.limit(0)).selectExpr("sum(good_lost) + sum(toxic_lost)").first()[0] == 0
