import random
import re
from collections import defaultdict

import numpy as np

from isohypse.llm import ngram_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders, common = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for k in s:
            holders[k].append(i)
    for own in holders.values():
        for x, i in enumerate(own):
            for j in own[x + 1 :]:
                common[i, j] += 1
    for (i, j), c in common.items():
        if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
            parent[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return sorted((str(doc), len(sets[i]), low.get(find(i))) for i, (doc, _) in enumerate(rows))


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in df.collect())


def test_equals_brute_force(documents, rows):
    assert result(J.components(documents)) == brute(rows)


def test_chains_of_near_copies_and_shared_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows, passage = [], [word() for _ in range(40)]
    for g in range(6):
        own = [word() for _ in range(60)]
        for _ in range(25):
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, " ".join(passage + [word() for _ in range(6)])) for k in range(40)]
    rows += [(500 + k, " ".join(passage[: 5 + k % 9])) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(J.components(docs)) == brute(rows)


def test_links_are_counted_within_groups_too(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = []
    for _ in range(3):
        own = [word() for _ in range(60)]
        for _ in range(25):
            rows.append((len(rows), " ".join(own)))
            own[rng.randrange(60)] = word()
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    linked = lambda x, y: x != y and 100 * len(x & y) >= 80 * len(x | y)
    want = {i: sum(linked(x, y) for y in set(sets.values())) for i, x in sets.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert max(want.values()) > 2
    assert {r.doc_id: r.n_links for r in J.link_counts(docs).collect()} == want


def test_frequent_tokens_are_indexed_in_combinations(spark, monkeypatch):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(12)]
    rows = [(k, " ".join(rng.sample(pool, 4))) for k in range(150)]
    real = J._sketch
    monkeypatch.setattr(J, "_sketch", lambda sets: (real(sets)[0], 20))  # nearly all tokens count as frequent
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(J.components(docs)) == brute(rows)


def test_large_sets_of_frequent_tokens(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(60):
        own = base[rng.randrange(8) :]
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(30)}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, " ".join(base[: rng.randint(5, 400)])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = J._sketch
    for frequent in (9, 30, 255):
        monkeypatch.setattr(J, "_sketch", lambda sets, f=frequent: (real(sets)[0], f))
        assert result(J.components(docs)) == brute(rows)


def test_partners_share_a_number_of_groups():
    for n in range(1, 3000):
        for m in range(-(-4 * n // 5), 5 * n // 4 + 1):
            assert set(J._groups(n)) & set(J._groups(m)) & {1 << max(0, (x // 10).bit_length() - 1) for x in (n, m)}


def test_bounds_never_rule_out_a_link():
    rng = np.random.default_rng(8)
    levels = rng.integers(0, 40, 1 << J._SKETCH).astype(np.uint8)
    sets = []
    for _ in range(20):
        base = rng.integers(0, 1 << 63, rng.integers(5, 300), dtype=np.uint64)
        for _ in range(6):
            own = base[rng.random(len(base)) > rng.random() * 0.2]
            sets.append(np.unique(np.r_[own, rng.integers(0, 1 << 63, rng.integers(0, 12), dtype=np.uint64)]))
    sets = [s for s in sets if len(s)]
    keys = [J.indexed(s, levels, 30) for s in sets]
    held = defaultdict(set)
    for k, (own, rare, _, _) in enumerate(keys):
        for x in own.tolist():
            held[x].add(k)
    alone = [sum(len(held[x]) == 1 for x in own[:rare].tolist()) for own, rare, _, _ in keys]
    linked = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if J.linked(a, b):
                linked += 1
                assert J.can_link(*(np.array(v) for v in (len(a), len(b), alone[i], alone[j], keys[i][2], keys[j][2])))
                assert set(keys[i][0].tolist()) & set(keys[j][0].tolist())
    assert linked > 50


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
        b = np.unique(np.r_[a[: rng.integers(300, 400)], rng.integers(0, 1 << 63, rng.integers(0, 60), dtype=np.uint64)])
        lost = np.bitwise_count((J.bitmap(a) & ~J.bitmap(b)).view(np.uint64)).sum()
        assert lost <= len(np.setdiff1d(a, b))


def test_one_document_of_each_group_stays(documents, rows, empty):
    want = {x[2] for x in brute(rows) if x[2] is not None}
    out = J.representatives(documents)
    assert out.columns == documents.columns
    assert sorted(r.doc_id for r in out.where("doc_id IS NOT NULL").collect()) == sorted(want)
    assert J.components(empty).count() == 0
