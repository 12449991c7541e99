import hashlib
import math
import random

import numpy as np
import pytest

from isohypse.llm import clustering as C


def brute(rows, k=16, rounds=3, dims=64):
    """rows: (vec_id, vector); everything in Python integers, all dimensions of all centroids."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in first[:k]]

    def go():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        at = go()
        for j in range(len(c)):
            own = [v for (_, v), (_, x) in zip(kept, at, strict=True) if x == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at, top = go(), (1 << 63) - 1
    inertia = [sum(min(d, top) for d, x in at if x == j) for j in range(len(c))]
    return sorted(((i, j, min(d, top), min(inertia[j], top), min(sum(inertia), top), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at, strict=True)), key=repr)


def run(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS cluster", "2 AS distance", "'x' AS vector").repartition(3)
    return sorted((tuple(r) for r in C.cluster(df).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = [(i, [float(np.float32(r.gauss((i % 5) / 3 - 0.5, 0.3) * (1 + d % 7))) for d in range(64)]) for i in range(200)]
    return out


EDGE = [(1000, None), (1001, []), (1002, [0.1] * 63), (1003, [0.1] * 65), (1004, [0.1] * 63 + [None]), (1005, [math.nan] * 64), (1006, [0.5] * 63 + [math.inf]), (None, [0.25] * 64), (1007, [0.0] * 64), (1008, [-0.0] * 64), (1009, [-1 / 64] * 64), (1009, [-1 / 64] * 64), (3, [-1.0] * 64)]


def test_equals_brute_force(spark, rows):
    assert run(spark, rows + EDGE) == brute(rows + EDGE)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_large_components(spark, rows):
    big = rows[:40] + [(500 + i, [3e38 * (-1) ** i] * 60 + [1e30, 5e7, -3e7, 0.1]) for i in range(4)]
    assert run(spark, big, "double") == brute(big)
    over = [(1, [1e308] * 64), (2, [0.0] * 64)]  # 64e308 is no double
    assert [r[0] for r in run(spark, over, "double")] == [2]


def test_few_vectors_and_none(spark, rows):
    assert run(spark, rows[:3]) == brute(rows[:3])
    assert run(spark, EDGE[:7]) == [] and run(spark, []) == []


def test_partial_distances_only_save_work():
    r = np.random.default_rng(3)
    x, c = r.integers(-40, 40, (5000, 64)), r.integers(-40, 40, (16, 64))
    full = ((x[:, None] - c) ** 2).sum(2)
    for order in (list(range(64)), list(r.permutation(64))):
        number, far = C.nearest(x, c, order)
        assert (number == full.argmin(1)).all() and (far == full.min(1)).all()


def test_limbs():
    for n in (0, -1, 1 << 61, 1 << 62, -(1 << 62), -(1 << 62) - 1, 3**200, -(3**200)):
        parts = C.limbs(n)
        assert sum(x << 60 * i for i, x in enumerate(parts)) == n and all(-(1 << 63) <= x < 1 << 63 for x in parts)
