"""Labels in rounds against labels one by one."""

import random

import pytest

from isohypse.operators import thinning
from isohypse.operators.thinning import overlap, thin_labels

SCHEMA = "sheet int, layer string, name string, rank double, x double, y double, width double, height double, angle double"


def one_by_one(rows, limits):
    import math

    kept = []
    high = lambda v: (v is None, v)
    for r in sorted(rows, key=lambda r: (high(r[3]), high(r[2]), r[4], r[5], r[1])):
        box = (*r[4:8], math.cos(math.radians(r[8])), math.sin(math.radians(r[8])))
        if r[1] in limits and sum(k[0] == r[0] and k[1] == r[1] for k, _ in kept) >= limits[r[1]]:
            continue
        if not any(k[0] == r[0] and overlap(box, other) for k, other in kept):
            kept.append((r, box))
    return sorted((r for r, _ in kept), key=repr)


def labels(seed, n=400, reach=600, rank=lambda rng, x: rng.randrange(40)):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x = rng.uniform(0, reach)
        out.append((k % 2, "abc"[k % 3], f"n{k % 150}", float(rank(rng, x)), x, rng.uniform(0, reach), rng.choice((10.0, 60.0, 200.0)), 14.0, rng.uniform(-90, 90)))
    return out


@pytest.mark.parametrize(("tile", "most"), [(4096.0, 100_000), (64.0, 100_000), (300.0, 20)])
@pytest.mark.parametrize("limits", [{}, {"a": 4, "b": 0}])
def test_rounds_equal_one_by_one(spark, tile, most, limits):
    rows = labels(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    of = spark.createDataFrame(list(limits.items()), "layer string, limit int") if limits else None
    assert sorted(map(tuple, thin_labels(df, of, tile, most).collect()), key=repr) == one_by_one(rows, limits)


def test_a_chain_through_all_tiles(spark):
    """Ranks that grow to the right: each label depends on its neighbour."""
    rows = [(0, "a", f"n{k}", float(k), 9.0 * k, 0.0, 10.0, 4.0, 0.0) for k in range(40)]
    assert sorted(map(tuple, thin_labels(spark.createDataFrame(rows, SCHEMA), tile=90.0).collect()), key=repr) == one_by_one(rows, {})


def test_hot_place_nulls_copies_and_no_rows(spark):
    rows = [(0, "a", f"n{k}", float(k % 7), 5.0, 5.0, 10.0, 4.0, 0.0) for k in range(300)]
    rows += [(0, "a", None, None, 5.0, 5.0, 10.0, 4.0, 0.0), (0, "a", None, None, 500.0, 5.0, 10.0, 4.0, 0.0)] + [(0, "a", "same", 1.0, 50.0, 50.0, 10.0, 4.0, 0.0)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    for most in (50, 100_000):
        assert sorted(map(tuple, thin_labels(df, most=most).collect()), key=repr) == one_by_one(rows, {})
    assert thin_labels(df.limit(0)).count() == 0


def test_both_forms_of_overlap_agree(spark):
    rng = random.Random(5)
    rows = [tuple(float(rng.randrange(0, 40)) for _ in range(4)) + (float(rng.choice((0, 30, 90, 45))),) for _ in range(300)]
    box = "struct<x:double,y:double,width:double,height:double,angle:double>"
    import math

    pairs = list(zip(rows[::2], rows[1::2], strict=True))
    got = [r.met for r in spark.createDataFrame(pairs, f"a {box}, b {box}").select(thinning.overlaps("a", "b").alias("met")).collect()]
    turned = lambda r: (*r[:4], math.cos(math.radians(r[4])), math.sin(math.radians(r[4])))
    assert got == [overlap(turned(a), turned(b)) for a, b in pairs] and 0 < sum(got) < len(got)
