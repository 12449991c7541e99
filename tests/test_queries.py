import pytest

import __spark_entry__ as entry
from isohypse.plans import queries as plans
from isohypse.plans import views as V

from .compare import differences

WITH_SQL = [name for name, (_, sql) in plans.QUERIES.items() if sql]


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_gives_the_rows_of_its_sql(name, spark, sf_dir):
    query, sql = plans.QUERIES[name]
    assert differences(query, sql, spark, sf_dir) == ""


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n not in WITH_SQL])
def test_query_without_sql_runs(name, spark, sf_dir):
    assert plans.QUERIES[name][0](spark, sf_dir).count() >= 0


def test_bands_have_the_areas_of_their_cells(spark, sf_dir):
    from isohypse.operators.vector import signed_double_area

    areas = {r.level: r.area for r in plans.QUERIES["region_areas"][0](spark, sf_dir).collect()}
    made: dict[float, float] = {}
    for r in plans.QUERIES["elevation_bands"][0](spark, sf_dir).collect():
        size = [abs(signed_double_area([(p.x, p.y) for p in ring][:-1])) / 2 for ring in r.rings]
        made[r.low] = made.get(r.low, 0) + size[0] - sum(size[1:])
    levels = sorted(areas)
    want = {a: areas[a] - (areas[b] if b is not None else 0) for a, b in zip(levels, [*levels[1:], None], strict=True)}
    assert made == pytest.approx(want, abs=0.01)


def test_streamlines_cover_the_whole_field(spark, sf_dir):
    rows = V.field(spark, sf_dir).agg({"row": "max"}).first()[0] + 1
    out = plans.QUERIES["streamlines"][0](spark, sf_dir).selectExpr("int(r / 64) AS part").distinct().collect()
    assert {x.part for x in out} == set(range((rows + 63) // 64))


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
