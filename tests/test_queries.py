"""Every query with SQL gives the rows that DuckDB gives, at the smallest size."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, (bool, int, str)):
            return v
        try:
            return round(float(v), 4) + 0.0
        except (TypeError, ValueError):
            return str(v)

    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=str), [names[i] for i in order]


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    said = duck.execute(catalogue.oracle_sql()[name])
    assert got == normal(said.fetchall(), [x[0] for x in said.description])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["tile_id", "window", "row", "col", "ndvi", "ndbi", "albedo", "looks"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["composite_depth", "concentration_sum", "benefit_shares", "lattice", "scenario_deltas", "matched_difference", "hindcast_score", "feature_rows"])
def test_plans_have_no_cartesian_product_and_no_row_python(spark, name):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan
