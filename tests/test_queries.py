"""Every query of the library against its SQL twin, on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from scenewright.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("SCENEWRIGHT_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


#: They generate tasks of many types: ``test_pool`` and ``test_generate`` try the same on small inputs.
LONG = {"candidate_pool", "evaluation_files"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LONG))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*columns).collect())
    assert got
    if name in ORACLES:
        rel = duck.sql(driver.oracle_sql()[name])
        assert sorted(rel.columns) == columns
        assert got == sorted(tuple(map(cell, r)) for r in rel.select(", ".join(columns)).fetchall())


def test_entry(spark):
    assert driver.entry(spark).columns == ["scene_id", "target_idx", "question", "answer"]
