"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tailwright.plans import file_queries  # noqa: F401  adds its queries to the registry
from tailwright.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 9) if isinstance(x, float) else x
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toArrow().to_pandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_is_registered():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(QUERIES) == set(ORACLES)


def test_interval_join_is_an_equi_join(spark, tmp_path):
    from tailwright.operators import annotate
    from tailwright.plans import queries as q

    for name, df in (("a", q.alignments(spark, DIR)), ("b", q.bridge(spark, DIR, "anno"))):
        df.write.parquet(str(tmp_path / name))
    pairs = annotate.candidates(spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b")))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "HashJoin" in plan + plan.replace("SortMergeJoin", "HashJoin")
