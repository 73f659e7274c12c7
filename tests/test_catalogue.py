"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from weftline import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    def value(v):
        return round(float(v), 6) if isinstance(v, float) else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = plain(df.select(*cols).collect())
    sql = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalogue.ORACLE_SQL[name]})")
    assert got == plain(sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) - {"greedy_cluster"}))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_emerging_roles_are_planned_in_steps(spark):
    """What several steps read is computed once: the plan stays small for the driver."""
    plan = catalogue.QUERIES["candidate_score"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 20, plan
