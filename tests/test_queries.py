"""Every registered query of the tables against its SQL, and its plan."""

import duckdb
import pytest

from tessel import registry
from tessel.sources.tables import NAMES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def cells(row):
    return tuple("" if v is None else f"{float(v):.5g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sql, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = sql.execute(registry.ORACLE_SQL[name])
    assert columns == sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(cells(r) for r in df.select(columns).collect()) == sorted(cells(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["batch_statistics", "check_engine_scores", "dataset_diff", "contradictory_labels", "funnel_stages", "profile_score"])
def test_plan_stays_in_the_engine(spark, name):
    plan = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "CartesianProduct"))
