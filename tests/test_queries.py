"""Every registered base query against DuckDB on the same tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heddle import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.SQL:
        assert len(got)
        return
    want = duck.execute(catalog.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["l_orderkey", "n", "total"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown_reaches_the_scan(spark):
    plan = catalog.QUERIES["scan_pushdown"](spark, SF)._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    pushed, read = scan.dataFilters().mkString(" "), scan.requiredSchema().fieldNames()
    assert "l_quantity" in pushed and "45.0" in pushed
    assert "l_quantity" in list(read) and "l_extendedprice" not in list(read)


def test_sketches_are_of_groups_not_of_pairs(spark, duck, tmp_path):
    """A distinct count beside an estimate gives every (group, part) a sketch of 3 KB, which is shuffled."""
    rows = spark.range(3000).selectExpr("nullif(element_at(array('A', 'N', 'R', ''), cast(id % 4 + 1 AS int)), '') AS l_returnflag", "nullif(id DIV 8, 7) AS l_partkey")
    rows = rows.unionByName(spark.sql("SELECT 'X' AS l_returnflag, cast(null AS bigint) AS l_partkey FROM range(5)"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["agg_approx_error"](spark, str(tmp_path))
    sql = catalog.SQL["agg_approx_error"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(duck.execute(sql).fetchall(), key=str)
    plan = got._jdf.queryExecution().sparkPlan().toString().splitlines()
    keys = [x.split("keys=[")[1].split("]")[0] for x in plan if "Aggregate(" in x and "approx_count_distinct" in x]
    assert keys and not any("l_partkey" in k for k in keys)
    told = lambda df: dict(map(tuple, df.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02)).collect()))
    assert told(rows) == told(rows.distinct())
