"""Recursive shapes whose rows are more than Spark's limit for recursive queries."""

import duckdb
import pytest

from sourceloom.plans import shapes


@pytest.mark.parametrize("name", sorted(shapes.LEVELS))
def test_no_limit_of_rows(name, spark, sf_dir):
    spark.conf.set("spark.sql.cteRecursionRowLimit", 20)
    try:
        rows = {tuple(r) for r in shapes.queries()[name](spark, sf_dir).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{sf_dir}/part.parquet')")
    assert rows == set(con.execute(shapes.oracles()[name]).fetchall()) and len(rows) > 20
