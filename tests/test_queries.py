"""Every registered catalog query against its DuckDB SQL."""

import oracle
import pytest

from fieldbook.plans import queries as q
from fieldbook.plans import daily_queries, race_queries  # noqa: F401  add their queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = oracle.duck(SF)
    c.execute("SET TimeZone='UTC'")
    return c


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query(spark, con, name):
    assert oracle.differences(q.QUERIES[name](spark, SF), con, q.ORACLE_SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_poly_hash_slug(spark):
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    names = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name").collect()}
    for r in q.QUERIES["poly_hash_slug"](spark, SF).collect():
        h = 0
        for c in names[r[0]]:
            h = (h * 31 + ord(c)) % 2**32
        out = ""
        while h:
            h, k = divmod(h, 36)
            out = digits[k] + out
        assert r[1] == out[:6]


def test_point_lookup_keeps_tied_lines_in_table_order_and_repeated_keys(spark, tmp_path):
    lines = [(7, 90, 2), (7, 10, 2), (8, 1, 1), (7, 50, 1), (7, 20, 1), (7, 5, None), (7, None, 1)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, "O"), (7, "F"), (8, "O")], "o_orderkey bigint, o_orderstatus string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    c = oracle.duckdb.connect()
    for name in ("lineitem", "orders"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = q.QUERIES["catalog_point_lookup"](spark, str(tmp_path))
    assert oracle.differences(got, c, q.ORACLE_SQL["catalog_point_lookup"]) == ""
    assert {(r["o_orderstatus"], r["parts"], r["n_lines"]) for r in got.collect()} == {(s, "50,20,90,10,5", 6) for s in "OF"}
