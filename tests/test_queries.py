import pandas as pd
import pytest
from oracle import same

from lumenspec import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_matches_sql(spark, name):
    same(spark, Q.QUERIES[name], Q.SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(Q.QUERIES) <= set(e.queries()) and set(Q.SQL) <= set(e.oracle_sql())


def test_line_spectra_from_key_zero(spark, tmp_path):
    """Keys of orders begin with 0, numbers of arrays with 1; null and negative customers are odd ones, as in SQL."""
    rows = [(0, 2), (1, 3), (2, None), (3, -3), (4, -2), (-5, 4), (None, 6)]
    pd.DataFrame(rows, columns=["o_orderkey", "o_custkey"], dtype="Int64").to_parquet(tmp_path / "orders.parquet")
    same(spark, Q.QUERIES["line_spectra"], Q.SQL["line_spectra"], str(tmp_path))
