"""Every registered array query against its SQL form on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from ndlattice.plans.extended import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, (float, np.floating)) and np.isnan(x):
            return None
        return round(float(x), 6) + 0.0 if isinstance(x, (float, np.floating)) else x

    rows = [tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=lambda r: [(x is None, str(x) if isinstance(x, str) else "", x if x is not None and not isinstance(x, str) else 0) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(con.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


#: Rows that the small tables lack.
_ZEROS = "SELECT i AS c_custkey, [-0.0::DOUBLE, 0.0, 12.5, -3.25][i] AS c_acctbal FROM range(1, 5) t(i)"
EDGES = {
    "emath": ("customer", _ZEROS),
    "logarithms": ("customer", _ZEROS),
    "sign_bits": ("customer", _ZEROS),
    "number_text": ("orders", "SELECT o_orderkey, 1234.5 AS o_totalprice FROM (VALUES (5::BIGINT), (65535), (65536), (117885), (59150176)) t(o_orderkey)"),
}


@pytest.mark.parametrize("name", sorted(EDGES))
def test_edges_match_sql(spark, tmp_path, name):
    source, rows = EDGES[name]
    c = duckdb.connect()
    c.execute(f"COPY ({rows}) TO '{tmp_path}/{source}.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW {source} AS SELECT * FROM '{tmp_path}/{source}.parquet'")
    assert plain(QUERIES[name](spark, str(tmp_path)).toPandas()) == plain(c.execute(ORACLES[name]).df())
