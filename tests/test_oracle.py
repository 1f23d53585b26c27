"""Every query with oracle SQL: Spark result equals DuckDB's at sf0.01."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E
from loghawk.sources.tables import TABLES

from conftest import SF01

def _norm(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        row = []
        for v in r:
            if isinstance(v, np.generic):
                v = v.item()
            if isinstance(v, float):
                v = None if pd.isna(v) else round(v, 6)
            elif hasattr(v, "tolist"):
                v = tuple(round(x, 6) if isinstance(x, float) else x for x in v.tolist())
            elif isinstance(v, list):
                v = tuple(round(x, 6) if isinstance(x, float) else x for x in v)
            elif v is None or (not isinstance(v, (str, bytes, tuple)) and pd.isna(v)):
                v = None
            row.append(repr(v))
        out.append(tuple(row))
    return sorted(out)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF01).toPandas()
    odf = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(odf.columns)
    assert _norm(sdf) == _norm(odf)
