"""Every registered query of the engine against its SQL: on the smallest tables, network queries on larger ones, where screens keep edges."""

import os
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from tandem.plans import catalog, network_queries

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
EDGES = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01"))
pytestmark = pytest.mark.skipif(not (DATA.exists() and EDGES.exists()), reason="no test tables here")
#: Folder by folder, as the tables that queries share are kept for one folder at a time.
NAMES = sorted(catalog.queries(), key=lambda n: (n in network_queries.QUERIES, n))


@pytest.fixture(scope="module")
def duck():
    out = {}
    for data in {DATA, EDGES}:
        out[data] = duckdb.connect()
        for f in data.glob("*.parquet"):
            out[data].sql(f"create view {f.stem} as select * from '{f}'")
    return out


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    cell = lambda v: "null" if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else f"{v:.6f}" if isinstance(v, float) else str(v)
    out = pd.DataFrame({c: [cell(v) for v in frame[c].tolist()] for c in sorted(frame.columns)})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    data = EDGES if name in network_queries.QUERIES else DATA
    got = catalog.queries()[name](spark, str(data)).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
        return
    pd.testing.assert_frame_equal(canonical(got), canonical(duck[data].sql(sql).df()), check_dtype=False)
    if name in network_queries.QUERIES:
        assert len(got) > 0
