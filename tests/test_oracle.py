"""Every query with SQL gives what DuckDB gives for it."""

from __future__ import annotations

import glob
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillrank.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(pdf):
    cols = sorted(pdf.columns)

    def plain(v):
        if pd.isna(v):
            return None
        if hasattr(v, "year"):
            return str(v)[:10]
        return round(float(v), 6) if isinstance(v, (numbers.Number, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return cols, sorted(([plain(v) for v in r] for r in pdf[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, duck, name):
    got, want = rows(registry.QUERIES[name](spark, SF).toPandas()), rows(duck.sql(registry.ORACLE[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert got[1] == want[1]
