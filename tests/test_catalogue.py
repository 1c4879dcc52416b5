"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import lexiloom.plans.assembly  # noqa: F401
import lexiloom.plans.prefixes  # noqa: F401
import lexiloom.plans.recordings  # noqa: F401
import lexiloom.plans.reports  # noqa: F401
import lexiloom.plans.speech  # noqa: F401
import lexiloom.plans.training  # noqa: F401
import lexiloom.plans.vocabulary  # noqa: F401
from lexiloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    con.sql("SET TimeZone = 'UTC'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    clean = [tuple(None if pd.isna(x) else round(x, 5) if isinstance(x, float) else str(x) if isinstance(x, pd.Timestamp) else x for x in r) for r in df.astype(object).itertuples(index=False)]
    return sorted(clean, key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLE:
        assert len(got)
        return
    want = duck.sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows(got) == rows(want)
