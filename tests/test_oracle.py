"""Every query of the catalog that has SQL gives its rows."""

import glob
import math
import os

import duckdb
import pytest

from strandline.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def norm(v):
    if hasattr(v, "as_integer_ratio") and not isinstance(v, bool):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.6f}".replace("-0.000000", "0.000000")
    return repr(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, wanted = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert len(got) == len(wanted)
    assert [x for x in zip(got, wanted) if x[0] != x[1]][:3] == []


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
