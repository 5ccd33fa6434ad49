"""Every registered query with SQL against DuckDB, on the smallest test tables."""

import decimal
import glob
import os

import pytest

from millrace import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
#: The nice step of the histogram is another one on a tenth of the rows.
OTHER_SIZES = {"chart_histogram_nice"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", sorted(set(plans.all_sql()) - OTHER_SIZES))
def test_query_equals_sql(spark, duck, name):
    df = plans.all_queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(plans.all_sql()[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    want = sorted((tuple(norm(r[have.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_flagship(spark):
    assert plans.flagship(spark, DATA).count() > 0
