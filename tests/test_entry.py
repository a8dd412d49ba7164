import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["flagship", "sqrt", "gcd", "nanmean", "percentile_nearest", "unique", "interp", "transpose", "matmul", "medianFilter", "svd", "clusterPixels"]
#: And one in nine of all queries of arrays with SQL.
EVERY = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n not in SAMPLE)[::9]


def rows(df):
    names = sorted(df.columns)
    plain = lambda v: v + 0.0 if isinstance(v, float) else v
    return sorted(str(tuple(map(plain, r))) for r in df[names].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE + EVERY)
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for table in ("lineitem", "part", "customer", "supplier", "events", "orders", "nation", "region", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(db.execute(entry.oracle_sql()[name]).df())


def test_registration():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known)
    assert len(known) > 300


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_smoke(spark):
    assert entry.entry(spark).count() == 3
