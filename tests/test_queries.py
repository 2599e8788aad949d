import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.catalog.QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def tidy(df):
    df = df[sorted(df.columns)].astype(object).where(lambda d: d.notna(), None)
    return sorted((tuple(round(v, 6) if isinstance(v, (float, np.floating)) else str(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = entry.catalog.QUERIES[name](spark, SF).toPandas()
    if name in entry.catalog.SQL:
        rows = con.execute(entry.catalog.SQL[name])
        want = pd.DataFrame(rows.fetchall(), columns=[d[0] for d in rows.description])
        assert sorted(got.columns) == sorted(want.columns)
        a, b = tidy(got), tidy(want)
        assert len(a) == len(b)
        for x, y in zip(a, b):
            for u, v in zip(x, y):
                assert u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) < 1e-6) or str(u) in (str(v), f"{v}.0") or f"{u}.0" == str(v), (x, y)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
