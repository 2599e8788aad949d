"""The registered corpus queries that SQL can state, compared with it."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.corpus.oracle_sql()))
def test_corpus_query(spark, con, name):
    rows = con.execute(entry.corpus.oracle_sql()[name])
    want = pd.DataFrame(rows.fetchall(), columns=[d[0] for d in rows.description])
    got = entry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    plain = lambda df: sorted(tuple("" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert plain(got) == plain(want)
