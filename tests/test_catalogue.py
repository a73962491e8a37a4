"""Every query against its SQL, on the small tables."""

from pathlib import Path

import pytest

from tidemark.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def shown(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    import duckdb

    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted(tuple(map(shown, r)) for r in got.select(cols).collect())
    if name not in ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())
