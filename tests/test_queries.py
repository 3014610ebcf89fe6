"""Every query with a check in SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from tidelog.plans import CHECKS, QUERIES
from tools.check_queries import TABLES, ordered, plain, same


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    frame = QUERIES[name](spark, small)
    cols = sorted(frame.columns)
    rows = ordered([tuple(plain(r[c]) for c in cols) for r in frame.select(*cols).collect()])
    if name not in CHECKS:
        assert rows
        return
    result = duck.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    index = [names.index(c) for c in cols]
    want = ordered([tuple(plain(r[i]) for i in index) for r in result.fetchall()])
    assert len(rows) == len(want)
    assert all(all(map(same, a, b)) for a, b in zip(rows, want))
