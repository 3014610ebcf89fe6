"""The queries of this package on the smallest tables, against SQL where there is some."""

import duckdb
import pytest

import __spark_entry__
from tidelog.llm.queries import CHECKS, QUERIES
from tools.check_queries import TABLES, ordered, plain


def test_all_operators_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(CHECKS) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    frame = QUERIES[name](spark, small)
    rows = [tuple(r) for r in frame.collect()]
    table = {"op8_warc": "pages", "op9_embeddings": "embeddings"}.get(name, "documents")
    if name == "op12_divergence":
        count = len(rows)
    else:
        count = spark.read.parquet(f"{small}/{table}.parquet").count()
    assert len(rows) >= count if name in ("op4_tokens", "op10_packing") else len(rows) == count
    if name not in CHECKS:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    result = con.execute(CHECKS[name])
    index = [[d[0] for d in result.description].index(c) for c in frame.columns]
    want = [tuple(r[k] for k in index) for r in result.fetchall()]
    assert ordered([tuple(map(plain, r)) for r in rows]) == ordered([tuple(map(plain, r)) for r in want])
