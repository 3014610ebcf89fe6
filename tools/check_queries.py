"""Run registered queries and compare them with their SQL in DuckDB.

    python tools/check_queries.py [--root DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidelog.plans import CHECKS, QUERIES  # noqa: E402
from tidelog.session import session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return type(a) is type(b) and a == b


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--root", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    spark = session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{opts.root}/{name}.parquet'")
    bad = 0
    for name in opts.names or list(QUERIES):
        begin = time.time()
        try:
            frame = QUERIES[name](spark, opts.root)
            cols = sorted(frame.columns)
            rows = [tuple(plain(r[c]) for c in cols) for r in frame.select(*cols).collect()]
        except Exception as problem:
            bad += 1
            print(f"FAIL {name}: spark: {str(problem)[:600]}", flush=True)
            continue
        took = time.time() - begin
        if name not in CHECKS:
            print(f"rows {name}: {len(rows)} rows {took:.1f}s", flush=True)
            continue
        try:
            result = duck.execute(CHECKS[name])
            names = [d[0] for d in result.description]
            found = result.fetchall()
        except Exception as problem:
            bad += 1
            print(f"FAIL {name}: sql: {str(problem)[:600]}", flush=True)
            continue
        if sorted(names) != cols:
            bad += 1
            print(f"FAIL {name}: columns {cols} vs {sorted(names)}", flush=True)
            continue
        index = [names.index(c) for c in cols]
        want = [tuple(plain(r[i]) for i in index) for r in found]
        left, right = ordered(rows), ordered(want)
        wrong = [(x, y) for x, y in zip(left, right) if not all(map(same, x, y))]
        exact = sum(1 for x, y in zip(left, right) if x != y)
        if len(left) != len(right) or wrong:
            bad += 1
            print(f"FAIL {name}: {len(left)} vs {len(right)} rows, {len(wrong)} differ", flush=True)
            for x, y in wrong[:3]:
                print("   spark", str(x)[:300], "\n   sql  ", str(y)[:300], flush=True)
        else:
            note = f" ({exact} differ in the last bits)" if exact else ""
            empty = "  EMPTY" if not rows else ""
            print(f"ok   {name}: {len(rows)} rows {took:.1f}s{note}{empty}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
