"""Vector near-duplicates against all pairs."""

import math
import random

import numpy as np
import pytest

from tidelog.llm import embeddings


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def expected(rows, least=0.98):
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(n):
        for b in range(a):
            (_, x, p), (_, y, q) = rows[a], rows[b]
            if p is None or p != q or not usable(x) or not usable(y) or len(x) != len(y):
                continue
            u, v = np.array(x, np.float64), np.array(y, np.float64)
            if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= least:
                links[a] += 1
                links[b] += 1
                i, j = find(a), find(b)
                root[max(i, j)] = min(i, j)
    out = []
    for k in range(n):
        ids = [rows[j][0] for j in range(n) if find(j) == find(k) and rows[j][0] is not None]
        low = min(ids, default=None)
        out.append((rows[k][0], links[k], low, rows[k][0] is not None and rows[k][0] == low))
    return sorted(out, key=str)


def compare(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, links int")
    # What the frame holds are floats.
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], p) for i, v, p in rows]
    got = [tuple(r) for r in embeddings.near_duplicates(frame, **options).collect()]
    assert sorted(got, key=str) == expected(rows)


def clusters(seed, width=16):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(10):
        center = rng.normal(size=width)
        for _ in range(rng.integers(1, 12)):
            noise = rng.normal(size=width) * rng.choice([0, 0.02, 0.1, 0.18])
            rows.append((len(rows), (center + noise).tolist(), int(rng.integers(0, 2)) if c % 2 else 5))
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("block", [3, 256])
def test_clusters(spark, seed, block):
    compare(spark, clusters(seed), block=block)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 0.0, -2.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [nan, 1.0, 1.0], 1)]
    rows += [(7, [inf, 1.0, 0.0], 1), (8, [None, 1.0, 0.0], 1), (9, [], 1), (10, [1.0, -0.0, -2.0], 1), (None, v, 1)]
    rows += [(11, [1.0, 0.0], 1), (12, v, 2), (None, v, 3), (13, [3e37, 0.0, -6e37], 1), (14, [1e-30, 0.0, -2e-30], 1)]
    compare(spark, rows)


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(frame).count() == 0
