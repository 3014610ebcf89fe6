"""SimHash near-duplicates against all pairs."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import graph, simhash


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def expected(docs):
    fps = [plain(t) for _, t in docs]
    n = range(len(docs))
    near = [(a, b) for a in n for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    component = roots(n, near)
    rows = []
    for k in n:
        ids = [docs[j][0] for j in n if component[j] == component[k] and docs[j][0] is not None]
        rows.append((docs[k][0], f"{fps[k]:016x}", min(ids, default=None)))
    return sorted(rows, key=str)


@pytest.mark.parametrize(
    "text", [None, "", " \t\n", "One", "one TWO three", "a b c d", "a b c d e f g", "é Ü x y z\x0bq w " * 50]
)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_spark_hashes_the_same(spark):
    [row] = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).collect()
    assert row.h % 2**64 == simhash._hash(b"a b c d")


def random_docs(seed):
    rng = random.Random(seed)
    docs = []
    for base in range(12):
        w = [f"w{rng.randint(0, 60)}" for _ in range(rng.choice([1, 3, 4, 30, 150]))]
        for copy in range(rng.randint(1, 6)):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 2])):
                v[rng.randrange(len(v))] = f"x{rng.randint(0, 9)}"
            docs.append((base * 10 + copy, " ".join(v)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    docs = random_docs(seed) + [(None, docs_text) for _, docs_text in random_docs(seed)[:3]]
    docs += [(500, None), (501, ""), (502, "  "), (500, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in simhash.near_duplicates(frame).collect()), key=str) == expected(docs)


@pytest.mark.parametrize("flips", range(6))
def test_every_link_is_found(spark, flips):
    rng = random.Random(flips)
    pairs = []
    for _ in range(150):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), flips):
            b ^= 1 << bit
        pairs.append((a, b))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    fps = spark.createDataFrame([(signed(x),) for p in pairs for x in p], "fp long").distinct()
    root = {r.fp: r.root for r in simhash.classes(fps).collect()}
    assert all((root[signed(a)] == root[signed(b)]) == (flips <= 4) for a, b in pairs)


def test_keep_one(spark):
    docs = [(3, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (1, "a b c d e"), (None, "q"), (7, "z z")]
    frame = spark.createDataFrame([(*d, "r", 1) for d in docs], "doc_id long, text string, fp string, row int")
    left = simhash.keep_one(frame)
    assert left.schema == frame.schema
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == [(1, "a b c d e"), (7, "z z"), (None, "q")]


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(frame).count() == 0
    assert simhash.keep_one(frame).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(20)]
    edges += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(45)] + [(5, 5), (None, 3), (300, None)]
    rng.shuffle(edges)
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    want = roots({n for e in real for n in e}, real)
    frame = spark.createDataFrame(edges, "a long, b long")
    got = graph.components(frame, "a", "b").collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
