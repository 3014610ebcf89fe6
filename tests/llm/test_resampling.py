"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tidelog.llm import resampling


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_features(text, length, buckets):
    w = plain_words(text)
    runs = [" ".join(w[k : k + n]) for n in range(1, length + 1) for k in range(len(w) - n + 1)]
    return [crc32(r.encode()) % buckets for r in runs]


def plain(docs, target, length=1, buckets=10_000, seed=2024, least=20, percent=10):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_features(text, length, buckets))
    for text in target:
        t.update(plain_features(text, length, buckets))
    every_s, every_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (every_s + buckets) / ((s[k] + 1) * (every_t + buckets))))
    rows = []
    for ident, text in docs:
        found = plain_features(text, length, buckets)
        weight = sum(map(gain, found))
        name = "null" if ident is None else ident
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([ident, len(found), weight, score, None, len(plain_words(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, row in enumerate(able[: percent * len(able) // 100], start=1):
        row[4] = k
    return Counter(tuple(r[:5]) for r in rows)


def some_docs(seed):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice(['Wort', 'mot', 'é', 'x'])}{k}" for k in range(60)]
    text = lambda: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.choice([0, 1, 19, 20, 21, 80])))
    docs = [(k, text()) for k in range(150)]
    docs += [(None, None), (None, text()), (5, docs[5][1]), (5, docs[5][1]), (200, ""), (201, "._!"), (202, "Long word " * 30_000)]
    return docs, [text() for _ in range(10)] + [None, ""]


@pytest.mark.parametrize("seed, length", [(1, 1), (2, 2), (3, 3)])
def test_against_a_plain_version(spark, seed, length):
    docs, target = some_docs(seed)
    frame = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, row string, score int").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    options = {"length": length, "buckets": 97, "seed": 7, "least_words": 19, "percent": 33}
    got = Counter(map(tuple, resampling.report(frame, bench, **options).collect()))
    assert got == plain(docs, target, length, 97, 7, 19, 33)


def test_default_parameters(spark):
    docs, target = some_docs(9)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert Counter(map(tuple, resampling.report(frame, bench).collect())) == plain(docs, target)


@pytest.mark.parametrize("held", [1, 2, 5, 1000])
@pytest.mark.parametrize("length", [1, 2, 4])
def test_runs_do_not_cross_texts(monkeypatch, held, length):
    monkeypatch.setattr(resampling, "HELD_WORDS", held)
    rng = random.Random(held)
    texts = [" ".join(rng.choices(["a", "B", "c9", "é"], k=rng.choice([0, 1, 2, 9]))) for _ in range(20)] + [None, "x" * 50]
    got = [[] for _ in texts]
    base = 0
    for group in resampling.groups(texts, size=40):
        for _, owner, bucket in resampling.features(group, length, 1000):
            for o, b in zip(owner.tolist(), bucket.tolist()):
                got[base + o].append(b)
        base += len(group)
    assert base == len(texts)
    assert [sorted(g) for g in got] == [sorted(plain_features(t, length, 1000)) for t in texts]


def test_ranks_over_ranges(spark):
    rows = [(k % 7, k, 50 - k % 11) for k in range(300)] + [(None, 0, 45), (None, 1, 45)]
    frame = spark.createDataFrame(rows, "doc_id long, n_features long, score long").selectExpr(
        "struct(doc_id) as row", "20L as n_words", "n_features", "score as weight", "score"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = resampling.ranked(frame, doc_id="doc_id", least_words=20, percent=100).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(rows, key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1]))
    assert [(r.row.doc_id, r.n_features, r.score) for r in sorted(got, key=lambda r: r.rank)] == want
    assert sorted(r.rank for r in got) == list(range(1, 303))


def test_gains_of_empty_buckets():
    assert resampling.gains(np.zeros(4, np.int64), np.zeros(4, np.int64)).tolist() == [0] * 4


def test_drawn_documents_are_as_they_were(spark):
    docs, target = some_docs(4)
    frame = spark.createDataFrame([(*d, 1, "r") for d in docs], "doc_id long, text string, rank int, weight string")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    left = resampling.drawn(frame, bench, percent=50)
    rows = resampling.report(frame, bench, percent=50).filter("rank is not null")
    assert left.schema == frame.schema and sorted(r.doc_id or -1 for r in left.collect()) == sorted(r.doc_id or -1 for r in rows.collect())


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, "c " * 30)], "doc_id long, text string")
    assert resampling.report(none, some).count() == 0
    got = resampling.report(some, none, percent=50)
    assert Counter(map(tuple, got.collect())) == plain([(1, "a b " * 20), (2, "c " * 30)], [], percent=50)
