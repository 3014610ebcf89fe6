"""The shuffle: bijection, laws of the shards, edges."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.llm import shuffle


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 7, 16, 17, 100, 1009])
def test_permutation_is_a_bijection(spark, rows):
    places = [r.place for r in shuffle.permuted(spark.range(rows), "id", rows, seed=3).collect()]
    assert sorted(places) == list(range(rows))
    assert rows < 100 or places != sorted(places)


def plain(number, rows, seed):
    a, b = shuffle.bases(rows)
    p, small, factor = shuffle._PRIME, shuffle._SMALL, shuffle._FACTOR

    def mix(x, key):
        v = (x + key) % p * factor % p
        return v * (v % small + key % small + 1) % p

    while True:
        left, right = divmod(number, b)
        for k in range(shuffle.ROUNDS):
            key = (seed * 1_000_003 + k * 7_368_787 + 12_345) % p
            if k % 2 == 0:
                left = (left + mix(right, key)) % a
            else:
                right = (right + mix(left, key)) % b
        number = left * b + right
        if number < rows:
            return number


def test_permutation_is_that_of_plain_python(spark):
    for rows in (50, 10**6 + 3, 7 * 10**11):
        numbers = spark.range(0, rows, max(1, rows // 50))
        for r in shuffle.permuted(numbers, "id", rows, seed=5).collect():
            assert r.place == plain(r.id, rows, 5)


DOCS = [(k, f"text {k}") for k in range(200)] + [(None, None), (None, ""), (7, "é" * 5), (None, None)] + [(9, "same")] * 60


def check(rows, count):
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) <= set(range(count)) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(count)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


@pytest.mark.parametrize("cell_rows", [7, 100_000])
def test_shards(spark, monkeypatch, cell_rows):
    frame = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, number int")
    monkeypatch.setattr(shuffle.numbered, "__defaults__", (cell_rows,))
    out = shuffle.shards(frame)
    rows = out.collect()
    check(rows, 24)
    want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in DOCS]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(want)
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    again = shuffle.shards(frame.repartition(5, F.rand(3))).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame(DOCS, "doc_id long, text string")
    check(shuffle.shards(frame.limit(5)).collect(), 24)
    assert shuffle.shards(frame.limit(0)).count() == 0
