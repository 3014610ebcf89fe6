"""Decontamination against a search that looks at every position."""

import hashlib
import random
import re

import pytest

from tidelog.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(docs, items, size=10):
    table = {}
    for ident, text in items:
        w = WORD.findall(lowered(text))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            table.setdefault(tuple(w[k : k + size]), set()).add(str(ident))
    rows = []
    for ident, text in docs:
        w, hit, found = WORD.findall(lowered(text)), set(), set()
        for window, ids in table.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        rows.append((ident, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(rows, key=str)


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def compare(spark, docs, items, **options):
    got = [tuple(r) for r in decontaminate.report(*frames(spark, docs, items), **options).collect()]
    assert sorted(got, key=str) == expected(docs, items)


def random_case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "straße", "x1", "É", "the", "of"][: rng.randint(2, 7)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, line(rng.choice([0, 1, 4, 9, 10, 11, 25]))) for k in range(12)]
    docs = [(k, line(rng.randint(0, 80))) for k in range(40)]
    docs += [(100 + k, f"{line(3)}, {items[k][1].upper()}! {line(3)}") for k in range(12)]
    return docs, items


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    compare(spark, *random_case(seed))


def test_blocks_of_windows_give_the_same(spark):
    compare(spark, *random_case(9), block_windows=7)


def test_edges(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [
        (1, None),
        (2, ""),
        (3, "...!?"),
        (4, f"X {passage.upper()}."),
        (4, f"X {passage.upper()}."),
        (None, passage),
        (5, (passage + " ") * 3000),
        (6, "one two three four five six seven eight nine"),
    ]
    items = [(10, passage), (2, passage), (3, None), (4, ""), (10, passage), (7, "only-seven")]
    compare(spark, docs, items)


def test_empty_tables(spark):
    docs, items = frames(spark, [], [(1, "a b")])
    assert decontaminate.report(docs, items).count() == 0
    docs, items = frames(spark, [(1, "a b")], [])
    assert [r.contaminated for r in decontaminate.report(docs, items).collect()] == [False]


def test_clean_keeps_columns_also_with_clashing_names(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", 5, "r"), (2, "z", 6, None)], "doc_id long, text string, spans int, row string"
    )
    items = spark.createDataFrame([(1, "b")], "item_id long, text string")
    left = decontaminate.clean(docs, items)
    assert left.schema == docs.schema
    assert [tuple(r) for r in left.collect()] == [(2, "z", 6, None)]
