"""Repeated passages against a table of all strings of 100 bytes."""

import hashlib
import random

import numpy as np
import pytest

from tidelog.llm import repeats

N = repeats.LENGTH


def expected(docs):
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, k))
    seen, rows = set(), []
    for k in order:
        text = (docs[k][1] or "").encode()
        gone = np.zeros(len(text) + 1, bool)
        for p in range(len(text) - N + 1):
            if text[p : p + N] in seen:
                gone[p : p + N] = True
            seen.add(text[p : p + N])
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if text else 0
        rows.append((docs[k][0], len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=str)


def compare(spark, docs, slices=1):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in repeats.report(frame.repartition(slices) if slices > 1 else frame.coalesce(1)).collect()]
    assert sorted(got, key=str) == expected(docs)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def random_docs(seed):
    rng = random.Random(seed)
    passages = [prose(rng, rng.choice([10, 25, 60, 200])) for _ in range(6)]
    docs = []
    for k in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts.append(rng.choice([p, p[a:], p[:a], p[a : a + 101], prose(rng, 20), "ab" * rng.randint(1, 150)]))
        docs.append((k, rng.choice(["", " ", "\n"]).join(parts)))
    docs += [(100 + k, rng.choice(docs)[1]) for k in range(10)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot", [3, 512])
def test_random(spark, monkeypatch, seed, hot):
    # Rows of equal ids are ordered by the input, so ids differ where rows are dealt out.
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 2000)
    compare(spark, random_docs(seed), slices=3)


def test_edges(spark):
    line = prose(random.Random(1), 40)
    docs = [(None, line), (1, None), (2, ""), (3, line), (3, line), (4, "x" * 99), (5, "x" * 99), (6, "y" * 100)]
    docs += [(7, "y" * 100), (8, "z" * 1500), (9, "q" + line[1:]), (10, "é" * 400), (None, line[:99])]
    compare(spark, docs)


def test_text_longer_than_a_step(spark):
    rng = random.Random(2)
    body = prose(rng, 60_000)
    assert len(body) > repeats._STEP
    compare(spark, [(1, body + prose(rng, 50) + body[250_000:]), (2, body[200_000:270_000]), (3, prose(rng, 8000))])


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.report(frame).count() == 0
    assert repeats.strip(frame).count() == 0


def test_strip_keeps_columns_and_characters(spark):
    body = "é" * 10 + prose(random.Random(3), 60)
    docs = [(1, body, "a", 1), (2, None, "b", 2), (3, "ø" + body[1:], "c", 3), (4, body, None, 4)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, block string, gone int")
    out = repeats.strip(frame)
    assert out.schema == frame.schema
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == body and rows[2].text is None and rows[4].text == ""
    assert rows[3].text == "ø" and rows[3].block == "c" and rows[3].gone == 3


def test_maximal_repeats_are_those_of_all_substrings():
    rng = random.Random(4)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 5))]
        least = rng.randint(1, 4)
        where = {}
        for t, text in enumerate(texts):
            for a in range(len(text)):
                for b in range(a + least, len(text) + 1):
                    where.setdefault(text[a:b], []).append((t, a))
        want = set()
        for word, places in where.items():
            left = [texts[t][a - 1] if a else (t, a) for t, a in places]
            right = [texts[t][a + len(word)] if a + len(word) < len(texts[t]) else (t, a) for t, a in places]
            if len(places) > 1 and len(set(map(str, left))) > 1 and len(set(map(str, right))) > 1:
                want.add((len(word), tuple(sorted(places))))
        got = {(n, tuple(sorted(zip(o.tolist(), p.tolist())))) for n, o, p in repeats.maximal_repeats(texts, least)}
        assert got == want
