"""Token files: best fit against a plain search, exact round trips."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelog.llm import tokens


def plain_best_fit(sizes, length):
    pieces = [(d, a, min(length, n - a)) for d, n in enumerate(sizes) for a in range(0, n, length)]
    rooms = []
    for _, _, size in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        fitting = [r for r in rooms if r >= size]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - size)
        else:
            rooms.append(length - size)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    length = rng.choice([1, 7, 8, 100, 2048])
    sizes = [rng.randint(1, 3 * length) for _ in range(rng.randint(0, 200))]
    sequences = tokens.best_fit(sizes, length)
    assert sorted(length - sum(p[2] for p in s) for s in sequences) == plain_best_fit(sizes, length)
    covered = defaultdict(list)
    for doc, start, size in (p for s in sequences for p in s):
        covered[doc] += range(start, start + size)
    assert all(sorted(covered[d]) == list(range(n)) for d, n in enumerate(sizes))


def test_file_arrays():
    docs = [np.arange(5, dtype=np.uint32), np.arange(100, 112, dtype=np.uint32), np.array([70_000], np.uint32)]
    a = tokens.decode_file(tokens.encode_file(docs, [1, None, 3], 8, 0))
    assert a["ids"].dtype == np.uint32 and a["ids"].shape[1] == 8
    back = defaultdict(dict)
    for k, (row, at, size) in enumerate(a["segments"]):
        back[a["doc_ids"][k] if a["doc_known"][k] else None][int(a["doc_starts"][k])] = a["ids"][row, at : at + size].tolist()
    assert back == {1: {0: [0, 1, 2, 3, 4]}, None: {0: list(range(100, 108)), 8: list(range(108, 112))}, 3: {0: [70_000]}}
    assert a["cu_seqlens"][-1] == 18 and (np.diff(a["position_resets"]) > 0).all()


DOCS = [(k, f"text {k} " * (k % 7)) for k in range(50)] + [(None, None), (None, ""), (3, "x y " * 6000), (9, "same"), (9, "same")]


@pytest.mark.parametrize("group", [100, 1 << 22])
def test_round_trip(spark, monkeypatch, group):
    monkeypatch.setattr(tokens, "GROUP_TOKENS", group)
    frame = spark.createDataFrame([(*d, "n") for d in DOCS], "doc_id long, text string, ids string").repartition(3)
    rows = tokens.report(frame, length=64).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for ident, text in DOCS:
        ids = [*t.encode(text or "").ids, tokens.END]
        for a in range(0, len(ids), 64):
            part = np.array(ids[a : a + 64], "<u4")
            want[ident, a, len(part), len(ids), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 64


def test_empty(spark):
    assert tokens.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
