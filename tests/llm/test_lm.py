"""The language model: slopes by differences, probabilities that add up, base scores, held-out gain."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import gru, lm
from tidelog.llm.common import read


def small_model(n=14, seed=0):
    rng = np.random.default_rng(seed)
    model = gru.start(rng.integers(1, 50, n))
    model.arrays = {k: (a + rng.normal(0, 0.3, a.shape)).astype(np.float64) for k, a in model.arrays.items()}
    return model


def docs_of(rng, n, end, sizes):
    return [np.append(rng.integers(0, end, s), end).astype(np.uint16) for s in sizes]


def test_slopes_are_differences():
    rng = np.random.default_rng(1)
    model = small_model()
    [window] = gru.windows(docs_of(rng, 14, 13, [5, 9, 3, 12, 1]), 13, lanes=3)
    state = rng.normal(size=(window.given.shape[1], gru.HIDDEN)) * 0.1

    def total():
        states, _ = gru.forward(model, window, state)
        use = window.wanted >= 0
        return gru._told(model, states.astype(np.float64)[use], window.wanted[use], None).sum()

    found, _, _ = gru.slopes(model, window, state)
    rows = found.pop("input_rows")
    whole = np.zeros_like(model.arrays["input"])
    whole[rows] = found["input"]
    found["input"] = whole
    for name, slope in found.items():
        flat = model.arrays[name].reshape(-1)
        for k in rng.choice(flat.size, min(12, flat.size), replace=False):
            old = flat[k]
            flat[k] = old + 1e-2
            up = total()
            flat[k] = old - 1e-2
            down = total()
            flat[k] = old
            assert math.isclose((up - down) / 2e-2, slope.reshape(-1)[k], rel_tol=2e-2, abs_tol=5e-3), name


def test_probabilities_add_up_and_state_is_carried():
    model = small_model(9, 3)
    end = 8
    past = np.array([3, 1, 4, 1, 5] * 20, np.uint16)  # longer than a window
    base = gru.score(model, [past], end)[0]
    following = [gru.score(model, [np.append(past, w).astype(np.uint16)], end)[0] - base for w in range(9)]
    assert math.isclose(sum(map(math.exp, following)), 1, rel_tol=1e-3)
    other = np.concatenate(([6], past[1:])).astype(np.uint16)
    far = [gru.score(model, [np.append(other, w).astype(np.uint16)], end)[0] for w in range(9)]
    assert far != following


def test_lanes_do_not_matter():
    rng = np.random.default_rng(5)
    model, docs = small_model(20, 2), docs_of(rng, 20, 19, rng.integers(0, 90, 30))
    together = gru.score(model, docs, 19)
    alone = [gru.score(model, [d], 19)[0] for d in docs]
    assert np.allclose(together, alone, rtol=1e-4)


def test_windows_do_not_grow_with_the_longest_document():
    rng = np.random.default_rng(7)
    docs = docs_of(rng, 20, 19, [20_000, *[30] * 600])
    tracemalloc.start()
    told = np.zeros(len(docs), np.int64)
    for window in gru.windows(docs, 19):
        told += np.bincount(window.owner[window.wanted >= 0], minlength=len(docs))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told.tolist() == [len(d) for d in docs] and peak < 8 << 20


def test_windows_use_the_same_memory_again():
    rng = np.random.default_rng(9)
    model, docs = gru.start(rng.integers(1, 50, 400)), docs_of(rng, 400, 399, rng.integers(40, 90, 600))
    first, second = list(gru.windows(docs, 399))[:2]
    state, room = np.zeros((first.given.shape[1], gru.HIDDEN), np.float32), gru.Room()
    _, state, _ = gru.slopes(model, first, state, room)
    state = state[: second.given.shape[1]].copy()
    alone = gru.slopes(model, second, state)
    tracemalloc.start()
    again = gru.slopes(model, second, state, room)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20, peak
    assert all(np.array_equal(again[0][k], alone[0][k]) for k in alone[0])
    assert np.array_equal(again[1], alone[1]) and again[2] == alone[2]


def test_windows_hold_each_lane_in_order():
    rng = np.random.default_rng(8)
    docs = docs_of(rng, 20, 19, rng.integers(0, 90, 40))
    seen = {d: [] for d in range(len(docs))}
    for window in gru.windows(docs, 19, lanes=7):
        for given, wanted, keep, owner in zip(window.given, window.wanted, window.keep, window.owner):
            for g, w, k, o in zip(given, wanted, keep, owner):
                if w >= 0:
                    assert (k == 0) == (not seen[o]) and g == (seen[o][-1] if seen[o] else 19)
                    seen[o].append(w)
                else:
                    assert (g, k, o) == (19, 1, 0)
    assert all(seen[d] == docs[d].tolist() for d in seen)


def test_classes_cover_all_words():
    for counts in ([5, 3, 2, 1, 1, 9, 4], [7, 7], [0, 0, 0], list(range(500, 0, -1))):
        bounds = gru.classes(np.array(counts))
        assert bounds[0] == 0 and bounds[-1] == len(counts) and (np.diff(bounds) > 0).all()


def base_scores(docs):
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    rows = []
    for i, t in docs:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        rows.append((i, held(i), len(w), sum(counts[x] > 0 for x in w), total, round(base, 6)))
    return sorted(rows, key=str)


def compare(rows, docs):
    assert sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in rows), key=str) == base_scores(docs)
    assert all(math.isfinite(r.score) and r.score <= 1e-6 for r in rows)


@pytest.mark.parametrize("common", [5, 1 << 16])
def test_base_scores(spark, monkeypatch, common):
    monkeypatch.setattr(lm, "COMMON_WORDS", common)
    monkeypatch.setattr(lm, "NETWORK_WORDS", 4)
    docs = [(k, f"The cat{k % 5} saw THE dog{k % 11}\n é {'rare' + str(k) if k % 3 else ''}") for k in range(60)]
    docs += [(100, None), (101, ""), (None, "the cat1"), (5, "twice"), (5, "twice"), (102, "x" * 5000 + " y" * 9000)]
    frame = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double")
    compare(lm.scores(frame.repartition(3)).collect(), docs)


def test_words_of_equal_counts_are_common_up_to_the_bound(spark, monkeypatch):
    monkeypatch.setattr(lm, "COMMON_WORDS", 5)
    counts = [(b"top", 90), *((b"w%d" % k, 40) for k in range(7, -1, -1)), (b"w9", 41), (b"", 30)]
    frame = spark.createDataFrame([(bytearray(w), n) for w, n in counts], "word binary, count long")
    vocab = lm.vocabulary(frame)
    assert list(vocab.logs) == [b"top", b"w9", b"w0", b"w1", b"w2", b""] and vocab.rare == 5
    vocab = lm.vocabulary(frame.filter("count = 40"))
    assert list(vocab.logs)[:5] == [b"w%d" % k for k in range(5)] and vocab.rare == 5


def test_nothing_to_learn_from(spark):
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 10 == 0][:3]
    docs = [(k, "a b") for k in held]
    compare(lm.scores(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_all_documents_are_trained_on(spark):
    """Each document has a word of its own, whose sum of squared slopes tells whether it was trained on."""
    docs = [(k, False, np.array([k] * 100 + [65], np.uint16).tobytes()) for k in range(64)] + [(64, True, np.array([0], np.uint16).tobytes())]
    vocab = lm.Vocabulary([*((b"%02d" % k, 100) for k in range(64)), (b"", 64)], 6464, 65)
    rows = spark.createDataFrame([(k, h, bytearray(b)) for k, h, b in docs], "uid long, held_out boolean, ids binary")
    squares = lm.fit(rows.repartition(3), vocab).squares["input"]
    assert (squares[:64].max(axis=1) > 0.01 + 1e-7).all()


def test_held_out_gain(spark):
    rows = [r for r in lm.scores(read(spark, "/root/testdata/sf0.01", "documents")).collect() if r.held_out]
    assert len(rows) > 50 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_partitions_do_not_matter(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    told = [{r.doc_id: r.score for r in lm.scores(docs.repartition(n)).collect()} for n in (1, 6, 32)]
    assert all(len(t) == 200 for t in told)
    for other in told[1:]:
        assert all(math.isclose(other[k], told[0][k], rel_tol=1e-6) for k in told[0])


def test_cells_are_trained_alone(spark, monkeypatch):
    """Several copies are made and averaged; all documents are in one of them."""
    monkeypatch.setattr(lm, "CELL_WORDS", 300)
    docs = [(k, False, np.array([k] * 100 + [65], np.uint16).tobytes()) for k in range(64)]
    vocab = lm.Vocabulary([*((b"%02d" % k, 100) for k in range(64)), (b"", 64)], 6464, 65)
    rows = spark.createDataFrame([(k, h, bytearray(b)) for k, h, b in docs], "uid long, held_out boolean, ids binary")
    found = [lm.fit(rows.repartition(n), vocab).flat() for n in (1, 5)]
    assert np.array_equal(*found)
