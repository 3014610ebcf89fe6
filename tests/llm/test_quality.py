"""The quality classifier: random indexing against plain counting, held-out accuracy, edges."""

import zlib

import numpy as np
import pytest

from tidelog.llm import quality
from tidelog.llm.common import read


def test_context_vectors_are_sums_of_neighbours(spark):
    texts = ["the cat saw the the dog!", "A cat", "one", "", None, "dog dog DOG 17"]
    index = quality.index_vectors()
    total = np.zeros((quality.UNITS, quality.DIMENSIONS))
    dense = np.zeros_like(total)
    for k in range(quality.NONZERO):
        np.add.at(dense, (np.arange(quality.UNITS), index[0][:, k]), index[1][:, k])
    for text in texts:
        own, form, _ = quality.streams([(text or "").encode()])
        for a in range(len(own)):
            for b in (a - 1, a + 1):
                if 0 <= b < len(own):
                    for unit in (own[a], form[a]):
                        total[unit] += dense[own[b]] + dense[form[b]]
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert np.allclose(quality.context_vectors(frame), total / np.maximum(norm, 1e-9), atol=1e-5)


def test_forms_tell_case_signs_and_repeats():
    own, form, bounds = quality.streams([b"Word word WORD word! word!", b"", b" word", b"word \xc3\xa9t\xc3\xa9 $$$ 12 $$$"])
    assert len(set(own[:7])) == 1 and len(set(form[:5])) == 4
    assert form[5] == form[6] and form[6] not in form[1:5]
    assert own[8] == own[10] != own[6] and bounds.tolist() == [0, 5, 5, 6, 11]
    assert [len(x) for x in quality.streams([b"", b" "])] == [0, 0, 3]


def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.01"
    rows = quality.report(read(spark, root, "documents"), read(spark, root, "labels"))
    labels = {r.doc_id: r.quality for r in read(spark, root, "labels").collect()}
    held = [r for r in rows.collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    right = np.mean([r.predicted == labels[r.doc_id] for r in held])
    assert len(held) > 50 and right > 0.93


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 8))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    scores = quality.fit(x[:3000], y[:3000]).scores(x[3000:])
    for low, high in ((0.0, 0.3), (0.3, 0.7), (0.7, 1.0)):
        part = (scores >= low) & (scores <= high)
        assert abs(scores[part].mean() - y[3000:][part].mean()) < 0.12


DOCS = [(1, None, 9.0), (2, "", 9.0), (None, "some words", 9.0), (4, "x " * 50_000, 9.0), (4, "x " * 50_000, 9.0)]


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (None, 0), (2, 7), (4, 0), (4, 1)]])
def test_edges(spark, labels):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality.report(docs, known).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert not next(r for r in rows if r.doc_id is None).held_out


def test_empty_and_clashing_names(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, score double")
    known = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.accepted(docs, known).schema == docs.schema
    assert quality.accepted(docs, known).count() == 5
    assert quality.report(docs.limit(0), known).count() == 0
