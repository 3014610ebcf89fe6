"""The pipeline against its stages done by brute force."""

from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import test_decontaminate as plain_benchmark
from tests.llm import test_simhash as plain_simhash
from tidelog.llm import quality
from tidelog.llm.common import read
from tidelog.llm.repeats import LENGTH
from tidelog.llm.vocabulary import encoder

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = read(spark, ROOT, "documents"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, ROOT).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def rows(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes


def test_quality(spark, stages):
    scored = quality.report(stages["documents"], read(spark, ROOT, "labels")).collect()
    assert set(rows(stages["quality"])) == {r.doc_id for r in scored if r.predicted}


def test_near_copies(stages):
    docs = list(rows(stages["quality"]).items())
    want = {r[0] for r in plain_simhash.expected(docs) if r[0] == r[2]}
    left = rows(stages["near_copies"])
    assert set(left) == want and all(left[k] == dict(docs)[k] for k in left)


def test_repeats(stages):
    docs = sorted(rows(stages["near_copies"]).items())
    seen, left = set(), rows(stages["repeats"])
    assert set(left) == {k for k, _ in docs}
    for ident, text in docs:
        data = text.encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - LENGTH + 1):
            if data[p : p + LENGTH] in seen:
                gone[p : p + LENGTH] = True
            seen.add(data[p : p + LENGTH])
        keep, at = [], 0
        for c in text:
            size = len(c.encode())
            if not gone[at : at + size].all():
                keep.append(c)
            at += size
        assert left[ident] == "".join(keep)


def test_benchmark(spark, stages):
    docs = list(rows(stages["repeats"]).items())
    items = [(r.item_id, r.text) for r in read(spark, ROOT, "benchmark").collect()]
    want = {r[0] for r in plain_benchmark.expected(docs, items) if not r[5]}
    assert set(rows(stages["benchmark"])) == want


def test_packing(stages):
    docs = rows(stages["benchmark"])
    pieces = defaultdict(list)
    for r in stages["packing"].collect():
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert set(pieces) == set(docs)
    for ident, parts in pieces.items():
        at = 0
        for start, length, tokens in sorted(parts):
            assert start == at and tokens == len(encoder().encode(docs[ident], 1))
            at += length
        assert at == tokens


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, ROOT).select("doc_id", "start", "length", "ids_crc32").collect()
    want = stages["packing"].select("doc_id", "start", "length", "ids_crc32").collect()
    total = lambda rs: sorted((r.doc_id, r.start + r.length) for r in rs)[-1]
    assert {r.doc_id for r in got} == {r.doc_id for r in want} and total(got) == total(want)
