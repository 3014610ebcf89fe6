"""Byte-level BPE: against a plain merge loop, the tokenizer library, and round trips."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import bpe


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def wanted(library, text):
    return np.array(library.encode_ordinary(text or ""), "<u4").tobytes()


def plain_merge(piece, ranks):
    if piece in ranks:
        return [ranks[piece]]
    parts = [bytes([b]) for b in piece]
    while True:
        best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_merges_of_any_vocabulary(seed):
    """Vocabularies with ties of place, and entries that no merge reaches."""
    rng = random.Random(seed)
    tokens = {bytes([b]) for b in range(97, 101)}
    while len(tokens) < 40:
        tokens.add(b"".join(rng.choices(sorted(tokens), k=2)))
    tokens = sorted(tokens)
    rng.shuffle(tokens)
    ranks = {t: k for k, t in enumerate(tokens)}
    for n in [1, 2, 3, 7, 8, 9, 64, 300]:
        piece = bytes(rng.choices(range(97, 101), k=n))
        assert bpe.merge(piece, ranks) == plain_merge(piece, ranks)


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_any_text(library, text):
    coder = bpe.coder()
    ids = coder.encode(text)
    assert ids == wanted(library, text) and coder.decode(ids) == text.encode()


def test_every_character_is_classed_as_in_the_library(library):
    coder = bpe.coder()
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000, 7))]
    newer = bpe._newer()
    for c in every + list(newer[::50]):
        text = f"x{c}7{c} {c}!{c}{c}"
        assert coder.encode(text) == wanted(library, text), hex(ord(c))


@pytest.mark.parametrize(
    "text",
    ["a" * 30_000, " \n\t" * 5000 + "x", "x" + " " * 4000, "<|endoftext|> it's we'LL", "\x00\x1c\x85  ", "é" * 3000, "ab" * 600_000],
)
def test_long_and_odd_texts(library, text):
    ids = bpe.coder().encode(text)
    assert ids == wanted(library, text) and bpe.coder().decode(ids) == text.encode()


def test_remembered_matches_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    coder = bpe.Coder(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    text = " ".join(f"word{k}" for k in range(300)) + " " + "z" * 100
    assert coder.encode(text) == wanted(library, text) and len(coder.ids) <= 10


DOCS = [(k, f"Text {k}, it's  é{chr(0x4E00 + k)} " * (k % 5)) for k in range(40)]
DOCS += [(None, None), (None, ""), (7, "same"), (7, "same"), (8, "long  word " * 20_000)]


def test_report(spark, library):
    frame = spark.createDataFrame([(*d, "x", "y") for d in DOCS], "doc_id long, text string, ids string, decoded string")
    rows = bpe.report(frame.repartition(3)).collect()
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    want = Counter()
    for ident, text in DOCS:
        ids = wanted(library, text)
        want[ident, len(ids) // 4, digest(ids), digest((text or "").encode())] += 1
    assert Counter(map(tuple, rows)) == want


def test_columns_stay_and_ids_are_decoded(spark):
    frame = spark.createDataFrame([("a", "b c", 1, 2), ("k", None, 3, 4)], "doc_id string, text string, row int, decoded int")
    coded = bpe.encode(frame)
    assert sorted(r.row.asDict().items() for r in coded.collect()) == sorted(r.asDict().items() for r in frame.collect())
    back = bpe.decode(coded.selectExpr("row.doc_id", "if(row.doc_id = 'k', null, ids) as ids", "1 as decoded")).collect()
    assert {r.doc_id: r.decoded for r in back} == {"a": b"b c", "k": None}


def test_empty(spark):
    assert bpe.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
