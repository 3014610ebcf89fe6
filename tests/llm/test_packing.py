"""Packing: every id in one piece, full sequences, neighbours as BM25 ranks them."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import packing
from tidelog.llm.common import read
from tidelog.llm.vocabulary import encoder


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = ["", None, "a", " two  blanks \n\n\tand more ", "日本語 のテキスト, ok", "<|endoftext|> x", "it's we'll 12 345!!!", "é" * 50]


def test_encoder(plain):
    for text in [*TEXTS, "word " * 5000, "x" * 20_000, "".join(map(chr, range(1, 0x400)))]:
        assert encoder(ordinary=False).encode(text, 1).tolist() == plain(text)
    assert encoder(ordinary=False).encode("<|endoftext|> x", 1).tolist() == [50256, 2124, 1]


def test_special_tokens_can_be_ordinary_text():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in TEXTS:
        assert encoder().encode(text, 1).tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, docs, plain, length=packing.LENGTH):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id, r.doc_tokens].append(r)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == length or (at < length and at & (at - 1) == 0)
    got, want = defaultdict(int), defaultdict(int)
    for ident, text in docs:
        want[ident, tuple(plain(text))] += 1
    for (ident, tokens), rs in pieces.items():
        for copy in whole(rs, tokens):
            got[ident, copy] += 1
    assert got == want


def whole(rs, tokens):
    """The documents that pieces with the same name add up to."""
    starts = defaultdict(list)
    for r in rs:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        starts[r.start].append(r)
    while starts[0]:
        at, ids = 0, []
        while at < tokens:
            r = starts[at].pop(0)
            ids += r.ids
            at += r.length
        yield tuple(ids)
    assert not any(starts.values())


def test_documents_are_whole(spark, plain):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 900)))) for k in range(60)]
    docs += [(100 + k, t) for k, t in enumerate(TEXTS)] + [(None, "none"), (None, "none"), (7, "lo ng " * 9000)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int").repartition(3)
    check(packing.pack(frame).collect(), docs, plain)


def test_shards_and_short_sequences(spark, plain):
    docs = [(r.doc_id, r.text) for r in read(spark, "/root/testdata/sf0.001", "documents").limit(40).collect()]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check(packing.pack(frame, length=100, shard_tokens=3000).collect(), docs, plain, length=100)
    assert packing.report(frame).columns[-1] == "offset"


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_ranks_as_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 40, rng.integers(1, 25)).astype(np.uint32) for _ in range(30)]
    index = packing.Index(docs)
    mean = sum(map(len, docs)) / len(docs)

    def weight(term, doc):
        tf = int((docs[doc] == term).sum())
        df = sum(term in d for d in docs)
        idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[doc]) / mean))

    free = np.ones(30, bool)
    free[[0, 4]] = False
    scores = {d: sum(weight(t, d) for t in set(docs[0].tolist())) for d in range(30) if free[d]}
    want = sorted((d for d in scores if scores[d] > 0), key=lambda d: (-round(scores[d], 9), d))
    assert index.neighbours(0, free) == want


def test_all_terms_of_a_seed_look_up():
    """The last document shares only the lightest of the seed's 61 terms."""
    seed = np.arange(61, dtype=np.uint32)
    others = [np.append(seed[:60], np.uint32(100 + k)) for k in range(3)]
    last = [np.array([60, 200 + k], np.uint32) for k in range(9)]
    index = packing.Index([seed, *others, *last])
    assert sorted(index.neighbours(0, np.arange(13) > 0)) == list(range(1, 13))


def test_neighbours_share_a_sequence():
    a, b = np.arange(100, 160, dtype=np.uint32), np.arange(500, 560, dtype=np.uint32)
    docs = [a, b, a[::-1], b[::-1], a, b]
    sequences = packing.fill([60] * 6, packing.Index(docs), 180)
    assert [sorted({d % 2 for d, _, _ in s}) for s in sequences] == [[0], [1]]


def corpus_of(spark, rows=200):
    return [(r.doc_id, r.text) for r in read(spark, "/root/testdata/sf0.001", "documents").limit(rows).collect()]


def test_pieces_do_not_depend_on_partitions(spark):
    docs = [*corpus_of(spark, 80), (7, None), (7, None), (None, "x y"), (8, "x y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = [
        sorted(map(repr, packing.pack(f, length=256, shard_tokens=20_000).collect()))
        for f in (frame.coalesce(1), frame.repartition(5), frame.orderBy(F.rand(3)).repartition(23))
    ]
    assert got[0] == got[1] == got[2]


def test_clashing_columns_and_any_id(spark):
    frame = spark.createDataFrame([("a", "one two", 1, 2, 3), (None, "", 1, 2, 3)], "doc_id string, text string, uid int, shard int, n int")
    rows = packing.report(frame).collect()
    assert sorted((r.doc_id or "", r.start, r.doc_tokens) for r in rows if not r.start)[0] == ("", 0, 1)
    assert {r.doc_id for r in rows} == {"a", None}


def plain_fill(docs, corpus, length):
    """The greedy fill, said plainly: sequences as lists of (document, start, size)."""
    bags = [Counter(d.tolist()) for d in docs]

    def weight(term, doc):
        tf, df = bags[doc][term], int(corpus.frequency[term])
        idf = math.log(1 + (corpus.count - df + 0.5) / (df + 0.5))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[doc]) / corpus.mean))

    used, out, now = set(), [], []

    def room():
        return length - sum(p[2] for p in now)

    def put(doc):
        used.add(doc)
        start = 0
        while start < len(docs[doc]):
            size = min(room(), len(docs[doc]) - start)
            now.append((doc, start, size))
            start += size
            if not room():
                out.append(list(now))
                now.clear()

    def near(seed):
        score = {d: sum(weight(t, d) for t in bags[seed] if t in bags[d]) for d in range(len(docs)) if d not in used}
        return sorted((d for d in score if score[d] > 0), key=lambda d: (-round(score[d], 9), d))

    while len(used) < len(docs):
        seed = min(set(range(len(docs))) - used)
        put(seed)
        while seed is not None and now:
            following = None
            for d in near(seed):
                if len(docs[d]) <= room():
                    put(d)
                    if not now:
                        break
                elif following is None:
                    following = d
            if now and following is not None:
                put(following)
            else:
                following = None
            seed = following
    return out, now


def test_greedy_fill_as_said_plainly():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        docs = [rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint16) for _ in range(50)]
        corpus = packing.Corpus.of([*docs, *[rng.integers(0, 60, 9).astype(np.uint16) for _ in range(70)]])
        full, rest = plain_fill(docs, corpus, 64)
        got = packing.fill([len(d) for d in docs], packing.Index(docs, corpus), 64)
        assert got == full + (packing._powers(rest) if rest else [])


def test_statistics_are_those_of_the_corpus(spark):
    docs = corpus_of(spark, 50)
    coded = packing.token_ids(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), "doc_id", "text", packing.VOCABULARY)
    got = packing.statistics(coded)
    want = packing.Corpus.of([encoder(ordinary=False).encode(t, 1) for _, t in docs])
    assert (got.count, got.mean) == (want.count, want.mean)
    assert np.array_equal(got.frequency[: len(want.frequency)], want.frequency) and not got.frequency[len(want.frequency) :].any()


def test_near_documents_share_a_shard(spark):
    """Of the ten best neighbours by BM25 over all documents, far more are in the shard than by chance."""
    docs = [(r.doc_id, r.text) for r in read(spark, "/root/testdata/sf0.01", "documents").collect()]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    coded = packing.token_ids(frame, "doc_id", "text", packing.VOCABULARY)
    corpus, n = packing.statistics(coded), len(docs)
    tokens = int(coded.agg(F.sum("n")).first()[0])
    dealt = packing.shards(coded, corpus, -(-tokens // 8)).join(coded, "uid").select("shard", "ids").collect()
    shard = np.array([r.shard for r in dealt])
    index = packing.Index([np.frombuffer(r.ids, "<u2") for r in dealt], corpus)
    asked = range(0, n, 5)
    best = [index.neighbours(d, np.arange(n) != d)[:10] for d in asked]
    recall = np.mean([np.mean(shard[b] == shard[d]) for d, b in zip(asked, best) if b])
    chance = np.mean([np.mean(shard == shard[d]) for d in asked])
    print(f"recall {recall:.3f}, by chance {chance:.3f}")
    assert set(shard.tolist()) == set(range(8)) and recall > 1.7 * chance
