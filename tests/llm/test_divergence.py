"""Divergence of sources against a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidelog.llm import divergence


def plain_terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, least=10, top=10):
    docs = [(text, lang or "", source or "") for text, lang, source in docs]
    df, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        terms = plain_terms(text)
        df[lang].update(set(terms))
        count[lang, source].update(terms)
        sources[lang].add(source)
    rows = []
    for lang, every in sources.items():
        kept = {t for t, n in df[lang].items() if n >= least}
        whole = Counter()
        for source in every:
            whole.update(count[lang, source])

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = shares(whole)
        p = {source: shares(count[lang, source]) for source in every}
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for source in every:
            pairs = [("pair", o, sum(apart(p[source][t], p[o][t]) for t in kept)) for o in every if o != source]
            terms = [("term", t, apart(p[source][t], q[t])) for t in kept if count[lang, source][t] and p[source][t] > q[t]]
            for part, limit in ((pairs, None), (terms, top)):
                part.sort(key=lambda r: (-r[2], r[1].encode()))
                rows += [(lang, source, *r, k) for k, r in enumerate(part[:limit], start=1)]
    return Counter(rows)


def some_docs(seed, n=250):
    rng = random.Random(seed)
    vocabulary = [w + chr(97 + k % 26) * (k % 12) for k, w in enumerate(["Haus", "été", "x", "internationalisation", "中文"] * 9)]
    docs = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=rng.choice([0, 1, 5, 40]))
        lang = rng.choice(["en", "en", "fr", None, ""])
        docs.append((rng.choice([" ", "9", "-"]).join(words), lang, rng.choice(["s1", "s1", "s1", "S2", "é", None, "s10"])))
    docs += [("rare words only", "de", "a"), ("other rare", "de", "b"), (None, "de", "c"), (None, "it", "alone"), ("many words " * 30_000, "en", "s1")]
    return docs + docs[:3]


def frame_of(spark, docs):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "text string, lang string, source string, term string, n int")


@pytest.mark.parametrize("seed, block, least", [(1, 64, 10), (2, 2, 10), (3, 1, 3)])
def test_against_a_plain_version(spark, seed, block, least):
    docs = some_docs(seed)
    got = divergence.report(frame_of(spark, docs).repartition(4), block=block, least_documents=least, top_terms=7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == plain(docs, least, 7)


@pytest.mark.parametrize("leaf", [0, 1, 3, 50, 10_000])
def test_sorted_pointers(leaf):
    rng = random.Random(leaf)
    terms = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefgi", "é" * 40, "é" * 40 + "a", "z" * 16, "z" * 17]
    text = " ".join(rng.choices(terms, k=2000)).encode()
    raw = text.translate(divergence._TABLE)
    data = np.frombuffer(raw + bytes(8), np.uint8)
    starts, ends = divergence.pointers(data[: len(raw)], np.array([0]))
    order, heads = divergence.multikey_sort(data, starts, ends, leaf)
    assert sorted(order.tolist()) == list(range(2000))
    words = [raw[starts[k] : ends[k]] for k in order]
    runs = [w for w, head in zip(words, heads) if head]
    assert len(runs) == len(set(runs)) == len(set(words))
    assert [w for w, head in zip(words, heads) if not head] == [a for a, b, head in zip(words, words[1:], heads[1:]) if not head]
    run = np.cumsum(heads)
    assert all(a < b for a, b, r, s in zip(order, order[1:], run, run[1:]) if r == s)


def test_terms_end_with_their_text():
    data = b"abABcd"
    terms, term, group, n, docs = divergence.shard_counts(data, np.array([0, 2, 4]), np.array([0, 1, 1]))
    rows = {(terms[t], g, c, d) for t, g, c, d in zip(term.tolist(), group.tolist(), n.tolist(), docs.tolist())}
    assert rows == {(b"ab", 0, 1, 1), (b"ab", 1, 1, 1), (b"cd", 1, 1, 1)}


@pytest.mark.parametrize("size", [1, 200, 1 << 20])
def test_shards_add_up(spark, size):
    docs = some_docs(5)
    shards = [docs] if size > 1 << 16 else [docs[k : k + max(1, size // 20)] for k in range(0, len(docs), max(1, size // 20))]
    got = Counter()
    for shard in shards:
        raw = [(t or "").encode() for t, _, _ in shard]
        real = [k for k, r in enumerate(raw) if r]
        offsets = np.cumsum([0] + [len(r) for r in raw])[:-1]
        terms, term, _, n, _ = divergence.shard_counts(b"".join(raw), offsets[real], np.zeros(len(real), np.int64))
        for t, c in zip(term.tolist(), n.tolist()):
            got[terms[t].decode()] += c
    want = Counter(t for text, _, _ in docs for t in plain_terms(text))
    assert got == want


def test_counts_of_documents(spark):
    docs = some_docs(6)
    want_n, want_docs = Counter(), Counter()
    for text, lang, source in docs:
        terms = plain_terms(text)
        want_n.update((lang or "", source or "", t) for t in terms)
        want_docs.update((lang or "", source or "", t) for t in set(terms))
    got = divergence.term_counts(frame_of(spark, docs).repartition(3)).collect()
    assert {(r.lang, r.source, r.term): (r.n, r.docs) for r in got} == {k: (n, want_docs[k]) for k, n in want_n.items()}


def test_shares_do_not_overflow(spark):
    frame = spark.createDataFrame([(10**14, 4 * 10**14, 3)], "n long, total long, terms long")
    assert frame.select(divergence._share("n", "total").alias("p")).first().p == 1 + 10**9 * (10**14 + 2) // (4 * 10**14 + 6)


def test_empty(spark):
    assert divergence.report(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
    blank = spark.createDataFrame([("", None, "a"), (None, None, "b")], "text string, lang string, source string")
    assert Counter(map(tuple, divergence.report(blank).collect())) == plain([("", None, "a"), (None, None, "b")])
