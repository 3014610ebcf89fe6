"""Packing of documents into full sequences, each with what is lexically near.

Documents are dealt to shards of bounded size by lexical nearness. A document's *key* is a
few of its terms, drawn by the weights that the terms have in it: each term has one random number for
the whole corpus, and the least numbers, divided by the fourth power of the weight, win. So documents that share
heavy terms tend to share their keys. The order of the keys, cut by a running count of
tokens, makes the shards; it follows from the documents alone, however the input is partitioned.

A shard has an inverted index with BM25 weights, whose document frequencies and mean
length are the corpus's. A document that no sequence holds yet is the seed; the seed's terms
look up unused neighbours, best first, and these fill the sequence while they fit. The best of
those that do not fit is cut, and what is left of it begins the next sequence and is its seed.
So every sequence is full but the last of a shard, which is cut into sequences of powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.vocabulary import VOCABULARY, encoder
from tidelog.operators.ordered import running
from tidelog.session import materialize, work_dir

LENGTH, END = 2048, 1
#: Tokens of a shard.
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75
#: A term is frequent in a shard if one in so many documents has it.
FREQUENT = 8
#: Terms of a key, and the seed of the terms' random numbers.
KEY_TERMS, SEED = 4, 11


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of their bytes, and how many each row has."""
    wide, size = (np.int64 if pa.types.is_large_binary(column.type) else np.int32), np.dtype(kind).itemsize
    if not len(column):
        return np.empty(0, kind), np.empty(0, np.int64)
    _, places, data = column.buffers()
    at = np.frombuffer(places, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    values = np.frombuffer(data, kind, (at[-1] - at[0]) // size, at[0]) if data is not None else np.empty(0, kind)
    return values, np.diff(at) // size


def bags(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and occurrences of the terms of documents that lie one after the other, in order."""
    code = np.repeat(np.arange(len(lengths)), lengths) << 32 | values.astype(np.int64)
    code.sort()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
    counts = np.diff(np.append(first, len(code)))
    code = code[first]
    return code >> 32, code & 0xFFFFFFFF, counts


@dataclass(frozen=True)
class Corpus:
    """Number of documents, their mean length, and in how many of them each term occurs."""

    count: int
    mean: float
    frequency: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Corpus:
        lengths = np.array([len(d) for d in docs])
        return cls(len(docs), float(lengths.mean()), np.bincount(bags(np.concatenate(docs), lengths)[1]))

    @cached_property
    def rare(self) -> np.ndarray:
        """What the occurrence of each term is worth."""
        return np.log1p((self.count - self.frequency + 0.5) / (self.frequency + 0.5))

    @cached_property
    def drawn(self) -> np.ndarray:
        """The random numbers of the terms; a term of one document leads to no neighbour."""
        numbers = np.random.default_rng(SEED).exponential(size=len(self.frequency))
        return np.where(self.frequency > 1, numbers, np.inf)

    def weights(self, terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """BM25 weights of terms that occur ``counts`` times in documents of ``lengths``."""
        return self.rare[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths / self.mean))

    def keys(self, values: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """The terms by which documents are dealt, as big-endian bytes."""
        owner, terms, counts = bags(values, lengths)
        # The fourth power, as two squares.
        cost = self.drawn[terms] / np.square(np.square(self.weights(terms, counts, lengths[owner])))
        begin = np.searchsorted(owner, np.arange(len(lengths) + 1)).tolist()
        keys = []
        for a, b in zip(begin, begin[1:]):
            own = cost[a:b]
            least = np.argpartition(own, KEY_TERMS)[:KEY_TERMS] if b - a > KEY_TERMS else np.arange(b - a)
            least = least[np.argsort(own[least])]
            keys.append(terms[a + least[np.isfinite(own[least])]].astype(">u4").tobytes())
        return pa.array(keys, pa.binary())


class Index:
    """Inverted index of a shard: for each term, the documents and their BM25 weights."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        corpus = corpus or Corpus.of(docs)
        length = np.array([len(d) for d in docs])
        owner, self.terms, counts = bags(np.concatenate(docs), length)
        self.count = self.held = len(docs)
        self.begin = np.searchsorted(owner, np.arange(len(docs) + 1))
        weight = corpus.weights(self.terms, counts, length[owner])
        frequency = np.bincount(self.terms)
        #: The lists of frequent terms are rows with a place for each document, which are quicker to add.
        frequent = frequency * FREQUENT >= len(docs)
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.rows = np.zeros((np.count_nonzero(frequent), len(docs)))
        often = frequent[self.terms]
        self.rows[self.row[self.terms[often]], owner[often]] = weight[often]
        order = np.argsort(self.terms[~often], kind="stable")
        self.posting, self.posted = owner[~often][order], weight[~often][order]
        self.first = np.concatenate(([0], np.cumsum(np.where(frequent, 0, frequency))))

    def thin(self, free: np.ndarray) -> None:
        """Leaves out the documents that are not free."""
        kept = free[self.posting]
        self.first = np.concatenate(([0], np.cumsum(kept)))[self.first]
        self.posting, self.posted = self.posting[kept], self.posted[kept]
        self.held = np.count_nonzero(free)

    def neighbours(self, seed: int, free: np.ndarray) -> list[int]:
        """Free documents that share a term with the seed, best first, then by number."""
        part = slice(self.begin[seed], self.begin[seed + 1])
        terms = self.terms[part]
        row = self.row[terms]
        slices = [slice(a, b) for a, b in zip(self.first[terms].tolist(), self.first[terms + 1].tolist()) if a < b]
        scores = self.rows[row[row >= 0]].sum(axis=0)
        if slices:
            docs = np.concatenate([self.posting[s] for s in slices])
            scores += np.bincount(docs, np.concatenate([self.posted[s] for s in slices]), self.count)
        found = np.flatnonzero((scores > 0) & free)
        return found[np.argsort(-scores[found], kind="stable")].tolist()


def fill(sizes: list[int], index: Index, length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, size) that hold each document whole, in order."""
    free = np.ones(len(sizes), bool)
    sequences: list[list[tuple[int, int, int]]] = []
    current: list[tuple[int, int, int]] = []
    room, following, left = length, 0, len(sizes)

    def place(doc: int) -> None:
        nonlocal current, room, left
        free[doc] = False
        left -= 1
        if 4 * left < 3 * index.held:
            index.thin(free)
        start = 0
        while start < sizes[doc]:
            size = min(room, sizes[doc] - start)
            current.append((doc, start, size))
            start += size
            room -= size
            if not room:
                sequences.append(current)
                current, room = [], length

    seed = -1
    while True:
        if seed < 0:
            while following < len(sizes) and not free[following]:
                following += 1
            if following == len(sizes):
                break
            seed = following
            place(seed)
        if room == length:  # the seed ended with a sequence
            seed = -1
            continue
        too_long = -1
        for doc in index.neighbours(seed, free):
            if sizes[doc] <= room:
                place(doc)
                if room == length:
                    break
            elif too_long < 0:
                too_long = doc
        if room == length:
            seed = -1
        elif too_long >= 0:
            seed = too_long
            place(seed)
        else:
            seed = -1
    if current:
        sequences += _powers(current)
    return sequences


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A short sequence as sequences of powers of two, the longest first."""
    total = sum(p[2] for p in pieces)
    out, pieces = [], list(reversed(pieces))
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out.append([])
        while room:
            doc, start, size = pieces.pop()
            out[-1].append((doc, start, min(size, room)))
            if size > room:
                pieces.append((doc, start + room, size - room))
            room -= min(size, room)
    return out


def token_ids(docs: DataFrame, doc_id: str, text: str, vocabulary: str) -> DataFrame:
    """``doc_id``, ``ids`` (bytes of their ids and the end, in as few bytes for each as all ids need), ``n``, ``uid``."""
    kind = _kind(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(vocabulary, ordinary=False)
        for batch in batches:
            found = [codes.encode(body.as_py(), END) for body in batch["text"]]
            ids = pa.array([d.astype(kind).tobytes() for d in found], pa.binary())
            yield pa.record_batch([batch["doc_id"], ids, pa.array(map(len, found), pa.int64())], names=["doc_id", "ids", "n"])

    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    ident = slim.schema["doc_id"].dataType.simpleString()
    coded = slim.mapInArrow(run, f"doc_id {ident}, ids binary, n long").withColumn("uid", F.monotonically_increasing_id())
    path = work_dir(docs.sparkSession, "token-ids")
    # Ids of documents do not repeat as a whole.
    coded.write.options(**{"compression": "zstd", "parquet.enable.dictionary#ids": "false"}).parquet(path)
    return docs.sparkSession.read.schema(coded.schema).parquet(path)


def _kind(vocabulary: str) -> str:
    return "<u2" if encoder(vocabulary, ordinary=False).size <= 1 << 16 else "<u4"


def statistics(coded: DataFrame, vocabulary: str = VOCABULARY) -> Corpus:
    """Counts over all documents; as many numbers as the vocabulary has entries reach the driver."""
    kind, size = _kind(vocabulary), encoder(vocabulary, ordinary=False).size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(bags(*flat(batch["ids"], kind))[1], minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used])], names=["term", "docs"])

    count, tokens = coded.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(size, np.int64)
    for row in coded.select("ids").mapInArrow(run, "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        frequency[row.term] = row.docs
    return Corpus(count, tokens / max(1, count), frequency)


def shards(coded: DataFrame, corpus: Corpus, shard_tokens: int = SHARD_TOKENS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``uid``, ``shard`` and ``through``, the tokens up to and with the document, in the order of keys."""
    kind, shared = _kind(vocabulary), coded.sparkSession.sparkContext.broadcast(corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            keys = known.keys(*flat(batch["ids"], kind))
            yield pa.record_batch([batch["uid"], batch["n"], batch["mix"], keys], names=["uid", "n", "mix", "key"])

    mix = F.xxhash64(F.col("doc_id").cast("string"), "ids").alias("mix")
    keyed = coded.select("uid", "n", mix, "ids").mapInArrow(run, "uid long, n long, mix long, key binary")
    # Written, as dealing out by ranges runs it twice. Only equal rows are left to the order of ``uid``.
    placed = running(materialize(keyed, "keys"), [], ["key", "mix", "uid"], {"through": ("sum", F.col("n"))})
    return placed.select("uid", F.expr(f"(through - 1) div {shard_tokens}").alias("shard"), "through")


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    vocabulary: str = VOCABULARY,
    shard_tokens: int = SHARD_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece of a document in a sequence of at most ``length`` tokens.

    Columns ``doc_id``, ``start`` (the document's ids before it), ``length``, ``ids_crc32``
    (of the ids as little-endian 32-bit numbers), ``doc_tokens`` (with the end id 1),
    ``sequence_id``, ``offset`` (in the sequence, gapless from 0), and ``ids`` if asked for. Every id is in
    exactly one piece; a null or empty text is its end id. Ids are those of the tokenizer's file as
    it is, so the string of a special token in a text is that token's id. Sequences are full or have a
    power of two tokens. Repeated rows and null ids are documents like any other. The same
    documents give the same pieces, whatever the partitions and the order of the input.
    """
    coded = token_ids(docs, doc_id, text, vocabulary)
    corpus = statistics(coded, vocabulary)
    shared, ids_kind = docs.sparkSession.sparkContext.broadcast(corpus), _kind(vocabulary)
    # A few bytes for each document, so that side is the one to hash.
    places = shards(coded, corpus, shard_tokens, vocabulary).hint("shuffle_hash")
    dealt = coded.drop("n").join(places, "uid").drop("uid")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "through")
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = {"doc_id": dealt.schema["doc_id"].dataType.simpleString(), **dict.fromkeys(numbers, "long")}
    if with_ids:
        out["ids"] = "array<int>"
    names_out = list(out)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Scalar, np.ndarray]]:
        for batch in batches:
            values, lengths = flat(batch["ids"], ids_kind)
            yield from zip(batch["shard"].to_pylist(), batch["doc_id"], np.split(values, np.cumsum(lengths)[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident_type = None
        for shard, group in groupby(rows(batches), key=lambda r: r[0]):
            _, names, held = zip(*group)
            ident_type = ident_type or names[0].type
            ids = pa.array([n.as_py() for n in names], ident_type)
            sequences = fill([len(d) for d in held], Index(list(held), shared.value), length)
            for begin in range(0, len(sequences), 512):
                part = sequences[begin : begin + 512]
                pieces = [p for s in part for p in s]
                which = [p[0] for p in pieces]
                cut = [held[d][a : a + n].astype("<u4") for d, a, n in pieces]
                sizes = np.array([len(s) for s in part])
                # Below 2 ** 33 sequences in a shard.
                sequence = np.repeat((shard << 33) + begin + np.arange(len(part)), sizes)
                offset = np.concatenate([np.cumsum([0] + [p[2] for p in s[:-1]]) for s in part])
                columns = [
                    ids.take(pa.array(which)),
                    pa.array([p[1] for p in pieces], pa.int64()),
                    pa.array([p[2] for p in pieces], pa.int64()),
                    pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64()),
                    pa.array([len(held[d]) for d in which], pa.int64()),
                    pa.array(sequence, pa.int64()),
                    pa.array(offset, pa.int64()),
                ]
                if with_ids:
                    ends = pa.array(np.cumsum([0] + [len(c) for c in cut]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(cut).astype(np.int32))))
                yield pa.record_batch(columns, names=names_out)

    return dealt.select("shard", "doc_id", "ids").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in out.items()))


def report(docs: DataFrame, **options) -> DataFrame:
    """``pack`` without the ids."""
    return pack(docs, with_ids=False, **options)
