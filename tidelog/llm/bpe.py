"""Byte-level BPE encoding and decoding, merges chosen by a segment tree.

A pattern cuts a text into matches, and each match is encoded by itself. Over its byte
positions lies a segment tree of minima; the leaf of a position holds the rank of the
pair that starts there, if a live token starts there and the pair is in the vocabulary.
The root names the leftmost pair of the least rank. Merging it changes three leaves, those
of the pair, of its right half and of its left neighbour, and their paths to the root; so
a match of n bytes takes n log n steps, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k"
#: Matches whose ids a task remembers in each of two tables, and the longest of them in characters.
REMEMBERED, LONGEST = 1 << 18, 48
#: Characters of a text up to which its matches are listed at once.
LISTED = 1 << 20


def merge(piece: bytes, ranks: dict[bytes, int], longest: int | None = None, limit: int | None = None) -> list[int]:
    """Ids of one match: the pair of least rank, leftmost first, merges until none is left.

    ``longest`` is the number of bytes of the longest entry of ``ranks`` and ``limit`` a number above
    all ranks; both are found if not given.
    A match that is an entry itself is one id.
    """
    if piece in ranks:
        return [ranks[piece]]
    longest = longest or max(map(len, ranks))
    n, rank = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    bits = max(0, n - 1).bit_length()
    leaves = 1 << bits
    # A key is a rank and, in its low bits, a position; ``none`` is above all of them.
    above = max(ranks.values()) + 1 if limit is None else limit
    none = above << bits
    tree = [none] * (2 * leaves)
    for i in range(n - 1):
        tree[leaves + i] = rank(piece[i : i + 2], above) << bits | i
    for node in range(leaves - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    while tree[1] < none:
        i = tree[1] & (leaves - 1)
        gone = after[i]
        end = after[i] = after[gone]
        if end < n:
            before[end] = i
        for place in (gone, i, before[i]):
            if place < 0:
                continue
            middle = after[place]
            end = n if place == gone or middle == n else after[middle]
            fits = place != gone and middle < n and end - place <= longest
            value = rank(piece[place:end], above) << bits | place if fits else none
            node = leaves + place
            tree[node] = value
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def _newer() -> str:
    """Letters and numbers of the pattern library that the tokenizer library does not know yet.

    They follow different versions of Unicode. Characters that the older tables of the standard
    library leave unassigned are tried once: "x" or "7" and a character of its class
    are one match, so a vocabulary of bytes and pairs gives one id less.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    pairs = {bytes([b]): b for b in range(256)}
    pairs |= {bytes([a, b]): 256 + 256 * k + b for k, a in enumerate(b"x7") for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+", mergeable_ranks=pairs, special_tokens={})
    unknown = []
    for kind, lead in (("L", "x"), ("N", "7")):
        for c in regex.findall(rf"\p{{{kind}}}", every):
            if unicodedata.category(c) == "Cn" and probe.encode_ordinary(lead + c)[0] < 256:
                unknown.append(c)
    return "".join(sorted(unknown))


def _ranges(characters: str) -> str:
    """The inside of a character class."""
    out, codes = [], sorted(map(ord, characters))
    for code in codes:
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in out)


class Remembered(dict):
    """The ids of matches, as bytes; those that are met again need no merging.

    When the table is full it becomes the older one, and what was older and has not been met
    since is forgotten.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.longest, self.limit = ranks, max(map(len, ranks)), max(ranks.values()) + 1
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        raw = self.older.get(piece)
        if raw is None:
            ids = merge(piece.encode(), self.ranks, self.longest, self.limit)
            raw = b"".join([k.to_bytes(4, "little") for k in ids])
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = self.copy()
                self.clear()
            self[piece] = raw
        return raw


class Coder:
    """Encodes texts to the bytes of their ids (little-endian, 32 bits) and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = {k: token for token, k in ranks.items()}
        self.pieces = regex.compile(pattern)
        self.ids = Remembered(ranks)
        newer = _ranges(_newer())
        self.is_newer = re.compile(f"[{newer}]").search if newer else lambda text: None
        if newer:
            older = {kind: rf"[\p{{{kind}}}--[{newer}]]" for kind in "LN"}
            inside = pattern.replace(r"[^\s\p{L}\p{N}]", "\0")
            for kind, own in older.items():
                inside = inside.replace(rf"\p{{{kind}}}", own)
            other = rf"[[^\s\p{{L}}\p{{N}}]||[{newer}]]"
            self.careful = regex.compile(inside.replace("\0", other), regex.V1)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        pieces = self.careful if self.is_newer(text) else self.pieces
        found = pieces.findall(text) if len(text) < LISTED else (m[0] for m in pieces.finditer(text))
        return b"".join(map(self.ids.__getitem__, found))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a file of base64 tokens and their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def coder(vocabulary: str = VOCABULARY) -> Coder:
    """The coder of this process, for one of the installed byte-level vocabularies."""
    import public_tokenizers as installed

    return Coder(read_ranks(installed.path(f"{vocabulary}.tiktoken")), installed.PATTERN)


def encode(docs: DataFrame, *, text: str = "text", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """``row`` (all columns, or those to keep) and ``ids``, the text's ids as little-endian 32-bit integers.

    A null or empty text has no ids. Every row stays a row; a text of any length is encoded whole.
    """
    slim = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = coder(vocabulary)
        for batch in batches:
            ids = pa.array([mine.encode(t.as_py()) for t in batch["text"]], pa.binary())
            yield pa.record_batch([batch["row"], ids], names=["row", "ids"])

    return slim.mapInArrow(run, f"row {slim.schema['row'].dataType.simpleString()}, ids binary")


def decode(coded: DataFrame, *, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds ``decoded``, or puts it in place of a column of that name: the bytes of a column of ids.

    Null ids are decoded to null.
    """
    columns = [c for c in coded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = coder(vocabulary)
        for batch in batches:
            raw = [None if v is None else mine.decode(v) for v in (x.as_py() for x in batch[ids])]
            yield pa.record_batch([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "decoded"])

    kept = coded.select(*[f"`{c}`" for c in columns])
    return kept.mapInArrow(run, f"{kept.schema.simpleString()[7:-1]}, decoded binary")


def report(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    The digests are those of the ids and of the bytes that the ids are decoded to; of nothing for
    a null or empty text. Null ids and repeated rows stay rows.
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    # One pass does it all: each pass in a row has a Python worker, with a table of matches, of its own.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = coder(vocabulary)
        for batch in batches:
            rows = []
            for value in batch["text"]:
                ids = mine.encode(value.as_py())
                raw = mine.decode(ids)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()))
            n, coded, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
