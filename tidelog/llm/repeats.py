"""Exact repeated passages: an enhanced suffix array and its common-prefix intervals.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier. Such a
string has one *anchor*, the least hash among its ``GRAM``-byte substrings (the leftmost
of equal ones). Equal strings have equal anchors at equal places, so it is enough to
compare the surroundings of equal anchors:

1. Documents are gathered into blocks of about ``BLOCK_BYTES``, written once.
2. A *context* is a stretch of text whose strings all have one anchor occurrence. Each
   block tells the anchors and contexts it has, by 48 bits of hash each; they meet by
   anchor. An anchor that occurs once is done with, and so are all copies of a context
   but the first: their blocks learn that they go.
3. The first copies of the contexts of an anchor that has several are sent to where the
   anchor is dealt with. If it has over ``HOT``, their strings go one by one, dealt by
   128 bits of hash that stand for them, so that they do not all meet in one task.
4. Over the contexts that meet: suffix array with common-prefix lengths, a stack scan
   for the intervals of suffixes with a common prefix of ``LENGTH`` bytes or more, and of
   these the ones that differ in the byte to their left. These are the maximal repeats
   with all their occurrences. All but the first occurrence go.
5. What goes is brought back to the blocks.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog.llm.common import utf8
from tidelog.session import materialize

LENGTH, GRAM = 100, 32
BLOCK_BYTES = 1 << 20
HOT = 1024
#: Bytes of the hash that stands for a string that is sent alone.
DIGEST = 16
#: Rows that cross to Python at once; a row may be a block.
BATCH_ROWS = 256
CHUNK_BYTES = 1 << 20
_STEP = 1 << 18
_MASK, _SHORT = (1 << 64) - 1, (1 << 48) - 1


def _grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on, by doubling."""
    h, width, factor = raw.astype(np.uint64) + np.uint64(1), 1, 0xBF58476D1CE4E5B9
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        h ^= h >> np.uint64(29)
        factor = (factor * 0x94D049BB133111EB + 2) & _MASK | 1
        width *= 2
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    rest = width - done
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def zones(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [low, high] of starts of strings with one anchor occurrence, and its hash.

    ``raw`` holds texts one after the other, ``ends`` where they end.
    """
    lows, highs, hashes = [], [], []
    starts = len(raw) - LENGTH + 1
    if starts <= 0:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    inside = np.ones(len(raw), bool)
    for end in ends:
        inside[max(0, end - LENGTH + 1) : end] = False
    bits = (_STEP + LENGTH).bit_length()
    for base in range(0, starts, _STEP):
        n = min(_STEP, starts - base)
        h = _grams(raw[base : base + n + LENGTH - 1])
        place = np.arange(len(h), dtype=np.uint64)
        keys = (h >> np.uint64(bits) << np.uint64(bits)) | place
        at = (_least(keys, LENGTH - GRAM + 1) & np.uint64((1 << bits) - 1)).astype(np.int64)
        good = inside[base : base + n]
        cut = np.flatnonzero((at[1:] != at[:-1]) | (good[1:] != good[:-1])) + 1
        low = np.concatenate(([0], cut))
        high = np.concatenate((cut, [n])) - 1
        use = good[low]
        lows.append(low[use] + base)
        highs.append(high[use] + base)
        hashes.append(h[at[low[use]]])
    return np.concatenate(lows), np.concatenate(highs), np.concatenate(hashes)


def _ranks(symbols: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, up to ``depth``."""
    n, width = len(symbols), 1
    levels = [symbols.astype(np.int64)]
    while width < depth:
        last = levels[-1]
        key = last << 32
        key[: n - width] |= last[width:]
        width *= 2
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        levels.append(rank)
    return levels


def _prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes ``a`` and ``b``, at most ``room``."""
    n, length = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
        fits = (a + length < n) & (b + length < n)
        length += np.where(fits & (levels[k][x] == levels[k][y]), 1 << k, 0)
    return np.minimum(length, room)


def _intervals(prefix: list[int]) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of neighbours' prefix lengths, by a stack."""
    stack: list[tuple[int, int]] = []
    for k, value in enumerate([*prefix, 0]):
        first = k
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            yield length, first, k
        if value and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def maximal_repeats(texts: list[bytes], least: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of at least ``least`` bytes: length, text numbers and places of all occurrences.

    A repeat is maximal if its occurrences differ on the right (an interval of the
    suffix array) and on the left; the start of a text differs from everything.
    """
    size = np.array([len(t) for t in texts], np.int64)
    if len(texts) == 0 or size.max() < least:
        return
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    after = np.cumsum(size + 1)
    symbols[after - 1] = 0
    begin = after - size - 1
    levels = _ranks(symbols, int(size.max()))
    # Only suffixes with room for a repeat; text by text, so the places ascend.
    counts = np.maximum(0, size - least + 1)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    suffix = begin[owner] + place
    order = np.argsort(levels[-1][suffix], kind="stable")
    suffix, owner, place = suffix[order], owner[order], place[order]
    room = size[owner] - place
    prefix = _prefix(levels, suffix[:-1], suffix[1:], np.minimum(room[:-1], room[1:]))
    left = np.where(place > 0, symbols[suffix - 1], -1 - np.arange(len(suffix)))
    # Neighbours with a long prefix in common form runs; most have one left byte only.
    long = prefix >= least
    edges = np.flatnonzero(np.diff(np.concatenate(([0], long.view(np.int8), [0]))))
    for first, last in zip(edges[::2], edges[1::2]):
        run = left[first : last + 1]
        if (run == run[0]).all():
            continue
        changes = np.concatenate(([0], np.cumsum(run[1:] != run[:-1])))
        for length, a, b in _intervals(prefix[first:last].tolist()):
            if changes[a] != changes[b]:
                part = slice(first + a, first + b + 1)
                yield length, owner[part], place[part]


def later_occurrences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, from and to of each occurrence of a maximal repeat but the first."""
    owners, starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length, owner, place in maximal_repeats(texts):
        first = owner.min()
        later = (owner != first) | (place != place[owner == first].min())
        owners.append(owner[later])
        starts.append(place[later])
        ends.append(place[later] + length)
    return np.concatenate(owners), np.concatenate(starts), np.concatenate(ends)


def _blocks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents in blocks: compressed texts, their sizes, the rows without the text."""
    rest = [c for c in docs.columns if c != text]
    slim = docs.select(
        F.col(text).cast("string").alias("text"),
        F.col(doc_id).cast("long").alias("ident"),
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"),
    )
    kind = slim.schema["rest"].dataType
    schema = T.StructType(
        [
            T.StructField("data", T.BinaryType()),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField("idents", T.ArrayType(T.LongType())),
            T.StructField("missing", T.ArrayType(T.BooleanType())),
            T.StructField("rest", T.ArrayType(kind)),
        ]
    )
    arrow = to_arrow_schema(schema)

    def block(texts: list, idents: list, rest: list[pa.Array]) -> pa.RecordBatch:
        data = [utf8(t) for t in texts]
        sizes = np.array([len(x) for x in data], np.int64)
        joined = b"".join(data)
        rows = pa.concat_arrays(rest)
        values = [
            pa.array([zstandard.ZstdCompressor(level=5).compress(joined)], pa.binary()),
            pa.array([sizes], pa.list_(pa.int64())),
            pa.array([idents], pa.list_(pa.int64())),
            pa.array([[t is None for t in texts]], pa.list_(pa.bool_())),
            pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
        ]
        return pa.record_batch([v.cast(f.type) for v, f in zip(values, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, idents, rest, size = [], [], [], 0
        for batch in batches:
            begin = 0
            held = batch["text"].to_pylist()
            ids = batch["ident"].to_pylist()
            for k, t in enumerate(held):
                size += 4 * len(t or "") if t and not t.isascii() else len(t or "")
                if size >= BLOCK_BYTES or k == len(held) - 1:
                    texts += held[begin : k + 1]
                    idents += ids[begin : k + 1]
                    rest.append(batch["rest"].slice(begin, k + 1 - begin))
                    begin = k + 1
                    if size >= BLOCK_BYTES:
                        yield block(texts, idents, rest)
                        texts, idents, rest, size = [], [], [], 0
        if texts:
            yield block(texts, idents, rest)

    blocks = slim.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())
    return materialize(blocks, "blocks")


_NULL = -(1 << 63)
# What a block does with its occurrences of a context.
_ALL, _BUT_FIRST, _SEND, _SEND_STRINGS = 0, 1, 2, 3


class _Block:
    """An opened block: its contexts in the order of the documents."""

    def __init__(self, data: bytes, sizes: list[int], idents: list):
        self.raw = zstandard.ZstdDecompressor().decompress(data)
        self.ends = np.cumsum(np.array(sizes, np.int64))
        self.begins = self.ends - np.array(sizes, np.int64)
        self.idents = np.array([_NULL if i is None else i for i in idents], np.int64)
        low, high, anchor = zones(np.frombuffer(self.raw, np.uint8), self.ends)
        doc = np.searchsorted(self.ends, low, side="right")
        missing = np.array([i is not None for i in idents], bool)
        rank = np.empty(len(sizes), np.int64)
        rank[np.lexsort((np.arange(len(sizes)), self.idents, missing))] = np.arange(len(sizes))
        order = np.lexsort((low, rank[doc]))
        self.low, self.high, self.doc = low[order], high[order], doc[order]
        self.anchor = (anchor & np.uint64(_SHORT)).view(np.int64)[order]
        digest, spans = xxhash.xxh3_64_intdigest, zip(self.low.tolist(), (self.high + LENGTH).tolist())
        hashes = np.fromiter((digest(self.raw[a:b]) for a, b in spans), np.uint64, len(low))
        self.context = (hashes & np.uint64(_SHORT)).view(np.int64)


_BLOCK = ["block", "data", "sizes", "idents", "missing", "rest"]


def _told(blocks: DataFrame) -> DataFrame:
    """Distinct contexts of each block: anchor, hash, id of the first document, occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, sizes, idents in zip(*(batch[c].to_pylist() for c in ("block", "data", "sizes", "idents"))):
                block = _Block(data, sizes, idents)
                pairs = np.empty(len(block.low), [("anchor", np.int64), ("context", np.int64)])
                pairs["anchor"], pairs["context"] = block.anchor, block.context
                # Contexts are in order, so the first of equal ones is in the first document.
                kinds, first, counts = np.unique(pairs, return_index=True, return_counts=True)
                yield pa.record_batch(
                    [
                        pa.array(np.ascontiguousarray(kinds["anchor"])),
                        pa.array(counts.astype(np.int32)),
                        pa.array(np.ascontiguousarray(kinds["context"])),
                        pa.array(np.full(len(kinds), name, np.int64)),
                        pa.array(block.idents[block.doc[first]]),
                    ],
                    names=["anchor", "count", "context", "block", "ident"],
                )

    slim = blocks.select("block", "data", "sizes", "idents")
    return slim.mapInArrow(run, "anchor long, count int, context long, block long, ident long")


def _mark(anchor: np.ndarray, context: np.ndarray, code: np.ndarray | int) -> np.ndarray:
    """62 bits for a context, unique enough within a block, and the code in the lowest two."""
    both = anchor.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ context.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    both = (both ^ (both >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (both & np.uint64(_MASK - 3)).view(np.int64) | code


def _marks(told: DataFrame) -> DataFrame:
    """For each block, what it does with which contexts: ``marks`` of contexts, with codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        columns = [np.concatenate(c) for c in zip(*parts)]
        anchor, count, context, block, ident = columns
        order = np.lexsort((block, ident, context, anchor))
        anchor, count, context, block, ident = (c[order] for c in columns)
        new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        first = new_anchor | np.concatenate(([True], context[1:] != context[:-1]))
        begin = np.flatnonzero(new_anchor)
        size = np.diff(np.concatenate((begin, [len(anchor)])))
        total = np.repeat(np.add.reduceat(count, begin), size)
        kinds = np.repeat(np.add.reduceat(first.astype(np.int64), begin), size)
        code = np.where(kinds > HOT, _SEND_STRINGS, np.where(kinds > 1, _SEND, _BUT_FIRST))
        code = np.where(first, code, _ALL)
        use = (total > 1) & ((code != _BUT_FIRST) | (count > 1))
        order = np.argsort(block[use], kind="stable")
        block, marks = block[use][order], _mark(anchor[use], context[use], code[use])[order]
        names, begin = np.unique(block, return_index=True)
        marks = [part.tobytes() for part in np.split(marks, begin[1:])]
        yield pa.record_batch([pa.array(names), pa.array(marks[: len(names)], pa.binary())], names=["block", "marks"])

    marks = told.repartition("anchor").mapInArrow(run, "block long, marks binary")
    return marks.groupBy("block").agg(F.collect_list("marks").alias("marks"))


_SENT = "route long, block long, doc int, start long, ident long, context binary"


def _contexts(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """The contexts to compare, and for each block what goes without that (a row without start)."""

    def one(name: int, data: bytes, sizes: list[int], idents: list, marks: list[bytes]) -> Iterator[tuple]:
        codes = {mark & -4: mark & 3 for mark in np.frombuffer(b"".join(marks), np.int64).tolist()}
        block = _Block(data, sizes, idents)
        gone: list[tuple[int, int, int]] = []
        columns = (block.anchor, _mark(block.anchor, block.context, 0), block.low, block.high, block.doc)
        for anchor, mark, low, high, doc in zip(*(c.tolist() for c in columns)):
            code = codes.get(mark)
            if code is None:
                continue
            begin = int(block.begins[doc])
            if code == _ALL:
                gone.append((doc, low - begin, high + LENGTH - begin))
                continue
            codes[mark] = _ALL
            ident = int(block.idents[doc])
            if code == _SEND:
                yield anchor, name, doc, low - begin, ident, block.raw[low : high + LENGTH]
            elif code == _SEND_STRINGS:
                for p in range(low, high + 1):
                    digest = xxhash.xxh3_128_digest(block.raw[p : p + LENGTH])
                    yield int.from_bytes(digest[:8], signed=True), name, doc, p - begin, ident, digest
        if gone:
            yield name, name, None, None, None, np.array(gone, np.int64).tobytes()

    fields = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["route", "block", "doc", "start", "ident", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("block", "data", "sizes", "idents", "marks")]
            for row in zip(*columns):
                out = list(one(*row))
                for k in range(0, len(out), 4096):
                    part = zip(*out[k : k + 4096])
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(part, fields)], names=names)

    # All columns, as in the last join, so that both use one exchange of the blocks.
    return blocks.select(*_BLOCK).join(marks, "block").mapInArrow(run, _SENT)


def _compared(contexts: DataFrame) -> DataFrame:
    """``block`` and ``gone``: (document, from, to) triples of what goes from it."""

    def chunk(routes: list, blocks: list, docs: list, starts: list, idents: list, texts: list) -> Iterator[tuple]:
        gone: dict[int, list] = defaultdict(list)
        key = lambda k: (idents[k], blocks[k], docs[k], starts[k])
        first: dict[bytes, int] = {}
        for k in sorted(range(len(texts)), key=key):
            if first.setdefault(texts[k], k) != k:
                size = LENGTH if len(texts[k]) == DIGEST else len(texts[k])
                gone[blocks[k]].append((docs[k], starts[k], starts[k] + size))
        by_route: dict[int, list[int]] = defaultdict(list)
        for k in first.values():
            if len(texts[k]) > DIGEST:
                by_route[routes[k]].append(k)
        # In the order of the documents. A context holds no string twice: its anchor is one occurrence.
        kept = sorted((k for ks in by_route.values() if len(ks) > 1 for k in ks), key=key)
        for owner, a, b in zip(*(x.tolist() for x in later_occurrences([texts[k] for k in kept]))):
            k = kept[owner]
            gone[blocks[k]].append((docs[k], starts[k] + a, starts[k] + b))
        for name, spans in gone.items():
            yield name, np.array(spans, np.int64).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = list(chunk(*held))
            if out:
                names, spans = zip(*out)
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array(spans, pa.binary())], names=["block", "gone"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[3] is None:
                    yield pa.record_batch(
                        [pa.array([row[1]], pa.int64()), pa.array([row[5]], pa.binary())], names=["block", "gone"]
                    )
                    continue
                if size >= CHUNK_BYTES and row[0] != held[0][-1]:
                    yield from flush()
                    held, size = [[] for _ in range(6)], 0
                for column, value in zip(held, row):
                    column.append(value)
                size += len(row[5])
        if size:
            yield from flush()

    dealt = contexts.repartition("route").sortWithinPartitions("route")
    return dealt.mapInArrow(run, "block long, gone binary")


def _whole(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Blocks, each with all that goes from it in ``gone``."""
    blocks = _blocks(docs, doc_id, text)
    gone = _compared(_contexts(blocks, _marks(_told(blocks))))
    gone = gone.groupBy("block").agg(F.collect_list("gone").alias("gone"))
    return blocks.select(*_BLOCK).join(gone, "block", "left")


def _runs(gone: list[bytes] | None, sizes: list[int]) -> list[list[tuple[int, int]]]:
    """Maximal runs of bytes that go, document by document."""
    runs: list[list[tuple[int, int]]] = [[] for _ in sizes]
    spans = np.frombuffer(b"".join(gone or []), np.int64).reshape(-1, 3)
    for doc, a, b in spans[np.lexsort((spans[:, 1], spans[:, 0]))].tolist():
        if runs[doc] and a <= runs[doc][-1][1]:
            runs[doc][-1] = (runs[doc][-1][0], max(b, runs[doc][-1][1]))
        else:
            runs[doc].append((a, b))
    return runs


def _without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[list[tuple[int, int]]], list[bool]]]:
    columns = [batch[c].to_pylist() for c in ("data", "sizes", "gone", "missing")]
    for k, (data, sizes, gone, missing) in enumerate(zip(*columns)):
        joined = zstandard.ZstdDecompressor().decompress(data)
        ends = np.cumsum(sizes)
        yield k, [joined[e - n : e] for n, e in zip(sizes, ends)], _runs(gone, sizes), missing


def _rows(column: pa.ListArray, k: int) -> pa.StructArray:
    return column.slice(k, 1).flatten()


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: what goes from it.

    Columns ``doc_id``, ``n_bytes`` of the text in UTF-8, ``n_removed``, ``n_spans``
    (maximal runs of removed bytes) and ``kept_sha256`` of the rest. A null text has no
    bytes. Documents are in the order of their ids, null first; of equal ids, also of
    repeated rows, the earlier row of the input is first. Texts under 100 bytes stay whole.
    """
    blocks = _whole(docs.select(doc_id, text), doc_id, text)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, texts, runs, _ in _opened(batch):
                kept = [_without(t, r) for t, r in zip(texts, runs)]
                size = [len(t) for t in texts]
                yield pa.record_batch(
                    [
                        _rows(batch["rest"], k).field(0),
                        pa.array(size, pa.int64()),
                        pa.array([a - len(b) for a, b in zip(size, kept)], pa.int64()),
                        pa.array([len(r) for r in runs], pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return blocks.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the parts of characters at their ends."""
    cut = []
    for a, b in runs:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            cut.append((a, b))
    return cut


def strip(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their repeated passages, all columns as they were.

    As ``report``, but a character stays if only part of its bytes would go. A null
    text stays null; a text of which all is repeated becomes empty.
    """
    rest = [c for c in docs.columns if c != text]
    blocks = _whole(docs, doc_id, text)
    inner = docs.select(*[f"`{c}`" for c in rest]).schema
    schema = T.StructType([T.StructField("rest", inner), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, texts, runs, missing in _opened(batch):
                kept = [None if m else _without(t, _characters(t, r)).decode() for t, r, m in zip(texts, runs, missing)]
                yield pa.record_batch([_rows(batch["rest"], k), pa.array(kept, pa.string())], names=["rest", "text"])

    done = blocks.mapInArrow(run, schema)
    return done.select(*[(F.col("text") if c == text else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])
