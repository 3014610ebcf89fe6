"""Benchmark decontamination by Wu-Manber search over words.

A symbol of the search is a word, a pattern is a window of consecutive benchmark
words. For each window length there is one searcher: a table of shifts by the last
few words of the window skips positions where no window can end, buckets by these
words and by the first words of a window select what is compared, and a direct
comparison confirms it.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import utf8
from tidelog.session import materialize

WINDOW = 10
#: Windows, and bytes of them, that one pass over the documents searches and every task
#: holds; a larger benchmark takes more passes.
BLOCK_WINDOWS, BLOCK_BYTES = 50_000, 16 << 20

# Bytes that belong to words (after lower-casing), all others part words.
_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b if b in _KEPT else 0x20 for b in bytes(range(256)).lower())


def words(text: str | None) -> list[bytes]:
    """Words of digits, ASCII letters in lower case and non-ASCII characters."""
    return utf8(text).translate(_TABLE).split()


class Searcher:
    """Finds where windows of one length end in a list of words."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.length = m = len(patterns[0])
        self.block = b = 3 if m > 5 else min(m, 2)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for pattern in patterns:
            for end in range(b, m + 1):
                key = pattern[end - b : end]
                self.shift[key] = min(self.shift.get(key, m), m - end)
            self.buckets[pattern[-b:]][pattern[:b]].append(pattern)
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def find(self, text: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """Each occurrence: its first word, and the window."""
        m, b, n = self.length, self.block, len(text)
        shift, buckets, most = self.shift.get, self.buckets, m - b + 1
        end = m
        while end <= n:
            step = shift(key := tuple(text[end - b : end]), most)
            if step:
                end += step
                continue
            start = end - m
            for pattern in buckets[key].get(tuple(text[start : start + b]), ()):
                if tuple(text[start:end]) == pattern:
                    yield start, pattern
            end += 1


def windows(items: DataFrame, item_id: str, text: str, length: int) -> DataFrame:
    """Distinct windows of the benchmark: ``window`` (words joined by a blank) and ``ids``.

    Items without words or with a null text have none; items of equal text share theirs.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for ident, body in zip(batch["i"].to_pylist(), batch["t"].to_pylist()):
                w = words(body)
                for k in range(max(1, len(w) - length + 1) if w else 0):
                    ids.append(ident)
                    found.append(b" ".join(w[k : k + length]).decode("utf-8", "surrogatepass"))
            yield pa.record_batch({"id": pa.array(ids, pa.string()), "window": pa.array(found, pa.string())})

    slim = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    cuts = slim.mapInArrow(cut, "id string, window string")
    return cuts.groupBy("window").agg(F.collect_set(F.coalesce("id", F.lit("null"))).alias("ids"))


def _blocks(table: DataFrame, size: int) -> Iterator[list[tuple[str, list[str]]]]:
    """The windows in blocks of at most ``size``, one block in memory at a time."""
    block: list[tuple[str, list[str]]] = []
    held = 0
    for row in table.toLocalIterator():
        block.append((row.window, row.ids))
        held += len(row.window) + sum(map(len, row.ids))
        if len(block) == size or held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


_SPANS = T.ArrayType(T.LongType())
_IDS = T.ArrayType(T.StringType())


def _search(block: list[tuple[str, list[str]]], docs: DataFrame) -> DataFrame:
    """Adds the occurrences of one block of windows to ``spans`` and ``ids``."""
    by_length: dict[int, list] = defaultdict(list)
    owners = {}
    for window, ids in block:
        pattern = tuple(window.encode("utf-8", "surrogatepass").split(b" "))
        by_length[len(pattern)].append(pattern)
        owners[pattern] = ids
    shared = docs.sparkSession.sparkContext.broadcast(
        (dict(by_length), owners)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, owner = shared.value
        searchers = [Searcher(p) for _, p in sorted(patterns.items())]
        for batch in batches:
            spans, ids = [], []
            columns = (batch[c].to_pylist() for c in ("text", "spans", "ids"))
            for text, old_spans, old_ids in zip(*columns):
                w, here, items = words(text), [], set(old_ids)
                for searcher in searchers:
                    for start, pattern in searcher.find(w):
                        here += (start, start + searcher.length)
                        items.update(owner[pattern])
                spans.append(old_spans + here)
                ids.append(sorted(items))
            yield pa.record_batch(
                [batch[c] for c in batch.schema.names if c not in ("spans", "ids")]
                + [pa.array(spans, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))],
                names=[c for c in batch.schema.names if c not in ("spans", "ids")] + ["spans", "ids"],
            )

    return docs.mapInArrow(run, docs.schema)


def occurrences(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows of ``docs`` with ``spans`` and ``ids`` of the benchmark windows inside.

    ``row`` holds all columns of the document (or those to ``keep``), so none can clash. ``spans`` lists
    [first word, word after the last) pairs of all occurrences, flat; ``ids`` the
    items, sorted as strings. A null text has no words. A row stays a row, also if
    it is repeated; an empty benchmark marks nothing. Windows are searched in
    blocks, one pass for each, so a benchmark of any size takes bounded memory.
    """
    found = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
        F.col(text).cast("string").alias("text"),
        F.array().cast(_SPANS).alias("spans"),
        F.array().cast(_IDS).alias("ids"),
    )
    table = windows(items, item_id, item_text, window)
    for k, block in enumerate(_blocks(materialize(table, "windows"), block_windows)):
        found = _search(block, found)
        if k % 8 == 7:
            found = materialize(found, "occurrences")
    return found


def _covered(spans: list[int]) -> int:
    covered, last = 0, 0
    for start, end in sorted(zip(spans[::2], spans[1::2])):
        covered += max(0, end - max(start, last))
        last = max(last, end)
    return covered


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row for each document: how much of it the benchmark holds.

    Columns ``doc_id``, ``n_words``, ``n_hit`` (words inside any occurrence),
    ``n_items``, ``items_sha256`` (of the sorted item ids, comma-joined; of nothing if
    there are none) and ``contaminated``. Null ids and repeated rows stay rows; a null
    item id counts as the item "null".
    """
    found = occurrences(docs, items, keep=["doc_id"], **options).select("row.doc_id", "text", "spans", "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"].to_pylist()
            hit = [_covered(s) for s in batch["spans"].to_pylist()]
            yield pa.record_batch(
                [
                    batch["doc_id"],
                    pa.array([len(words(t)) for t in batch["text"].to_pylist()], pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([h > 0 for h in hit], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(
        count, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no occurrence of a benchmark window, as they were."""
    return occurrences(docs, items, **options).filter(F.size("spans") == 0).select("row.*")
