"""Importance resampling towards the distribution of a target set.

Texts are compared through hashed features: every run of a few consecutive words falls into a
bucket. What a bucket is worth is the logarithm of how much more frequent it is in the
target than in the documents; a document weighs the sum over its features. Weights with
Gumbel noise, derived from the id, are sorted, and the highest are drawn without replacement.

The texts of a batch are joined with separators between them, so that one pass of one
pattern finds the words of all of them; their places among the offsets of the texts tell whose
they are, and runs that begin in one text and end in another are masked before counting.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import utf8
from tidelog.operators.ordered import CELL, split_groups
from tidelog.session import materialize

LENGTH, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: Bytes of text that are joined, and words that are held, at once. They do not affect results.
JOINED_BYTES, HELD_WORDS = 4 << 20, 1 << 16

_LOWER = bytes(range(256)).lower()
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SEPARATOR = b"\n"


def groups(texts: list[str | None], size: int = JOINED_BYTES) -> Iterator[list[bytes]]:
    """The texts in order, as bytes in lower case (A to Z), in groups of about ``size`` bytes."""
    group, held = [], 0
    for text in texts:
        group.append(utf8(text).translate(_LOWER))
        held += len(group[-1])
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def features(group: list[bytes], length: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The features of joined texts: number of words, then text and bucket of each feature.

    The hash of a run of words is carried on from that of the run without its last word. The last
    words held are taken over to the next ones, as runs may continue there.
    """
    offsets = np.cumsum([0] + [len(text) + len(_SEPARATOR) for text in group[:-1]])
    matches = _WORD.finditer(_SEPARATOR.join(group))
    words: list[bytes] = []
    owners = np.empty(0, np.int64)
    while held := list(islice(matches, HELD_WORDS)):
        old = len(words)
        words += [m[0] for m in held]
        starts = np.fromiter((m.start() for m in held), np.int64, len(held))
        owners = np.concatenate([owners, np.searchsorted(offsets, starts, side="right") - 1])
        hashes = list(map(crc32, words))
        following = [b" " + w for w in words] if length > 1 else words
        for size in range(1, length + 1):
            if size > 1:
                hashes = list(map(crc32, following[size - 1 :], hashes))
            ends = owners[size - 1 :]
            inside = owners[: len(ends)] == ends
            # Runs that end among the words taken over have been counted.
            inside[: max(0, old - size + 1)] = False
            values = np.fromiter(hashes, np.int64, len(ends))
            yield size, ends[inside], values[inside] % buckets
        keep = min(length - 1, len(words))
        words, owners = words[len(words) - keep :], owners[len(owners) - keep :]


def bucket_counts(frame: DataFrame, *, text: str = "text", length: int = LENGTH, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; ``buckets`` numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for group in groups(batch["text"].to_pylist()):
                for _, _, found in features(group, length, buckets):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})

    slim = frame.select(F.col(f"`{text}`").cast("string").alias("text"))
    sums = slim.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight, in thousandths, rounded down."""
    size = len(source)
    all_source, all_target = float(source.sum() + size), float(target.sum() + size)
    return np.array(
        [math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def noise(ident: object, seed: int) -> int:
    """Gumbel noise in thousandths, rounded down, that depends on the id and the seed alone."""
    h = int(hashlib.sha256(f"{seed}:{ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(
    docs: DataFrame, gain: np.ndarray, *, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, seed: int = SEED, keep: list[str] | None = None
) -> DataFrame:
    """``row`` (all columns, or those to keep), ``n_words``, ``n_features``, ``weight``, ``score``.

    A text without words, null or empty, weighs nothing; the noise of a null id is that of "null".
    """
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    slim = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
        F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")).alias("ident"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = shared.value
        for batch in batches:
            columns: list[list] = [[], [], []]
            for group in groups(batch["text"].to_pylist()):
                n = len(group)
                n_words, n_features, weight = (np.zeros(n, np.int64) for _ in range(3))
                for size, owner, bucket in features(group, length, len(worth)):
                    found = np.bincount(owner, minlength=n)
                    n_features += found
                    if size == 1:
                        n_words += found
                    # Whole numbers below 2 ** 53 are exact.
                    weight += np.bincount(owner, weights=worth[bucket], minlength=n).astype(np.int64)
                for column, values in zip(columns, (n_words, n_features, weight)):
                    column += values.tolist()
            score = [w + noise(i, seed) for w, i in zip(columns[2], batch["ident"].to_pylist())]
            numbers = [pa.array(c, pa.int64()) for c in (*columns, score)]
            yield pa.record_batch([batch["row"], *numbers], names=["row", "n_words", "n_features", "weight", "score"])

    kind = slim.schema["row"].dataType.simpleString()
    return slim.mapInArrow(run, f"row {kind}, n_words long, n_features long, weight long, score long")


def ranked(weighed: DataFrame, *, doc_id: str, least_words: int, percent: int) -> DataFrame:
    """Adds ``rank`` from 1 for the highest scores among documents of enough words; null for the rest.

    Ranks are places in a table cut into ranges of scores: the sizes of the ranges before, and
    the place inside. Ties go to the smaller id, null ids last.
    """
    weighed = materialize(weighed, "weighed")
    eligible = F.col("n_words") >= least_words
    order = {"_down": -F.col("score"), "_unknown": F.col(f"row.`{doc_id}`").isNull(), "_ident": F.col(f"row.`{doc_id}`")}
    split = split_groups(weighed.filter(eligible).withColumns(order), [], [*order, "n_features"])
    # One row for each range.
    sizes = split.frame.groupBy(CELL).count()
    everything = Window.partitionBy()
    sizes = sizes.select(
        CELL,
        F.coalesce(F.sum("count").over(everything.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.floor(F.sum("count").over(everything) * percent / F.lit(100)).alias("_drawn"),
    )
    placed = split.frame.join(F.broadcast(sizes), CELL)
    place = F.row_number().over(split.window) + F.col("_before")
    drawn = placed.withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= F.col("_drawn"), F.col("rank")))
    rest = weighed.filter(~eligible).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*rest.columns).unionByName(rest)


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    target_text: str = "text",
    length: int = LENGTH,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    keep: list[str] | None = None,
) -> DataFrame:
    """All documents with what they weigh and, for the drawn ones, their rank.

    Columns ``row`` (all columns of a document, so none can clash), ``n_words``, ``n_features``,
    ``weight``, ``score``, ``rank``. Of the N documents of at least ``least_words`` words the
    ``percent`` of highest scores are drawn, rounded down; ties go to the smaller id, null ids
    last. Null and empty texts have no features, repeated rows stay rows, and of an
    empty target all buckets are empty. Texts of any length count whole.
    """
    shape = {"length": length, "buckets": buckets}
    gain = gains(bucket_counts(docs, text=text, **shape), bucket_counts(target, text=target_text, **shape))
    weighed = weigh(docs, gain, text=text, doc_id=doc_id, length=length, seed=seed, keep=keep)
    return ranked(weighed, doc_id=doc_id, least_words=least_words, percent=percent)


def report(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score``, ``rank`` of every document."""
    rows = resample(docs, target, doc_id=doc_id, keep=[doc_id], **options)
    return rows.select(F.col(f"row.`{doc_id}`").alias("doc_id"), "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, their columns as they were."""
    return resample(docs, target, **options).filter("rank is not null").select("row.*")
