"""Near-duplicate documents by 64-bit SimHash and multi-index hashing.

A fingerprint is cut into segments of 21, 21 and 22 bits. If two of them differ in at
most four bits, the first or the second segment differs in at most one bit, or the
third one in none. So a table holds each fingerprint under its three segment values;
a search looks up the Hamming ball of radius one around the first two values, and the
third value itself, and compares whole fingerprints with what it finds. Equal
fingerprints are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import utf8
from tidelog.llm.graph import components
from tidelog.session import materialize

WORDS, DISTANCE, SEED = 4, 4, 42
#: Lowest bit and width of each segment, and the radius that is searched in it.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the word shingles, repeats included; zero for a text without words."""
    w = utf8(text).lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[k:] for k in range(words))))
    ones, total, part = np.zeros(64, np.int64), 0, []
    for h in map(_hash, shingles):
        part.append(h)
        if len(part) == 65_536:
            ones, total, part = ones + _ones(part), total + len(part), []
    ones, total = ones + _ones(part), total + len(part)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def _hash(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, SEED)


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (all columns, or those to keep) and ``fp``, the fingerprint as a signed long."""
    slim = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
        F.col(text).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch["text"].to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch["row"], pa.array(fps.view(np.int64))], names=["row", "fp"])

    return slim.mapInArrow(run, f"row {slim.schema['row'].dataType.simpleString()}, fp long")


def _value(low: int, width: int) -> F.Column:
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))


def _table(fps: DataFrame) -> DataFrame:
    """Each fingerprint under each of its segment values."""
    keys = [F.struct(F.lit(s).alias("s"), _value(low, width).alias("v")) for s, (low, width, _) in enumerate(SEGMENTS)]
    return fps.select("*", F.inline(F.array(*keys)))


def _probes(fps: DataFrame) -> DataFrame:
    """Each fingerprint under all values in the ball of each segment."""
    keys = []
    for s, (low, width, radius) in enumerate(SEGMENTS):
        masks = [0] + [1 << bit for bit in range(width) if radius]
        keys += [F.struct(F.lit(s).alias("s"), _value(low, width).bitwiseXOR(F.lit(m)).alias("v")) for m in masks]
    return fps.select("*", F.inline(F.array(*keys)))


def _near(a: str, b: str, distance: int) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def classes(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp`` and ``root``, equal for those that links of ``distance`` bits join, for distinct ``fp``.

    First each is compared only with the
    least one under each of its segment values, which already joins large groups of
    near copies; the full search then returns only links between different groups, so
    it never lists the pairs inside a group.
    """
    if distance > DISTANCE:
        raise ValueError(f"the segments find links of at most {DISTANCE} bits")
    table = _table(fps)
    first = materialize(table.groupBy("s", "v").agg(F.min("fp").alias("lead")), "leads")
    easy = table.join(first, ["s", "v"]).filter((F.col("lead") != F.col("fp")) & _near("lead", "fp", distance))
    groups = components(easy.select("fp", "lead"), "fp", "lead")
    named = fps.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    named = materialize(named.select("fp", F.coalesce("root", "fp").alias("root")), "groups")
    left = _probes(named).select("s", "v", F.col("fp").alias("a"), F.col("root").alias("ra"))
    right = _table(named).select("s", "v", F.col("fp").alias("b"), F.col("root").alias("rb"))
    # Which of two fingerprints is looked up does not matter: the ball is symmetric.
    found = left.join(
        right,
        (left.s == right.s) & (left.v == right.v) & (F.col("ra") < F.col("rb")) & _near("a", "b", distance),
    )
    between = components(found.select("ra", "rb"), "ra", "rb")
    between = between.select(F.col("node").alias("root"), F.col("root").alias("last"))
    return named.join(between, "root", "left").select("fp", F.coalesce("last", "root").alias("root"))


def _components(fps: DataFrame) -> DataFrame:
    """``fp`` and ``root`` of all distinct fingerprints of ``fps``, as a written table."""
    own = materialize(fps.select("fp").distinct(), "distinct")
    return materialize(classes(own), "components")


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each document: ``doc_id``, ``fingerprint``, ``component_id``.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the least id that links
    of at most four differing bits reach, the document's own included. Null, empty and
    blank texts have the fingerprint zero and are linked like any other. A document
    with a null id takes part and gets the least id of its component, null if there
    is none. Repeated rows stay rows.
    """
    fps = fingerprints(docs, text=text, keep=[doc_id]).select(F.col(f"row.{doc_id}").alias("doc_id"), "fp")
    fps = materialize(fps, "fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = materialize(least.join(_components(fps), "fp"), "named")
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = materialize(named.join(lowest, "root").select("fp", "component_id"), "by_fp")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each component, that with the least id, its columns as they were.

    A document without an id stays only where no document of its component has one. Of
    several rows with that id (or without any) one stays, with the least fingerprint.
    """
    fps = fingerprints(docs, text=text, keep=[doc_id]).select(F.col(f"row.`{doc_id}`").alias("ident"), "fp")
    fps = materialize(fps, "fingerprints")
    rank = F.struct(F.col("ident").isNull().alias("none"), "ident", "fp")
    best = fps.groupBy("fp").agg(F.min(rank).alias("best"))
    best = best.join(_components(fps), "fp").groupBy("root").agg(F.min("best").alias("best"))
    best = materialize(best.select("best.ident", F.col("best.fp").alias("fp")), "best")
    # Where an id is that of one row, it tells the row; where not, the fingerprint must help.
    again = materialize(fps.groupBy("ident").count().filter("count > 1 or ident is null").select("ident"), "again")
    mine = F.col(doc_id)
    plain = best.join(again, "ident", "left_anti").filter("ident is not null")
    once = docs.join(plain, mine == plain["ident"], "left_semi")
    rows = fingerprints(docs.join(again, mine.eqNullSafe(again["ident"]), "left_semi"), text=text)
    same = F.col(f"row.`{doc_id}`").eqNullSafe(best["ident"]) & (rows["fp"] == best["fp"])
    rows = rows.join(best, same, "left_semi").withColumn("ident", F.col(f"row.`{doc_id}`"))
    return once.unionByName(rows.dropDuplicates(["ident", "fp"]).select("row.*"))
