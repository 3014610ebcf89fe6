"""Near-duplicate vectors by sign hashing in several tables, checked by exact cosine.

Equal vectors of one label are one entry with its number of copies. In each table an
entry has a bucket: its label and the signs of its products with the table's random
hyperplanes. Entries of a bucket are compared all with all, in blocks: a large bucket is
cut into blocks by hash, and each pair of blocks is a task's unit of work, so that no
task holds a whole bucket. A pair is counted in the first table in which it meets.
Pairs are not listed: a unit of work returns counts, and links that join what is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.graph import components
from tidelog.session import materialize

COSINE = 0.98
#: A pair at the cosine 0.98 meets with the probability 1 - (1 - 0.936^16)^24, over 0.9999.
TABLES, BITS = 24, 16
#: Entries in a block. Of a bucket of n, each entry goes to n / BLOCK units of work.
BLOCK = 256
_EDGE = 1e-9


def _hyperplanes(width: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng(1_234_567).normal(size=(width, tables * bits))


def _entries(vectors: DataFrame, tables: int, bits: int) -> DataFrame:
    """Distinct vectors: ``entry`` (least id), ``copies``, unit vector, bucket signs, ``uid``."""
    distinct = vectors.groupBy("label", "vector").agg(F.min("vec_id").alias("entry"), F.count("*").alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_width: dict[int, list[int]] = {}
            held = batch["vector"].to_pylist()
            for k, v in enumerate(held):
                by_width.setdefault(len(v), []).append(k)
            for width, rows in by_width.items():
                x = np.array([held[k] for k in rows], np.float64)
                # Scaled first, so that no square leaves the range of doubles.
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                signs = (x @ _hyperplanes(width, tables, bits) > 0).reshape(len(rows), tables, bits)
                codes = signs @ (1 << np.arange(bits))
                pick = pa.array(rows, pa.int64())
                yield pa.record_batch(
                    [
                        batch["label"].take(pick),
                        batch["entry"].take(pick),
                        batch["copies"].take(pick),
                        batch["vector"].take(pick),
                        pa.array([width] * len(rows), pa.int32()),
                        pa.array([r.tobytes() for r in x], pa.binary()),
                        pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())),
                    ],
                    names=["label", "entry", "copies", "vector", "width", "unit", "codes"],
                )

    label = vectors.schema["label"].dataType.simpleString()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    out = distinct.mapInArrow(
        run, f"label {label}, entry {kind}, copies long, vector array<double>, width int, unit binary, codes array<int>"
    )
    return materialize(out.withColumn("uid", F.monotonically_increasing_id()), "entries")


def _work(entries: DataFrame, block: int) -> DataFrame:
    """Entries under every pair of blocks that they are part of: ``unit_of``, ``side``."""
    keys = ["label", "width", "table", "code"]
    # Without the vectors: most entries are alone in their bucket.
    met = entries.select("label", "width", "uid", F.posexplode("codes").alias("table", "code"))
    sizes = met.groupBy(*keys).agg(F.count("*").alias("members")).filter("members > 1")
    sizes = sizes.select(*keys, F.ceil(F.col("members") / block).cast("int").alias("parts"))
    met = met.join(materialize(sizes, "buckets"), keys)
    met = met.withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    # A block meets itself and every other block once.
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least("part", o).alias("low"), F.greatest("part", o).alias("high")),
    )
    return met.select("*", F.inline(others)).join(entries.select("uid", "copies", "unit", "codes"), "uid")


def _compare(x: np.ndarray, codes: np.ndarray, left: np.ndarray, right: np.ndarray, table: int, least: float):
    """Pairs of rows at the cosine or above that meet first in this table: two arrays."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for begin in range(0, len(left), 128):
        rows = left[begin : begin + 128]
        a, b = np.nonzero(x[rows] @ x[right].T >= least - _EDGE)
        a, b = rows[a], right[b]
        # A sum of products in a fixed order decides near the limit.
        sure = np.einsum("ij,ij->i", x[a], x[b]) >= least
        new = sure & ~(codes[a, :table] == codes[b, :table]).any(axis=1)
        found.append((a[new], b[new]))
    return tuple(map(np.concatenate, zip(*found)))


def _groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that the pairs join each row to."""
    root = np.arange(n)
    while len(a) and (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    return root


def _links(work: DataFrame, least: float) -> DataFrame:
    """Per unit of work and entry: ``links`` first met there, and a ``peer`` that joins it to its group."""
    order = ["label", "width", "table", "code", "low", "high"]

    def unit(key: tuple, rows: list[tuple]) -> tuple[list, list, list]:
        table, low, high = key[2], key[4], key[5]
        uids = np.array([r[0] for r in rows], np.int64)
        copies = np.array([r[1] for r in rows], np.int64)
        x = np.stack([np.frombuffer(r[2], np.float64) for r in rows])
        codes = np.stack([np.asarray(r[3]) for r in rows])
        part = np.array([r[4] for r in rows])
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        a, b = _compare(x, codes, left, right, table, least)
        if low == high:
            a, b = a[a < b], b[a < b]
        links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
        peer = _groups(len(rows), a, b)
        said = links > 0
        return uids[said].tolist(), links[said].astype(np.int64).tolist(), uids[peer[said]].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                u, n, p = unit(key, rows)
                if u:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in (u, n, p)], names=["uid", "links", "peer"])

        for batch in batches:
            keys = zip(*(batch[c].to_pylist() for c in order))
            for k, row in zip(keys, zip(*(batch[c].to_pylist() for c in ("uid", "copies", "unit", "codes", "part")))):
                if k != key:
                    yield from flush()
                    key, rows = k, []
                rows.append(row)
        yield from flush()

    slim = work.select(*order, "uid", "copies", "unit", "codes", "part")
    dealt = slim.repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "uid long, links long, peer long")


def near_duplicates(
    vectors: DataFrame, *, least: float = COSINE, tables: int = TABLES, bits: int = BITS, block: int = BLOCK
) -> DataFrame:
    """One row for each vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors with equal labels are linked at a cosine of ``least`` or more. Null labels, and
    vectors that are null, empty, zero or hold null or non-finite components, link
    with nothing. Vectors of different lengths are not compared. Repeated rows
    link with each other and stay rows. ``component_id`` is the least id that links
    reach; a vector with a null id takes part, and has its own (null) id only if
    nothing else is reached. ``kept``: the id is that of the component (false for null).
    """
    # Zero is added so that -0.0 and 0.0 are one number.
    flat = F.transform("embedding", lambda c: c.cast("double") + F.lit(0.0))
    slim = vectors.select("vec_id", "label", flat.alias("vector"))
    odd = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    some = F.exists("vector", lambda c: c != 0.0)
    good = F.col("label").isNotNull() & F.coalesce(~odd & some, F.lit(False))
    slim = slim.select("vec_id", "label", F.when(good, F.col("vector")).alias("vector"))
    entries = _entries(slim.filter("vector is not null"), tables, bits)
    links = materialize(_links(_work(entries, block), least), "links")
    joined = components(links.select("uid", "peer"), "uid", "peer")
    counted = links.groupBy("uid").agg(F.sum("links").alias("links"))
    named = entries.select("uid", "label", "vector", "entry", "copies").join(counted, "uid", "left")
    named = named.join(joined.withColumnRenamed("node", "uid"), "uid", "left")
    named = materialize(named.withColumn("root", F.coalesce("root", "uid")), "named")
    lowest = named.groupBy("root").agg(F.min("entry").alias("lowest"))
    named = named.join(lowest, "root").select("label", "vector", "links", "copies", "lowest")
    # Members of an entry have its label and vector.
    out = slim.join(materialize(named, "entries_done"), ["label", "vector"], "left")
    component = F.coalesce("lowest", "vec_id")
    return out.select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
