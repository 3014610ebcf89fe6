"""A reproducible shuffle into shards by a Feistel permutation of global row numbers.

Only DataFrame functions. Rows are numbered without gaps: cells of equal hash are
counted, the counts add up to the first number of each cell, and rows are counted
inside their cell. The permutation works on pairs (left, right) of digits to the bases
``a`` and ``b``, with ``a * b`` the least such product that holds all numbers; what
falls outside walks on along its cycle. Shard and slot follow from the new place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.session import materialize

SHARDS, ROUNDS = 24, 4
CELL_ROWS = 20_000
_PRIME, _FACTOR, _SMALL = 2_147_483_647, 48_271, 65_521


def bases(rows: int) -> tuple[int, int]:
    """Digits' bases: about the root of the number of rows; less than ``a`` pairs are too many."""
    a = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    return a, max(1, -(-rows // a))


def _mix(x: F.Column, key: int) -> F.Column:
    """A number below the prime from ``x`` < 2^31 and a key."""
    v = ((x + F.lit(key % _PRIME)) % _PRIME * _FACTOR) % _PRIME
    return (v * (v % _SMALL + F.lit(key % _SMALL + 1))) % _PRIME


def _step(k: int, key: int, a: int, b: int):
    """Round ``k``: one digit moves by a mix of the other."""
    if k % 2 == 0:
        return lambda p: F.struct(((p["l"] + _mix(p["r"], key)) % a).alias("l"), p["r"].alias("r"))
    return lambda p: F.struct(p["l"].alias("l"), ((p["r"] + _mix(p["l"], key)) % b).alias("r"))


def feistel(number: F.Column, rows: int, seed: int) -> F.Column:
    """One pass of the permutation of [0, a * b)."""
    a, b = bases(rows)
    pair = F.struct(F.call_function("div", number, F.lit(b)).alias("l"), (number % b).alias("r"))
    for k in range(ROUNDS):
        step = _step(k, (seed * 1_000_003 + k * 7_368_787 + 12_345) % _PRIME, a, b)
        # Through a one-element array, so that each round's expression is written once.
        pair = F.transform(F.array(pair), step)[0]
    return F.transform(F.array(pair), lambda p: p["l"] * b + p["r"])[0]


def permuted(numbered: DataFrame, number: str, rows: int, seed: int) -> DataFrame:
    """``numbered`` with ``place``: a permutation of [0, rows), walked until all are inside.

    A walk ends after at most ``a`` steps, since fewer than ``a`` pairs lie outside. What
    is still outside after one pass, about one row in the root of their number, is
    walked on in an expression that stops by itself.
    """
    a, b = bases(rows)
    steps = F.lit(min(a * b - rows, 1 << 20))
    first = numbered.withColumn("place", feistel(F.col(number), rows, seed))
    walked = F.aggregate(
        F.sequence(F.lit(0), steps), F.col("place"), lambda p, _: F.when(p < rows, p).otherwise(feistel(p, rows, seed))
    )
    return first.withColumn("place", F.when(F.col("place") < rows, F.col("place")).otherwise(walked))


def numbered(rows: DataFrame, keys: list[str], cell_rows: int = CELL_ROWS) -> tuple[DataFrame, int]:
    """Rows with ``number``, gapless from 0, and how many there are; a written table.

    The number depends only on the values of the keys; rows that are equal in all keys
    are interchangeable, and are counted, not sorted.
    """
    distinct = rows.groupBy(*keys).agg(F.count("*").alias("copies"))
    distinct = materialize(distinct.withColumn("h", F.xxhash64(*keys)), "distinct_rows")
    total, kinds = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    cells = max(1, -(-kinds // cell_rows))
    distinct = distinct.withColumn("cell", F.pmod("h", F.lit(cells)))
    per_cell = distinct.groupBy("cell").agg(F.sum("copies").alias("n"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = per_cell.select("cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("cell").orderBy("h", *keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = distinct.withColumn("within", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    placed = placed.join(first, "cell").withColumn("low", F.col("first") + F.col("within"))
    # Repeated rows are written out again, numbers in a row.
    each = F.explode(F.sequence(F.col("low"), F.col("low") + F.col("copies") - 1))
    return placed.select(*keys, each.alias("number")), int(total)


def shards(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", count: int = SHARDS, seed: int = 1
) -> DataFrame:
    """One row for each document: its place in a reproducible shuffle into ``count`` shards.

    Columns ``doc_id``, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``law``
    ("rows": counts of the shards differ by one at most), ``shard``, ``slot`` (gapless from 0)
    and ``grown_shard`` (null). A null text has no bytes. Null ids and repeated rows count as
    rows; equal rows get different slots. The result depends on the rows and the seed,
    not on how they are stored. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), (F.length(body).cast("long") + 8).alias("size"), F.crc32(body).alias("text_crc32")
    )
    rows, total = numbered(slim, ["doc_id", "size", "text_crc32"])
    placed = permuted(rows, "number", total, seed)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % count).cast("int").alias("shard"),
        F.call_function("div", "place", F.lit(count)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
