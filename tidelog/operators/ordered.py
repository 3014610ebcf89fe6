"""Ordered-event building blocks that hold when one group is huge.

A window partitioned by session puts a whole session into one task, which fails once
one session holds a third of the table. Here the rows are dealt out by ranges of (keys,
order), whatever the sizes of the groups, and written. A range is a *cell*; a large group
lies in several cells, one after the other, and windows run inside a cell. What a cell
needs to know of earlier ones is little, as only the first group of a cell can have
begun before it:

* ``with_previous``  copies the last few rows before a cell into that cell, so that
  ``lag`` and short row frames see what they would see uncut;
* ``running``        adds the totals of the earlier cells to running sums and maxima;
* ``trailing_count`` counts the events of the last ``span`` as the difference of two
  running counts, which stays linear where a range frame is quadratic.

The lists of groups at the edges of cells have at most two rows for each partition, and
those of the cells that need a cell's last rows one, so they are broadcast. There is one
plan for all sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidelog.session import materialize

CELL = "_cell"
COPY = "_copy"
_PLACE = "_place"


def _sorted(order: list[str], down: bool) -> list[Column]:
    return [F.col(c).desc() if down else F.col(c).asc() for c in order]


@dataclass(frozen=True)
class Split:
    """A frame whose windows over ``by`` all lie inside one range of rows."""

    frame: DataFrame
    keys: list[str]
    order: list[str]
    down: bool = False

    @property
    def by(self) -> list[str]:
        return [CELL, *self.keys]

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*_sorted(self.order, self.down))

    def rows(self, start: int, end: int) -> WindowSpec:
        return self.window.rowsBetween(start, end)

    def own(self, frame: DataFrame) -> DataFrame:
        """Drop the copied rows and the helper columns."""
        if COPY in frame.columns:
            frame = frame.filter(~F.col(COPY)).drop(COPY)
        return frame.drop(CELL)

    def at_edges(self) -> DataFrame:
        """The rows of the first and the last group of each cell."""
        # A struct is never null, also if a key is, and is compared field by field.
        group = F.struct(CELL, *self.keys)
        ends = self.frame.groupBy(CELL).agg(F.min(group).alias("_first"), F.max(group).alias("_last"))
        edges = ends.select(F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_edge"))
        return self.frame.join(F.broadcast(edges), group == F.col("_edge")).drop("_edge")


def _dealt(frame: DataFrame, keys: list[str], order: list[str], parts: int | None, down: bool) -> DataFrame:
    by = [*map(F.col, keys), *_sorted(order, down)]
    return frame.repartitionByRange(parts, *by) if parts else frame.repartitionByRange(*by)


def split_groups(
    frame: DataFrame, keys: list[str], order: list[str], parts: int | None = None, down: bool = False
) -> Split:
    """Cut the rows, sorted by keys and order, into ranges of about equal size.

    ``order`` holds columns of any type that can be sorted. ``parts`` is the number of
    ranges; without it, the session decides. ``down`` turns the order round.
    """
    dealt = _dealt(frame, keys, order, parts, down)
    # Written, so that every use of it sees the same ranges.
    return Split(materialize(dealt.withColumn(CELL, F.spark_partition_id()), "cells"), list(keys), list(order), down)


def with_previous(
    frame: DataFrame,
    keys: list[str],
    at: str,
    seq: str,
    depth: int = 1,
    parts: int | None = None,
    down: bool = False,
) -> Split:
    """Split so that every row sees its ``depth`` predecessors (``down``: successors) in its window.

    Apply window functions over ``split.window``, then call ``split.own``. The last rows of a cell go
    to the next ones whatever their keys; those of other groups stand alone there and are dropped.
    """
    order = [at, seq]
    dealt = _dealt(frame, keys, order, parts, down).sortWithinPartitions(*map(F.col, keys), *_sorted(order, down))
    # The upper bits of the id are the number of the partition, the lower ones count its rows.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    cells = materialize(dealt.withColumns({CELL: F.spark_partition_id(), _PLACE: place}), "cells")
    # One row for each partition, and with it the next ones that need its last rows.
    sizes = sorted(cells.groupBy(CELL).agg(F.max(_PLACE) + 1).collect())
    routes = frame.sparkSession.createDataFrame(_routes(sizes, depth), f"{CELL} int, _first long, _routes array<struct<to int, first long>>")
    sent = F.transform(F.filter("_routes", lambda r: F.col(_PLACE) >= r.first), lambda r: F.struct(r.to.alias(CELL), F.lit(True).alias("copy")))
    stays = F.array(F.struct(F.col(CELL), F.lit(False).alias("copy")))
    goes = F.when(F.col(_PLACE) >= F.col("_first"), F.concat(stays, sent)).otherwise(stays)
    both = cells.join(F.broadcast(routes), CELL, "left").withColumn("_goes", F.explode(goes))
    both = both.select(*frame.columns, F.col("_goes")[CELL].alias(CELL), F.col("_goes")["copy"].alias(COPY))
    return Split(both, list(keys), order, down)


def _routes(sizes: list[tuple[int, int]], depth: int) -> list[tuple]:
    """Which rows of a cell, from which place on, the later cells need: those of the ``depth`` before them."""
    routes: dict[int, list[tuple[int, int]]] = {}
    for i, (to, _) in enumerate(sizes):
        wanted, j = depth, i
        while wanted > 0 and j > 0:
            j -= 1
            cell, rows = sizes[j]
            routes.setdefault(cell, []).append((to, max(rows - wanted, 0)))
            wanted -= rows
    return [(cell, min(first for _, first in ways), ways) for cell, ways in routes.items()]


_COMBINE = {
    "sum": lambda before, inside: F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0)),
    "max": lambda before, inside: F.greatest(before, inside),
}
_AGGREGATE = {"sum": F.sum, "max": F.max}


def running(
    frame: DataFrame,
    keys: list[str],
    order: list[str],
    measures: dict[str, tuple[str, Column]],
    include_current: bool = True,
    parts: int | None = None,
) -> DataFrame:
    """Add running sums or maxima: ``{"name": ("sum" | "max", column)}``."""
    return running_over(split_groups(frame, keys, order, parts), measures, include_current)


def running_over(split: Split, measures: dict[str, tuple[str, Column]], include_current: bool = True) -> DataFrame:
    """``running`` on rows that are cut already, without copies; so one cut serves several operators."""
    keys = split.keys
    here = split.rows(Window.unboundedPreceding, Window.currentRow if include_current else -1)
    out = split.frame.withColumns(
        {name: _AGGREGATE[kind](col).over(here) for name, (kind, col) in measures.items()}
    )
    group = F.struct(CELL, *keys)
    totals = (
        split.at_edges()
        .groupBy(*split.by)
        .agg(*[_AGGREGATE[kind](col).alias(f"_t_{n}") for n, (kind, col) in measures.items()])
    )
    # At most two rows per cell, so this window and the table are small.
    earlier = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        group.alias("_of"),
        *[_AGGREGATE[kind](f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, (kind, _) in measures.items()],
    )
    out = out.join(F.broadcast(carried), group == F.col("_of"), "left")
    out = out.withColumns(
        {n: _COMBINE[kind](F.col(f"_c_{n}"), F.col(n)) for n, (kind, _) in measures.items()}
    )
    return out.drop(CELL, *carried.columns)


def row_numbers(
    frame: DataFrame, keys: list[str], at: str, seq: str, name: str = "row_no", parts: int | None = None
) -> DataFrame:
    """1-based position of each row in its group, or in the whole table."""
    one = {name: ("sum", F.lit(1).cast("long"))}
    return running(frame, keys, [at, seq], one, parts=parts)


def trailing_count(
    frame: DataFrame,
    keys: list[str],
    at: str,
    seq: str,
    span: int,
    name: str = "recent",
    parts: int | None = None,
) -> DataFrame:
    """Rows of the same keys in ``(at - span, at]`` that do not come later.

    The current row counts. The result has ``keys``, ``at``, ``seq`` and ``name``, a row for each
    row; ``seq`` is of any type that can be sorted. Rows that are equal in all of these are
    counted together and numbered afterwards, so none is lost. Each is joined by a probe
    at ``at - span`` that sorts after the rows of that instant; the two running counts
    differ by the rows inside the span.
    """
    counts = frame.groupBy(*keys, at, seq).agg(F.count(F.lit(1)).alias("_n"))
    pair = F.array(
        F.struct(F.col(at).alias("place"), F.lit(False).alias("probe")),
        F.struct((F.col(at) - F.lit(span)).alias("place"), F.lit(True).alias("probe")),
    )
    doubled = counts.select(*keys, at, seq, "_n", F.inline(pair)).withColumnsRenamed({"place": "_at", "probe": "_probe"})
    rows = {"_cum": ("sum", F.when(F.col("_probe"), 0).otherwise(F.col("_n")))}
    counted = running(doubled, keys, ["_at", "_probe", seq], rows, parts=parts)
    is_row = ~F.col("_probe")
    both = counted.groupBy(*keys, at, seq).agg(
        F.max("_n").alias("_n"),
        F.max(F.when(is_row, F.col("_cum"))).alias("_here"),
        F.max(F.when(~is_row, F.col("_cum"))).alias("_then"),
    )
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_number")
    return both.select("*", number).select(
        *keys, at, seq, (F.col("_here") - F.col("_then") - F.col("_n") + F.col("_number")).alias(name)
    )
