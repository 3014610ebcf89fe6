"""Streaming jobs. Each one is the batch operator applied to micro-batches.

Where a result depends on the order of all earlier events (sequences), the little that
must be remembered is itself a table, joined in by key. So a source that sends
a third of all events is split over tasks as in the batch operator, and no
single stateful task owns it. Alerts need only a window of time, and keep their
state in Spark's state store (``stateful``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidelog.functions.times import floor_div
from tidelog.operators import quality as q
from tidelog.operators import search as so
from tidelog.operators.behaviour import route_events
from tidelog.schema import EVENT_LOG
from tidelog.sources import eventlog as el
from tidelog.streaming.compaction import compact
from tidelog.streaming.tables import read_state, write_batch, write_state

Handler = Callable[[DataFrame, int], None]


def file_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    kind: str = "parquet",
    pattern: str | None = None,
    files_per_batch: int | None = None,
    bytes_per_batch: str | None = None,
) -> DataFrame:
    """Files as they arrive. The batch size is the rate limit of the stream."""
    reader = spark.readStream.schema(schema).format(kind)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.load(path)


def start(
    stream: DataFrame, handler: Handler, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Without ``every`` the job takes what has arrived and ends, for an outer
    scheduler; with it, it runs on, for example every ``5 minutes``."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.foreachBatch(handler)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


# -- ingest ------------------------------------------------------------------------------


def ingest_handler(root: str, temporal: bool = True, compact_every: int | None = None) -> Handler:
    """Validate, split off frames, write events by day; issues and a ledger aside.

    Events are written as ``write_event_log`` writes them: sorted, compressed, with bloom filters
    and a bound on rows per file. ``temporal`` also reports, of each batch, ids that occur
    more than once and steps of over an hour between neighbours in time. A batch of files
    has no order of arrival; a stream that numbers its rows uses ``sequence_handler`` for
    that. Reports without rows are not written.

    After each ``compact_every`` batches the small files of earlier ones are packed; read such a log
    by ``compaction.read_compacted``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        checked = q.validate_events(batch).persist()
        try:
            ledger = checked.agg(
                F.count(F.lit(1)).alias("events"),
                F.count_if(~F.col("passed")).alias("invalid"),
                F.count_if(F.col("event_type") == "frame").alias("frames"),
                F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"),
            )
            [found] = ledger.collect()
            if found.invalid:
                issues = checked.filter(~F.col("passed")).select("event_id", "errors")
                write_batch(issues, f"{root}/issues", batch_id)
            events = checked
            if found.frames:
                write_batch(el.frames(checked), f"{root}/frames", batch_id)
                events = el.without_frames(checked)
            # Broken events are reported and kept.
            events = events.drop("errors", "passed")
            write_batch(el.by_day(events), f"{root}/events", batch_id, ["event_date"], el.event_options())
            if temporal:
                copies = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
                steps = _steps(events, 1000 * q.LARGE_GAP_US)
                for name, report in (("duplicates", copies), ("gaps", steps)):
                    rows = report.persist()
                    if not rows.isEmpty():
                        write_batch(rows, f"{root}/{name}", batch_id)
                    rows.unpersist()
            write_batch(spark.createDataFrame([found], ledger.schema), f"{root}/ledger", batch_id)
            if compact_every and batch_id and batch_id % compact_every == 0:
                # This batch may run again, those before it are done.
                compact(spark, f"{root}/events", EVENT_LOG, before=batch_id)
        finally:
            checked.unpersist()

    return handle


def _steps(events: DataFrame, limit_ns: int) -> DataFrame:
    """Events over ``limit_ns`` after the one before them in time, with the step.

    A longer step lies between two spans of that length, so the first and last event of
    each span are enough.
    """
    event = F.struct("timestamp_ns", "event_id")
    spans = (
        events.filter(F.col("timestamp_ns").isNotNull())
        .groupBy(floor_div(F.col("timestamp_ns"), limit_ns).alias("span"))
        .agg(F.min(event).alias("first"), F.max("timestamp_ns").alias("last"))
    )
    step = F.col("first.timestamp_ns") - F.lag("last").over(Window.orderBy("span"))
    return spans.select("first.timestamp_ns", "first.event_id", step.alias("step")).filter(F.col("step") > limit_ns)


# -- sequences ------------------------------------------------------------------------------


#: Late ids are remembered as far below the largest id.
LATE_IDS = 1_000_000


def sequence_handler(
    root: str, key: str = "source", parts: int | None = None, horizon: int = LATE_IDS
) -> Handler:
    """Gaps, late and repeated ids per source, across batches.

    Remembered: the largest id per source, and the ids that were late once, as far as
    they are at most ``horizon`` below it. An older id that comes again counts as late.
    Rows need ``key``, ``id`` (a number, of any sign), ``arrival`` and ``event_id`` (of any type,
    also null).
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(key, "id", "arrival", "event_id").persist()
        source = rows.select(key, "id")
        top_path, late_path = f"{root}/top", f"{root}/late"
        top = read_state(spark, top_path, batch_id, source.schema)
        late_before = read_state(spark, late_path, batch_id, source.schema)
        try:
            # The remembered maximum enters as a row that arrived before all others.
            first = F.lit(-(2**63)).cast("long")
            none = F.lit(None).cast(rows.schema["event_id"].dataType)
            carried = top.select(key, "id", first.alias("arrival"), none.alias("event_id"), F.lit(True).alias("_carried"))
            both = carried.unionByName(rows.withColumn("_carried", F.lit(False)))
            issues = q.sequence_issues(both, "id", "arrival", "event_id", [key], parts).filter(~F.col("_carried"))
            again = late_before.withColumn("_again", F.lit(True))
            issues = issues.join(again, [key, "id"], "left").withColumn(
                "issue",
                F.when(
                    (F.col("issue") == "out_of_order") & F.col("_again").isNotNull(), "duplicate"
                ).otherwise(F.col("issue")),
            )
            issues = issues.select(key, "id", "arrival", "event_id", "prev_max", "issue").persist()
            write_batch(issues, f"{root}/issues", batch_id)
            new_top = top.unionByName(source).groupBy(key).agg(F.max("id").alias("id"))
            write_state(new_top, top_path, batch_id)
            late = issues.filter(F.col("issue") != "gap").select(key, "id")
            late = late_before.unionByName(late).distinct()
            near = new_top.withColumnRenamed("id", "_top")
            late = late.join(near, key).filter(F.col("id") >= F.col("_top") - F.lit(horizon)).drop("_top")
            write_state(late, late_path, batch_id)
            issues.unpersist()
        finally:
            rows.unpersist()

    return handle


# -- routing, following, de-duplication ---------------------------------------------------------


def route_handler(
    routes: list[tuple[str, str]], handlers: dict[str, Handler], kind: str
) -> Handler:
    """Each handler gets the events of its types, ``*`` all of them."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        routed = route_events(batch, routes, kind).persist()
        try:
            for name, handler in handlers.items():
                handler(routed.filter(F.col("handler") == name).drop("handler"), batch_id)
        finally:
            routed.unpersist()

    return handle


def table_handler(path: str) -> Handler:
    return lambda batch, batch_id: write_batch(batch, path, batch_id)


def follow(stream: DataFrame, spec: so.SearchSpec, time: str, text: str) -> DataFrame:
    """The hits among the events still to come; paging does not apply."""
    return so.matching(stream, spec, time, text)


def dedup(stream: DataFrame, ident: str, time: str, delay: str) -> DataFrame:
    """One row per id among copies that arrive within ``delay`` of each other.

    Copies inside one Arrow batch are dropped before the shuffle, so an id with
    very many copies does not pile up in one task.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(ident).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            _, first = np.unique(codes, return_index=True)
            yield batch.take(pa.array(np.sort(first)))

    return (
        stream.mapInArrow(local, stream.schema)
        .withWatermark(time, delay)
        .dropDuplicatesWithinWatermark([ident])
    )


def append(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
