"""Failure alerts on a stream, from state that Spark keeps per key on RocksDB.

The key is a source and a span of time as long as the window. An event goes to its own span and,
as context, to the next one; so the window of every event lies inside one key, a source with
very many failures is spread over as many keys as it has spans, and an event that is
dated wrongly touches only the span that it names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidelog.functions.times import floor_div
from tidelog.operators import security as sec

# Fixed value: how long tracked failures are kept.
KEPT_S = 86_400

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A processing-time state asks for another batch for ever; without this, a job that
    # takes what has arrived would not end.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class SlidingFailures(StatefulProcessor):
    """Judges the events of one source and span, with those of the span before as context.

    Remembered, for ``kept_s`` seconds after the last one came: time, id, whether the event
    belongs to this span, whether it has raised its alert. Events that come late are
    put in their place and those after them are judged again.
    """

    def __init__(self, threshold: int, window_us: int, id_type: str, kept_s: int):
        self.threshold, self.window_us, self.id_type, self.kept_s = threshold, window_us, id_type, kept_s

    def init(self, handle) -> None:
        # One row with the events in order: as rows of their own, their transfer would take most of the time.
        schema = f"ts_us array<long>, event_id array<{self.id_type}>, own array<boolean>, told array<boolean>"
        self.events = handle.getValueState("events", schema, ttlDurationMs=1000 * self.kept_s)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.events.get()
        events = [*zip(*held)] if held else []
        events += [(r.ts_us, r.event_id, r.own, False) for r in rows]
        # Null ids first, as Spark sorts.
        events.sort(key=lambda e: (e[0], e[1] is not None, e[1] if e[1] is not None else 0))
        times, idents, owns, tolds = map(list, zip(*events))
        for place in [k for k, (own, told) in enumerate(zip(owns, tolds)) if own and not told]:
            at = times[place]
            recent = place + 1 - bisect_right(times, at - self.window_us)
            if recent >= self.threshold:
                tolds[place] = True
                yield Row(source=key[0], ts_us=at, event_id=idents[place], recent=recent)
        self.events.update((times, idents, owns, tolds))

    def close(self) -> None:
        pass


def failure_alerts(
    stream: DataFrame,
    threshold: int = sec.AUTH_FAILURES,
    window_s: int = sec.AUTH_WINDOW_S,
    kept_s: int = KEPT_S,
) -> DataFrame:
    """Failures that are at least the ``threshold``-th of their source within the window.

    Columns ``source``, ``ts_us``, ``event_id``, ``recent``, ``action``; types of source and id as
    they come. An event raises one alert, with the count when it first did, also if
    it comes late or is judged again because of a late one. State of a source and span is forgotten
    ``kept_s`` seconds after its last event arrived, by the clock of the cluster.
    Ids may be null or repeated; rows without source or time are left out. A key holds
    the failures of one source in two windows. Start the stream with ``start_stateful``.
    """
    span_us = window_s * sec.SECOND_US
    failures = stream.filter(
        (F.col("kind") == "AuthenticationFailure") & F.col("source").isNotNull() & F.col("ts_us").isNotNull()
    )
    places = F.array(
        F.struct(floor_div(F.col("ts_us"), span_us).alias("span"), F.lit(True).alias("own")),
        F.struct((floor_div(F.col("ts_us"), span_us) + 1).alias("span"), F.lit(False).alias("own")),
    )
    spread = failures.select("source", "ts_us", "event_id", F.inline(places))
    kinds = {f.name: f.dataType.simpleString() for f in spread.schema}
    counted = spread.groupBy("source", "span").transformWithState(
        SlidingFailures(threshold, span_us, kinds["event_id"], kept_s),
        f"source {kinds['source']}, ts_us long, event_id {kinds['event_id']}, recent long",
        "Append",
        "ProcessingTime",
    )
    return counted.withColumn("action", _blocked(F.col("source")))


def _blocked(source: Column) -> Column:
    return F.format_string("IP %s temporarily blocked", source.cast("string"))


def start_stateful(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append the stream to a table. The settings it needs hold for this stream alone."""
    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        conf.set(name, value)
    try:
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return (
            stream.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )
    finally:
        for name, value in before.items():
            if value is None:
                conf.unset(name)
            else:
                conf.set(name, value)
