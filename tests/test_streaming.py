"""A stream over several files must give what the batch operator gives."""

import datetime as dt
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidelog.operators import quality as q
from tidelog.operators import security as sec
from tidelog.plans import streaming as plans
from tidelog.schema import EVENT_LOG, RAW_EVENTS
from tidelog.session import work_dir
from tidelog.sources import eventlog as el
from tidelog.sources import tables as t
from tidelog.streaming import jobs, stateful
from tidelog.streaming.tables import read_table


@pytest.fixture(scope="module")
def parts(spark, small):
    """Four files in order of arrival, written one after the other."""
    path = work_dir(spark, "parts")
    raw = t.table(spark, small, "events")
    for i in range(4):
        part = raw.filter(F.col("event_id").between(i * 250, i * 250 + 249))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, parts):
    return jobs.file_stream(spark, parts, RAW_EVENTS, files_per_batch=1)


def run(frame, handler, out):
    done = jobs.start(frame, handler, f"{out}/checkpoint")
    done.awaitTermination()
    return done


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_ingest_and_repeat(spark, parts, small):
    out = work_dir(spark, "ingest")
    handler = jobs.ingest_handler(out)
    run(t.as_event_log(stream(spark, parts)), handler, out)
    log = t.event_log(spark, small)
    assert rows(read_table(spark, f"{out}/events", EVENT_LOG)) == rows(log)
    # A batch that runs again replaces what it wrote.
    ledger = read_table(spark, f"{out}/ledger", "events long")
    assert ledger.count() == 4
    first = log.filter(F.col("event_id").cast("long") < 250)
    handler(first, 0)
    assert rows(read_table(spark, f"{out}/events", EVENT_LOG)) == rows(log)
    assert read_table(spark, f"{out}/ledger", "events long").count() == 4


def test_ingest_splits_frames_and_reports_issues(spark):
    out = work_dir(spark, "ingest")
    data = [
        (1, "frame", None, None, '{"data": "aGk="}', "s", "1"),
        (2, "click", None, None, "{", "", "2"),
    ]
    jobs.ingest_handler(out)(spark.createDataFrame(data, EVENT_LOG), 0)
    assert [r.event_id for r in read_table(spark, f"{out}/events", EVENT_LOG).collect()] == ["2"]
    issues = read_table(spark, f"{out}/issues", "event_id string, errors array<string>")
    assert [(r.event_id, len(r.errors)) for r in issues.collect()] == [("2", 2)]
    assert read_table(spark, f"{out}/frames", "event_id string").count() == 1


ALERT = "source {0}, ts_us long, event_id {1}, recent long, action string"
FAILURE = "source string, ts_us long, event_id string, kind string"


def alerts_of(spark, frame, kinds=("string", "string"), **options):
    out = work_dir(spark, "alerts")
    alerts = stateful.failure_alerts(frame, **options)
    stateful.start_stateful(alerts, f"{out}/alerts", f"{out}/checkpoint").awaitTermination()
    return read_table(spark, f"{out}/alerts", ALERT.format(*kinds))


def batches_of(spark, batches, schema=FAILURE):
    """A stream of one file for each list of rows."""
    path = work_dir(spark, "batches")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def plain_alerts(rows, threshold=5, window_us=300_000_000):
    """What a list of failures in any order must raise: one alert a row, by source, time and id."""
    want = []
    for source in {r[0] for r in rows if r[0] is not None}:
        mine = sorted(((r[1], r[2]) for r in rows if r[0] == source), key=lambda e: (e[0], e[1] is not None, e[1] or ""))
        for place, (at, ident) in enumerate(mine):
            recent = place + 1 - sum(t <= at - window_us for t, _ in mine)
            if recent >= threshold:
                want.append((source, at, ident, recent, f"IP {source} temporarily blocked"))
    return sorted(want, key=str)


def test_alerts_across_batches(spark, parts, small):
    week = 7 * 86_400
    got = alerts_of(spark, t.as_security_log(stream(spark, parts)), ("long", "long"), window_s=week)
    want = sec.auth_alerts(t.security_log(spark, small), window_s=week)
    assert rows(got) == rows(want.select(*got.columns))
    assert got.count() > 0


def test_alerts_with_odd_events(spark):
    """An event of the year 2096 in the first batch, null, repeated and negative times and ids."""
    second = 1_000_000
    failure = lambda s, at, ident: (s, at * second, ident, "AuthenticationFailure")
    batches = [
        [failure("a", k, f"e{k}") for k in range(3)] + [failure("a", 4_000_000_000, "future"), failure("b", -5, None)],
        [failure("a", k, f"e{k}") for k in range(3, 6)] + [failure("b", k, None) for k in range(-4, 2)],
        [failure("c", 7, "same")] * 3 + [failure("c", 8, None)] * 3 + [failure(None, 8, "x"), ("a", 9, "z", "AuthenticationSuccess")],
        [failure("c", 300 + k, "same") for k in range(7)] + [failure("c", 8, "same")],
    ]
    got = alerts_of(spark, batches_of(spark, batches))
    every = [r for batch in batches for r in batch if r[3] == "AuthenticationFailure"]
    # Of batch three, the last event of "c" comes late and raises the count of what follows; what has
    # raised its alert before keeps the count of then.
    want = plain_alerts(every)
    key = lambda r: (r[0], r[1], r[2])
    assert sorted(map(key, rows_any(got)), key=str) == sorted(map(key, want), key=str)
    assert [r for r in rows_any(got) if r[0] in "ab"] == [r for r in want if r[0] in "ab"]
    assert {r.event_id for r in got.collect() if r.source == "a"} == {"e4", "e5"}


def rows_any(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("kept_s, alerts", [(1, 0), (3600, 2)])
def test_forgotten_state(spark, kept_s, alerts):
    """A job that starts again goes on with its state, but for what came longer ago than state is kept."""
    path, out = work_dir(spark, "batches"), work_dir(spark, "alerts")
    failures = [("a", k * 1_000_000, f"e{k}", "AuthenticationFailure") for k in range(6)]
    for batch in (failures[:4], failures[4:]):
        spark.createDataFrame(batch, FAILURE).coalesce(1).write.mode("append").parquet(path)
        frame = stateful.failure_alerts(spark.readStream.schema(FAILURE).parquet(path), kept_s=kept_s)
        stateful.start_stateful(frame, f"{out}/alerts", f"{out}/checkpoint").awaitTermination()
        time.sleep(3)
    assert read_table(spark, f"{out}/alerts", ALERT.format("string", "string")).count() == alerts


def test_stateful_settings_are_put_back(spark):
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    alerts_of(spark, batches_of(spark, [[("a", 1, "e", "AuthenticationFailure")]]))
    assert spark.conf.get(name) == before


def test_sequences_of_text_and_negative_ids(spark):
    out = work_dir(spark, "sequence")
    handler = jobs.sequence_handler(out)
    cols = "source string, id long, arrival long, event_id string"
    batches = [[(-9, "a"), (-8, None)], [(-5, "b"), (-6, "c")], [(-6, "d"), (-4, None), (0, "e")]]
    for k, batch in enumerate(batches):
        handler(spark.createDataFrame([("s", i, 10 * k + n, e) for n, (i, e) in enumerate(batch)], cols), k)
    got = read_table(spark, f"{out}/issues", "id long, event_id string, prev_max long, issue string")
    assert rows_any(got.select("id", "event_id", "prev_max", "issue")) == sorted(
        [(-5, "b", -8, "gap"), (-6, "c", -5, "out_of_order"), (-6, "d", -5, "duplicate"), (0, "e", -4, "gap")], key=str
    )


def test_sequences_across_batches(spark, parts, small):
    out = work_dir(spark, "sequence")
    one_key = lambda f: f.withColumn("session", F.col("session") % 2)
    run(one_key(t.as_arrivals(stream(spark, parts))), jobs.sequence_handler(out, "session", 9), out)
    cols = ["session", "event_id", "id", "prev_max", "issue"]
    got = read_table(spark, f"{out}/issues", "session long, event_id long, id long, prev_max long, issue string")
    want = q.sequence_issues(one_key(t.arrivals(spark, small)), "id", "arrival", "event_id", ["session"])
    assert rows(got.select(*cols)) == rows(want.select(*cols))
    assert {r[0] for r in got.select("issue").distinct().collect()} >= {"gap", "out_of_order"}


def test_repeat_of_a_late_id_in_a_later_batch(spark):
    out = work_dir(spark, "sequence")
    handler = jobs.sequence_handler(out)
    cols = "source string, id long, arrival long, event_id long"
    for batch, ids in enumerate([[1, 5, 3], [3, 6], [3]]):
        data = [("s", i, batch * 10 + n, batch * 10 + n) for n, i in enumerate(ids)]
        handler(spark.createDataFrame(data, cols), batch)
    got = read_table(spark, f"{out}/issues", "event_id long, issue string")
    assert rows(got) == [(1, "gap"), (2, "out_of_order"), (10, "duplicate"), (20, "duplicate")]


def test_dedup_across_batches(spark, parts, small):
    out = work_dir(spark, "dedup")
    ids = t.as_arrivals(stream(spark, parts)).select("id", F.timestamp_micros("ts_us").alias("seen"))
    jobs.append(jobs.dedup(ids, "id", "seen", "10 days").select("id"), f"{out}/ids", f"{out}/cp").awaitTermination()
    got = read_table(spark, f"{out}/ids", "id long")
    assert rows(got) == rows(t.arrivals(spark, small).select("id").distinct())


def test_interval_trigger_runs_on(spark, parts):
    out = work_dir(spark, "interval")
    query = jobs.start(
        stream(spark, parts).select("event_id"), jobs.table_handler(f"{out}/t"), f"{out}/cp", "1 second"
    )
    try:
        query.processAllAvailable()
        assert query.isActive
        assert read_table(spark, f"{out}/t", "event_id long").count() == 1000
    finally:
        query.stop()


def test_written_log_can_be_the_source(spark, small):
    path = work_dir(spark, "log")
    el.write_event_log(t.event_log(spark, small), path)
    out = work_dir(spark, "again")
    run(jobs.file_stream(spark, path, EVENT_LOG), jobs.ingest_handler(out), out)
    assert read_table(spark, f"{out}/events", EVENT_LOG).count() == 1000


def test_ingest_reports_repeated_ids_and_gaps(spark):
    out = work_dir(spark, "ingest")
    data = [(t * 60_000_000_000, "click", None, None, "{}", "s", i) for t, i in [(1, "1"), (2, "2"), (3, "2"), (90, "3")]]
    data.append((91 * 60_000_000_000, None, None, None, "{}", "s", "4"))
    loose = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_LOG)
    jobs.ingest_handler(out)(spark.createDataFrame(data, loose), 0)
    assert [tuple(r) for r in read_table(spark, f"{out}/duplicates", "event_id string, copies long").collect()] == [("2", 2)]
    assert [r.event_id for r in read_table(spark, f"{out}/gaps", "event_id string, step long").collect()] == ["3"]
    # Nothing to report, nothing written.
    assert not el.folder_exists(spark, f"{out}/frames")
    # An event without a type is reported and kept.
    assert read_table(spark, f"{out}/events", EVENT_LOG).count() == 5
    assert [r.event_id for r in read_table(spark, f"{out}/issues", "event_id string").collect()] == ["4"]


def test_late_failures_count_for_later_events(spark):
    failures = [("a", t * 1_000_000, f"e{t}", "AuthenticationFailure") for t in (10, 20, 30, 40, 290, 1000)]
    batches = [[r for r in failures if r[2] in ("e10", "e20", "e30", "e290")], [failures[5]], [failures[3]]]
    got = alerts_of(spark, batches_of(spark, batches)).collect()
    want = sec.auth_alerts(spark.createDataFrame(failures, FAILURE)).collect()
    assert [(r.event_id, r.recent) for r in got] == [(r.event_id, r.recent) for r in want] == [("e290", 5)]


@pytest.mark.parametrize("ids", [range(40), [*range(5), None, *range(900, 920)], []])
def test_arriving_files_read_the_events_twice(spark, monkeypatch, ids):
    """Once for their bounds and once to deal them out, whatever the number of files; oldest events in the oldest file."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    data = [(k, dt.datetime(2024, 1, 1), 1, "error", 0.5, "{}") for k in ids]
    raw = spark.createDataFrame(data, plans.RAW_EVENTS).mapInArrow(count, plans.RAW_EVENTS)
    monkeypatch.setattr(plans.t, "table", lambda *a: raw)
    got = plans._raw(spark, "", 8)
    assert read.value <= 2 * len(data)
    path = work_dir(spark, "seen")
    seen = []
    query = got.writeStream.foreachBatch(lambda rows, k: seen.append([r.event_id for r in rows.collect()]))
    query.option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    places = [[k + 7 * (k % 50 == 0) for k in batch] for batch in seen if batch]
    assert sorted(k for batch in seen for k in batch) == sorted(k for k in ids if k is not None)
    assert all(max(a) < min(b) for a, b in zip(places, places[1:]))


def test_state_of_alerts_is_one_value():
    """However many events a key has, its state is read and written as one row for each batch."""
    moves = []

    class Value:
        held = None

        def get(self):
            moves.append("get")
            return self.held

        def update(self, value):
            moves.append("update")
            self.held = tuple(map(list, value))

    class Handle:
        def getValueState(self, name, schema, ttlDurationMs):  # noqa: N802
            return Value()

    judge = stateful.SlidingFailures(3, 1_000, "string", 60)
    judge.init(Handle())
    row = lambda at, ident: Row(ts_us=at, event_id=ident, own=True)
    batches = [[row(k, f"e{k}") for k in (10, 20, 5)], [row(15, None)], [row(30, "e30"), row(1_012, "far")]]
    told = [[(r.event_id, r.recent) for r in judge.handleInputRows(("a",), iter(batch), None)] for batch in batches]
    assert told == [[("e20", 3)], [(None, 3)], [("e30", 5), ("far", 4)]]
    assert moves == ["get", "update"] * 3
