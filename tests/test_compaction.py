"""Packing of small files: every row once at each step, and few files afterwards."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.schema import EVENT_LOG
from tidelog.session import work_dir
from tidelog.streaming import compaction as c
from tidelog.streaming import jobs
from tidelog.streaming.tables import BATCH

NS_OF_DAY = 86_400 * 10**9


def events(first, n, days=3):
    return [((i % days) * NS_OF_DAY + i, "click", None, None, "{}", "s", str(i)) for i in range(first, first + n)]


@pytest.fixture
def log(spark):
    """Seven batches of rising size over three days."""
    out = work_dir(spark, "compaction")
    handler, first = jobs.ingest_handler(out, temporal=False), 0
    for batch in range(7):
        handler(spark.createDataFrame(events(first, 30 + 6 * batch), EVENT_LOG), batch)
        first += 30 + 6 * batch
    return f"{out}/events", first


def ids(spark, path):
    return sorted(int(r.event_id) for r in c.read_compacted(spark, path, EVENT_LOG).collect())


def folders(spark, path):
    rows = c.read_compacted(spark, path, EVENT_LOG, folders=True)
    return {(str(r.event_date), r[BATCH]): r["n"] for r in rows.groupBy("event_date", BATCH).agg(F.count("*").alias("n")).collect()}


def test_best_fit_by_hand():
    # 6 | 5 and 4 into the fullest that holds them: 6+4, 5+3+2.
    assert c.best_fit([2, 6, 3, 5, 4], 10) == [1, 0, 1, 1, 0]
    assert c.best_fit([], 10) == []
    assert c.best_fit([10, 10], 10) == [0, 1]
    with pytest.raises(ValueError):
        c.best_fit([11], 10)


def test_best_fit_fills_all_bins_but_one():
    rnd = random.Random(1)
    for _ in range(50):
        sizes = [rnd.randint(1, 50) for _ in range(rnd.randint(1, 80))]
        bins = c.best_fit(sizes, 100)
        filled = [sum(s for s, b in zip(sizes, bins) if b == number) for number in range(max(bins) + 1)]
        assert max(filled) <= 100 and sum(f <= 50 for f in filled) <= 1


def test_rows_stay_and_folders_go(spark, log):
    path, n = log
    assert len(folders(spark, path)) == 21
    assert c.compact(spark, path, EVENT_LOG, before=6) == 18
    assert ids(spark, path) == list(range(n))
    # Of each day one packed folder, and the batch that may run again.
    assert {batch for _, batch in folders(spark, path)} == {-1, 6}
    assert c.clean(spark, path) == 18 and c.clean(spark, path) == 0
    assert ids(spark, path) == list(range(n))
    assert spark.read.schema(EVENT_LOG).parquet(path).count() == n
    # What was packed is packed again, with what has come since.
    assert c.compact(spark, path, EVENT_LOG, before=7) == 6
    assert {batch for _, batch in folders(spark, path)} == {-2}
    assert ids(spark, path) == list(range(n))
    # Nothing is left to pack.
    assert c.compact(spark, path, EVENT_LOG, before=7) == 0
    assert ids(spark, path) == list(range(n))
    assert spark.read.schema(EVENT_LOG).parquet(path).count() == n


def test_room_bounds_files_and_large_folders_stay(spark, log):
    path, n = log
    before = folders(spark, path)
    c.compact(spark, path, EVENT_LOG, before=7, room=40)
    after = folders(spark, path)
    # Folders of more than half the room are not written again.
    assert {u for u in after if u[1] >= 0} >= {u for u, rows in before.items() if rows > 20}
    files = (
        c.read_compacted(spark, path, EVENT_LOG, folders=True)
        .filter(F.col(BATCH) < 0)
        .groupBy("_metadata.file_path")
        .agg(F.count("*").alias("n"))
    )
    assert 0 < max(r.n for r in files.collect()) <= 40
    assert ids(spark, path) == list(range(n))


@pytest.mark.parametrize("lost", ["rows", "marker"])
def test_a_failed_compaction_is_finished(spark, log, lost, monkeypatch):
    path, n = log

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        # Before the rows are written, or between them and the marker.
        broken.setattr(c.el, "event_options", fail) if lost == "rows" else broken.setattr(c, "_mark", fail)
        with pytest.raises(OSError):
            c.compact(spark, path, EVENT_LOG, before=6)
    assert ids(spark, path) == list(range(n))
    # The plan stays that of the failed run, also if more batches are done by now.
    assert c.compact(spark, path, EVENT_LOG, before=7) == 18
    assert ids(spark, path) == list(range(n))
    assert {batch for _, batch in folders(spark, path)} == {-1, 6}


def test_a_plan_half_written_is_none(spark, log):
    path, n = log
    spark.range(3).write.parquet(f"{path}/_compactions/plan-1")
    c.el.drop_folder(spark, f"{path}/_compactions/plan-1/_SUCCESS")
    assert ids(spark, path) == list(range(n))
    assert c.compact(spark, path, EVENT_LOG, before=6) == 18
    assert ids(spark, path) == list(range(n))


def test_many_cells_and_null_days(spark, monkeypatch):
    monkeypatch.setattr(c, "CELL_FOLDERS", 4)
    rows = [(None, k, 3) for k in range(10)] + [(None, -1, 3), (None, 99, 6)]
    units = spark.createDataFrame(rows, "event_date date, batch_id long, rows long")
    plan = c.packing_plan(units, 10).collect()
    # Twelve folders in three cells; 6 is over half of the room and stays.
    bins = {}
    for r in plan:
        bins.setdefault((r.cell, r.bin), []).append(r.rows)
    assert all(1 < len(b) and sum(b) <= 10 for b in bins.values())
    assert len({r.cell for r in plan}) == 3
    assert 99 not in {r.batch_id for r in plan}


def test_handler_packs_as_it_goes(spark):
    out = work_dir(spark, "compaction")
    handler = jobs.ingest_handler(out, temporal=False, compact_every=2)
    for batch in range(5):
        frame = spark.createDataFrame(events(10 * batch, 10, days=2), EVENT_LOG)
        handler(frame, batch)
        if batch == 4:
            # A batch that runs again, after its compaction.
            handler(frame, batch)
    path = f"{out}/events"
    assert ids(spark, path) == list(range(50))
    assert {batch for _, batch in folders(spark, path)} == {-2, 4}


def test_rows_without_a_day(spark):
    out = work_dir(spark, "compaction")
    schema = EVENT_LOG
    for batch in range(3):
        frame = spark.createDataFrame(events(5 * batch, 5), schema).withColumn("event_date", F.lit(None).cast("date"))
        frame.withColumn(BATCH, F.lit(batch)).write.mode("append").partitionBy("event_date", BATCH).parquet(out)
    assert c.compact(spark, out, schema, before=3) == 3
    assert ids(spark, out) == list(range(15))
    assert c.clean(spark, out) == 3
    assert ids(spark, out) == list(range(15))
