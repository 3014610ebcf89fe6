import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.operators import storage as st
from tidelog.plans import QUERIES
from tidelog.schema import EVENT_COLUMNS, EVENT_LOG
from tidelog.session import work_dir
from tidelog.sources import eventlog as el
from tidelog.sources import export as ex
from tidelog.sources.arrow_files import ArrowFiles, read_batches
from tidelog.sources import tables as t


@pytest.fixture(scope="module")
def log(spark, small):
    return t.event_log(spark, small)


@pytest.fixture(scope="module")
def written(spark, log):
    path = work_dir(spark, "log")
    el.write_event_log(log, path)
    return path


def test_scan_opens_only_the_days_of_the_range(spark, log, written):
    low, high = dt.datetime(2024, 1, 3, 6), dt.datetime(2024, 1, 5)
    scan = el.scan_event_log(spark, written, low, high)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "PushedFilters: [IsNotNull(timestamp_ns), GreaterThanOrEqual(timestamp_ns" in plan
    want = log.filter(st.selection(log, low, high))
    assert st.same_content(want, scan).first().equal


def test_empty_log_is_an_error(spark):
    with pytest.raises(ValueError):
        el.write_event_log(spark.createDataFrame([], EVENT_LOG), work_dir(spark, "none"))


def test_unsigned_times_are_read_as_long(spark, log):
    path = work_dir(spark, "unsigned")
    log.withColumn("timestamp_ns", F.col("timestamp_ns").cast("decimal(20,0)")).write.parquet(path)
    scan = el.scan_event_log(spark, path)
    assert scan.schema["timestamp_ns"].dataType.simpleString() == "bigint"
    assert st.same_content(log, scan).first().equal


@pytest.mark.parametrize("codec", ["snappy", "GZIP", "lz4", "zstd", "unknown"])
def test_codecs(spark, log, codec):
    path = work_dir(spark, "codec")
    el.write_event_log(log, path, codec)
    assert el.scan_event_log(spark, path).count() == log.count()


def test_catalogue_footers_and_checks(spark, log, written):
    catalogue = el.file_catalog(spark, written).persist()
    assert catalogue.agg(F.sum("record_count")).first()[0] == log.count()
    assert st.verify_files(catalogue, el.file_catalog(spark, written)).filter("not passed").count() == 0
    groups = el.footers(spark, written)
    assert groups.agg(F.sum("rows")).first()[0] == log.count()
    assert el.schema_check(groups).filter("not passed").count() == 0
    assert el.rowgroup_check(groups).filter("not consistent").count() == 0
    assert el.schema_check(groups, [*EVENT_COLUMNS, "more"]).first().missing == "more"
    assert el.crowded_folders(catalogue, 0).filter("rotate").count() == 30
    assert el.crowded_folders(catalogue).filter("rotate").count() == 0


@pytest.mark.parametrize("bound", [1, 7, 1000])
def test_arrow_files_are_bounded_and_read_by_batches(spark, tmp_path, bound):
    rows = spark.range(0, 40, 1, 3).select("id", F.concat(F.lit("t"), "id").alias("name"), F.array("id").alias("list"))
    path = str(tmp_path / "files")
    spark.dataSource.register(ArrowFiles)
    rows.write.format("arrow_files").option("path", path).option("maxRecordsPerFile", bound).mode("overwrite").save()
    sizes = [pa.ipc.open_file(str(f)).read_all().num_rows for f in (tmp_path / "files").glob("*.arrow")]
    assert sum(sizes) == 40 and max(sizes) <= bound and len(sizes) == sum(-(-n // bound) for n in (13, 13, 14))
    files = el.list_files(spark, path, "*.arrow")
    back = read_batches(files, rows.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    some = rows.select("name").schema
    assert sorted(r.name for r in read_batches(files, some).collect()) == sorted(f"t{k}" for k in range(40))
    assert read_batches(files.limit(0), rows.schema).count() == 0


def tree_by_hand(data, chunk, fan):
    import hashlib

    level = [hashlib.sha256(b"leaf:" + data[i : i + chunk]).hexdigest() for i in range(0, max(1, len(data)), chunk)]
    while len(level) > 1:
        groups = [level[i : i + fan] for i in range(0, len(level), fan)]
        level = [g[0] if len(g) == 1 else hashlib.sha256(("node:" + ",".join(g)).encode()).hexdigest() for g in groups]
    return level[0]


@pytest.mark.parametrize("chunk,fan", [(7, 3), (100, 2), (1 << 20, 1024)])
def test_tree_hashes(spark, tmp_path, chunk, fan):
    contents = {f"f{n}": bytes((n * i) % 251 for i in range(n)) for n in (0, 1, 6, 7, 8, 21, 22, 150, 700, 1500)}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    # Spark does not list files without bytes.
    files = spark.createDataFrame([(f"file:{tmp_path}/{name}", len(data)) for name, data in contents.items()], "path string, size long")
    listed = el.list_files(spark, str(tmp_path), "*").select(F.regexp_replace("path", "^file:/*", "file:/").alias("path"), "size")
    assert listed.exceptAll(files).count() == 0 and listed.count() == len(contents) - 1
    got = {r.path.rsplit("/", 1)[1]: r.checksum for r in el.tree_hashes(files, chunk, fan).collect()}
    assert got == {name: tree_by_hand(data, chunk, fan) for name, data in contents.items()}
    assert el.tree_hashes(files.limit(0)).count() == 0
    short = files.withColumn("size", F.col("size") + 1)
    with pytest.raises(Exception, match="shorter than listed"):
        el.tree_hashes(short, chunk, fan)


def test_catalogue_tells_changed_bytes_and_columns(spark, log, written):
    catalogue = el.file_catalog(spark, written)
    checks = ("size", "checksum", "record_count", "columns")
    assert st.verify_files(catalogue, catalogue, checks).filter("not passed").count() == 0
    assert {r.columns for r in catalogue.select("columns").distinct().collect()} == {",".join(EVENT_COLUMNS)}
    other = catalogue.withColumn("columns", F.concat("columns", F.lit(",more")))
    got = st.verify_files(catalogue, other, checks)
    assert got.filter("columns_ok or not checksum_ok").count() == 0 and got.filter("passed").count() == 0


def test_verify_reports_each_check(spark):
    cols = "path string, size long, checksum string, record_count long"
    expected = spark.createDataFrame([("a", 1, "x", 1), ("b", 1, "x", None), ("c", 1, "x", 1), ("d", 1, "x", 1)], cols)
    actual = spark.createDataFrame([("a", 2, "x", 1), ("b", 1, "x", 9), ("d", 1, "y", 2), ("e", 1, "x", 1)], cols)
    got = {r.path: r for r in st.verify_files(expected, actual).collect()}
    assert (got["a"].size_ok, got["a"].checksum_ok, got["a"].passed) == (False, True, False)
    assert got["b"].passed
    assert not got["c"].exists and got["c"].size_ok is None
    assert (got["d"].checksum_ok, got["d"].record_count_ok) == (False, False)
    assert not got["e"].listed
    report = st.stored_report(st.verify_files(expected, actual), expected).first()
    assert (report.files, report.valid, report.corrupted, report.success_rate) == (4, 1, 3, 0.25)


def test_frames(spark):
    rows = [
        (1, "frame", None, None, '{"data": "aGk="}', "s", "1"),
        (2, "frame", None, None, '{"data": "***"}', "s", "2"),
        (3, "frame", None, None, "{", "s", "3"),
        (4, "click", None, None, '{"data": "aGk="}', "s", "4"),
        (5, "frame", None, None, '{"other": 1}', "s", "5"),
    ]
    frame = spark.createDataFrame(rows, EVENT_LOG)
    assert [(r.event_id, bytes(r.frame)) for r in el.frames(frame).collect()] == [("1", b"hi")]
    assert el.without_frames(frame).count() == 1


@pytest.mark.parametrize("kind", ex.FORMATS)
@pytest.mark.parametrize("compression", [None, "gzip", "bzip2", "lz4"])
def test_exports(spark, kind, compression):
    rows = spark.createDataFrame([(1, 'say "hi", ok'), (2, "two\nlines"), (3, None)], "id long, data string")
    path = work_dir(spark, "export")
    if compression and compression not in ex._SUPPORTED[kind]:
        with pytest.raises(ValueError):
            ex.export(rows, path, kind, compression)
        return
    ex.export(rows, path, kind, compression)
    back = ex.read_export(spark, path, kind, rows.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert ex.validate_export(spark, rows, path, kind).first().valid
    # A second export replaces the first.
    ex.export(rows.limit(1), path, kind, compression)
    assert not ex.validate_export(spark, rows, path, kind).first().valid


def test_wipe_takes_all_only_if_asked_to(spark, log):
    with pytest.raises(ValueError):
        st.selection(log)
    everything = st.selection(log, everything=True)
    assert st.wipe_keep(log, everything).count() == 0
    assert st.wipe_plan(log, everything).agg(F.sum("events")).first()[0] == log.count()
    with pytest.raises(ValueError):
        st.selection(log, event_types=["click", " "])


def test_backfill_writes_one_day(spark, log):
    path = work_dir(spark, "day")
    day = dt.date(2024, 1, 7)
    report = st.backfill_day(log, day).first()
    st.backfill_day(log, day, dry_run=False, path=path)
    assert el.scan_event_log(spark, path).count() == report.events > 0
    assert report.folders == 1


def test_open_ends(spark):
    rows = spark.createDataFrame([(d * 86_400 * 10**9, "click", str(d)) for d in range(5)], "timestamp_ns long, event_type string, event_id string")
    two = dt.datetime(1970, 1, 3)
    ids = lambda **ends: [int(r.event_id) for r in rows.filter(st.selection(rows, **ends)).orderBy("timestamp_ns").collect()]
    assert ids(end=two) == [0, 1, 2] and ids(start=two) == [2, 3, 4] and ids(start=two, end=two) == [2]


def daily(spark, days, kind="click"):
    return spark.createDataFrame([(d * 86_400 * 10**9, kind, "a", "w", "{}", "s", f"{kind}{d}") for d in days], EVENT_LOG)


def ids_of(spark, path, **ends):
    return sorted(r.event_id for r in el.scan_event_log(spark, path, **ends).collect())


def test_second_write_keeps_the_first(spark):
    path = work_dir(spark, "twice")
    el.write_event_log(daily(spark, [0, 1]), path)
    el.write_event_log(daily(spark, [1, 2], "view"), path)
    assert ids_of(spark, path) == ["click0", "click1", "view1", "view2"]
    assert ids_of(spark, path, start=dt.datetime(1970, 1, 3)) == ["view2"]
    assert ids_of(spark, path, end=dt.datetime(1970, 1, 1)) == ["click0"]
    el.write_event_log(daily(spark, [1], "again"), path, mode="days")
    assert ids_of(spark, path) == ["again1", "click0", "view2"]
    el.write_event_log(daily(spark, [5]), path, mode="all")
    assert ids_of(spark, path) == ["click5"]


def test_wipe_and_retention_delete(spark):
    path = work_dir(spark, "wipe")
    el.write_event_log(daily(spark, range(5)).union(daily(spark, [3, 4], "view")), path)
    gone = st.wipe(spark, path, st.selection(el.scan_event_log(spark, path), start=dt.datetime(1970, 1, 3), event_types=["click"]))
    assert gone == [dt.date(1970, 1, d) for d in (3, 4, 5)]
    assert ids_of(spark, path) == ["click0", "click1", "view3", "view4"]
    assert el.day_folders(spark, path) == [dt.date(1970, 1, d) for d in (1, 2, 4, 5)]
    assert st.wipe(spark, path, F.lit(False)) == []
    assert st.drop_expired(spark, path, dt.datetime(1970, 1, 5), days=3) == [dt.date(1970, 1, 1)]
    assert ids_of(spark, path) == ["click1", "view3", "view4"]


@pytest.mark.parametrize("strategy", ["daily", "hourly", "type", "type_hour", "shard"])
def test_layouts_hold_all_rows(spark, strategy):
    path = work_dir(spark, strategy)
    rows = daily(spark, range(3)).union(daily(spark, [1], "view"))
    el.write_layout(rows, path, strategy)
    el.write_layout(daily(spark, [9]), path, strategy)
    names = list(el.layout_columns(strategy, F.col("timestamp_ns"), F.col("event_type")))
    back = spark.read.parquet(path)
    assert back.columns[-len(names) :] == names and back.count() == 5


def test_written_layouts_hold_what_is_counted(spark, small):
    rows = lambda name: sorted(map(tuple, QUERIES[name](spark, small).collect()))
    assert rows("layout_files") == rows("partition_counts")
    assert rows("shard_files") == [(sum(n for _, n in rows("shard_counts")), 0)]


def test_encryption_loses_no_row(spark):
    keys = spark.createDataFrame([("a", 1, bytearray(16), 5), ("a", 2, bytearray(b"k" * 16), 6)], "kind string, key_id int, key binary, created long")
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "kind string, payload string")
    sealed = st.encrypt_by_type(rows.filter("kind = 'a'"), keys, "payload", "kind")
    assert [tuple(r) for r in st.decrypt_by_type(sealed, keys, "payload", "kind").collect()] == [("a", "x")]
    with pytest.raises(Exception, match="no key for type"):
        st.encrypt_by_type(rows, keys, "payload", "kind").collect()
    with pytest.raises(Exception, match="unknown key"):
        st.decrypt_by_type(sealed.withColumn("key_id", F.lit(7)), keys, "payload", "kind").collect()


def test_any_identifier(spark):
    cols = "drive int, uuid string, bsd_name string, volume_label string, serial_number string"
    targets = spark.createDataFrame([(0, "u", None, "v", None), (0, None, None, None, "s")], cols)
    drives = spark.createDataFrame(
        [(1, "u", None, None, None), (2, None, "u", None, None), (3, None, None, "v", "s"), (4, None, None, None, None), (5, "x", "y", "z", "s")],
        cols,
    )
    got = st.match_any(targets, drives, "drive", ["uuid", "bsd_name", "volume_label", "serial_number"])
    assert sorted(r.drive for r in got.collect()) == [1, 3, 5]


def test_versions(spark):
    rows = spark.createDataFrame([("1.0.0",), ("1.1.0",), ("1.12.3",), ("2.5.0",), ("x",)], "v string")
    got = [r[0] for r in rows.select(F.coalesce(st.compatible(F.col("v"), "1.1.0"), F.lit(False))).collect()]
    assert got == [False, True, True, False, False]
    old = spark.range(2)
    assert [bytes(r.metadata) for r in st.migrate(old, "1.0.0", "1.1.0").collect()] == [b"", b""]
    assert st.migrate(old, "1.0.0", "1.0.0").columns == ["id"]
    with pytest.raises(ValueError):
        st.migrate(old, "1.1.0", "1.0.0")


def test_difference_counts_copies(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(1,), (3,), (None,)], "a int")
    got = {r.a: r.surplus for r in st.difference(left, right).collect()}
    assert got == {1: 1, 2: 1, 3: -1}


def test_manifest_names_job_source_and_totals(spark, log):
    target = work_dir(spark, "backup")
    manifest = st.backup(spark, log, target, st.selection(log, everything=True), job="nightly", source="laptop")
    assert {r.compression for r in manifest.collect()} == {"snappy"}
    [total] = st.manifest_totals(manifest).collect()
    assert (total.job, total.source, total.events) == ("nightly", "laptop", log.count())
    assert total.files == manifest.count() and not total.verified and not manifest.first().encrypted


def test_release_removes_what_the_application_wrote(spark, tmp_path, monkeypatch):
    from tidelog import session

    monkeypatch.setattr(session, "work_dir", lambda spark, label: f"file:{tmp_path}/application/{label}")
    table = session.materialize(spark.range(5).toDF("n"), "kept")
    assert table.count() == 5 and list(tmp_path.rglob("*.parquet"))
    session.release(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_second_backup_replaces_the_first(spark, log):
    target = work_dir(spark, "backup")
    for _ in range(2):
        manifest = st.backup(spark, log, target, F.lit(True))
        assert manifest.agg(F.sum("record_count")).first()[0] == log.count()
    assert st.same_content(log, st.restore(spark, target)).first().equal


def test_the_key_created_last_is_the_newest(spark):
    made = [("a", "k9", bytearray(16), 1), ("a", "k10", bytearray(b"k" * 16), 2), ("a", "k1", bytearray(b"l" * 16), 2)]
    keys = spark.createDataFrame(made, "kind string, key_id string, key binary, created long")
    rows = spark.createDataFrame([("a", "x")], "kind string, payload string")
    assert st.encrypt_by_type(rows, keys, "payload", "kind").first().key_id == "k10"


def test_wipe_of_rows_without_time(spark):
    loose = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_LOG)
    day = 86_400_000_000_000
    rows = [(k * day if k else None, kind, None, None, "{}", "s", f"{k}{kind}") for k in range(3) for kind in ("x", "y")]
    for wiped, left in ((["x"], ["0y", "1y", "2y"]), (["x", "y"], [])):
        path = work_dir(spark, "wipe")
        el.write_event_log(spark.createDataFrame(rows, loose), path)
        gone = st.wipe(spark, path, F.col("event_type").isin(wiped) & (F.coalesce("timestamp_ns", F.lit(0)) < 3 * day))
        assert gone == [dt.date(1970, 1, 2), dt.date(1970, 1, 3), None]
        if left:
            assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == left
        else:
            assert not any(el.folder_exists(spark, f"{path}/event_date={d}") for d in ("1970-01-02", "1970-01-03", st.NO_DAY))
