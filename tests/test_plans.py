"""What the plans must and must not contain."""

import pytest

import __spark_entry__ as entry
from tidelog.plans import CHECKS, QUERIES

# Python runs where Spark has no expression for the work: JSON of any depth, Arrow files, Parquet footers.
PYTHON = {"screen_json", "export_arrow", "validate_export", "schema_check", "rowgroup_check", "schema_missing", "rowgroup_rows"}
# Queries whose plans are made by jobs that write first.
WRITERS = {n for n in QUERIES if n.startswith(("stream_", "export_", "backup_"))}


def plan(spark, small, name):
    frame = QUERIES[name](spark, small)
    return frame._jdf.queryExecution().executedPlan().toString()


def test_contract():
    assert set(entry.queries()) - set(entry.LLM_QUERIES) == set(QUERIES)
    assert set(entry.oracle_sql()) - set(entry.LLM_CHECKS) <= set(QUERIES)
    unchecked = set(QUERIES) - set(CHECKS)
    assert unchecked == {
        "crc_hashes",
        "shard_counts",
        "rotate_check",
        "file_catalog",
        "schema_check",
        "rowgroup_check",
        "backlog_check",
        "backup_manifest",
    }


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["event_id", "ts_us", "user_id", "event_type", "value"]
    assert 0 < frame.count() <= 200


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_no_row_at_a_time_python_and_no_cross_products(spark, small, name):
    text = plan(spark, small, name)
    assert "BatchEvalPython" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text or name in {
        "validate_export"
    }
    if name not in PYTHON:
        assert "EvalPython" not in text and "MapInPandas" not in text and "MapInArrow" not in text


@pytest.mark.parametrize(
    "name,part",
    [
        ("search_page", "TakeOrderedAndProject(limit=500, offset=300"),
        ("search_page", "GreaterThanOrEqual(ts,2024-01-02T00:00)"),
        ("time_range", "LessThanOrEqual(ts,2024-02-01T00:00)"),
        ("type_filter", "In(event_type, [click,error])"),
        ("find_by_id", "EqualTo(event_id,777)"),
        ("alert_critical", "EqualTo(event_type,"),
        ("scan_events", "PartitionFilters: [isnotnull(event_date"),
        ("search_index_join", "EqualTo(token,tion)"),
        ("facets", "ReadSchema: struct<lang:string,source:string>"),
        ("latency_report", "ReadSchema: struct<event_type:string,value:double>"),
        ("leak_trend", "WindowGroupLimit"),
    ],
)
def test_pushed_and_pruned(spark, small, name, part):
    assert part in plan(spark, small, name)


@pytest.mark.parametrize("name", ["page_numbers", "batch_ids", "out_of_order", "replay_schedule"])
def test_whole_table_order_is_cut_into_cells(spark, small, name):
    """Only one row per cell may meet in a single partition."""
    lines = plan(spark, small, name).splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            below = "".join(lines[i + 1 : i + 8])
            assert "HashAggregate" in below or "_back" in below
