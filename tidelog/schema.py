"""Schemas of the event log."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and order of the stored event table.
EVENT_LOG = T.StructType(
    [
        T.StructField("timestamp_ns", T.LongType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("app_bundle_id", T.StringType(), True),
        T.StructField("window_title", T.StringType(), True),
        T.StructField("data", T.StringType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("event_id", T.StringType(), False),
    ]
)
EVENT_COLUMNS = EVENT_LOG.fieldNames()

# The given ``events`` table, used by streams (which need a schema up front).
RAW_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
