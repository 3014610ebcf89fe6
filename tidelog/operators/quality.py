"""Data quality: rules, order, gaps, repeats, checksums, loss."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import payload as pl
from tidelog.functions.times import floor_div
from tidelog.operators.ordered import (
    row_numbers,
    running,
    with_previous,
)
from tidelog.operators.screening import EMAIL
from tidelog.session import materialize

# Messages of the five event rules. A null breaks its rule like an empty value.
EVENT_RULES = [
    ("Timestamp cannot be zero", lambda: F.coalesce(F.col("timestamp_ns") == 0, F.lit(True))),
    ("Event type cannot be empty", lambda: F.coalesce(F.col("event_type") == "", F.lit(True))),
    ("Event ID cannot be empty", lambda: F.coalesce(F.col("event_id") == "", F.lit(True))),
    ("Session ID cannot be empty", lambda: F.coalesce(F.col("session_id") == "", F.lit(True))),
    ("Event data is not valid JSON", lambda: ~pl.is_json(F.col("data"))),
]
LARGE_GAP_US = 3_600_000_000
# Fixed value: pattern of the ready-made rule.
URL_PATTERN = r"^https?://[^\s/$.?#].[^\s]*$"


def validate_events(log: DataFrame) -> DataFrame:
    """Keep every row; add ``errors`` (array of messages) and ``passed``."""
    errors = pl.listed([(bad(), F.lit(message)) for message, bad in EVENT_RULES])
    return log.withColumn("errors", errors).withColumn("passed", F.size("errors") == 0)


# -- rules over JSON fields --------------------------------------------------------


@dataclass(frozen=True)
class Value:
    """What a rule sees of a row: the document, and the field it looks at with its
    JSON type. A missing field is null and has no type."""

    document: Column
    field: Column
    kind: Column

    @property
    def text(self) -> Column:
        return F.when(self.kind == "string", self.field.try_cast("string"))

    @property
    def number(self) -> Column:
        return F.when(self.kind == "number", self.field.try_cast("double"))


@dataclass(frozen=True)
class Rule:
    """``broken`` is true where the rule fails; null counts as kept."""

    name: str
    field: str
    message: str
    broken: Callable[[Value], Column]
    path: str | None = None
    severity: str = "error"


# The messages and names of the ready-made rules below.
def required(field: str) -> Rule:
    message = f"Required field '{field}' is missing"
    return Rule(f"required_field_{field}", field, message, lambda v: v.kind.isNull(), field)


def field_type(field: str, kind: str) -> Rule:
    if kind not in pl.JSON_TYPES:
        raise ValueError(f"unknown JSON type: {kind}")
    message = f"Field '{field}' has incorrect type"
    return Rule(f"field_type_{field}", field, message, lambda v: v.kind != kind, field)


def number_range(field: str, low: float, high: float) -> Rule:
    message = f"Field '{field}' is outside [{low}, {high}]"
    return Rule(f"range_{field}", field, message, lambda v: ~v.number.between(low, high), field)


def pattern(field: str, regex: str) -> Rule:
    message = f"Field '{field}' does not match required pattern"
    return Rule(f"pattern_{field}", field, message, lambda v: ~v.text.rlike(regex), field)


def custom(name: str, holds: Callable[[Column], Column]) -> Rule:
    """``holds`` gets the parsed document; it may wrap a pandas UDF. Null is a failure."""
    return _custom(name, lambda v: holds(v.document))


def _custom(name: str, holds: Callable[[Value], Column], path: str | None = None) -> Rule:
    message = f"Custom validation '{name}' failed"
    return Rule(name, "data", message, lambda v: ~F.coalesce(holds(v), F.lit(False)), path)


def email(field: str) -> Rule:
    return pattern(field, EMAIL)


def url(field: str) -> Rule:
    return pattern(field, URL_PATTERN)


def non_empty(field: str) -> Rule:
    return _custom(f"non_empty_string_{field}", lambda v: v.text.rlike(r"(?U)\S"), field)


def positive(field: str) -> Rule:
    return _custom(f"positive_number_{field}", lambda v: v.number > 0, field)


def apply_rules(frame: DataFrame, rules: list[Rule], data: str = "data") -> DataFrame:
    """Add ``rule_errors``: all broken rules of a row.

    The JSON is parsed once, and each field is taken out and typed once, however
    many rules look at it.
    """
    paths = list(dict.fromkeys(r.path for r in rules if r.path))
    document = F.col("_doc")
    parsed = frame.withColumn("_doc", F.try_parse_json(data))
    parsed = parsed.withColumns({f"_f{i}": pl.json_field(document, p) for i, p in enumerate(paths)})
    parsed = parsed.withColumns({f"_k{i}": pl.json_type(F.col(f"_f{i}")) for i in range(len(paths))})
    none = F.lit(None).cast("string")
    broken = []
    for rule in rules:
        i = paths.index(rule.path) if rule.path else None
        value = (
            Value(document, document, none)
            if i is None
            else Value(document, F.col(f"_f{i}"), F.col(f"_k{i}"))
        )
        details = F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(rule.field).alias("field"),
            F.lit(rule.message).alias("message"),
            F.lit(rule.severity).alias("severity"),
        )
        broken.append((rule.broken(value), details))
    helpers = [f"_{x}{i}" for i in range(len(paths)) for x in "fk"]
    kind = "struct<rule:string,field:string,message:string,severity:string>"
    return parsed.withColumn("rule_errors", pl.listed(broken, kind)).drop("_doc", *helpers)


def errors_by_rule(checked: DataFrame, errors: Column) -> DataFrame:
    """(rule, n): how often each rule failed."""
    return (
        checked.select(F.explode(errors).alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def rule_totals(checked: DataFrame, passed: Column) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(passed).alias("passed"),
        F.count_if(~passed).alias("failed"),
    )


def late_flags(
    frame: DataFrame,
    ts_us: str,
    as_of: dt.datetime,
    ahead: dt.timedelta = dt.timedelta(hours=1),
    old: dt.timedelta = dt.timedelta(days=365),
) -> DataFrame:
    """Warnings only: rows are never dropped for their time."""
    micro = dt.timedelta(microseconds=1)
    now = (as_of - dt.datetime(1970, 1, 1)) // micro
    return frame.withColumns(
        {
            "in_future": F.col(ts_us) > F.lit(now + ahead // micro),
            "too_old": F.col(ts_us) < F.lit(now - old // micro),
        }
    )


# -- order and identity ------------------------------------------------------------


def out_of_order(
    frame: DataFrame,
    arrival: str,
    unique: str,
    ts: str,
    keys: list[str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Rows whose time is before that of the row that arrived just before."""
    gaps = _steps(frame, arrival, unique, ts, keys, parts)
    return gaps.filter(F.col("step") < 0)


def large_gaps(
    frame: DataFrame,
    arrival: str,
    unique: str,
    ts: str,
    threshold: int = LARGE_GAP_US,
    keys: list[str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Rows more than ``threshold`` after their predecessor; a step back is no gap."""
    gaps = _steps(frame, arrival, unique, ts, keys, parts)
    return gaps.filter(F.col("step") > threshold)


def _steps(frame, arrival, unique, ts, keys, parts) -> DataFrame:
    split = with_previous(frame, keys or [], arrival, unique, 1, parts)
    step = F.col(ts) - F.lag(ts).over(split.window)
    return split.own(split.frame.withColumn("step", step))


def sequence_issues(
    frame: DataFrame,
    ident: str,
    arrival: str,
    unique: str,
    keys: list[str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Rows that break the rising id sequence, judged against the largest id so far.

    ``gap``: ids were skipped; ``out_of_order``: a late id for the first time;
    ``duplicate``: a late id again. Adds ``prev_max`` and ``issue``.
    """
    keys = keys or []
    seen = running(
        frame,
        keys,
        [arrival, unique],
        {"prev_max": ("max", F.col(ident))},
        include_current=False,
        parts=parts,
    ).filter(F.col("prev_max").isNotNull() & (F.col(ident) != F.col("prev_max") + 1))
    # Only the offending rows are left; they are needed three times.
    seen = materialize(seen, "sequence")
    gaps = seen.filter(F.col(ident) > F.col("prev_max") + 1).withColumn("issue", F.lit("gap"))
    late = seen.filter(F.col(ident) <= F.col("prev_max"))
    # The first late arrival per id by aggregation, so that one id with very many
    # copies is combined before the shuffle.
    first = late.groupBy(*keys, ident).agg(F.min(F.struct(arrival, unique)).alias("_first"))
    same = [F.col(f"late.{c}").eqNullSafe(F.col(f"first.{c}")) for c in [*keys, ident]]
    match = same[0]
    for one in same[1:]:
        match = match & one
    repeats = (
        late.alias("late")
        .join(first.alias("first"), match)
        .select(
            "late.*",
            F.when(F.struct(f"late.{arrival}", f"late.{unique}") == F.col("_first"), "out_of_order")
            .otherwise("duplicate")
            .alias("issue"),
        )
    )
    return gaps.unionByName(repeats)


def missing_ids(issues: DataFrame, ident: str, block: int = 10_000) -> DataFrame:
    """Every id skipped by a gap. A long gap is first cut into blocks, so that no
    row ever holds more than ``block`` ids."""
    low, high = F.col("prev_max") + 1, F.col(ident) - 1
    blocks = issues.filter(F.col("issue") == "gap").select(
        high.alias("_high"), F.explode(F.sequence(low, high, F.lit(block).cast("long"))).alias("_low")
    )
    top = F.least(F.col("_low") + F.lit(block - 1), F.col("_high"))
    return blocks.select(F.explode(F.sequence("_low", top)).alias("missing_id"))


def keep_first(frame: DataFrame, ident: str, arrival: str, unique: str) -> DataFrame:
    """One row per id, the first to arrive. An aggregate, so copies are combined
    before the shuffle."""
    rest = [c for c in frame.columns if c not in (ident, arrival, unique)]
    first = F.min(F.struct(arrival, unique, *rest)).alias("_first")
    return (
        frame.groupBy(ident)
        .agg(first)
        .select(ident, *[F.col(f"_first.{c}").alias(c) for c in (arrival, unique, *rest)])
        .select(*frame.columns)
    )


def repeats(frame: DataFrame, ident: str, arrival: str, unique: str) -> DataFrame:
    """Every row whose id arrived before. Only ids that repeat take part in the join."""
    first = (
        frame.groupBy(ident)
        .agg(F.min(F.struct(arrival, unique)).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .select(F.col(ident).alias("_id"), "_first")
    )
    joined = frame.join(first, F.col(ident).eqNullSafe(F.col("_id")))
    return joined.filter(F.struct(arrival, unique) > F.col("_first")).drop("_id", "_first")


# -- checksums and loss --------------------------------------------------------------


def checksum_mismatch(
    frame: DataFrame, expected: DataFrame, ident: str, actual: str = "checksum"
) -> DataFrame:
    """Rows whose checksum differs from an expected one; no expectation, no finding."""
    wanted = expected.select(ident, F.col("checksum").alias("expected"))
    return frame.join(wanted, ident).filter(F.col(actual) != F.col("expected"))


def batches(
    frame: DataFrame, arrival: str, unique: str, size: int, parts: int | None = None
) -> DataFrame:
    """Add ``batch``: runs of ``size`` rows in arrival order."""
    numbered = row_numbers(frame, [], arrival, unique, "_row", parts)
    return numbered.withColumn("batch", floor_div(F.col("_row") - 1, size)).drop("_row")


def batch_checksum(
    batched: DataFrame, arrival: str, unique: str, parts: list[Column]
) -> DataFrame:
    """SHA-256 of the parts of all rows of a batch, in arrival order.

    A batch is bounded by the size it was cut with, so it may be collected.
    """
    entry = F.struct(F.col(arrival), F.col(unique), F.concat(*parts).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.part), "")
    return batched.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.sha2(joined, 256).alias("checksum")
    )


def loss_check(
    sent: DataFrame, stored: DataFrame, checksum: str, allowed: float = 0.05
) -> DataFrame:
    """One row: counts, stored share, whether it suffices, and whether the
    checksums agree as multisets."""
    sides = sent.select(F.col(checksum).alias("c"), F.lit(1).alias("s"), F.lit(0).alias("d"))
    sides = sides.unionAll(
        stored.select(F.col(checksum).alias("c"), F.lit(0).alias("s"), F.lit(1).alias("d"))
    )
    per_sum = sides.groupBy("c").agg(F.sum("s").alias("s"), F.sum("d").alias("d"))
    total = per_sum.agg(
        F.sum("s").alias("sent"),
        F.sum("d").alias("stored"),
        F.sum(F.greatest(F.col("s") - F.col("d"), F.lit(0))).alias("lost"),
        F.sum(F.greatest(F.col("d") - F.col("s"), F.lit(0))).alias("extra"),
    )
    share = F.when(F.col("sent") == 0, 1.0).otherwise(F.col("stored") / F.col("sent"))
    return total.select(
        "sent",
        "stored",
        "lost",
        "extra",
        share.alias("share"),
        (share >= 1.0 - allowed).alias("enough"),
        ((F.col("lost") == 0) & (F.col("extra") == 0)).alias("equal"),
    )


# -- integrity reports ------------------------------------------------------------------


def integrity_stats(checked: DataFrame, passed: str, errors: str) -> DataFrame:
    """(error, n) rows plus the totals repeated as the rows ``total``, ``passed``, ``failed``."""
    labels = F.concat(
        F.array(F.lit("total"), F.when(F.col(passed), F.lit("passed")).otherwise(F.lit("failed"))),
        F.transform(F.col(errors), lambda e: F.concat(F.lit("error: "), e)),
    )
    return (
        checked.select(F.explode(labels).alias("item"))
        .groupBy("item")
        .agg(F.count(F.lit(1)).alias("n"))
    )
