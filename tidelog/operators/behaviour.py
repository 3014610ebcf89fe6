"""Behaviour of ordered events: motion, focus, repeats, rates, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.ordered import row_numbers, with_previous

SECOND_US = 1_000_000.0

# Thresholds of the motion rules.
SLOW_STEP_S = 0.1
FAST_STEP_S = 0.05
FAST_VELOCITY = 100.0
BUFFER_ROWS = 100
BUFFER_SECONDS = 30.0
PATTERN_ROWS = 10
MIN_TURNS = 3
IDLE_VELOCITY = 5.0
SWIPE_ROWS = 5
SWIPE_DISTANCE = 50.0

# Path parts that are never of interest, and private ones.
NOISE_PATHS = [
    "/.Trash/",
    "/tmp/",
    "/var/tmp/",
    "/.git/",
    "/node_modules/",
    ".DS_Store",
    ".localized",
]
PRIVATE_PATHS = [
    "/Library/Keychains/",
    "/Library/Application Support/com.apple.TCC/",
    "/.ssh/",
    "/Documents/Private/",
]
# Applications that mean a meeting.
MEETING_APPS = [
    "us.zoom.xos",
    "com.microsoft.teams",
    "com.skype.skype",
    "com.apple.facetime",
    "com.google.meet",
    "com.webex.meetingmanager",
    "com.gotomeeting.GoToMeetingWinStore",
    "com.bluejeans.mac",
]
MAX_EVENT_BYTES = 1024 * 100

# Names by key code.
KEY_NAMES = {
    0: "A",
    1: "S",
    2: "D",
    3: "F",
    4: "H",
    5: "G",
    6: "Z",
    7: "X",
    8: "C",
    9: "V",
    11: "B",
    12: "Q",
    13: "W",
    14: "E",
    15: "R",
    16: "Y",
    17: "T",
    18: "1",
    19: "2",
    20: "3",
    21: "4",
    22: "6",
    23: "5",
    24: "=",
    25: "9",
    26: "7",
    27: "-",
    28: "8",
    29: "0",
    30: "]",
    31: "O",
    32: "U",
    33: "[",
    34: "I",
    35: "P",
    36: "Return",
    37: "L",
    38: "J",
    39: "'",
    40: "K",
    41: ";",
    42: "\\",
    43: ",",
    44: "/",
    45: "N",
    46: "M",
    47: ".",
    48: "Tab",
    49: "Space",
    50: "`",
    51: "Delete",
    53: "Escape",
    54: "Right Command",
    55: "Command",
    56: "Shift",
    57: "Caps Lock",
    58: "Option",
    59: "Control",
    60: "Right Shift",
    61: "Right Option",
    62: "Right Control",
    63: "Function",
    64: "F17",
    65: "Keypad .",
    67: "Keypad *",
    69: "Keypad +",
    71: "Keypad Clear",
    75: "Keypad /",
    76: "Keypad Enter",
    78: "Keypad -",
    79: "F18",
    80: "F19",
    81: "Keypad =",
    82: "Keypad 0",
    83: "Keypad 1",
    84: "Keypad 2",
    85: "Keypad 3",
    86: "Keypad 4",
    87: "Keypad 5",
    88: "Keypad 6",
    89: "Keypad 7",
    90: "F20",
    91: "Keypad 8",
    92: "Keypad 9",
    96: "F5",
    97: "F6",
    98: "F7",
    99: "F3",
    100: "F8",
    101: "F9",
    103: "F11",
    105: "F13",
    106: "F16",
    107: "F14",
    109: "F10",
    111: "F12",
    113: "F15",
    114: "Help",
    115: "Home",
    116: "Page Up",
    117: "Delete Forward",
    118: "F4",
    119: "End",
    120: "F2",
    121: "Page Down",
    122: "F1",
    123: "Left Arrow",
    124: "Right Arrow",
    125: "Down Arrow",
    126: "Up Arrow",
}


# -- pointer motion -----------------------------------------------------------------


def _motion(split, ts_us: str) -> DataFrame:
    w = split.window
    dx = F.col("x") - F.lag("x").over(w)
    dy = F.col("y") - F.lag("y").over(w)
    dt = (F.col(ts_us) - F.lag(ts_us).over(w)) / SECOND_US
    moved = split.frame.withColumns({"dx": dx, "dy": dy, "dt": dt})
    step = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    moved = moved.withColumn("step", step)
    speed = F.when(F.col("dt") > 0, F.col("step") / F.col("dt")).otherwise(0.0)
    # The first row of a session has no predecessor and is not a move.
    return moved.withColumn("velocity", speed).filter(F.col("dt").isNotNull())


def pointer_velocity(
    moves: DataFrame,
    key: str = "session",
    ts_us: str = "ts_us",
    unique: str = "event_id",
    parts: int | None = None,
) -> DataFrame:
    """Add ``dx``, ``dy``, ``dt``, ``step`` and ``velocity`` against the move before."""
    split = with_previous(moves, [key], ts_us, unique, 1, parts)
    return split.own(_motion(split, ts_us))


def move_thinning(velocity: DataFrame) -> DataFrame:
    """Moves worth emitting: a longer wait for slow ones. The wait counts from the
    previous raw move, so no state is needed."""
    wait = F.when(F.col("velocity") > FAST_VELOCITY, FAST_STEP_S).otherwise(SLOW_STEP_S)
    return velocity.filter(F.col("dt") >= wait)


def move_stats(
    moves: DataFrame,
    key: str = "session",
    ts_us: str = "ts_us",
    unique: str = "event_id",
    max_rows: int = BUFFER_ROWS,
    seconds: float = BUFFER_SECONDS,
    parts: int | None = None,
) -> DataFrame:
    """Per move, statistics of the buffer that ends with it: at most ``max_rows``
    moves, none older than ``seconds``.

    ``distance`` is the path between the buffered places, so the step that led
    to the first of them does not count.
    """
    split = with_previous(moves, [key], ts_us, unique, max_rows, parts)
    moved = _motion(split, ts_us)
    entry = F.struct(F.col(ts_us).alias("t"), F.col("velocity").alias("v"), F.col("step").alias("s"))
    recent = F.collect_list(entry).over(split.rows(-(max_rows - 1), 0))
    oldest = F.col(ts_us) - F.lit(int(seconds * SECOND_US))
    moved = moved.withColumn("_b", recent).withColumn(
        "_b", F.filter("_b", lambda e: e.t >= oldest)
    )
    own = split.own(moved)
    n = F.size("_b")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    speeds = F.transform("_b", lambda e: e.v)
    return own.withColumns(
        {
            "moves": n.cast("long"),
            "distance": total(F.transform("_b", lambda e: e.s)) - F.element_at("_b", 1).s,
            "span_s": (F.col(ts_us) - F.element_at("_b", 1).t) / SECOND_US,
            "avg_velocity": total(speeds) / n,
            "max_velocity": F.array_max(speeds),
            "min_velocity": F.array_min(speeds),
        }
    ).drop("_b", "dx", "dy", "dt", "step", "velocity", "x", "y")


def motion_patterns(
    moves: DataFrame,
    key: str = "session",
    ts_us: str = "ts_us",
    unique: str = "event_id",
    seconds: float = BUFFER_SECONDS,
    parts: int | None = None,
) -> DataFrame:
    """Per move: ``back_and_forth`` and ``idle`` over the last ten moves, ``swipe``
    (a direction or null) over the last five. Moves older than ``seconds`` are
    not in the buffer, so then there is no pattern."""
    split = with_previous(moves, [key], ts_us, unique, PATTERN_ROWS + 1, parts)
    moved = _motion(split, ts_us)
    window = split.window
    # A turn is a sign change between two steps that both lie inside the last ten places.
    moved = moved.withColumn(
        "_turn", (F.col("dx") * F.lag("dx").over(window) < 0).cast("int")
    )
    ten = split.rows(-(PATTERN_ROWS - 1), 0)
    five = split.rows(-(SWIPE_ROWS - 1), 0)
    turns = split.rows(-(PATTERN_ROWS - 3), 0)
    oldest = F.col(ts_us) - F.lit(int(seconds * SECOND_US))
    moved = moved.withColumns(
        {
            "_full10": (F.count(F.lit(1)).over(ten) == PATTERN_ROWS)
            & (F.first(ts_us).over(ten) >= oldest),
            "_full5": (F.count(F.lit(1)).over(five) == SWIPE_ROWS)
            & (F.first(ts_us).over(five) >= oldest),
            "_turns": F.sum("_turn").over(turns),
            "_speed": F.avg("velocity").over(ten),
            "_dx": F.col("x") - F.first("x").over(five),
            "_dy": F.col("y") - F.first("y").over(five),
        }
    )
    sideways = F.abs("_dx") > F.abs("_dy")
    direction = (
        F.when(sideways & (F.col("_dx") > 0), "right")
        .when(sideways, "left")
        .when(F.col("_dy") > 0, "down")
        .otherwise("up")
    )
    far = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) > SWIPE_DISTANCE
    return split.own(moved).select(
        key,
        ts_us,
        unique,
        (F.col("_full10") & (F.col("_turns") >= MIN_TURNS)).alias("back_and_forth"),
        (F.col("_full10") & (F.col("_speed") < IDLE_VELOCITY)).alias("idle"),
        F.when(F.col("_full5") & far, direction).alias("swipe"),
    )


# -- focus, repeats, rates --------------------------------------------------------------


def focus_changes(
    rows: DataFrame,
    key: str = "session",
    ts_us: str = "ts_us",
    unique: str = "event_id",
    parts: int | None = None,
) -> DataFrame:
    """Rows at which the front window changed, with the reason.

    ``has_window`` false means that no window was in front. Two such rows in a
    row still count as a change.
    """
    split = with_previous(rows, [key], ts_us, unique, 1, parts)
    parts = ["window_id", "process_id", "title", "bounds"]
    before = F.lag(F.struct("has_window", *parts)).over(split.window)
    seen = split.frame.withColumn("_before", before)
    had = F.coalesce(F.col("_before.has_window"), F.lit(False))
    same = had & F.col("has_window")
    for part in parts:
        same = same & F.col(part).eqNullSafe(F.col(f"_before.{part}"))
    differs = {p: ~F.col(p).eqNullSafe(F.col(f"_before.{p}")) for p in parts}
    reason = (
        F.when(~F.col("has_window"), "window_closed")
        .when(~had, "initial_focus")
        .when(differs["process_id"], "application_switch")
        .when(differs["window_id"], "window_switch")
        .when(differs["title"], "window_title_change")
        .otherwise("unknown")
    )
    changed = seen.withColumn("reason", reason).filter(~same).drop("_before")
    return split.own(changed)


def drop_consecutive(
    rows: DataFrame,
    content: str,
    key: str,
    ts_us: str = "ts_us",
    unique: str = "event_id",
    parts: int | None = None,
) -> DataFrame:
    """Drop rows whose content equals that of the row before; empty never counts as equal."""
    split = with_previous(rows, [key], ts_us, unique, 1, parts)
    repeated = (F.col(content) == F.lag(content).over(split.window)) & (F.col(content) != "")
    marked = split.frame.withColumn("_rep", F.coalesce(repeated, F.lit(False)))
    return split.own(marked.filter(~F.col("_rep")).drop("_rep"))


def counter_rate(
    rows: DataFrame,
    counters: list[str],
    key: str = "host",
    ts_us: str = "ts_us",
    unique: str = "event_id",
    parts: int | None = None,
) -> DataFrame:
    """Counter increases and their sum per second. Without a predecessor, without
    elapsed time or after a reset of any counter there is no row."""
    split = with_previous(rows, [key], ts_us, unique, 1, parts)
    w = split.window
    deltas = {f"{c}_delta": F.col(c) - F.lag(c).over(w) for c in counters}
    seconds = (F.col(ts_us) - F.lag(ts_us).over(w)) / SECOND_US
    out = split.own(split.frame.withColumns({**deltas, "seconds": seconds}))
    valid, total = F.col("seconds") > 0, None
    for name in deltas:
        valid = valid & (F.col(name) >= 0)
        total = F.col(name) if total is None else total + F.col(name)
    return out.filter(valid).withColumn("rate", total / F.col("seconds"))


def idle_state(
    rows: DataFrame,
    key: str,
    ts_us: str = "ts_us",
    unique: str = "event_id",
    timeout_s: float = 30.0,
    active_rate: float = 1.0,
    idle_rate: float = 0.2,
    parts: int | None = None,
) -> DataFrame:
    """``state_rate``: the sampling rate that the gap to the previous event calls for."""
    split = with_previous(rows, [key], ts_us, unique, 1, parts)
    gap = (F.col(ts_us) - F.lag(ts_us).over(split.window)) / SECOND_US
    state = F.when(gap > timeout_s, idle_rate).otherwise(active_rate)
    return split.own(split.frame.withColumn("state_rate", state))


def event_pairs(
    rows: DataFrame,
    kind: str,
    key: str,
    ts_us: str = "ts_us",
    unique: str = "event_id",
    parts: int | None = None,
) -> DataFrame:
    """How often one kind of event directly follows another within a key."""
    split = with_previous(rows.select(key, ts_us, unique, kind), [key], ts_us, unique, 1, parts)
    pairs = split.own(split.frame.withColumn("first", F.lag(kind).over(split.window)))
    return (
        pairs.filter(F.col("first").isNotNull())
        .groupBy("first", F.col(kind).alias("second"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def replay_schedule(
    rows: DataFrame,
    ts_us: str,
    unique: str,
    speed: float = 1.0,
    keys: list[str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """``wait_ms`` until the next event at ``speed``, at least one; null at the end.
    Elapsed time counts in whole milliseconds."""
    if not 0 < speed <= 100:
        raise ValueError("speed must be above 0 and at most 100")
    split = with_previous(rows, keys or [], ts_us, unique, 1, parts, down=True)
    step = F.lag(ts_us).over(split.window) - F.col(ts_us)
    wait = F.greatest(F.floor(step / 1000) / F.lit(float(speed)), F.lit(1.0))
    return split.own(split.frame.withColumn("wait_ms", F.when(step.isNotNull(), wait)))


def type_sequence(
    rows: DataFrame,
    kind: str,
    ts_us: str,
    unique: str,
    parts: int | None = None,
) -> DataFrame:
    """Running number of an event within its type."""
    return row_numbers(rows, [kind], ts_us, unique, "type_no", parts)


# -- buffers and filters --------------------------------------------------------------------


def bounded_buffer(
    rows: DataFrame, arrival: str, unique: str, capacity: int, keep: str = "newest"
) -> DataFrame:
    """What a buffer of ``capacity`` rows holds after all arrivals: a top-k."""
    if keep == "newest":
        order = [F.col(arrival).desc(), F.col(unique).desc()]
    elif keep == "oldest":
        order = [F.col(arrival).asc(), F.col(unique).asc()]
    else:
        raise ValueError("keep must be 'newest' or 'oldest'")
    return rows.orderBy(*order).limit(capacity)


def buffer_overflow(rows: DataFrame, capacity: int) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("writes"),
        F.greatest(n - F.lit(capacity), F.lit(0)).cast("long").alias("overflow"),
        (F.least(n, F.lit(capacity)) / F.lit(float(capacity))).alias("utilization"),
    )


def exclude_apps(rows: DataFrame, app: str, excluded: list[str]) -> DataFrame:
    """Rows without an application are kept."""
    return rows.filter(~F.coalesce(F.col(app).isin(excluded), F.lit(False)))


def excluded_path(path: Column, private: bool = True) -> Column:
    found = F.lit(False)
    for part in NOISE_PATHS + (PRIVATE_PATHS if private else []):
        found = found | path.contains(part)
    return found


def encoded_size(rows: DataFrame) -> Column:
    return F.octet_length(F.to_json(F.struct(*rows.columns)))


def sample_rows(rows: DataFrame, unique: str, rate: float) -> DataFrame:
    """A share of the rows, chosen by the MD5 hash of the id as text, so the same on every run and anywhere."""
    if rate >= 1.0:
        return rows
    # 52 bits of the hash, in 13 hex digits, are exact in a double.
    head = F.conv(F.substring(F.md5(F.coalesce(F.col(unique).cast("string"), F.lit(""))), 1, 13), 16, 10)
    share = head.cast("long") / F.lit(float(1 << 52))
    return rows.filter(share < F.lit(float(rate)))


def route_events(rows: DataFrame, routes: list[tuple[str, str]], kind: str) -> DataFrame:
    """Each row once per handler that takes its type; ``*`` takes every type.

    ``routes`` is configuration: (handler, type) pairs.
    """
    handlers = F.array_distinct(
        F.array_compact(
            F.array(
                *[
                    F.when((F.col(kind) == wanted) | F.lit(wanted == "*"), F.lit(handler))
                    for handler, wanted in routes
                ]
            )
        )
    )
    return rows.withColumn("handler", F.explode(handlers))


def key_names(spark: SparkSession) -> DataFrame:
    """The names of key codes as a table, for ``with_names``."""
    return spark.createDataFrame(list(KEY_NAMES.items()), "code long, key_name string")


def with_names(
    rows: DataFrame, names: DataFrame, code: str, name: str, unknown: str | None = None
) -> DataFrame:
    """Add ``name`` from a table of (``code``, ``name``), which holds each code once.

    A code that the table lacks, also null, keeps its row and gets ``unknown``. Whether
    the table is sent out or both sides are shuffled is left to Spark, by its size.
    """
    table = names.select(F.col(code).alias("_code"), F.col(name).alias("_name"))
    joined = rows.join(table, F.col(code) == F.col("_code"), "left").drop("_code")
    return joined.withColumn(name, F.coalesce("_name", F.lit(unknown).cast("string"))).drop("_name")


def window_stats(windows: DataFrame, app: str) -> DataFrame:
    """Per application: windows, visible ones, total area."""
    visible = F.col("on_screen") & (F.col("alpha") > 0.1)
    return windows.groupBy(app).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(visible).alias("visible"),
        F.sum(F.col("width") * F.col("height")).alias("area"),
    )


def meeting_flag(rows: DataFrame, key: str, apps: str) -> DataFrame:
    """Per key: was any of the running applications a meeting application?"""
    known = F.array(*[F.lit(a) for a in MEETING_APPS])
    return rows.groupBy(key).agg(
        F.coalesce(F.bool_or(F.arrays_overlap(apps, known)), F.lit(False)).alias("in_meeting")
    )


# Hosts whose traffic is local.
LOCAL_HOSTS = ("127.", "localhost", "::1", "[::1]")


def network_totals(
    rows: DataFrame, url: str, size: Column, local: tuple[str, ...] = LOCAL_HOSTS
) -> DataFrame:
    """Bytes and requests per remote host; local traffic is left out.

    Hosts that cannot be read are a group, with null. A local entry that ends in a dot
    is a prefix, others are whole host names.
    """
    host = F.expr(f"try_parse_url({url}, 'HOST')")
    scheme = F.expr(f"try_parse_url({url}, 'PROTOCOL')")
    seen = rows.select(host.alias("remote"), scheme.alias("protocol"), size.alias("_size"))
    for name in local:
        here = F.col("remote").startswith(name) if name.endswith(".") else F.lower("remote") == name
        seen = seen.filter(~F.coalesce(here, F.lit(False)))
    return seen.groupBy("remote", "protocol").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("_size").alias("bytes")
    )
