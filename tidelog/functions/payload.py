"""JSON payloads, checksums, bit flags and privacy masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File change bits and their names.
FILE_FLAGS = [
    (0x00000100, "created"),
    (0x00000200, "removed"),
    (0x00000800, "renamed"),
    (0x00001000, "modified"),
    (0x00008000, "metadata_modified"),
    (0x00004000, "owner_changed"),
]
# Modifier bits and their names.
MODIFIER_FLAGS = [
    (0x00010000, "Caps Lock"),
    (0x00020000, "Shift"),
    (0x00040000, "Control"),
    (0x00080000, "Option"),
    (0x00100000, "Command"),
    (0x00200000, "Numeric Pad"),
    (0x00400000, "Help"),
    (0x00800000, "Function"),
]
# Fixed value: bytes counted for the time field of an event.
TIME_BYTES = 12
ID_BYTES = 8

JSON_TYPES = ("string", "number", "boolean", "array", "object", "null")


def listed(checks: list[tuple[Column, Column]], kind: str = "string") -> Column:
    """The items whose condition holds, as an array. Unlike ``array_compact`` over
    nulls this stays inside generated code."""
    none = F.array().cast(f"array<{kind}>")
    return F.concat(*[F.when(cond, F.array(item)).otherwise(none) for cond, item in checks])


def is_json(text: Column) -> Column:
    """Exactly one JSON value and nothing after it.

    The parser stops after the first value, so the text is parsed once inside an
    array and once inside an object: what follows a first value can close only
    one of the two, and a second value makes the array longer. A document that does
    not fit into a variant (128 MiB) counts as not valid.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    single = F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(
        listed, "$[1]", "variant"
    ).isNull()
    return F.coalesce(single, F.lit(False)) & keyed.isNotNull()


def json_field(document: Column, path: str) -> Column:
    """The value at ``a.b.c`` of a variant; a JSON null is a value, not a gap."""
    return F.try_variant_get(document, "$." + path, "variant")


def json_type(value: Column) -> Column:
    """``string``, ``number``, ``boolean``, ``array``, ``object`` or ``null``."""
    return F.transform(
        F.array(F.schema_of_variant(value)),
        lambda name: F.when(value.isNull(), F.lit(None).cast("string"))
        .when(name == "VOID", F.lit("null"))
        .when(name == "STRING", F.lit("string"))
        .when(name == "BOOLEAN", F.lit("boolean"))
        .when(name.startswith("ARRAY"), F.lit("array"))
        .when(name.startswith("OBJECT"), F.lit("object"))
        .otherwise(F.lit("number")),
    )[0]


def event_checksum(event_id: Column, stamp: Column, event_type: Column, data: Column) -> Column:
    """SHA-256 over id, RFC 3339 time, type and JSON text, joined without separators."""
    return F.sha2(F.concat(event_id.cast("string"), stamp, event_type, data), 256)


def event_size(event_type: Column, data: Column, checksum: Column) -> Column:
    total = (
        F.lit(ID_BYTES + TIME_BYTES)
        + F.octet_length(event_type)
        + F.octet_length(data)
        + F.coalesce(F.octet_length(checksum), F.lit(0))
    )
    return total.cast("long")


def flag_names(bits: Column, table: list[tuple[int, str]]) -> Column:
    return listed([(bits.bitwiseAND(F.lit(mask)) != 0, F.lit(name)) for mask, name in table])


def file_change(bits: Column) -> Column:
    names = flag_names(bits, FILE_FLAGS)
    return F.when(F.size(names) == 0, F.lit("unknown")).otherwise(F.array_join(names, ","))


def modifiers(bits: Column) -> Column:
    return flag_names(bits, MODIFIER_FLAGS)


def mask_payload(
    level: Column, payload: Column, stamp: Column, fields: list[str], dropped: str, hashed: str
) -> Column:
    """Payload struct to JSON text by privacy level.

    ``basic`` leaves out one field, ``enhanced`` replaces another by ``hash_`` and
    the length of its JSON rendering, ``strict`` keeps only the time.
    """
    kept = [payload[f].alias(f) for f in fields]
    no_field = [payload[f].alias(f) for f in fields if f != dropped]
    quoted = F.to_json(F.struct(payload[hashed].alias(hashed)))
    # {"name":VALUE} is VALUE plus the name and five more characters.
    size = F.octet_length(quoted) - F.lit(len(hashed.encode()) + 5)
    blurred = [
        F.concat(F.lit("hash_"), size.cast("string")).alias(f)
        if f == hashed
        else payload[f].alias(f)
        for f in fields
    ]
    strict = F.to_json(F.struct(F.lit(True).alias("redacted"), stamp.alias("timestamp")))
    return (
        F.when(level == "basic", F.to_json(F.struct(*no_field)))
        .when(level == "enhanced", F.to_json(F.struct(*blurred)))
        .when(level == "strict", strict)
        .otherwise(F.to_json(F.struct(*kept)))
    )
