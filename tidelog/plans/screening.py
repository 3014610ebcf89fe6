"""Screening queries over texts, addresses and logged queries."""

from pyspark.sql import functions as F

from tidelog.operators import screening as sc
from tidelog.plans.base import query
from tidelog.sources import tables as t


def _sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any(text, values):
    return f"len(list_filter({_sql_list(values)}, lambda b: contains({text}, b))) > 0"


def _listed(*checks):
    cases = ", ".join(f"CASE WHEN {bad} THEN '{name}' END" for bad, name in checks)
    return f"array_to_string(list_filter([{cases}], lambda e: e IS NOT NULL), ',')"


_CONTROL_SQL = "regexp_matches({0}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{{80}}-\\x{{9F}}]')"
_ODD_SQL = "regexp_matches({0}, '[\\p{{Cf}}\\p{{Co}}]')"


@query(
    "screen_text",
    "SELECT doc_id, "
    + _listed(
        ("strlen(text) > 1000", "too_long"),
        (_any("lower(text)", sc.BLOCKED), "blocked"),
        (_CONTROL_SQL.format("text"), "control"),
        (_ODD_SQL.format("text"), "odd_unicode"),
    )
    + " AS problems FROM documents",
)
def screen_text(spark, root):
    problems = F.array_join(sc.text_problems(F.col("text")), ",").alias("problems")
    docs = t.table(spark, root, "documents").select("doc_id", "text")
    return docs.select("doc_id", problems)


_NAMES = (
    "(SELECT page_id, url, ['page_' || page_id, '-p' || page_id, 'p q', repeat('x', 40 + CAST(page_id % 90 AS INTEGER))]"
    "[CAST(page_id % 4 AS INTEGER) + 1] AS identifier, ['p' || page_id || '.json', 'nul.txt', '.rc' || page_id, "
    "'p.' || page_id || '.exe', 'p/' || page_id, 'LOG.TXT'][CAST(page_id % 6 AS INTEGER) + 1] AS file_name, "
    "['/home/u', '/etc/', 'sub/', '/tmp/../', '/Users/'][CAST(page_id % 5 AS INTEGER) + 1] || page_id AS path, "
    "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || "
    "substr(h, 21, CASE WHEN page_id % 9 = 0 THEN 11 ELSE 12 END) AS uuid, 'u' || page_id || CASE WHEN page_id % 8 = 0 "
    "THEN '.at.' ELSE '@' END || split_part(split_part(url, '//', 2), '/', 1) AS email, page_id % 13 AS number "
    "FROM (SELECT *, md5(url) AS h FROM pages)) n"
)


def _pick(parts, modulus):
    index = (F.col("page_id") % modulus + 1).cast("int")
    return F.element_at(F.array(*parts), index)


def _names(spark, root):
    p = F.col("page_id").cast("string")
    h = F.md5("url")
    last = F.when(F.col("page_id") % 9 == 0, 11).otherwise(12)
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    at = F.when(F.col("page_id") % 8 == 0, ".at.").otherwise("@")
    cut = [(1, 8), (9, 4), (13, 4), (17, 4)]
    return t.table(spark, root, "pages").select(
        "page_id",
        _pick(
            [
                F.concat(F.lit("page_"), p),
                F.concat(F.lit("-p"), p),
                F.lit("p q"),
                F.repeat(F.lit("x"), (F.col("page_id") % 90 + 40).cast("int")),
            ],
            4,
        ).alias("identifier"),
        _pick(
            [
                F.concat(F.lit("p"), p, F.lit(".json")),
                F.lit("nul.txt"),
                F.concat(F.lit(".rc"), p),
                F.concat(F.lit("p."), p, F.lit(".exe")),
                F.concat(F.lit("p/"), p),
                F.lit("LOG.TXT"),
            ],
            6,
        ).alias("file_name"),
        F.concat(
            _pick([F.lit(f) for f in ("/home/u", "/etc/", "sub/", "/tmp/../", "/Users/")], 5), p
        ).alias("path"),
        F.concat_ws(
            "-", *[F.substring(h, a, n) for a, n in cut], F.substr(h, F.lit(21), last)
        ).alias("uuid"),
        F.concat(F.lit("u"), p, at, host).alias("email"),
        (F.col("page_id") % 13).alias("number"),
    )


@query(
    "screen_formats",
    f"SELECT page_id, regexp_matches(identifier, '{sc.IDENTIFIER}') AND strlen(identifier) <= 100 AS identifier_ok, "
    f"regexp_matches(file_name, '{sc.FILE_NAME}') AND file_name NOT LIKE 'nul%' AND file_name NOT LIKE '%.exe' "
    "AS file_name_ok, NOT contains(path, '..') AND (path NOT LIKE '/%' OR path LIKE '/home%' OR path LIKE '/Users%' OR "
    f"path LIKE '/tmp%') AS path_ok, regexp_matches(uuid, '{sc.UUID}') AS uuid_ok, regexp_matches(email, '{sc.EMAIL}') "
    f"AND strlen(email) <= 254 AS email_ok, number BETWEEN 2 AND 9 AS number_ok FROM {_NAMES}",
)
def screen_formats(spark, root):
    return _names(spark, root).select(
        "page_id",
        sc.identifier_ok(F.col("identifier")).alias("identifier_ok"),
        sc.file_name_ok(F.col("file_name")).alias("file_name_ok"),
        sc.path_ok(F.col("path")).alias("path_ok"),
        sc.uuid_ok(F.col("uuid")).alias("uuid_ok"),
        sc.email_ok(F.col("email")).alias("email_ok"),
        sc.number_ok(F.col("number"), 2, 9).alias("number_ok"),
    )


_QUERY_TEXT = (
    "(SELECT conv_id, turn, q, regexp_replace(q, '(?s)\\\\.', '', 'g') AS plain FROM (SELECT conv_id, turn, "
    "repeat('(', CAST(conv_id % 3 AS INTEGER)) || text || repeat(')', CAST(turn % 3 AS INTEGER)) || CASE WHEN conv_id % 11 "
    "= 0 THEN ' \"' WHEN conv_id % 13 = 0 THEN ' \\)' WHEN conv_id % 17 = 0 THEN ' $gt select' ELSE '' END AS q "
    "FROM conversations)) c"
)
_DEPTH = (
    "list_reduce(list_transform(string_split(regexp_replace(regexp_replace(plain, '\"[^\"]*(\"|$)', '', 'g'), '[^()]', '', "
    "'g'), ''), lambda c: CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END), lambda a, x: CASE WHEN a < 0 THEN a "
    "ELSE a + x END, 0)"
)


@query(
    "screen_queries",
    "SELECT conv_id, turn, "
    + _listed(
        ("q = ''", "empty"),
        ("strlen(q) > 5000", "too_long"),
        (_any("upper(q)", sc.SQL_WORDS), "sql_word"),
        (_any("q", sc.QUERY_OPERATORS), "operator"),
        (_CONTROL_SQL.format("q"), "control"),
        (_ODD_SQL.format("q"), "odd_unicode"),
        ("d < 0", "closing_parenthesis"),
        ("d > 0", "open_parenthesis"),
        ("length(regexp_replace(plain, '[^\"]', '', 'g')) % 2 = 1", "open_quote"),
    )
    + f" AS problems FROM (SELECT *, {_DEPTH} AS d FROM {_QUERY_TEXT})",
)
def screen_queries(spark, root):
    c = F.col("conv_id")
    tail = (
        F.when(c % 11 == 0, ' "')
        .when(c % 13 == 0, " \\)")
        .when(c % 17 == 0, " $gt select")
        .otherwise("")
    )
    logged = F.concat(
        F.repeat(F.lit("("), (c % 3).cast("int")),
        F.col("text"),
        F.repeat(F.lit(")"), (F.col("turn") % 3).cast("int")),
        tail,
    )
    turns = t.table(spark, root, "conversations")
    rows = turns.select("conv_id", "turn", logged.alias("q"))
    problems = F.array_join(sc.query_problems(F.col("q")), ",").alias("problems")
    return rows.select("conv_id", "turn", problems)


@query(
    "screen_json",
    "SELECT conv_id, turn, CASE WHEN "
    + _any("lower(text)", sc.BLOCKED)
    + " THEN 'blocked' END AS problem FROM conversations",
)
def screen_json(spark, root):
    deep = F.struct(F.array(F.struct(F.col("text").alias("body"))).alias("parts"), "role")
    rows = t.table(spark, root, "conversations").select(
        "conv_id", "turn", F.to_json(F.struct(deep.alias("message"), "turn")).alias("data")
    )
    return rows.select("conv_id", "turn", sc.json_problem("data").alias("problem"))
