"""The queries of this package, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import (
    bpe,
    decontaminate,
    divergence,
    embeddings,
    lm,
    packing,
    quality,
    repeats,
    resampling,
    shuffle,
    simhash,
    tokens,
    warc,
)
from tidelog.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate.report(read(spark, root, "documents"), read(spark, root, "benchmark"))


def op2_quality(spark: SparkSession, root: str) -> DataFrame:
    return quality.report(read(spark, root, "documents"), read(spark, root, "labels"))


def op3_simhash(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, root, "documents"))


def op4_tokens(spark: SparkSession, root: str) -> DataFrame:
    return tokens.report(read(spark, root, "documents"))


def op5_lm(spark: SparkSession, root: str) -> DataFrame:
    return lm.scores(read(spark, root, "documents"))


def op6_shuffle(spark: SparkSession, root: str) -> DataFrame:
    return shuffle.shards(read(spark, root, "documents"))


def op7_repeats(spark: SparkSession, root: str) -> DataFrame:
    return repeats.report(read(spark, root, "documents", batch_rows=repeats.BATCH_ROWS))


def op8_warc(spark: SparkSession, root: str) -> DataFrame:
    return warc.round_trip(read(spark, root, "pages"))


def op9_embeddings(spark: SparkSession, root: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, root, "embeddings", batch_rows=2048))


def op10_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.report(read(spark, root, "documents"))


def op11_resampling(spark: SparkSession, root: str) -> DataFrame:
    return resampling.report(read(spark, root, "documents"), read(spark, root, "benchmark"))


def op12_divergence(spark: SparkSession, root: str) -> DataFrame:
    return divergence.report(read(spark, root, "documents"))


def op13_bpe(spark: SparkSession, root: str) -> DataFrame:
    return bpe.report(read(spark, root, "documents"))


QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_tokens": op4_tokens,
    "op5_lm": op5_lm,
    "op6_shuffle": op6_shuffle,
    "op7_repeats": op7_repeats,
    "op8_warc": op8_warc,
    "op9_embeddings": op9_embeddings,
    "op10_packing": op10_packing,
    "op11_resampling": op11_resampling,
    "op12_divergence": op12_divergence,
    "op13_bpe": op13_bpe,
}

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
_DECONTAMINATE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, size, win FROM (
    SELECT item, least(len(w), 10) AS size,
      unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS win
    FROM items WHERE len(w) > 0)),
places AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (
    SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows))),
found AS (SELECT r, i, size, item FROM places JOIN windows USING (size, win)),
words AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + size)) AS k FROM found) GROUP BY r),
names AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(names.n, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN names USING (r)
"""

# Five bits at a time of the digest's hex digits.
_NIBBLE = "(instr('0123456789abcdef', substr(h, {at}, 1)) - 1)"
_BASE32 = (
    "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((("
    + _NIBBLE.format(at="CAST(5 * i // 4 + 1 AS BIGINT)")
    + " * 16 + greatest(0, "
    + _NIBBLE.format(at="CAST(5 * i // 4 + 2 AS BIGINT)")
    + ")) >> (3 - (5 * i) % 4)) & 31 AS BIGINT), 1)), '')"
)
_WARC = f"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
firsts AS (SELECT body, max(page_id) AS first FROM bodies GROUP BY body),
roles AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h, first,
  first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM bodies JOIN firsts USING (body))
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to FROM roles
"""

_EMBEDDINGS = """
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM vectors WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT r, r AS other FROM vectors UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN vectors v ON v.r = reach.other GROUP BY reach.r),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, FALSE) AS kept
FROM vectors JOIN least USING (r) LEFT JOIN counts USING (r)
"""

_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(w)), "
    "lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT))), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), "
    "lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"
)
_RESAMPLING = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
occurring AS (SELECT r, unnest(words) AS w FROM docs), wanted AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
buckets AS (SELECT w, {_CRC32} % 10000 AS k FROM (SELECT w FROM occurring UNION SELECT w FROM wanted)),
s AS (SELECT k, count(*) AS s FROM occurring JOIN buckets USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM wanted JOIN buckets USING (w) GROUP BY k),
gains AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)
  / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (k)),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM occurring JOIN buckets USING (w) JOIN gains USING (k) GROUP BY r),
scored AS (SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000
  * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
  / 4294967296))) AS BIGINT) AS score FROM docs LEFT JOIN weights USING (r)),
places AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN places USING (r)
"""

_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
_DIVERGENCE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS terms
  FROM documents),
words AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS all_n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(all_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) USING (lang, source)),
shares AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 2) // (total + 2 * v) AS p,
  1 + 1000000000 * (all_n + 2) // (lang_total + 2 * v) AS q
  FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
WHERE part = 'pair' OR rank <= 10
"""

#: Checks in SQL, for the queries that SQL can express on whole tables.
CHECKS: dict[str, str] = {
    "op1_decontaminate": _DECONTAMINATE,
    "op8_warc": _WARC,
    "op9_embeddings": _EMBEDDINGS,
    "op11_resampling": _RESAMPLING,
    "op12_divergence": _DIVERGENCE,
}
