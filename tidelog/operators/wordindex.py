"""A written index of words, tags and days, and searches that read it instead of the texts.

Documents get dense numbers in the order in which they lie. Numbers are cut into buckets of 32,768, and a
posting list has one entry for each bucket: a sorted array where few documents have the
term, a bitmap where many have. So unions and intersections are bit operations on buckets.

Words that are not known exactly are first looked up among the distinct words, which are
far fewer than the texts' words: those that contain a part through the three-character
grams of the part, those within two edits through their *pieces*. A word is cut into three, so two edits
leave one piece as it is, and it lies in the other word at one of few places. Words too short
for that have *deletion forms*: if two words are within two edits, one form of each, with at most
two of the first characters left out, is the same. So all of them are found, and the exact distance decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.session import materialize

WORD, TAG, DAY = "word", "tag", "day"
#: Documents of a bucket from which their list is a bitmap, which takes 4 KB.
DENSE = 1024
#: Edits that deletion forms find, and the characters that they leave out some of.
EDITS, HEAD = 2, 7
#: Symbols of a word from which it is found by its pieces, of two symbols at least; one more than edits.
LONG, PIECES = 6, EDITS + 1
GRAM = 3


@dataclass(frozen=True)
class WordIndex:
    """The tables of an index: read lazily, each with the columns that a search needs."""

    spark: SparkSession
    path: str
    unique: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def _write(frame: DataFrame, path: str, *by: str, ranges: bool = True) -> None:
    """Sorted, so that a scan for a few values skips the other pages.

    Dealing out by ranges runs the input twice; where it is much work, rows are dealt out by hash.
    """
    dealt = frame.repartitionByRange(*by) if ranges else frame.repartition(*by)
    dealt.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def _shown(text: Column) -> Column:
    """A text as the edit distance sees it: one symbol for each byte beyond the characters."""
    return F.concat(text, F.repeat(F.lit("\0"), F.octet_length(text) - F.char_length(text)))


def deletion_forms(text: Column, head: int = HEAD) -> Column:
    """The first ``head`` symbols of a text, and what is left of them without any one or two."""
    start = F.substring(_shown(text), 1, head)
    n = F.char_length(start)

    def between(first: Column, end: Column) -> Column:
        return F.substring(start, first, end - first)

    def without_one(i: Column) -> Column:
        return F.concat(between(F.lit(1), i), between(i + 1, n + 1))

    def without_two(i: Column) -> Column:
        later = F.sequence(i + 1, n)
        return F.transform(later, lambda j: F.concat(between(F.lit(1), i), between(i + 1, j), between(j + 1, n + 1)))

    none = F.array().cast("array<string>")
    one = F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), without_one)).otherwise(none)
    two = F.when(n >= 2, F.flatten(F.transform(F.sequence(F.lit(1), n - 1), without_two))).otherwise(none)
    return F.array_distinct(F.concat(F.array(start), one, two))


def _piece_start(size: Column, part: int) -> Column:
    """Place, from 1, of a piece of a word of ``size`` symbols; that of the piece after the last ends the word."""
    return F.floor(size * F.lit(part - 1) / F.lit(PIECES)).cast("int") + 1


def pieces(text: Column) -> Column:
    """The pieces of a text: its size in symbols, the number and the symbols of each."""
    shown, size = _shown(text), F.octet_length(text)
    cuts = [_piece_start(size, part) for part in range(1, PIECES + 2)]
    return F.array(
        *[
            F.struct(size.alias("size"), F.lit(k + 1).alias("part"), F.substring(shown, cuts[k], cuts[k + 1] - cuts[k]).alias("piece"))
            for k in range(PIECES)
        ]
    )


def piece_probes(text: Column) -> Column:
    """What a text has where a word within ``EDITS`` edits may have a piece unchanged.

    Of the pieces of such a word, let the first be taken up to which there are fewer edits than pieces. It has
    none, and there are ``part - 1`` before it and at most ``EDITS + 1 - part`` after it, which
    bounds how far it can be moved as seen from either end.
    """
    shown, own = _shown(text), F.octet_length(text)
    probes = []
    for longer in range(-EDITS, EDITS + 1):
        size = own - longer  # of the word looked for
        for part in range(1, PIECES + 1):
            start, end = _piece_start(size, part), _piece_start(size, part + 1)
            left, right = part - 1, EDITS + 1 - part
            for move in range(max(-left, longer - right), min(left, longer + right) + 1):
                here = (size >= LONG) & (start + move >= 1) & (end + move <= own + 1)
                piece = F.substring(shown, start + move, end - start)
                probes.append(F.when(here, F.struct(size.alias("size"), F.lit(part).alias("part"), piece.alias("piece"))))
    return F.array_distinct(F.array_compact(F.array(*probes)))


def grams(text: Column, size: int = GRAM) -> Column:
    """All runs of ``size`` characters; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - size + 1, F.lit(1)))
    found = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))
    return F.when(F.char_length(text) >= size, found).otherwise(F.array().cast("array<string>"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``bucket`` and ``place`` of dense numbers from 1, written as they lie: no row is sorted or dealt out."""
    # The upper bits of the id are the number of the partition, the lower ones count its rows.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    laid = materialize(rows.withColumns({"_part": F.spark_partition_id(), "_row": row}), "numbered")
    # One row for each partition.
    sizes = laid.groupBy("_part").agg((F.max("_row") + 1).alias("_rows"))
    earlier = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_row") + 1
    placed = {"bucket": F.bitmap_bucket_number(number), "place": F.bitmap_bit_position(number)}
    return laid.join(F.broadcast(before), "_part").select(*rows.columns, *[c.alias(name) for name, c in placed.items()])


def write_word_index(
    docs: DataFrame, path: str, unique: str, text: str, tags: Column | None = None, day: Column | None = None
) -> WordIndex:
    """Index the words of ``text``, and optionally tags (an array) and a day.

    Null texts, tags and days are indexed under nothing. ``unique`` is an id of any type that sorts;
    a row that repeats an id is a document of its own.
    """
    fields = {WORD: F.array_distinct(tx.tokens(F.col(text)))}
    if tags is not None:
        fields[TAG] = F.array_distinct(tags.cast("array<string>"))
    if day is not None:
        fields[DAY] = F.array(day.cast("string"))
    rows = docs.select(F.col(unique), *[values.alias(f"_{name}") for name, values in fields.items()])
    numbered = _numbered(rows)
    _write(numbered.select("bucket", "place", unique), f"{path}/docs", "bucket", "place")
    posted = reduce(
        DataFrame.unionByName,
        [
            numbered.select(F.lit(name).alias("field"), F.explode(f"_{name}").alias("term"), "bucket", "place").filter("term is not null")
            for name in fields
        ],
    )
    lists = posted.groupBy("field", "term", "bucket").agg(F.sort_array(F.collect_list(F.col("place").cast("int"))).alias("places"))
    # Sorted here, so that the sparse ones are written as they lie.
    lists = materialize(lists.sortWithinPartitions("field", "term", "bucket"), "lists")
    lists.filter(F.size("places") < DENSE).write.mode("overwrite").parquet(f"{path}/sparse")
    many = lists.filter(F.size("places") >= DENSE).select("field", "term", "bucket", F.explode("places").alias("place"))
    dense = many.groupBy("field", "term", "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    _write(dense, f"{path}/dense", "field", "term", "bucket")
    terms = lists.groupBy("field", "term").agg(F.sum(F.size("places")).alias("docs"))
    terms.sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/terms")
    words = all_words(WordIndex(docs.sparkSession, path, unique))
    size = F.octet_length("term")
    short = words.filter((size > 3) & (size < LONG))
    _write(short.select(F.explode(deletion_forms(F.col("term"))).alias("form"), "term"), f"{path}/forms", "form", "term", ranges=False)
    cut = words.filter(size >= LONG).select(F.inline(pieces(F.col("term"))), "term")
    _write(cut, f"{path}/pieces", "size", "part", "piece", "term", ranges=False)
    _write(words.select(F.explode(grams(F.col("term"))).alias("gram"), "term"), f"{path}/grams", "gram", "term", ranges=False)
    return WordIndex(docs.sparkSession, path, unique)


def all_words(index: WordIndex) -> DataFrame:
    """The distinct words."""
    return index.table("terms").filter(F.col("field") == WORD).select("term")


# -- words ----------------------------------------------------------------------------------


def words_containing(index: WordIndex, part: str) -> DataFrame:
    """``term``: the words that contain the part, which is taken in lower case."""
    part = part.lower()
    wanted = sorted({part[i : i + GRAM] for i in range(len(part) - GRAM + 1)})
    if not wanted:
        # Too short for a gram: all words are looked through, but no text.
        return all_words(index).filter(F.col("term").contains(part))
    found = index.table("grams").filter(F.col("gram").isin(wanted)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return found.filter((F.col("n") == len(wanted)) & F.col("term").contains(part)).select("term")


def words_near(index: WordIndex, queries: DataFrame, query: str = "query", distance: int = EDITS) -> DataFrame:
    """``query`` and ``term``: the words of over three bytes within ``distance`` edits, for many queries at once.

    Distances are those of ``functions.text.edit_distance``; queries are taken as written.
    """
    asked = queries.select(F.col(query).alias("query")).filter("query is not null").distinct()
    forms = asked.select("query", F.explode(deletion_forms(F.col("query"))).alias("form"))
    parts = asked.select("query", F.inline(piece_probes(F.col("query"))))
    short = forms.join(index.table("forms"), "form").select("query", "term")
    long = parts.join(index.table("pieces"), ["size", "part", "piece"]).select("query", "term")
    return short.unionByName(long).filter(_close(F.col("query"), distance)).distinct()


def words_near_one(index: WordIndex, query: str, distance: int = EDITS) -> DataFrame:
    """``term``: the words near one query. Its few forms and places of pieces are filters that reach the scans."""
    [one] = index.spark.range(1).select(deletion_forms(F.lit(query)).alias("forms"), piece_probes(F.lit(query)).alias("probes")).collect()
    short = index.table("forms").filter(F.col("form").isin(one.forms)).select("term")
    wanted = [(F.col("size") == p["size"]) & (F.col("part") == p["part"]) & (F.col("piece") == p["piece"]) for p in one.probes]
    long = index.table("pieces").filter(reduce(lambda a, b: a | b, wanted, F.lit(False))).select("term")
    return short.unionByName(long).filter(_close(F.lit(query), distance)).distinct()


def _close(query: Column, distance: int) -> Column:
    if distance > EDITS:
        raise ValueError(f"the index finds at most {EDITS} edits")
    return tx.edit_distance(F.col("term"), query, distance) >= 0


# -- documents ----------------------------------------------------------------------------------


def bitmaps(index: WordIndex, terms: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``bucket``, ``bits``: the documents of any of the terms (``field``, ``term``), as bitmaps."""
    sparse = terms.join(index.table("sparse"), ["field", "term"]).select(*by, "bucket", F.explode("places").alias("place"))
    from_few = sparse.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    from_many = terms.join(index.table("dense"), ["field", "term"]).select(*by, "bucket", "bits")
    return from_few.unionByName(from_many).groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def any_of(index: WordIndex, field: str, values: list[str]) -> DataFrame:
    """Bitmaps of documents that have any of the values; the filter reaches the scans."""
    chosen = (F.col("field") == field) & F.col("term").isin(values)
    few = index.table("sparse").filter(chosen).select("bucket", F.explode("places").alias("place"))
    from_few = few.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    many = index.table("dense").filter(chosen).select("bucket", "bits")
    return from_few.unionByName(many).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def documents(index: WordIndex, found: DataFrame) -> DataFrame:
    """The ids under the set bits of ``bucket``, ``bits``; further columns stay."""
    byte = F.conv(F.hex(F.expr("substring(bits, cast(place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.getbit(byte, (F.col("place") % 8).cast("int")) == 1
    return index.table("docs").join(found, "bucket").filter(is_set).drop("bucket", "place", "bits")


def between(index: WordIndex, field: str, first: str, last: str) -> DataFrame:
    """Bitmaps of documents with a value in the range, both ends included, as text."""
    terms = index.table("terms").filter((F.col("field") == field) & F.col("term").between(first, last))
    return bitmaps(index, terms.select("field", "term"), [])


def all_of(sets: list[DataFrame]) -> DataFrame:
    """Bitmaps of documents that are in all of the sets."""
    together = reduce(DataFrame.unionByName, [s.select("bucket", "bits") for s in sets])
    both = together.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return both.filter(F.col("n") == len(sets)).drop("n")


def under_words(index: WordIndex, words: DataFrame) -> DataFrame:
    """Bitmaps of documents that have any word of the table ``term``."""
    return bitmaps(index, words.select(F.lit(WORD).alias("field"), "term"), [])


def search_part(index: WordIndex, part: str) -> DataFrame:
    """Ids of documents with a word that contains the part."""
    if not part or any(c.isspace() for c in part):
        return documents(index, under_words(index, all_words(index).limit(0)))
    return documents(index, under_words(index, words_containing(index, part)))


def search_near_one(index: WordIndex, query: str, distance: int = EDITS) -> DataFrame:
    """Ids of documents with a word of over three bytes within ``distance`` edits of the query."""
    return documents(index, under_words(index, words_near_one(index, query, distance)))


def search_near(index: WordIndex, queries: DataFrame, query: str = "query", distance: int = EDITS) -> DataFrame:
    """``query`` and id of documents with a word of over three bytes within ``distance`` edits."""
    near = words_near(index, queries, query, distance).withColumn("field", F.lit(WORD))
    return documents(index, bitmaps(index, near, ["query"]))


def search_pattern(index: WordIndex, docs: DataFrame, text: str, pattern: str, literals: list[str]) -> DataFrame:
    """Documents whose text matches a pattern of which every match holds the literals.

    ``literals`` are parts without white space that lie inside words of any match, in any letter case.
    Only documents that have words with all of them are read and matched.
    """
    if not literals:
        return docs.filter(F.col(text).rlike(pattern))
    having = [under_words(index, words_containing(index, literal)) for literal in literals]
    candidates = documents(index, all_of(having))
    return docs.join(candidates, index.unique, "left_semi").filter(F.col(text).rlike(pattern))
