"""Searches on the written index against searches over the texts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import text as tx
from tidelog.operators import search as so
from tidelog.operators import wordindex as wi
from tidelog.session import work_dir


def some_docs():
    rng = random.Random(3)
    stems = ["these", "tables", "Straße", "naïve", "été", "中文", "nation", "station", "a", "on", "x" * 30, "cat", "cart"]
    words = stems + ["".join(rng.sample(s, len(s))) for s in stems] + [s[:-1] + "q" for s in stems]
    docs = []
    for k in range(300):
        text = rng.choice([" ", "\n", " "]).join(rng.choices(words, k=rng.choice([0, 1, 4, 12])))
        docs.append((k * 3 - 200, text, [rng.choice(["en", "fr", None])], dt.date(2024, 1, 1 + k % 28)))
    return docs + [(5_000, None, None, None), (5_001, "", [], None), (5_001, "these nation", ["en"], dt.date(2024, 1, 2))]


@pytest.fixture(scope="module", params=["sparse", "dense"])
def built(spark, request):
    docs = spark.createDataFrame(some_docs(), "doc_id long, text string, tags array<string>, day date")
    before, wi.DENSE = wi.DENSE, 4 if request.param == "dense" else wi.DENSE
    try:
        index = wi.write_word_index(docs, work_dir(spark, "index"), "doc_id", "text", F.col("tags"), F.col("day"))
    finally:
        wi.DENSE = before
    assert (index.table("dense").count() > 0) == (request.param == "dense")
    return docs, index


def ids(frame):
    return sorted(r.doc_id for r in frame.collect())


@pytest.mark.parametrize("part", ["tion", "TIO", "on", "a", "é", "ß", "xxxx", "nothing", "", "a b"])
def test_parts_of_words(built, part):
    docs, index = built
    scan = docs.filter(so.text_predicate(F.col("text"), part, "wildcard")) if part else docs.limit(0)
    assert ids(wi.search_part(index, part)) == ids(scan)


WORDS = ["these", "thesea", "tabels", "Strase", "straße", "naive", "ete", "中", "cat", "carts", "xxxx", "", "natoin", "x" * 29, "é" * 3]


@pytest.mark.parametrize("distance", [1, 2])
def test_words_within_edits(spark, built, distance):
    docs, index = built
    asked = spark.createDataFrame([(w,) for w in [*WORDS, None, "these"]], "query string")
    got = sorted(map(tuple, wi.search_near(index, asked, distance=distance).select("query", "doc_id").collect()))
    want = sorted((w, i) for w in WORDS for i in ids(docs.filter(tx.token_near(F.col("text"), w, distance))))
    assert got == want and want
    for word in ("tabels", "straße"):
        assert ids(wi.search_near_one(index, word, distance)) == [i for w, i in want if w == word]


def test_more_edits_are_refused(built):
    with pytest.raises(ValueError):
        wi.words_near_one(built[1], "these", 3)


@pytest.mark.parametrize("seed", range(3))
def test_close_words_share_a_form(spark, seed):
    """Any two words within two edits, also of repeated symbols and of bytes beyond characters."""
    rng = random.Random(seed)
    pairs = []
    for _ in range(400):
        word = "".join(rng.choices("abé", k=rng.randint(0, 14)))
        other = list(word)
        for _ in range(2):
            place = rng.randint(0, len(other))
            other[place : place + rng.randint(0, 1)] = rng.choice(["", "a", "b", "z"])
        pairs.append((word, "".join(other)))
    frame = spark.createDataFrame(pairs, "a string, b string")
    frame = frame.withColumn("near", tx.edit_distance(F.col("a"), F.col("b")) <= 2)
    forms = [wi.deletion_forms(F.col(c)) for c in "ab"]
    rows = frame.withColumn("met", F.arrays_overlap(*forms)).withColumn("size", F.size(forms[0])).collect()
    assert all(r.met for r in rows if r.near) and sum(r.near for r in rows) > 100
    assert all(r["size"] <= 29 for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_close_words_share_a_piece(spark, seed):
    """Any long word within two edits of another has a piece where the other is looked up, in either direction."""
    rng = random.Random(seed)
    pairs = []
    for _ in range(600):
        word = "".join(rng.choices("abé", k=rng.randint(3, 14)))
        other = list(word)
        for _ in range(2):
            place = rng.randint(0, len(other))
            other[place : place + rng.randint(0, 1)] = rng.choice(["", "a", "b", "z"])
        pairs += [(word, "".join(other)), ("".join(other), word)]
    frame = spark.createDataFrame(pairs, "term string, query string").filter(F.octet_length("term") >= wi.LONG)
    frame = frame.withColumn("near", tx.edit_distance(F.col("term"), F.col("query")) <= 2)
    probes = wi.piece_probes(F.col("query"))
    rows = frame.select("*", F.arrays_overlap(wi.pieces(F.col("term")), probes).alias("met"), F.size(probes).alias("size")).collect()
    assert all(r.met for r in rows if r.near) and sum(r.near for r in rows) > 300
    assert all(r["size"] <= 19 for r in rows)


def test_words_cost_few_rows(spark):
    """A word of the index has three rows to be found within two edits by, or some forms if it is short."""
    words = [f"{k:05d}abcdefgh"[k % 9 :] for k in range(900)]
    docs = spark.createDataFrame([(0, " ".join(words))], "doc_id long, text string")
    index = wi.write_word_index(docs, work_dir(spark, "index"), "doc_id", "text")
    sizes = [len(w) for w in set(words)]
    rows = index.table("forms").count() + index.table("pieces").count()
    assert rows <= sum(3 if n >= wi.LONG else 16 for n in sizes)


def test_patterns_read_candidates_only(built):
    docs, index = built
    pattern = r"(?i)[a-z]+tion\s+(these|été)"
    assert ids(wi.search_pattern(index, docs, "text", pattern, ["TION"])) == ids(docs.filter(F.col("text").rlike(pattern)))
    both = r"(?i)tables\s+nation"
    assert ids(wi.search_pattern(index, docs, "text", both, ["tables", "nation"])) == ids(docs.filter(F.col("text").rlike(both)))
    assert ids(wi.search_pattern(index, docs, "text", both, [])) == ids(docs.filter(F.col("text").rlike(both)))


def test_sets_of_documents(built):
    docs, index = built
    words = lambda *w: F.arrays_overlap(tx.tokens(F.col("text")), F.array(*map(F.lit, w)))
    assert ids(wi.documents(index, wi.any_of(index, wi.WORD, ["these", "été"]))) == ids(docs.filter(words("these", "été")))
    tagged = F.array_contains("tags", "en")
    january = F.col("day").between(dt.date(2024, 1, 2), dt.date(2024, 1, 9))
    sets = [wi.any_of(index, wi.WORD, ["these"]), wi.any_of(index, wi.TAG, ["en"]), wi.between(index, wi.DAY, "2024-01-02", "2024-01-09")]
    assert ids(wi.documents(index, wi.all_of(sets))) == ids(docs.filter(words("these") & tagged & january))
    assert ids(wi.documents(index, wi.any_of(index, wi.WORD, ["nowhere"]))) == []


def test_many_buckets(spark):
    docs = spark.range(70_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'fizz', 'x') || ' ' || if(id % 40000 = 7, 'rare', 'y') as text")
    index = wi.write_word_index(docs, work_dir(spark, "index"), "doc_id", "text")
    assert ids(wi.documents(index, wi.any_of(index, wi.WORD, ["rare"]))) == [7, 40_007]
    assert wi.documents(index, wi.any_of(index, wi.WORD, ["fizz"])).count() == 23_334
    both = wi.all_of([wi.any_of(index, wi.WORD, ["fizz"]), wi.any_of(index, wi.WORD, ["rare"])])
    assert ids(wi.documents(index, both)) == [k for k in (7, 40_007) if k % 3 == 0]


@pytest.mark.parametrize("files", [1, 7])
def test_numbers_are_dense_and_no_text_is_dealt_out(spark, files, tmp_path):
    ids_ = [(k if k % 9 else None, f"w{k} all") for k in range(100)]
    spark.createDataFrame(ids_, "doc_id long, text string").repartition(files).write.parquet(str(tmp_path / "docs"))
    read = spark.read.option("maxPartitionBytes", "1").parquet(str(tmp_path / "docs"))
    rows = read.select("doc_id", F.array_distinct(tx.tokens(F.col("text"))).alias("_word"))
    numbered = wi._numbered(rows)
    assert "Exchange rangepartitioning" not in numbered._jdf.queryExecution().toString()
    numbers = [r["n"] for r in numbered.selectExpr("(bucket - 1) * 32768 + place as n").collect()]
    assert sorted(numbers) == list(range(100))
    index = wi.write_word_index(read, work_dir(spark, "index"), "doc_id", "text")
    assert wi.documents(index, wi.any_of(index, wi.WORD, ["all"])).filter("doc_id is null").count() == 12
    assert ids(wi.documents(index, wi.any_of(index, wi.WORD, ["w5", "w50"]))) == [5, 50]


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    index = wi.write_word_index(docs, work_dir(spark, "index"), "doc_id", "text")
    assert ids(wi.search_part(index, "tion")) == [] and ids(wi.search_near_one(index, "these")) == []
