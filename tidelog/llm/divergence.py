"""How far the vocabularies of a language's sources diverge.

The texts of a shard lie one after the other, as their Arrow buffers hold them. A pointer is
the place where a term starts. Multikey quicksort orders the pointers by the terms they point
at: eight bytes are one symbol, a pivot parts the pointers into those with a smaller, the same
and a greater symbol, and those with the same go on with the next symbol. Equal terms are
then one run, and its pointers, which keep the order of the texts, tell in how many documents and
how often in each source the term occurs. Spark adds up the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import materialize

LEAST_DOCUMENTS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
#: Bytes of text sorted at once, pointers that are sorted directly, sources compared at once.
#: They do not affect results.
SHARD_BYTES, LEAF, BLOCK = 8 << 20, 1 << 14, 64

# Bytes of terms: letters, A to Z in lower case, and all of non-ASCII characters; else zero.
_LETTERS = set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b if b in _LETTERS else 0 for b in bytes(range(256)).lower())


def pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms start and end in translated bytes; none goes over the start of a text."""
    letter = data != 0
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], letter[:-1]]) & ~cut[:-1]
    after = np.concatenate([letter[1:], [False]]) & ~cut[1:]
    return np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1


def _symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes of each term from ``8 * depth`` on, big-endian, zeros after its end.

    ``data`` has eight bytes more than the texts. A symbol that ends in zero is the term's last.
    """
    view = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    place = starts + 8 * depth
    left = np.minimum(ends - place, 8)
    known = np.where(left > 0, view[np.minimum(place, len(view) - 1)].astype(np.uint64), 0)
    drop = (8 * (8 - np.maximum(left, 1))).astype(np.uint64)
    return known >> drop << drop


def multikey_sort(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Pointers with equal terms next to each other, and whether a run begins at each.

    Pointers of a run keep their order.
    """
    order: list[np.ndarray] = []
    heads: list[np.ndarray] = []

    def done(which: np.ndarray, first: np.ndarray) -> None:
        order.append(which)
        heads.append(first)

    def small(which: np.ndarray, depth: int) -> None:
        run = np.zeros(len(which), np.int64)
        while len(which):
            symbol = _symbols(data, starts[which], ends[which], depth)
            by = np.lexsort((symbol, run))
            which, run, symbol = which[by], run[by], symbol[by]
            first = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (run[1:] != run[:-1])])
            alone = first & np.concatenate([first[1:], [True]])
            ended = ((symbol & np.uint64(0xFF)) == 0) | alone
            done(which[ended], first[ended])
            run = np.cumsum(first)[~ended]
            which, depth = which[~ended], depth + 1

    waiting = [(np.arange(len(starts)), 0, None)]
    while waiting:
        which, depth, symbol = waiting.pop()
        if len(which) <= leaf:
            small(which, depth)
            continue
        if symbol is None:
            symbol = _symbols(data, starts[which], ends[which], depth)
        sample = symbol[:: max(1, len(symbol) // 63)]
        pivot = np.partition(sample, len(sample) // 2)[len(sample) // 2]
        less, more = symbol < pivot, symbol > pivot
        same = ~(less | more)
        waiting.append((which[more], depth, symbol[more]))
        if int(pivot) & 0xFF:
            waiting.append((which[same], depth + 1, None))
        else:
            first = np.zeros(np.count_nonzero(same), bool)
            first[:1] = True
            done(which[same], first)
        waiting.append((which[less], depth, symbol[less]))
    if not order:
        return np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate(order), np.concatenate(heads)


def shard_counts(data: bytes, offsets: np.ndarray, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a shard, and for each term and group that has it: term, group, occurrences, documents.

    ``offsets`` tells where each text starts, ``group`` the number of its group.
    """
    raw = data.translate(_TABLE)
    padded = np.frombuffer(raw + bytes(8), np.uint8)
    starts, ends = pointers(padded[: len(raw)], offsets)
    order, heads = multikey_sort(padded, starts, ends)
    doc = np.searchsorted(offsets, starts[order], side="right") - 1
    run = np.cumsum(heads) - 1
    fresh = heads.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    width = int(group.max(initial=0)) + 1
    pairs, which, n = np.unique(run * width + group[doc], return_inverse=True, return_counts=True)
    documents = np.bincount(which, weights=fresh, minlength=len(pairs)).astype(np.int64)
    begins = order[heads]
    terms = [raw[a:b] for a, b in zip(starts[begins].tolist(), ends[begins].tolist())]
    return terms, pairs // width, pairs % width, n, documents


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _buffers(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a string column and the lengths of its values, from its buffers."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    at = np.frombuffer(places, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize)
    return (data[at[0] : at[-1]].to_pybytes() if data is not None else b""), np.diff(at).astype(np.int64)


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``docs`` (documents with it), over all documents.

    Nulls count as empty strings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[str, str], int] = {}
        texts, sizes, groups = [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = np.concatenate(sizes)
            offsets = np.cumsum(lengths) - lengths
            # An empty text has the place of the next one: leave it out.
            real = lengths > 0
            terms, term, group, n, documents = shard_counts(b"".join(texts), offsets[real], np.concatenate(groups)[real])
            names = list(numbers)
            langs, sources = (pa.array([g[k] for g in names], pa.string()) for k in (0, 1))
            words = pa.array(terms, pa.binary()).cast(pa.string())
            table = pa.table([langs.take(group), sources.take(group), words.take(term), pa.array(n), pa.array(documents)], schema=_COUNTS)
            yield from table.to_batches(max_chunksize=1 << 14)

        held = 0
        for batch in batches:
            pairs = zip(batch["lang"].to_pylist(), batch["source"].to_pylist())
            groups.append(np.array([numbers.setdefault(p, len(numbers)) for p in pairs], np.int64))
            raw, lengths = _buffers(batch["text"])
            texts.append(raw)
            sizes.append(lengths)
            held += len(raw)
            if held >= SHARD_BYTES:
                yield from flush()
                texts, sizes, groups, held = [], [], [], 0
                numbers.clear()
        if held:
            yield from flush()

    names = {"lang": lang, "source": source, "text": text}
    slim = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for a, c in names.items()])
    counts = slim.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str) -> Column:
    """``1 + floor(SCALE * (n + 2) / (total + 2 * terms))`` in whole numbers of any size."""
    above = f"cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(28,0))"
    return F.expr(f"1 + ({above}) div cast({total} + 2 * terms as decimal(28,0))")


def _pair_sums(shares: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """``lang``, ``a``, ``b`` (numbers of sources, a < b), ``value`` summed over all kept terms.

    A row is a term with the shares of the sources that have it, for one pair of blocks of
    sources; ``blocks`` has the shares of those that have not.
    """
    of = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("number", "p")).alias("found"))
    first = blocks.select("lang", F.col("block").alias("block_a"), F.col("none").alias("none_a"))
    second = blocks.select("lang", F.col("block").alias("block_b"), F.col("none").alias("none_b"))
    jobs = first.join(second, "lang").filter("block_a <= block_b")
    rows = of.join(jobs, "lang").select(
        "lang", "block_a", "block_b", "none_a", "none_b", F.col("found.number").alias("number"), F.col("found.p").alias("p")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "a", "b", "value"]
        sums: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, block_a, block_b), value in sums.items():
                a, b = np.nonzero(value)
                kept = a + width * block_a < b + width * block_b
                a, b = a[kept], b[kept]
                places = [pa.array(a + width * block_a, pa.int64()), pa.array(b + width * block_b, pa.int64())]
                yield pa.record_batch([pa.array([lang] * len(a), pa.string()), *places, pa.array(value[a, b], pa.int64())], names=names)
            sums.clear()

        for batch in batches:
            for row in batch.to_pylist():
                number, p = np.array(row["number"], np.int64), np.array(row["p"], np.int64)
                key = row["lang"], row["block_a"], row["block_b"]
                sides = []
                for block, none in ((key[1], row["none_a"]), (key[2], row["none_b"])):
                    side = np.array(none, np.int64)
                    mine = number // width == block
                    side[number[mine] - block * width] = p[mine]
                    sides.append(side)
                a, b = sides[0][:, None], sides[1][None, :]
                value = (a - b) ** 2 // (a + b)
                if key in sums:
                    sums[key] += value
                else:
                    sums[key] = value
            if len(sums) > 256:
                yield from flush()
        yield from flush()

    found = rows.mapInArrow(run, "lang string, a long, b long, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def report(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    top_terms: int = TOP_TERMS,
    block: int = BLOCK,
) -> DataFrame:
    """How far each source of a language is from each other one, and by which terms from the language.

    Columns ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``. Terms in fewer than
    ``least_documents`` documents of their language are left out; if none stays, all sources of
    the language are at the distance 0 and have no terms. ``pair`` rows have each other source,
    ``term`` rows at most ``top_terms`` terms more frequent in the source than in the
    language. Null text, language and source count as empty strings; repeated rows are
    documents of their own; of an empty table nothing is returned. A row per pair of a
    language's sources is the result itself, so a language's sources, unlike its documents, are
    taken to be few; ``block`` of them are compared at once.
    """
    counts = materialize(term_counts(docs, text=text, lang=lang, source=source), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
    kept = materialize(kept.filter(F.col("docs") >= least_documents).drop("docs"), "kept-terms")
    flat = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "kept-counts")

    names = {"lang": lang, "source": source}
    every = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for a, c in names.items()]).distinct()
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("lang_total"))
    totals = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = groups.withColumn("number", number.cast("long"))
    groups = groups.withColumn("none", F.when(F.col("terms") > 0, _share("0", "total")))
    groups = materialize(groups, "source-groups")
    shares = flat.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "total"), "q": _share("all_n", "lang_total")})
    shares = materialize(shares.select("lang", "source", "number", "term", "p", "q"), "shares")

    blocks = groups.filter("terms > 0").groupBy("lang", F.floor(F.col("number") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("number", "none"))).alias("s"))
    sums = _pair_sums(shares, blocks.select("lang", "block", F.col("s.none").alias("none")), block)
    one = groups.select("lang", "source", F.col("number").alias("here"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("there"))
    pairs = one.join(two, "lang").filter("here <> there")
    pairs = pairs.withColumns({"a": F.least("here", "there"), "b": F.greatest("here", "there")})
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")
    )
    terms = shares.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value")
    )
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    ranked = pairs.withColumn("rank", place)
    best = terms.withColumn("rank", place).filter(F.col("rank") <= top_terms)
    return ranked.unionByName(best)
