"""Log-likelihood of whole documents under a recurrent language model trained on the corpus.

Words of all training documents are counted. The most frequent are words of the
network; all others are one class, in which a word has its smoothed frequency, so that
every text has a probability. The training documents are dealt by hash into *cells* of about
``CELL_WORDS`` words. The network is trained in rounds: each cell of a round trains a copy,
and the copies are averaged by words. All training documents are trained on, each once; the
counts are those of all of them as well. Cells and the order inside them follow from the
documents alone, so the result is the same however the input is partitioned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import gru
from tidelog.llm.common import remainder, utf8
from tidelog.session import materialize

#: Words of the network, and at most so many words whose counts every task holds.
NETWORK_WORDS, COMMON_WORDS = 2_048, 1 << 16
#: Longer words are dealt with like rare ones, so the held words are bounded in bytes.
COMMON_BYTES = 64
ROUNDS = 4
#: Words, about, that one copy of the network learns from before it is averaged.
CELL_WORDS = 4 << 20
#: Words that a task holds at once, to count or to train on.
HELD_WORDS, HELD_KINDS = 4 << 20, 1 << 19
#: Parameters in a row when copies are averaged.
CHUNK = 4_096
END = b""


def words(text: str | None) -> list[bytes]:
    """Lower-case (A-Z) words of a text, parted by white space, and its end, which is the empty word."""
    return [*utf8(text).lower().split(), END]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` and ``count`` over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(counts.items())
            for k in range(0, len(items), 65_536):
                part = list(zip(*items[k : k + 65_536]))
                yield pa.record_batch([pa.array(part[0], pa.binary()), pa.array(part[1], pa.int64())], names=["word", "n"])
            counts.clear()

        for batch in batches:
            for t in batch["text"].to_pylist():
                counts.update(words(t))
                if len(counts) > HELD_KINDS:
                    yield from flush()
        yield from flush()

    each = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return materialize(each.groupBy("word").agg(F.sum("n").alias("count")), "words")


class Vocabulary:
    """Counts of the common words, and numbers of the network's words; the rare class and the end are last."""

    def __init__(self, common: list[tuple[bytes, int]], total: int, kinds: int):
        network = [(w, n) for w, n in common if w != END][:NETWORK_WORDS]
        ends = next((n for w, n in common if w == END), 0)
        self.rare, self.end = len(network), len(network) + 1
        self.total, self.kinds = total, kinds
        rest = total - ends - sum(n for _, n in network)
        self.counts = np.array([*(n for _, n in network), rest, ends], np.int64)
        #: Denominators: of the base, and of a word among the rare ones (the unknown word is one more).
        self.base = total + 0.1 * (kinds + 1)
        self.within = rest + 0.1 * max(1, kinds - len(network) - (ends > 0) + 1)
        self.number = {w: k for k, (w, _) in enumerate(network)} | {END: self.end}
        logs = {w: float(np.log10((n + 0.1) / self.base)) for w, n in common}
        logs.setdefault(END, float(np.log10((ends + 0.1) / self.base)))
        self.logs, self.ends = logs, ends


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, kinds = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    end = counts.filter(F.length("word") == 0).collect()
    # A sixteenth of an octave of counts is a step; whole steps are common, as many as fit.
    step = F.floor(F.log2("count") * 16).cast("int")
    short = counts.filter(F.length("word").between(1, COMMON_BYTES)).withColumn("step", step)
    lowest, parted, held = None, None, 0
    for row in sorted(short.groupBy("step").count().collect(), reverse=True):  # 16 steps for each doubling
        if held + row["count"] > COMMON_WORDS:
            parted = row["step"]
            break
        held += row["count"]
        lowest = row["step"]
    rows = [] if lowest is None else short.filter(F.col("step") >= lowest).collect()
    if parted is not None and held < COMMON_WORDS:
        # Of the step that does not fit, the first in order; its ranges are fetched one by one.
        ranked = short.filter(F.col("step") == parted).orderBy(F.col("count").desc(), "word")
        rows += islice(ranked.toLocalIterator(), COMMON_WORDS - held)
    common = sorted(((bytes(r["word"]), r["count"]) for r in rows), key=lambda x: (-x[1], x[0]))
    return Vocabulary([*common, *((bytes(r["word"]), r["count"]) for r in end)], total, kinds)


def encoded(docs: DataFrame, vocab: Vocabulary, text: str = "text") -> DataFrame:
    """Documents as numbers of the network's words, what is known of their probability, and their other words.

    ``common_log`` is the base log-probability of the common words, ``rare_log`` the part of it
    of those that are not the network's; ``others`` are the words that are not common.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    slim = docs.select("doc_id", "held_out", F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        # Each common word: its number in the network, its place among the common words.
        place = {w: (v.number.get(w, v.rare), k) for k, w in enumerate(v.logs)}
        packed = {w: number << 32 | k for w, (number, k) in place.items()}
        logs = np.array([*v.logs.values(), 0.0])
        known = np.ones(len(logs), np.int64)
        known[-1] = 0
        if not v.ends:
            known[list(v.logs).index(END)] = 0
        other = v.rare << 32 | len(place)
        for batch in batches:
            out = []
            for t in batch["text"].to_pylist():
                w = words(t)
                codes = np.fromiter(map(packed.get, w, [other] * len(w)), np.int64, len(w))
                number, which = codes >> 32, codes & 0xFFFFFFFF
                far = Counter(w[k] for k in np.flatnonzero(which == len(place)).tolist())
                rare = number == v.rare
                out.append(
                    (
                        len(w),
                        number.astype(np.uint16).tobytes(),
                        float(logs[which].sum()),
                        float(logs[which[rare]].sum()),
                        int(known[which].sum()),
                        int(rare.sum()),
                        list(far),
                        list(far.values()),
                    )
                )
            columns = list(zip(*out)) or [[]] * 8
            kinds = [pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            kinds += [pa.list_(pa.binary()), pa.list_(pa.int64())]
            names = ["n_tokens", "ids", "common_log", "rare_log", "known", "rare", "others", "times"]
            yield pa.record_batch(
                [batch["doc_id"], batch["held_out"], *(pa.array(c, t) for c, t in zip(columns, kinds))],
                names=["doc_id", "held_out", *names],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = slim.mapInArrow(
        run,
        f"doc_id {kind}, held_out boolean, n_tokens long, ids binary, common_log double, rare_log double, known long, "
        "rare long, others array<binary>, times array<long>",
    )
    return materialize(out.withColumn("uid", F.monotonically_increasing_id()), "encoded")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Batches together, about ``HELD_WORDS`` words at once, and their documents."""
    held: list[pa.RecordBatch] = []
    docs: list[np.ndarray] = []
    size = 0
    for batch in batches:
        new = [np.frombuffer(x, np.uint16) for x in batch["ids"].to_pylist()]
        held.append(batch)
        docs += new
        size += sum(map(len, new))
        if size >= HELD_WORDS:
            yield held, docs
            held, docs, size = [], [], 0
    if docs:
        yield held, docs


def fit(rows: DataFrame, vocab: Vocabulary) -> gru.Model:
    """Trains the network in rounds on the encoded documents that are not held out, one pass over all.

    A cell is dealt to one task and read there in the order of its hashes, ``HELD_WORDS`` words at a time.
    """
    spark = rows.sparkSession
    cells = ROUNDS * max(1, round(vocab.total / CELL_WORDS / ROUNDS))
    ident = "doc_id" if "doc_id" in rows.columns else "uid"
    deal = F.xxhash64(F.lit(7), F.col(ident).cast("string"), "ids")
    dealt = rows.filter(~F.col("held_out")).select("ids", deal.alias("deal"))
    dealt = dealt.withColumn("cell", F.pmod("deal", F.lit(cells)).cast("int"))
    model = gru.start(vocab.counts)
    end = vocab.end

    def averaged(model: gru.Model, part: DataFrame) -> gru.Model:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cell, groups in groupby(_cells(batches), key=lambda g: g[0]):
                own, count = shared.value.load(shared.value.flat()), 0
                for _, docs in groups:
                    count += gru.train(own, docs, end)[1]
                flat = own.flat().astype(np.float32)
                chunks = [flat[k : k + CHUNK].tobytes() for k in range(0, len(flat), CHUNK)]
                one = [[cell] * len(chunks), range(len(chunks)), [count] * len(chunks), chunks]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(one, kinds)], names=["cell", "chunk", "words", "values"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            weights: Counter = Counter()
            for batch in batches:
                for _, chunk, n, part in zip(*(c.to_pylist() for c in batch.columns)):
                    sums[chunk] = sums.get(chunk, 0) + np.frombuffer(part, np.float32).astype(np.float64) * n
                    weights[chunk] += n
            done = [(s / weights[c]).astype(np.float32).tobytes() for c, s in sums.items()]
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(done, pa.binary())], names=["chunk", "values"])

        ready = part.repartition("cell").sortWithinPartitions("cell", "deal", "ids")
        copies = ready.mapInArrow(run, "cell int, chunk int, words long, values binary")
        size = -(-len(model.flat()) // CHUNK)
        # In the order of cells, so that sums are rounded alike.
        copies = copies.repartition(size, "chunk").sortWithinPartitions("chunk", "cell")
        means = copies.mapInArrow(mean, "chunk int, values binary")
        found = {r.chunk: r["values"] for r in means.collect()}  # one model, whatever the corpus
        if not found:
            return model
        return model.load(np.concatenate([np.frombuffer(found[k], np.float32) for k in range(size)]))

    for k in range(ROUNDS):
        model = averaged(model, dealt.filter(F.col("cell") % ROUNDS == k))
    return model


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Documents of sorted cells, about ``HELD_WORDS`` words at once."""
    cell, docs, size = None, [], 0
    for batch in batches:
        for this, ids in zip(batch["cell"].to_pylist(), batch["ids"].to_pylist()):
            if docs and (this != cell or size >= HELD_WORDS):
                yield cell, docs
                docs, size = [], 0
            cell = this
            docs.append(np.frombuffer(ids, np.uint16))
            size += len(docs[-1])
    if docs:
        yield cell, docs


def scores(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its log10 probability under the network and under word frequencies.

    Columns ``doc_id``, ``held_out`` (crc32 of the id as text is divisible by 10; false for a
    null id), ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``. Only
    documents that are not held out are learned from. Null and empty texts are their
    end. Repeated rows stay rows. Without training documents all words are unknown.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(remainder(F.col(doc_id), 10) == 0, F.lit(False)).alias("held_out"),
        F.col(text).cast("string").alias("text"),
    )
    counts = word_counts(rows.filter(~F.col("held_out")))
    vocab = vocabulary(counts)
    coded = encoded(rows, vocab)
    model = fit(coded, vocab)

    # The words that are not common meet their counts; of few occurrences each, they are no hot keys.
    far = coded.select("uid", F.inline(F.arrays_zip(F.col("others").alias("word"), F.col("times").alias("n"))))
    far = far.join(counts, "word", "left")
    log = F.log10((F.coalesce("count", F.lit(0)) + F.lit(0.1)) / F.lit(vocab.base))
    far = far.groupBy("uid").agg(
        F.sum(F.col("n") * log).alias("far_log"),
        F.sum(F.when(F.col("count").isNotNull(), F.col("n")).otherwise(0)).alias("far_known"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    end, names = vocab.end, ["uid", "doc_id", "held_out", "n_tokens", "common_log", "rare_log", "known", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, found in _groups(batches):
            logs = gru.score(shared.value, found, end) / np.log(10)
            at = 0
            for batch in held:
                yield pa.record_batch(
                    [*(batch[n] for n in names), pa.array(logs[at : at + batch.num_rows])], names=[*names, "network"]
                )
                at += batch.num_rows

    slim = coded.select(*names, "ids")
    told = slim.mapInArrow(run, ", ".join(f"{n} {slim.schema[n].dataType.simpleString()}" for n in names) + ", network double")
    out = told.join(far, "uid", "left")
    far_log = F.coalesce("far_log", F.lit(0.0))
    # A word of the rare class has its share of the counts in this class.
    among = F.col("rare") * F.lit(float(np.log10(vocab.base / vocab.within)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("common_log") + far_log).alias("base_score"),
        (F.col("network") + F.col("rare_log") + far_log + among).alias("score"),
    )
