"""Quality classifier on random-indexing word vectors.

A text is a stream of words, each with its form: letter case, digits and the signs
around it, and whether it repeats the word before. Words and forms are hashed to a
fixed number of units. Each unit has a sparse random index vector; its *context
vector* is the sum of the index vectors of all units next to it, anywhere in the
corpus. A document is the mean of the unit-length context vectors of its words and
of its forms. A network with one hidden layer, fitted with numpy on a sample of
labelled documents, gives the score, and a temperature fitted on a part of the
sample that it did not see makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import remainder, utf8

WORD_UNITS, FORM_UNITS, DIMENSIONS, NONZERO = 1 << 14, 1 << 10, 32, 2
UNITS = WORD_UNITS + FORM_UNITS
#: Bound on the labelled documents that the network is fitted on.
SAMPLE_ROWS = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.01, 1e-4
CHUNK_UNITS = 128
#: Bytes of text, and words, that are worked on at once.
PIECE_BYTES, PIECE_WORDS, COUNTED_WORDS = 1 << 18, 1 << 13, 1 << 20


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: what it adds to a word's form (bits), and to its hash (zero: nothing)."""
    form = np.zeros(256, np.uint16)
    form[ord("a") : ord("z") + 1] = 1
    form[ord("A") : ord("Z") + 1] = 2
    form[ord("0") : ord("9") + 1] = 4
    form[0x80:] = 8
    for bit, signs in enumerate(("!?", ".", ",;:", "|", "$%&#@*~^_=+", "\"'`", "()[]{}<>", "-/\\"), start=4):
        for c in signs:
            form[ord(c)] = 1 << bit
    form[[b for b in range(0x80) if not form[b] and bytes([b]).strip()]] = 1 << 12
    value = np.random.default_rng(99).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
    lower = np.frombuffer(bytes(range(256)).lower(), np.uint8)
    return form, np.where((form & 15) > 0, value[lower], np.uint64(0))


_FORM, _VALUE = _byte_tables()
_POWER = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)], np.uint64)
_SPACE = np.array([not bytes([b]).strip() for b in range(256)])


def _spread(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return values ^ (values >> np.uint64(29))


def streams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of the words of texts and of their forms, and where each text's words begin (and end).

    Words are parted by ASCII white space. A word that repeats the one before has another form.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), bounds
    length = np.diff(np.concatenate((starts, [len(raw)])))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, length)
    first = starts - starts[0]
    letters = _VALUE[raw[starts[0] :]] * _POWER[place & 63]
    flags = np.bitwise_or.reduceat(_FORM[raw[starts[0] :]], first).astype(np.uint64)
    word = np.add.reduceat(letters, first)
    # A word of signs only is known by them.
    word = _spread(np.where(word == 0, flags + np.uint64(1), word))
    capital = (_FORM[raw[starts]] == 2).astype(np.uint64)
    long = np.minimum(np.add.reduceat((~space[starts[0] :]).astype(np.int64), first) // 10, 3).astype(np.uint64)
    own = (word >> np.uint64(20)).astype(np.int64) % WORD_UNITS
    form = _spread(flags | capital << np.uint64(16) | (long + np.uint64(1)) << np.uint64(17))
    form = WORD_UNITS + (form >> np.uint64(20)).astype(np.int64) % (FORM_UNITS // 2)
    again = word[1:] == word[:-1]
    again[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(word))] - 1] = False
    form[1:][again] += FORM_UNITS // 2
    return own, form, bounds


def _pieces(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Whole texts together, about ``PIECE_BYTES`` of them at once."""
    held, size = [], 0
    for text in texts:
        held.append(utf8(text))
        size += len(held[-1])
        if size >= PIECE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each unit's index vector."""
    rng = np.random.default_rng(20_240_501)
    places = rng.integers(0, DIMENSIONS, (UNITS, NONZERO))
    return places, rng.choice(np.array([-1.0, 1.0]), (UNITS, NONZERO))


#: Counts of a unit: of each place with either sign, and of no neighbour.
_WIDTH = 2 * DIMENSIONS + 1


def _slots() -> np.ndarray:
    """Where each unit's index vector counts, by its nonzero entries; the last unit parts documents."""
    places, signs = index_vectors()
    return np.concatenate([2 * places + (signs > 0), np.full((1, NONZERO), 2 * DIMENSIONS)]).T.copy()


def _parted(texts: list[bytes]) -> np.ndarray:
    """Units of the words and of the forms (two rows), with the last unit after each text."""
    own, form, bounds = streams(texts)
    return np.stack([np.insert(own, bounds[1:], UNITS), np.insert(form, bounds[1:], UNITS)])


def _count_neighbours(counts: np.ndarray, parted: list[np.ndarray], slots: np.ndarray) -> None:
    """Counts, for each unit, the entries of the index vectors next to it."""
    units = np.concatenate(parted, axis=1)
    bases = [u * _WIDTH for u in units]
    for slot in slots:
        for seen in (slot[u] for u in units):
            for base in bases:
                counts += np.bincount(base[:-1] + seen[1:], minlength=len(counts))
                counts += np.bincount(base[1:] + seen[:-1], minlength=len(counts))


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Context vectors of all units over all documents, of length one (or zero)."""
    slots = _slots()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((UNITS + 1) * _WIDTH, np.int64)
        held, size = [], 0
        for batch in batches:
            for texts in _pieces(batch["text"].to_pylist()):
                held.append(_parted(texts))
                size += held[-1].shape[1]
                if size >= COUNTED_WORDS:
                    _count_neighbours(counts, held, slots)
                    held, size = [], 0
        if held:
            _count_neighbours(counts, held, slots)
        counts = counts.reshape(UNITS + 1, _WIDTH)[:UNITS, : 2 * DIMENSIONS]
        chunks = (counts[:, 1::2] - counts[:, ::2]).reshape(-1, CHUNK_UNITS * DIMENSIONS).astype(np.float32)
        used = [k for k in range(len(chunks)) if chunks[k].any()]
        yield pa.record_batch(
            [pa.array(used, pa.int32()), pa.array([chunks[k].tobytes() for k in used], pa.binary())],
            names=["chunk", "sums"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch["chunk"].to_pylist(), batch["sums"].to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(part, np.float32).astype(np.float64)
        yield pa.record_batch(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
            names=["chunk", "sums"],
        )

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(partial, "chunk int, sums binary")
    summed = parts.repartition(UNITS // CHUNK_UNITS, "chunk").mapInArrow(add, "chunk int, sums binary")
    total = np.zeros((UNITS // CHUNK_UNITS, CHUNK_UNITS * DIMENSIONS))
    for row in summed.collect():  # a table of fixed size, whatever the corpus
        total[row.chunk] = np.frombuffer(row.sums)
    total = total.reshape(UNITS, DIMENSIONS)
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    return total.astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean context vectors of the words and of the forms of each text; zeros for one without words."""
    own, form, bounds = streams(texts)
    total = np.zeros((len(texts), 2 * DIMENSIONS))
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    for a in range(0, len(own), PIECE_WORDS):
        part = slice(a, a + PIECE_WORDS)
        first = np.flatnonzero(np.concatenate(([True], owner[part][1:] != owner[part][:-1])))
        rows = owner[part][first]
        total[rows, :DIMENSIONS] += np.add.reduceat(vectors[own[part]], first)
        total[rows, DIMENSIONS:] += np.add.reduceat(vectors[form[part]], first)
    return (total / np.maximum(np.diff(bounds), 1)[:, None]).astype(np.float32)


def _pooled_rows(docs: DataFrame, finish, kind: str, vectors: np.ndarray, text: str, keep: list[str] | None) -> DataFrame:
    """``row`` (all columns, or those to keep) and ``value``, which ``finish`` makes of the documents' vectors."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    slim = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
        F.col(text).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            if batch.num_rows:
                values = np.concatenate([pooled(p, table) for p in _pieces(batch["text"].to_pylist())])
                yield pa.record_batch([batch["row"], finish(values)], names=["row", "value"])

    return slim.mapInArrow(run, f"row {slim.schema['row'].dataType.simpleString()}, value {kind}")


def _lists(values: np.ndarray) -> pa.Array:
    return pa.array(list(values), pa.list_(pa.float32()))


@dataclass
class Network:
    """Standardised input, one hidden layer, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Fits the network by Adam, then the temperature on every fifth row, which it leaves out.

    Without rows of both labels every score is the share of label 1 (a half without rows).
    """
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    width = x.shape[1]
    if len(y) < 10 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        zero = np.zeros(width)
        return Network(zero, zero + 1, np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    held = np.arange(len(x)) % 5 == 0
    train, want = x[~held], y[~held]
    net = Network(
        train.mean(axis=0), train.std(axis=0) + 1e-4, rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0,
    )
    names = ("w1", "b1", "w2", "b2")
    first = {n: 0.0 for n in names}
    second = {n: 0.0 for n in names}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for rows in np.array_split(rng.permutation(len(train)), max(1, len(train) // 256)):
            z = (train[rows] - net.mean) / net.scale
            hidden = np.maximum(z @ net.w1 + net.b1, 0)
            error = 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -60, 60))) - want[rows]
            back = error[:, None] * net.w2 * (hidden > 0)
            slopes = {
                "w1": z.T @ back / len(rows) + DECAY * net.w1,
                "b1": back.mean(axis=0),
                "w2": hidden.T @ error / len(rows) + DECAY * net.w2,
                "b2": error.mean(),
            }
            step += 1
            for n, slope in slopes.items():
                first[n] = 0.9 * first[n] + 0.1 * slope
                second[n] = 0.999 * second[n] + 0.001 * slope**2
                move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                setattr(net, n, getattr(net, n) - rate * move)
    logits, truth = net.logits(x[held]), y[held]
    losses = [(np.logaddexp(0, -(2 * truth - 1) * logits / t).mean(), t) for t in np.geomspace(0.25, 16, 61)]
    net.temperature = float(min(losses)[1])
    return net


def train(
    docs: DataFrame, labels: DataFrame, vectors: np.ndarray, *, doc_id: str = "doc_id", text: str = "text"
) -> Network:
    """Fits the network on at most ``SAMPLE_ROWS`` labelled documents that are not held out.

    These are those with the least hash of their id, a plain random choice.
    """
    known = labels.select(F.col("doc_id").alias("ident"), F.col("quality").cast("int").alias("label"))
    known = known.filter("label in (0, 1) and ident is not null").filter(remainder(F.col("ident"), 3) != 1)
    known = known.dropDuplicates(["ident", "label"]).orderBy(F.xxhash64("ident"), "label").limit(SAMPLE_ROWS)
    chosen = docs.select(F.col(doc_id).alias("ident"), F.col(text).alias("text")).join(F.broadcast(known), "ident")
    feats = _pooled_rows(chosen, _lists, "array<float>", vectors, "text", ["ident", "label"]).select("row.*", "value")
    rows = feats.orderBy(F.xxhash64("ident"), "label").limit(SAMPLE_ROWS).collect()
    x = np.array([r.value for r in rows], np.float64).reshape(len(rows), 2 * DIMENSIONS)
    return fit(x, np.array([r.label for r in rows]))


def quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep=None) -> DataFrame:
    """Rows of ``docs`` (as ``row``, with all columns or those to keep) and their ``score``."""
    vectors = context_vectors(docs, text)
    network = docs.sparkSession.sparkContext.broadcast(train(docs, labels, vectors, doc_id=doc_id, text=text))
    score = lambda x: pa.array(network.value.scores(x.astype(np.float64)))
    return _pooled_rows(docs, score, "double", vectors, text, keep).withColumnRenamed("value", "score")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Labels are learned only from documents that are not held out. A null id is not held
    out and has no label; empty and null texts get the score of an empty vector.
    Repeated rows stay rows; rows with several labels count with each. Labels other
    than 0 and 1 are left out. Without labels of both kinds all scores are the same.
    """
    out = quality(docs, labels, keep=["doc_id"]).select("row.doc_id", "score")
    return out.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of a half or more, as they were."""
    return quality(docs, labels).filter("score >= 0.5").select("row.*")
