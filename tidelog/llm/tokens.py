"""Token-id files of packed sequences.

Each task packs its documents in groups of bounded size. Documents longer than a
sequence are split without loss. Pieces go, longest first, to the sequence with the
least room that still holds them; a segment tree over room sizes finds it. A file
(``.npz``) holds a group:

``ids``              matrix of sequences by ``length``, padded with the end id
``cu_seqlens``       cumulative segment lengths of all sequences, from 0
``sequence_starts``  for each sequence, its first segment, and the number of segments last
``position_resets``  where in the flattened matrix positions begin again at 0
``doc_ids``, ``doc_known``, ``doc_starts``, ``doc_tokens``  of each segment: its document
(``doc_known`` is false for a null id), the document's ids before it, and of the whole document
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.vocabulary import VOCABULARY, encoder
from tidelog.session import materialize, work_dir
from tidelog.sources.arrow_files import open_fs

LENGTH, END = 2048, 50256
#: Tokens of a group, which is a file.
GROUP_TOKENS = 4 << 20


class Rooms:
    """Open sequences by the room they have left; a segment tree finds the tightest that fits."""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.some = np.zeros(2 * self.width, np.int64).tolist()
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, sequence: int, room: int) -> None:
        self.open[room].append(sequence)
        self._change(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The sequence with the least room of at least ``size``, and its room."""
        node = self.width + size
        if not self.some[node]:
            # Up to the first node with something to its right, then down to its least leaf.
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        room = node - self.width
        self._change(room, -1)
        return self.open[room].pop(), room

    def _change(self, room: int, by: int) -> None:
        node = self.width + room
        while node:
            self.some[node] += by
            node >>= 1


def best_fit(sizes: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, size): split at ``length``, then best fit decreasing."""
    pieces = [(d, a, min(length, n - a)) for d, n in enumerate(sizes) for a in range(0, n, length)]
    pieces.sort(key=lambda p: (-p[2], p[0], p[1]))
    rooms, sequences = Rooms(length), []
    for piece in pieces:
        found = rooms.take(piece[2])
        if found is None:
            found = len(sequences), length
            sequences.append([])
        sequence, room = found
        sequences[sequence].append(piece)
        if room > piece[2]:
            rooms.add(sequence, room - piece[2])
    return sequences


def encode_file(docs: list[np.ndarray], idents: list, length: int, end: int) -> bytes:
    """The bytes of a group's file."""
    sequences = best_fit([len(d) for d in docs], length)
    ids = np.full((len(sequences), length), end, np.uint32)
    sizes, resets, pieces = [], [], []
    for row, sequence in enumerate(sequences):
        at = 0
        for doc, start, size in sequence:
            ids[row, at : at + size] = docs[doc][start : start + size]
            resets.append(row * length + at)
            sizes.append(size)
            pieces.append((doc, start))
            at += size
    which = [p[0] for p in pieces]
    out = io.BytesIO()
    np.savez(
        out,
        ids=ids.astype(np.uint16) if ids.max() < 1 << 16 else ids,
        cu_seqlens=np.cumsum([0, *sizes]),
        sequence_starts=np.cumsum([0, *map(len, sequences)]),
        position_resets=np.array(resets, np.int64),
        doc_ids=np.array([idents[d] or 0 for d in which], np.int64),
        doc_known=np.array([idents[d] is not None for d in which]),
        doc_starts=np.array([p[1] for p in pieces], np.int64),
        doc_tokens=np.array([len(docs[d]) for d in which], np.int64),
    )
    return out.getvalue()


def write(
    docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Writes the files below ``folder`` and returns ``path`` and number ``file`` of each.

    A null or empty text is its end id. Repeated rows and null ids are documents like any
    other; the id is an integer. A task names its files by its attempt, and only files
    of attempts that succeeded are in the result; no row, no file.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(vocabulary)
        files, target = open_fs(folder)
        files.create_dir(target, recursive=True)
        context = TaskContext.get()
        stem = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        held: list[np.ndarray] = []
        idents: list = []
        tokens, count = 0, 0

        def close() -> pa.RecordBatch:
            name = f"{stem}-{count:04d}.npz"
            with files.open_output_stream(f"{target}/{name}", compression=None) as out:
                out.write(encode_file(held, idents, length, end))
            number = (context.partitionId() << 20) + count
            return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([number])], names=["path", "file"])

        for batch in batches:
            for ident, body in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                held.append(codes.encode(body, end))
                idents.append(ident)
                tokens += len(held[-1])
                if tokens >= GROUP_TOKENS:
                    yield close()
                    held, idents, tokens, count = [], [], 0, count + 1
        if held:
            yield close()

    return materialize(slim.mapInArrow(run, "path string, file long"), "token_files")


def decode_file(data: bytes) -> dict[str, np.ndarray]:
    """The arrays of a file, and ``segments``: (sequence, offset, size) of each; checked for consistency."""
    with np.load(io.BytesIO(data)) as file:
        arrays = {name: file[name] for name in file.files}
    sizes = np.diff(arrays["cu_seqlens"])
    sequence = np.repeat(np.arange(len(arrays["ids"])), np.diff(arrays["sequence_starts"]))
    before = arrays["cu_seqlens"][arrays["sequence_starts"][:-1]]
    offset = arrays["cu_seqlens"][:-1] - before[sequence]
    if not np.array_equal(sequence * arrays["ids"].shape[1] + offset, arrays["position_resets"]):
        raise ValueError("positions and segments of a token file differ")
    arrays["segments"] = np.stack([sequence, offset, sizes], axis=1)
    return arrays


def read_back(written: DataFrame) -> DataFrame:
    """One row for each segment of the files: ``doc_id``, ``start``, ``length``, ``doc_tokens``,
    ``sequence_id``, ``offset``, and ``ids`` from the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, number in zip(batch["path"].to_pylist(), batch["file"].to_pylist()):
                files, name = open_fs(path)
                with files.open_input_stream(name, compression=None) as source:
                    a = decode_file(source.read())
                for begin in range(0, len(a["segments"]), 1024):
                    part = slice(begin, begin + 1024)
                    segments = a["segments"][part]
                    cut = [a["ids"][row, at : at + n] for row, at, n in segments]
                    bounds = pa.array(np.cumsum([0, *map(len, cut)]), pa.int32())
                    yield pa.record_batch(
                        [
                            pa.array(a["doc_ids"][part], pa.int64(), mask=~a["doc_known"][part]),
                            pa.array(a["doc_starts"][part]),
                            pa.array(segments[:, 2]),
                            pa.array(a["doc_tokens"][part]),
                            pa.array((number << 24) + segments[:, 0]),
                            pa.array(np.ascontiguousarray(segments[:, 1])),
                            pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(cut).astype(np.int32))),
                        ],
                        names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                    )

    # A path is small, but its file is not: the paths are dealt out to many tasks.
    tasks = 16 * written.sparkSession.sparkContext.defaultParallelism
    spread = written.repartition(max(1, min(written.count(), tasks)))
    return spread.mapInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    )


def report(docs: DataFrame, **options) -> DataFrame:
    """Writes all documents to token files in the shared folder, reads them back, and tells each segment.

    Columns as of ``read_back``, with ``ids_crc32`` (of the ids as little-endian 32-bit
    numbers) instead of the ids.
    """
    segments = read_back(write(docs, work_dir(docs.sparkSession, "tokens"), **options))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch["ids"].flatten().to_numpy().astype("<u4")
            ends = np.cumsum(batch["length"].to_numpy())
            sums = [zlib.crc32(flat[e - n : e].tobytes()) for e, n in zip(ends, batch["length"].to_numpy())]
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(sums, pa.int64())], names=[*batch.schema.names[:-1], "ids_crc32"]
            )

    return segments.mapInArrow(
        digest,
        "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long",
    )
