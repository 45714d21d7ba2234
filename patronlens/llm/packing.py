"""Token ids and best-fit-decreasing packing into fixed rows.

Each text becomes the ids of a given vocabulary and an end id. Documents longer than a row are split
into pieces of full rows and a rest, so no id is lost. Pieces wait in a window of ``WINDOW_ROWS``
rows' worth of ids; then the longest goes first into the fullest row that still holds it, found by a
segment tree over the free capacities. Packing runs inside the scan's tasks: no shuffle, memory
bounded by the window, and a task run again packs the same rows.

A packed row has ``pack_id``, ``input_ids`` and ``position_ids`` (little-endian matrices' rows of
``length`` entries; unused places hold the end id and position 0), ``cu_seqlens`` (cumulative segment
lengths from 0), and for each segment the document's id, the piece's number and its number of ids.
Positions start again at 0 with every segment, except that the further pieces of a split document go
on counting when ``continue_positions`` is set.

Defined cases: null and empty texts are the end id alone; repeated rows are packed as often as they
come; a null id is a null in ``doc_ids``; an empty table gives an empty table. Other columns are not
carried. Ids are stored in two bytes when all ids fit, in four otherwise.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
WINDOW_ROWS = 512
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_BYTES = 64 << 20
END_ID = 50256
#: The pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PACKED = (
    "pack_id string, n_ids int, cu_seqlens array<int>, doc_ids array<bigint>, piece_numbers array<int>, "
    "input_ids binary, position_ids binary"
)
SCHEMA = pa.schema([
    ("pack_id", pa.string()), ("n_ids", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())),
    ("piece_numbers", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary()),
])


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The rank file as it is, read by the driver; it is refused beyond ``VOCABULARY_BYTES``, since tasks receive it whole."""
    with open(path, "rb") as file:
        raw = file.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return raw


def encoding(raw: bytes, pattern: str = PATTERN):
    """The encoder of a rank file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_LONG_RUN = re.compile(r"\S{4096,}|\s{4096,}")


def encode(encoder, text: str | None) -> np.ndarray:
    """Ids of a text. Runs without a break are cut every 4,096 characters, which keeps the encoder's time linear; the ids still decode to the text."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    if len(text) < 4096 or not _LONG_RUN.search(text):
        return encoder.encode_to_numpy(text, disallowed_special=())
    parts, at = [], 0
    for run in _LONG_RUN.finditer(text):
        parts.append(text[at: run.start()])
        parts += [text[i: min(i + 4096, run.end())] for i in range(run.start(), run.end(), 4096)]
        at = run.end()
    parts.append(text[at:])
    return np.concatenate([encoder.encode_to_numpy(p, disallowed_special=()) for p in parts if p])


class Capacities:
    """Open rows by free capacity, with a segment tree that finds the least capacity of at least a size."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.filled = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = capacity + self.leaves
        while at and not self.filled[at]:
            self.filled[at] = 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) of the fullest row that holds ``size`` more ids."""
        at, filled = size + self.leaves, self.filled
        if not filled[at]:
            while at > 1 and (at & 1 or not filled[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if filled[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            filled[at] = 0
            at >>= 1
            while at and not filled[2 * at] and not filled[2 * at + 1]:
                filled[at] = 0
                at >>= 1
        return capacity, row


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indices into ``sizes``, none over ``length`` in sum, the longest piece placed first."""
    rows: list[list[int]] = []
    open_rows = Capacities(length)
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = open_rows.take(sizes[i])
        if found is None:
            capacity, row = length, len(rows)
            rows.append([])
        else:
            capacity, row = found
        rows[row].append(i)
        if capacity > sizes[i]:
            open_rows.put(capacity - sizes[i], row)
    return rows


def _packer(vocabulary, length: int, end_id: int, window_rows: int, continue_positions: bool) -> Callable:
    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(vocabulary.value)
        kind = "<u2" if max(encoder.max_token_value, end_id) < 1 << 16 else "<u4"
        place = "<u2" if length < 1 << 16 and not continue_positions else "<u4"
        partition, made = TaskContext.get().partitionId(), 0
        waiting: list[tuple[int | None, int, int, np.ndarray]] = []
        weight = 0

        def row_of(pieces):
            nonlocal made
            ids, positions = np.full(length, end_id, dtype=kind), np.zeros(length, dtype=place)
            bounds = [0]
            for _, _, start, own in pieces:
                at = bounds[-1]
                ids[at: at + len(own)] = own
                begin = start if continue_positions else 0
                positions[at: at + len(own)] = np.arange(begin, begin + len(own))
                bounds.append(at + len(own))
            made += 1
            return (f"{partition:06d}-{made:08d}", bounds[-1], bounds, [p[0] for p in pieces], [p[1] for p in pieces], ids.tobytes(), positions.tobytes())

        def batches_of(groups):
            for at in range(0, len(groups), 256):
                rows = [row_of([waiting[i] for i in g]) for g in groups[at: at + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encode(encoder, text.as_py()), np.uint32(end_id)).astype(kind)
                for number, start in enumerate(range(0, len(ids), length)):
                    waiting.append((doc_id, number, start, ids[start: start + length]))
                weight += len(ids)
                if weight >= window_rows * length:
                    yield from batches_of(best_fit([len(w[3]) for w in waiting], length))
                    waiting.clear()
                    weight = 0
        if waiting:
            yield from batches_of(best_fit([len(w[3]) for w in waiting], length))

    return pack_partition


def packed(documents: DataFrame, vocabulary: bytes, length: int = LENGTH, end_id: int = END_ID, window_rows: int = WINDOW_ROWS,
           continue_positions: bool = False) -> DataFrame:
    """Packed rows of all ``documents`` (doc_id, text); see the module's text for the columns."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_packer(shared, length, end_id, window_rows, continue_positions), PACKED)


def write_packed(documents: DataFrame, path: str, vocabulary: bytes, **options) -> None:
    """Write the packed rows as Parquet; every task writes its own matrix rows."""
    packed(documents, vocabulary, **options).write.mode("overwrite").parquet(path)
