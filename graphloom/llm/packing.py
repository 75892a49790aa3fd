"""Packing documents into training sequences of balanced attention cost.

Within a cell (at most ``CELL_TOKENS`` tokens of one partition) the documents go, longest first, to the sequence of the lowest
estimated cost (linear plus quadratic in the length of each piece) that has room for them; a document that fits nowhere is cut
to fill the cheapest one with room. A cell fills whole sequences; what is left over moves to the next cell. What a partition
has left at its end is cut into sequences whose lengths are powers of two, which need no padding. No row is shuffled and no
task holds more than a cell.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .tokens import tokenizer_path, word_ids

SEQUENCE, END_ID, CELL_TOKENS = 4096, 2, 1 << 20
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n. Their ratio is that of 12 * width to 2 for a width of 1024.
LINEAR, QUADRATIC = 6144.0, 1.0
OUT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

#: doc_id, start in its document, ids, and the document's number of tokens.
Piece = tuple


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack_cell(pieces: list[Piece], sequences: int, size: int = SEQUENCE) -> tuple[list[tuple[int, int, Piece]], list[Piece]]:
    """((sequence, offset, piece), ...) that fill so many sequences as far as the pieces go, and the pieces left over."""
    if not sequences:
        return [], pieces
    costs, room = np.zeros(sequences), np.full(sequences, size)
    placed: list[tuple[int, int, Piece]] = []
    left: list[Piece] = []
    for doc, start, ids, whole in sorted(pieces, key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1])):
        while len(ids):
            fits = room >= len(ids)
            open_ = fits if fits.any() else room > 0
            if not open_.any():
                left.append((doc, start, ids, whole))
                break
            k = int(np.where(open_, costs, np.inf).argmin())
            n = int(min(room[k], len(ids)))
            placed.append((k, size - int(room[k]), (doc, start, ids[:n], whole)))
            costs[k] += cost(n)
            room[k] -= n
            start, ids = start + n, ids[n:]
    return placed, left


def pack_rest(pieces: list[Piece], size: int = SEQUENCE) -> list[tuple[int, int, Piece]]:
    """The pieces one after another in sequences whose lengths are powers of two."""
    total = sum(len(p[2]) for p in pieces)
    lengths = [size] * (total // size) + [1 << b for b in reversed(range(size.bit_length())) if (total % size) >> b & 1]
    placed, k, used = [], 0, 0
    for doc, start, ids, whole in pieces:
        while len(ids):
            n = min(len(ids), lengths[k] - used)
            placed.append((k, used, (doc, start, ids[:n], whole)))
            start, ids, used = start + n, ids[n:], used + n
            if used == lengths[k]:
                k, used = k + 1, 0
    return placed


def _tasks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = word_ids(path), np.array([END_ID], dtype="<u4")
        first = TaskContext.get().partitionId() << 32
        sequences, held, tokens = 0, [], 0

        def out(placed: list[tuple[int, int, Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequences
            for at in range(0, len(placed), 4096):
                some = placed[at : at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0] for _, _, p in some], pa.int64()),
                        pa.array([p[1] for _, _, p in some], pa.int64()),
                        pa.array([len(p[2]) for _, _, p in some], pa.int64()),
                        pa.array([zlib.crc32(p[2]) for _, _, p in some], pa.int64()),
                        pa.array([p[3] for _, _, p in some], pa.int64()),
                        pa.array([first + sequences + k for k, _, _ in some], pa.int64()),
                        pa.array([o for _, o, _ in some], pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )
            sequences += 1 + max((k for k, _, _ in placed), default=-1)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.many(batch.column(1)), strict=True):
                ids = np.append(ids, end)
                n = len(ids)
                whole = n - n % SEQUENCE  # full sequences of their own
                if whole:
                    yield from out([(i // SEQUENCE, 0, (doc, i, ids[i : i + SEQUENCE], n)) for i in range(0, whole, SEQUENCE)])
                if whole < n:
                    held.append((doc, whole, ids[whole:].copy() if whole else ids, n))
                    tokens += n - whole
                if tokens >= CELL_TOKENS:
                    placed, held = pack_cell(held, tokens // SEQUENCE)
                    yield from out(placed)
                    tokens = sum(len(p[2]) for p in held)
        placed, held = pack_cell(held, tokens // SEQUENCE)
        yield from out(placed)
        yield from out(pack_rest(held))

    return run


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Defined results: a null or empty text is its end id alone; a null doc_id and repeated rows are documents like any other;
    equal lengths go by doc_id, nulls last; a text of more than 4096 tokens first gives whole sequences of its own; an empty
    table gives no rows; other columns are ignored. sequence_id is the partition's number times 2**32 plus a count within it.
    """
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(tidy(_tasks(tokenizer_path(tokenizer))), OUT)
