"""Cost-balanced packing of token sequences.

The cost of a piece of n tokens in a sequence is estimated as ``linear * n + quadratic * n * n`` (dense layers, and attention within the
piece). Documents are taken by descending length and each goes to the sequence of lowest cost that has room for all of it; one that fits
nowhere whole is cut at the room that the lowest-cost sequence has left. A document longer than a sequence first fills sequences of its own.
The sequences of a run of documents hold exactly its tokens: as many full ones as there are, and for the rest one for each power of two in
its size, so nothing is padded.

Runs are cut while a task streams its partition (``RUN_TOKENS`` tokens, or one longer document), so memory is bounded by a run, no rows
are shuffled, and cost is balanced within each run of some thousand sequences. Sequence ids are the partition's number and a counter.
Rerun after a lost executor, a task reads the same rows in the same order and packs them alike; callers whose rows arrive in varying
order should write them first.

Defined cases: a null text is empty; an empty text is its end token alone; ids may be null or repeat; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripscope.llm import tokens
from tripscope.llm.common import documents
from tripscope.plans.registry import Book

BOOK = Book()
RUN_TOKENS = 4 << 20
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, ...]:
    """(document, start, length, sequence, offset) of the pieces into which documents of these lengths are packed."""
    full = lengths // capacity
    doc = np.repeat(np.arange(len(lengths)), full)
    nth = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    whole = (doc, nth * capacity, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc), np.int64))

    rest = lengths % capacity
    total = int(rest.sum())
    rooms = [capacity] * (total // capacity)
    rooms += [1 << i for i in reversed(range(capacity.bit_length())) if (total % capacity) >> i & 1]
    size = list(rooms)
    # Sequences by the room they have left, cheapest first; ``lowest`` has the cheapest of each room.
    by_room: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    for i, room in enumerate(rooms):
        by_room[room].append((0.0, i))
    lowest = np.full(capacity + 1, np.inf)
    for room in set(rooms):
        lowest[room] = 0.0
    pieces = []
    for at in np.lexsort((np.arange(len(rest)), -rest)):
        left, start = int(rest[at]), int(lengths[at] - rest[at])
        while left:
            room = left + int(lowest[left:].argmin())
            if lowest[room] == np.inf:
                room = 1 + int(lowest[1:].argmin())
            part = min(left, room)
            cost, seq = heapq.heappop(by_room[room])
            lowest[room] = by_room[room][0][0] if by_room[room] else np.inf
            pieces.append((at, start, part, seq, size[seq] - room))
            if room > part:
                cost += linear * part + quadratic * part * part
                heapq.heappush(by_room[room - part], (cost, seq))
                lowest[room - part] = by_room[room - part][0][0]
            left, start = left - part, start + part
    cut = np.array(pieces, np.int64).reshape(-1, 5).T
    cut[3] += len(doc)
    return tuple(np.concatenate([a, b]) for a, b in zip(whole, cut))


def _packer(path: str, end_id: int, capacity: int, linear: float, quadratic: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(path, "byte", "I").encode
        end = np.uint32(end_id).tobytes()
        first = TaskContext.get().partitionId() << 40
        ids: list = []
        packed: list[bytes] = []
        held = 0

        def flush():
            nonlocal first, ids, packed, held
            lengths = np.fromiter((len(p) >> 2 for p in packed), np.int64, len(packed))
            doc, start, length, seq, offset = assign(lengths, capacity, linear, quadratic)
            values = [packed[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            out = pd.DataFrame({
                "doc_id": pd.array([ids[d] for d in doc], "Int64"), "start": start, "length": length, "doc_tokens": lengths[doc],
                "sequence_id": seq + first, "offset": offset, "ids": values,
            })
            first += int(seq.max()) + 1
            ids, packed, held = [], [], 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                packed.append(encode(text or "") + end)
                held += len(packed[-1]) >> 2
                if held >= RUN_TOKENS:
                    yield flush()
        if packed:
            yield flush()

    return run


def pack(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 4096) -> DataFrame:
    """Pieces of all documents with their ids (packed little-endian 32-bit): columns as in ``PIECES``."""
    path = path or tokens.vocabulary_path(tokens.BYTE_BPE)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_packer(path, end_id, capacity, linear, quadratic), PIECES)


@BOOK.query("op4_cost_balanced_packing")
def cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 1024 tokens."""
    pieces = pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
