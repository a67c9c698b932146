"""Token ids in compressed binary blocks: a static range asymmetric numeral system (rANS; Duda, "Asymmetric numeral systems", 2013).

One frequency table, counted over all ids, is shared by all blocks. It is scaled to 2^20 with every id of the corpus at 1 or more. A block
holds the ids of consecutive documents. They are cut into ``lanes`` stretches of equal length, each with a 64-bit state of its own, and one
numpy step codes one id of every lane. Words of 32 bits leave a lane's state when it would overflow; the words of all lanes are interleaved
in the order in which decoding takes them back. So lanes and blocks decode without each other.

Checkpoints: every ``CHECKPOINT`` steps a block notes all states and the place in its words, so decoding can start there and stop at the
next; each stretch between checkpoints has a CRC32 of its ids, and each block one of its bytes.

Block layout, little-endian: magic ``RNB1``, u32 lanes, u64 ids, u64 documents, u32 checkpoints; per document u32 length; per checkpoint
(the first is the start) u64 states[lanes], u64 word place, u32 CRC32; u32 words; last a u32 CRC32 of all before.

Files: blocks are the binary column of Parquet files in the shared folder, with the document ids of each block, its partition and number. Parquet
brings a commit that lost executors cannot spoil and works on any store Spark writes to.

Documents are dealt into ascending ranges of ids and sorted in them. Global starts come from sums per block and per range.

Defined cases: a null or empty text is its end id alone; null ids stand first; rows that repeat an id stand next to each other, ordered by
their text; an empty table gives empty files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tripscope.llm import tokens
from tripscope.llm.common import documents, scratch, written
from tripscope.plans.registry import Book

BOOK = Book()
MAGIC = b"RNB1"
SCALE_BITS = 20
LOW = np.uint64(1 << 32)
LANES = 2048
CHECKPOINT = 64
BLOCK_IDS = 1 << 20
_U32, _MASK = np.uint64(32), np.uint64(0xFFFFFFFF)


class Table(NamedTuple):
    """Scaled frequencies and their running sums, by id."""

    freq: np.ndarray
    start: np.ndarray

    def symbols(self) -> np.ndarray:
        """The id of each of the 2^20 slots."""
        return np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> Table:
    """Frequencies that sum to 2^bits and keep every id that occurs at 1 or more."""
    total, size = int(counts.sum()), 1 << bits
    seen = counts > 0
    freq = np.where(seen, np.maximum(1, counts * (size / max(total, 1))), 0).astype(np.int64)
    # The rest, of either sign, goes to the most frequent, largest first.
    rest, order, i = size - int(freq.sum()), np.argsort(-freq, kind="stable"), 0
    while rest and total:
        at = order[i % int(seen.sum())]
        step = rest if rest > 0 else max(rest, 1 - freq[at])
        freq[at] += step
        rest -= step
        i += 1
    return Table(freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64))


def encode_block(lengths: np.ndarray, ids: np.ndarray, table: Table, lanes: int = LANES) -> bytes:
    """A block of the ids of documents of these lengths."""
    n = len(ids)
    lanes = max(1, min(lanes, -(-n // CHECKPOINT)))
    steps = -(-n // lanes)
    grid = np.full(lanes * steps, ids[0] if n else 0, np.uint16)  # a lane's stretch, filled up at the end
    grid[:n] = ids
    grid = grid.reshape(lanes, steps).T
    shift = np.uint64(64 - SCALE_BITS)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []  # in reverse
    count, marks = 0, []
    for step in range(steps - 1, -1, -1):
        f, c = table.freq[grid[step]], table.start[grid[step]]
        out = (state >> shift) >= f
        low = (state[out] & _MASK).astype(np.uint32)
        state[out] >>= _U32
        words.append(low[::-1])
        count += len(low)
        q = state // f
        state = (q << np.uint64(SCALE_BITS)) + (state - q * f) + c
        if step % CHECKPOINT == 0:
            marks.append((state.copy(), count, zlib.crc32(np.ascontiguousarray(grid[step : step + CHECKPOINT]).tobytes())))
    flow = np.concatenate(words)[::-1] if words else np.empty(0, np.uint32)
    parts = [MAGIC, struct.pack("<IQQI", lanes, n, len(lengths), len(marks)), lengths.astype("<u4").tobytes()]
    for states, at, crc in reversed(marks):
        parts += [states.astype("<u8").tobytes(), struct.pack("<QI", count - at, crc)]
    body = b"".join([*parts, struct.pack("<I", len(flow)), flow.astype("<u4").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A block read back; ``decode`` gives any range of checkpoints, or everything."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("damaged block")
        self.lanes, self.n, docs, marks = struct.unpack_from("<IQQI", raw, 4)
        at = 28
        self.lengths = np.frombuffer(raw, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        self.marks = []
        for _ in range(marks):
            states = np.frombuffer(raw, "<u8", self.lanes, at)
            place, crc = struct.unpack_from("<QI", raw, at + 8 * self.lanes)
            self.marks.append((states, place, crc))
            at += 8 * self.lanes + 12
        self.flow = np.frombuffer(raw, "<u4", struct.unpack_from("<I", raw, at)[0], at + 4)
        self.steps = -(-self.n // self.lanes)

    def stretch(self, k: int, table: Table, symbols: np.ndarray) -> np.ndarray:
        """Steps x lanes of ids from checkpoint ``k`` to the next."""
        states, place, crc = self.marks[k]
        state = states.astype(np.uint64)
        grid = np.empty((min(CHECKPOINT, self.steps - k * CHECKPOINT), self.lanes), np.uint16)
        mask, bits = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
        for step in range(len(grid)):
            slot = state & mask
            ids = symbols[slot.astype(np.int64)]
            grid[step] = ids
            state = table.freq[ids] * (state >> bits) + slot - table.start[ids]
            short = state < LOW
            k_words = int(np.count_nonzero(short))
            state[short] = (state[short] << _U32) | self.flow[place : place + k_words]
            place += k_words
        if zlib.crc32(grid.tobytes()) != crc:
            raise ValueError("damaged stretch")
        return grid

    def decode(self, table: Table, symbols: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.empty(0, np.uint16)
        grid = np.concatenate([self.stretch(k, table, symbols) for k in range(len(self.marks))])
        return np.ascontiguousarray(grid.T).reshape(-1)[: self.n]


def _encoded(path: str, end_id: int):
    """Ids of each text of a range, and at its end one row of the range's counts by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, "word", "H").encode
        end, part, n = np.uint16(end_id).tobytes(), TaskContext.get().partitionId(), 0
        counts = np.zeros(1 << 16, np.int64)
        names = ["part", "nth", "doc_id", "ids", "counts"]
        for batch in batches:
            packed = [encode(t or "") + end for t in batch.column("text").to_pylist()]
            counts += np.bincount(np.frombuffer(b"".join(packed), "<u2"), minlength=1 << 16)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, part)), pa.array(np.arange(n, n + rows)), batch.column("doc_id"), pa.array(packed, pa.binary()), pa.nulls(rows, pa.list_(pa.int64()))], names
            )
            n += rows
        if n:
            seen = np.flatnonzero(counts)
            pairs = np.stack([seen, counts[seen]], 1).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([-1]), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([pairs.tolist()], pa.list_(pa.int64()))], names)

    return run


def _blocks(table: Table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        packed: list[bytes] = []
        held, first = 0, None

        def flush(part: int) -> pa.RecordBatch:
            lengths = np.fromiter((len(p) >> 1 for p in packed), np.int64, len(packed))
            raw = encode_block(lengths, np.frombuffer(b"".join(packed), "<u2"), table)
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([first]), pa.array([int(lengths.sum())]), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([raw], pa.binary())], ["part", "nth", "n_ids", "doc_ids", "block"]
            )

        at = None
        for batch in batches:
            for part, nth, doc_id, value in zip(*(batch.column(c).to_pylist() for c in ("part", "nth", "doc_id", "ids"))):
                # A task may read several ranges, or parts of them.
                if packed and (part != at or nth != first + len(packed) or held >= BLOCK_IDS):
                    yield flush(at)
                    ids, packed, held, first = [], [], 0, None
                at, first = part, nth if first is None else first
                ids.append(doc_id)
                packed.append(value)
                held += len(value) >> 1
        if packed:
            yield flush(at)

    return run


class Files(NamedTuple):
    path: str
    table: Table


def write(docs: DataFrame, path: str | None = None, end_id: int = 1, to: str | None = None) -> Files:
    """Encodes all documents in ascending order of their ids and writes them."""
    spark = docs.sparkSession
    path, to = path or tokens.vocabulary_path(tokens.WORD_BPE), to or scratch(spark, "rans")
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ids = written(ranged.mapInArrow(_encoded(path, end_id), "part long, nth long, doc_id long, ids binary, counts array<long>"), "ids")
    pairs = ids.filter("counts IS NOT NULL").select(F.explode(F.expr("transform(sequence(0, size(counts) div 2 - 1), i -> struct(counts[2 * i] AS id, counts[2 * i + 1] AS n))")).alias("c"))
    counts = np.zeros(1 << 16, np.int64)
    for row in pairs.groupBy("c.id").agg(F.sum("c.n").alias("n")).collect():  # at most 2^16 rows
        counts[row["id"]] = row["n"]
    table = scaled(counts)
    blocks = ids.filter("counts IS NULL").select("part", "nth", "doc_id", "ids").mapInArrow(_blocks(table), "part long, nth long, n_ids long, doc_ids array<long>, block binary")
    blocks.write.option("compression", "none").parquet(to)
    return Files(to, table)


def read(spark: SparkSession, files: Files) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document from its files; ids packed little-endian 32-bit."""
    blocks = spark.read.schema("part long, nth long, n_ids long, doc_ids array<long>, block binary").parquet(files.path)
    table = files.table

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = table.symbols()
        for batch in batches:
            for part, nth, doc_ids, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "nth", "doc_ids", "block"))):
                block = Block(raw)
                ids = block.decode(table, symbols).astype("<u4")
                ends = np.cumsum(block.lengths)
                starts = ends - block.lengths
                values = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
                k = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, part)), pa.array(np.full(k, nth)), pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(block.lengths), pa.array(values, pa.binary())],
                    ["part", "nth", "doc_id", "inside", "n_tokens", "ids"],
                )

    sizes = blocks.select("part", "nth", "n_ids")
    before = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    in_part = sizes.select("part", "nth", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("in_part"))
    # One row per range of ids, a few for each task.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    places = in_part.join(parts, "part").select("part", "nth", (F.col("before") + F.col("in_part")).alias("base"))
    rows = blocks.select("part", "nth", "doc_ids", "block").mapInArrow(decoded, "part long, nth long, doc_id long, inside long, n_tokens long, ids binary")
    rows = rows.select("part", "nth", "doc_id", "inside", "n_tokens", F.crc32("ids").alias("ids_crc32"), "ids")
    return rows.join(places, ["part", "nth"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ids")


@BOOK.query("op7_rans_token_files")
def rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as token ids, written in blocks and read back."""
    return read(spark, write(documents(spark, sf_dir))).drop("ids")
