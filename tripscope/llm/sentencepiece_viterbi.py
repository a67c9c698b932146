"""SentencePiece encoding and decoding, all words of one length at once: by merges for BPE models, by a Viterbi search for unigram ones.

A text is normalised as the model says (identity, a space in front), spaces become U+2581, and it is cut in front of each run of these,
which no piece of the vocabularies used here crosses (checked when the vocabulary is read). The words new to a worker are taken in
groups of equal length: substring hashes of every length are looked up in the sorted hashes of the pieces. Words are remembered up to a
bound.

``encode``, and so the query, merges: the scores of ``piece_bpe_32k.model`` are ranks of merges, whose sum says nothing, so a Viterbi
search does not give its ids. Each step joins, in every word of the group, the two neighbours that make the piece of the best score, the
leftmost on ties; words without such a pair are done, so all others have equally many parts. Words above ``LONG`` characters are merged
one by one with a heap. The ids are those of ``sentencepiece``. A character without a piece is written as its UTF-8 bytes.

``encoder`` is the Viterbi search, for models whose scores are log probabilities. It advances one place at a time and keeps, for all
words, the best score and the length of the piece that gave it; ties go to the longer last piece; a character without a piece costs the
lowest score less ten.

Decoding joins the bytes of the pieces. It gives back every text but those that contain U+2581 themselves or are a lone space.

Defined cases: a null or empty text has no ids; ids of rows may be null or repeat; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripscope.llm import tokens
from tripscope.llm.common import documents, per_arrow_batch
from tripscope.plans.registry import Book

BOOK = Book()
PIECES = "piece_bpe_32k.model"
SPACE = "▁"
GROUP = 1 << 19
LONG = 96
UNKNOWN = -2
_BASE = 0x9E3779B97F4A7C15
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Vocabulary:
    """Pieces of a model with the sorted hashes by which substrings find them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece runs across a space")
        self.longest = max(len(self.pieces[i]) for i in plain)
        self.up, self.down = _powers(_BASE, 64), _powers(pow(_BASE, -1, 1 << 64), 64)
        keys = np.array([self.hashes(self.pieces[i])[-1] for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain, np.int32)[order]
        scores = np.array([model.get_score(i) for i in plain])
        self.scores, self.unknown = scores[order], scores.min() - 10
        self.ranked = {self.pieces[i]: (s, i) for s, i in zip(scores.tolist(), plain)}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if model.is_byte(i)}
        self.raw = [b""] * len(self.pieces)
        for i in plain:
            self.raw[i] = self.pieces[i].replace(SPACE, " ").encode()
        for byte, i in self.byte_ids.items():
            self.raw[i] = bytes([byte])

    def _tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            self.up, self.down = _powers(_BASE, 2 * n), _powers(pow(_BASE, -1, 1 << 64), 2 * n)
        return self.up, self.down

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """Prefix sums along the last axis, from which any substring's hash follows."""
        n = codes.shape[-1]
        up, _ = self._tables(n)
        out = np.zeros((*codes.shape[:-1], n + 1), np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64) * np.uint64(_BASE) + np.uint64(1)) * up[:n], axis=-1, out=out[..., 1:])
        return out

    def hashes(self, word: str) -> np.ndarray:
        """Hashes of the beginnings of a word."""
        return _mixed(self.sums(np.array([ord(c) for c in word], np.uint32)))

    def found(self, sums: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Place in the sorted pieces, and whether there is one, of all substrings of a size."""
        _, down = self._tables(sums.shape[-1])
        n = sums.shape[-1] - size
        key = _mixed((sums[:, size:] - sums[:, :n]) * down[:n])
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.keys[at] == key

    def _tabled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece of each size, word (all of one length) and start."""
        n, count = len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(count, n)
        sums = self.sums(codes)
        longest = min(self.longest, n)
        score = np.full((longest + 1, count, n), -np.inf)  # by size, word, start
        piece = np.full((longest + 1, count, n), UNKNOWN, np.int32)
        for size in range(1, longest + 1):
            at, hit = self.found(sums, size)
            places = slice(0, n - size + 1)
            score[size, :, places] = np.where(hit, self.scores[at], -np.inf)
            piece[size, :, places] = np.where(hit, self.ids[at], UNKNOWN)
        return score, piece

    def search(self, words: list[str]) -> list[bytes]:
        """Packed ids of words of one length, by highest summed score."""
        n, count = len(words[0]), len(words)
        score, piece = self._tabled(words)
        longest = len(score) - 1
        score[1] = np.where(piece[1] == UNKNOWN, self.unknown, score[1])
        best = np.full((count, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((count, n + 1), np.int32)
        for end in range(1, n + 1):
            sizes = np.arange(min(longest, end), 0, -1)
            options = score[sizes, :, end - sizes] + best[:, end - sizes].T
            pick = options.argmax(axis=0)
            best[:, end] = options[pick, np.arange(count)]
            back[:, end] = sizes[pick]
        return self._collected(words, piece, back)

    def merged(self, words: list[str]) -> list[bytes]:
        """Packed ids of words of one length, by merges in the order of scores."""
        n = len(words[0])
        if n > LONG:
            return [self._merged_long(w) for w in words]
        score, piece = self._tabled(words)
        rows, bounds = np.arange(len(words)), np.tile(np.arange(n + 1), (len(words), 1))
        out = [b""] * len(words)
        while len(rows):
            size = bounds[:, 2:] - bounds[:, :-2]
            fits = size < len(score)
            gain = np.where(fits, score[np.where(fits, size, 0), rows[:, None], bounds[:, :-2]], -np.inf)
            pick = gain.argmax(axis=1) if gain.shape[1] else np.zeros(len(rows), np.int64)
            more = gain[np.arange(len(rows)), pick] > -np.inf if gain.shape[1] else np.zeros(len(rows), bool)
            ended, row = bounds[~more], rows[~more]
            grid = piece[np.diff(ended, axis=1), row[:, None], ended[:, :-1]]
            for at, ids in zip(row.tolist(), grid):
                out[at] = (self._bytes(words[at], ids) if (ids == UNKNOWN).any() else ids).astype("<u4").tobytes()
            bounds, rows, pick = bounds[more], rows[more], pick[more]
            stays = np.ones(bounds.shape, bool)
            stays[np.arange(len(rows)), pick + 1] = False
            bounds = bounds[stays].reshape(len(rows), bounds.shape[1] - 1)
        return out

    def _merged_long(self, word: str) -> bytes:
        """The same for one word, with a heap of the pairs."""
        n, ranked = len(word), self.ranked
        after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int]] = []

        def push(left: int) -> None:
            if left >= 0 and (right := after[left]) < n and ends[right] - left <= self.longest and (found := ranked.get(word[left : ends[right]])):
                heapq.heappush(heap, (-found[0], left, ends[right]))

        for left in range(n - 1):
            push(left)
        while heap:
            _, left, end = heapq.heappop(heap)
            right = after[left]
            if ends[left] < 0 or right >= n or ends[right] != end:
                continue  # one of the two has been joined with another
            ends[left], after[left], ends[right] = end, after[right], -1
            if after[left] < n:
                before[after[left]] = left
            push(left)
            push(before[left])
        ids, at = [], 0
        while at < n:
            ids.append(ranked.get(word[at : ends[at]], (0, UNKNOWN))[1])
            at = ends[at]
        return self._bytes(word, np.array(ids, np.int64)).astype("<u4").tobytes()

    def _collected(self, words: list[str], piece: np.ndarray, back: np.ndarray) -> list[bytes]:
        rows, at, steps = np.arange(len(words)), np.full(len(words), len(words[0])), []
        while (at > 0).any():
            size = back[rows, at]
            steps.append(np.where(at > 0, piece[size, rows, at - size], -1))
            at = at - size
        grid = np.stack(steps[::-1], 1)
        out = []
        for word, ids in zip(words, grid):
            ids = ids[ids != -1]
            if (ids == UNKNOWN).any():
                ids = self._bytes(word, ids)
            out.append(ids.astype("<u4").tobytes())
        return out

    def _bytes(self, word: str, ids: np.ndarray) -> np.ndarray:
        out, at = [], 0
        for i in ids:
            if i == UNKNOWN:
                out += [self.byte_ids[b] for b in word[at].encode("utf-8", "surrogatepass")]
                at += 1
            else:
                out.append(int(i))
                at += len(self.pieces[i])
        return np.array(out, np.int64)


class Encoder(dict):
    """Packed ids by word, by the Viterbi search."""

    BOUND = 200_000

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def learn(self, words: list[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for word in words:
            by_size.setdefault(len(word), []).append(word)
        for size, same in by_size.items():
            step = max(1, GROUP // (size * min(size, self.vocabulary.longest)))
            for at in range(0, len(same), step):
                part = same[at : at + step]
                self.update(zip(part, self.ids_of(part)))

    def ids_of(self, words: list[str]) -> list[bytes]:
        return self.vocabulary.search(words)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [words_of(t) for t in texts]
        now = set().union(*cut)
        new = now - self.keys()
        if len(self) + len(new) > self.BOUND:
            # Words met again are the frequent ones; the others make room.
            again = {w: self[w] for w in now - new}
            self.clear()
            self.update(again)
        self.learn(sorted(new))
        return [b"".join([self[w] for w in words]) for words in cut]


class Merger(Encoder):
    """Packed ids by word, by merges."""

    def ids_of(self, words: list[str]) -> list[bytes]:
        return self.vocabulary.merged(words)


def words_of(text: str) -> list[str]:
    """A text with a space in front, cut before each run of spaces."""
    if not text:
        return []
    parts = text.split(" ")
    if SPACE in text or "" in parts:
        return _RUNS.findall(SPACE + text.replace(" ", SPACE))
    return [SPACE + p for p in parts]


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    raw = vocabulary.raw
    text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


_HELD: dict[tuple[str, type], Encoder] = {}


def _held(path: str, kind: type[Encoder]) -> Encoder:
    if (path, kind) not in _HELD:
        _HELD[path, kind] = kind(Vocabulary(path))
    return _HELD[path, kind]


def encoder(path: str) -> Encoder:
    """The Viterbi encoder of this worker."""
    return _held(path, Encoder)


def merger(path: str) -> Encoder:
    """The merging encoder of this worker."""
    return _held(path, Merger)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text, ids) of every row; ids packed little-endian 32-bit."""
    path = path or tokens.vocabulary_path(PIECES)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[bytes] = []
        texts, own = batch.column("text").to_pylist(), merger(path)
        for at in range(0, len(texts), 1000):
            out += own.encode([t or "" for t in texts[at : at + 1000]])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(out, pa.binary())], ["doc_id", "text", "ids"])

    return per_arrow_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fn, "doc_id long, text string, ids binary")


def decoded(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of the ids, to a table with ``ids``."""
    path = path or tokens.vocabulary_path(PIECES)
    names = [*encoded.columns, "decoded"]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = merger(path).vocabulary
        texts = [decode(vocabulary, np.frombuffer(v, "<u4")) for v in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return per_arrow_batch(encoded, fn, ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded string")


ROUND_TRIP = "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean"


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes each text where it lies and returns what identifies the result; neither ids nor texts leave the worker."""
    path = path or tokens.vocabulary_path(PIECES)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = merger(path)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        found: list[tuple] = []
        for at in range(0, len(texts), 1000):
            part = texts[at : at + 1000]
            for text, packed in zip(part, own.encode(part)):
                back = decode(own.vocabulary, np.frombuffer(packed, "<u4"))
                found.append((len(packed) // 4, zlib.crc32(packed), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == text))
        n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, *columns], ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip"])

    return per_arrow_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fn, ROUND_TRIP)


@BOOK.query("op5_viterbi_sentencepiece")
def viterbi_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` encoded and decoded again."""
    return round_trip(documents(spark, sf_dir))
