"""Repeated byte strings by bucket-pointer refinement (after Schuermann and Stoye, "An incomplex algorithm for fast suffix array
construction", 2005), on a sampled suffix array.

A byte is removed when a string of ``length`` bytes that covers it also starts anywhere else. Suffixes are not sorted one by one; only
those at anchors are. The anchor of a window of ``length`` bytes is its q-gram of least hash (leftmost on ties), so equal windows have
equal anchors at equal offsets, and every window belongs to exactly one anchor. An anchor owns a range of offsets; about one byte in 85
is an anchor.

1. *Initial buckets*: anchors by their q-gram. A bucket with one member is final: the windows it owns occur once.
2. *Refinement*: each bucket is split by what stands around the anchor (all bytes that its windows can reach, marked where a text ends).
   Members of one sub-bucket with two or more members repeat in all they own. A sub-bucket of one is refined further if its bucket has
   other sub-buckets. A sub-bucket of any size goes on as one member, so hot passages cost one row.
3. *Recursion*: the offsets are cut into blocks. A block's bucket is what all its windows share; its sub-bucket what any of them
   reaches. The same rule settles it or hands it on, at last to single offsets, where sub-bucket and window are the same.

A bucket is always named by hashes of its parents' parts and its own; each is a 64-bit polynomial hash over random byte values. Texts are
named by a 64-bit hash of all their bytes, so equal texts are handled once and rows without or with repeated ids need no care.

Counts use map-side combine; joins are on hashes with one row per key on one side, which AQE can split. Nothing is collected per
bucket. Texts are moved twice: once to fetch the bytes around unsettled anchors, and once to cut repeats out.

Defined cases: a null text is empty; texts shorter than ``length`` keep all; rows keep their id, null or repeated; an empty table gives
an empty result; other columns are kept by ``cut_repeats`` and ignored by ``repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripscope.llm.common import discard, documents, per_arrow_batch, per_batch, written
from tripscope.plans.registry import Book

BOOK = Book()
QGRAM = 32
CHUNK_BYTES = 2 << 20
_RNG = np.random.default_rng(20050131)
#: One random value per byte, and one for places outside a text.
_BYTE = _RNG.integers(0, 2**63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OUTSIDE = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, from prefix and suffix minima of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    prefix = np.minimum.accumulate(table, axis=1).ravel()
    suffix = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


class _Anchors:
    """Anchors of the windows of texts laid end to end, with what stands around them."""

    def __init__(self, length: int):
        if not 2 * QGRAM <= length <= QGRAM + 255:
            raise ValueError(f"length must lie between {2 * QGRAM} and {QGRAM + 255}")
        self.length, self.span = length, length - QGRAM  # offsets run from 0 to span

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text number, place, first own offset, last own offset, q-gram hash, surroundings hash) of each anchor."""
        length, gap = self.length, self.length
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = gap + np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
        total = int(starts[-1] + sizes[-1] + gap)
        symbol = np.full(total, OUTSIDE, np.uint16)
        for at, text in zip(starts, texts):
            symbol[at : at + len(text)] = np.frombuffer(text, np.uint8)
        up, down = self._tables(total)
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(_BYTE[symbol] * up[:total], out=sums[1:])

        def hashed(a, b):
            return _mixed((sums[b] - sums[a]) * down[a])

        grams = total - QGRAM + 1
        order = _mixed((sums[QGRAM:] - sums[:grams]) * down[:grams])
        packed = (order & ~np.uint64(0xFFFFFFFF)) | np.arange(grams, dtype=np.uint64)
        own = (_window_minima(packed, self.span + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Windows that lie in one text.
        counts = np.maximum(sizes - length + 1, 0)
        text_of = np.repeat(np.arange(len(texts)), counts)
        first = np.cumsum(counts) - counts
        begin = np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(starts, counts)
        if not len(begin):
            empty = np.empty(0, np.int64)
            return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
        anchor = own[begin]
        turn = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text_of[1:] != text_of[:-1])]))
        last = np.concatenate([turn[1:], [len(begin)]]) - 1
        at, which = anchor[turn], text_of[turn]
        lo, hi = at - begin[last], at - begin[turn]
        return which, at - starts[which], lo, hi, order[at], hashed(at - self.span, at + length)

    _held: tuple[np.ndarray, np.ndarray] | None = None

    def _tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if _Anchors._held is None or len(_Anchors._held[0]) < n + 1:
            _Anchors._held = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
        return _Anchors._held


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of rows of at most ``CHUNK_BYTES`` of text, or one row."""
    for batch in batches:
        sizes = batch["body"].map(len).to_numpy()
        group = np.cumsum(sizes) // CHUNK_BYTES
        for _, part in batch.groupby(group, sort=False):
            yield part


def _anchor_rows(length: int):
    finder = _Anchors(length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _pieces(batches):
            which, at, lo, hi, gram, around = finder.of([t.encode("utf-8", "surrogatepass") for t in part["body"]])
            if len(which):
                yield pd.DataFrame({
                    "text_key": part["text_key"].to_numpy()[which], "place": (at << 16) | (lo << 8) | hi,
                    "gram": gram.view(np.int64), "around": around.view(np.int64),
                })

    return run


def _place(name: str):
    """Place of an anchor, and the first and last offset it owns, from the packed column."""
    c = F.col(name)
    return F.shiftright(c, 16), F.shiftright(c, 8).bitwiseAND(F.lit(255)), c.bitwiseAND(F.lit(255))


def _contexts(length: int):
    span = length - QGRAM

    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        out = {k: [] for k in ("ctx", "text_key", "place", "gram", "many", "bytes", "left", "right")}
        for key, text, anchors in zip(batch["text_key"], batch["body"], batch["anchors"]):
            raw = text.encode("utf-8", "surrogatepass")
            for a in anchors:
                at = a["place"] >> 16
                left, right = max(0, at - span), min(len(raw), at + length)
                for k, v in (("ctx", a["around"]), ("text_key", key), ("place", a["place"]), ("gram", a["gram"]), ("many", a["many"]), ("bytes", raw[left:right]), ("left", span - (at - left)), ("right", span + right - at)):
                    out[k].append(v)
        return pd.DataFrame(out)

    return fn


_CONTEXT_ROWS = "ctx long, text_key long, place long, gram long, many boolean, bytes binary, left int, right int"


def _frames(batch: pd.DataFrame, length: int) -> np.ndarray:
    """Prefix hashes of each context, laid out so that its anchor stands at the same place."""
    width = 2 * length - QGRAM
    symbol = np.full((len(batch), width), OUTSIDE, np.uint16)
    for row, raw, left in zip(symbol, batch["bytes"], batch["left"]):
        row[left : left + len(raw)] = np.frombuffer(raw, np.uint8)
    sums = np.zeros((len(batch), width + 1), np.uint64)
    np.cumsum(_BYTE[symbol] * _powers(_BASE, width), axis=1, out=sums[:, 1:])
    return sums


def _part(sums: np.ndarray, rows: np.ndarray, a: np.ndarray, b: np.ndarray, *also: np.ndarray) -> np.ndarray:
    out = _mixed((sums[rows, b] - sums[rows, a]))
    for x in also:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64))
    return out.view(np.int64)


def _block_rows(length: int, width: int):
    """For each context and block of offsets it owns: bucket (what its windows share) and sub-bucket (what they reach)."""
    span = length - QGRAM

    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        sums = _frames(batch, length)
        place = batch["place"].to_numpy()
        lo, hi = (place >> 8) & 255, place & 255
        gram = batch["gram"].to_numpy().view(np.uint64)
        out = []
        for block in range(-(-(span + 1) // width)):
            a, b = block * width, min(span, block * width + width - 1)
            rows = np.flatnonzero((lo <= b) & (hi >= a))
            fill = np.full(len(rows), block)
            shared = _part(sums, rows, np.full(len(rows), span - a), np.full(len(rows), span - b + length), gram[rows], fill)
            reach = _part(sums, rows, np.full(len(rows), span - b), np.full(len(rows), span - a + length))
            out.append(pd.DataFrame({"ctx": batch["ctx"].to_numpy()[rows], "block": fill.astype(np.int32), "many": batch["many"].to_numpy()[rows], "bucket": shared, "sub": reach}))
        return pd.concat(out)

    return fn


def _offset_rows(length: int, width: int):
    """For each context and offset in a block that goes on: the window there."""
    span = length - QGRAM

    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        sums = _frames(batch, length)
        place = batch["place"].to_numpy()
        lo, hi = (place >> 8) & 255, place & 255
        gram, on = batch["gram"].to_numpy().view(np.uint64), batch["on"].to_numpy()
        sure, many = batch["sure"].to_numpy(), batch["many"].to_numpy()
        out = [pd.DataFrame({"ctx": np.empty(0, np.int64), "offset": np.empty(0, np.int32), "window": np.empty(0, np.int64), "settled": np.empty(0, bool)})]
        for offset in range(span + 1):
            bit = np.int64(1) << np.int64(offset // width)
            rows = np.flatnonzero((lo <= offset) & (hi >= offset) & ((on & bit) != 0))
            if not len(rows):
                continue
            window = _part(sums, rows, np.full(len(rows), span - offset), np.full(len(rows), span - offset + length), gram[rows], np.full(len(rows), offset))
            settled = many[rows] | ((sure[rows] & bit) != 0)
            out.append(pd.DataFrame({"ctx": batch["ctx"].to_numpy()[rows], "offset": np.full(len(rows), offset, np.int32), "window": window, "settled": settled}))
        return pd.concat(out)

    return fn


def _refined(rows: DataFrame, weight: F.Column) -> DataFrame:
    """Sub-buckets of ``rows(bucket, sub, ...)``: how often each occurs, and whether its bucket has others."""
    subs = rows.groupBy("bucket", "sub").agg(F.sum(weight).alias("n"), F.min("ctx").alias("leader"))
    buckets = subs.groupBy("bucket").agg((F.count("*") > 1).alias("on"))
    return subs.join(buckets, "bucket")


def _text_key(text: F.Column) -> F.Column:
    return F.xxhash64(text)


def _runs(docs: DataFrame, length: int, width: int) -> DataFrame:
    """(text_key, runs): starts of repeated windows as ranges [lo, hi], for the texts that have any.

    The result is written, and tables on the way to it are deleted as soon as what follows from them is written.
    """
    span = length - QGRAM
    body = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(_text_key(body).alias("text_key"), body.alias("body"))
    anchors = written(
        texts.filter(F.octet_length("body") >= length).mapInPandas(_anchor_rows(length), "text_key long, place long, gram long, around long"), "anchors"
    )
    shared = anchors.groupBy("gram").count().filter("count > 1").select("gram")
    live = written(anchors.join(shared, "gram", "left_semi"), "live-anchors")
    discard(anchors)

    # Surroundings: one row for each that differs, however often it occurs.
    seen = live.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("text_key", "place")).alias("at"))
    buckets = seen.groupBy("gram").agg((F.count("*") > 1).alias("on"))
    seen = written(seen.join(buckets, "gram"), "surroundings")
    at, lo, hi = _place("place")
    whole = live.join(seen.filter("n > 1").select("gram", "around"), ["gram", "around"], "left_semi").select("text_key", (at - hi).alias("lo"), (at - lo).alias("hi"))

    # Unsettled surroundings, with their bytes.
    open_ = seen.filter("on").select("at.text_key", F.struct(F.col("at.place").alias("place"), "gram", "around", (F.col("n") > 1).alias("many")).alias("a"))
    per_text = open_.groupBy("text_key").agg(F.collect_list("a").alias("anchors"))  # bounded by the anchors of one text
    found = texts.join(per_text, "text_key").select("text_key", "body", "anchors")
    contexts = written(per_batch(found, _contexts(length), _CONTEXT_ROWS).dropDuplicates(["ctx", "gram", "text_key", "place"]), "contexts")

    # Blocks of offsets.
    blocks = written(per_batch(contexts, _block_rows(length, width), "ctx long, block int, many boolean, bucket long, sub long"), "blocks")
    weight = F.when(F.col("many"), 2).otherwise(1)
    subs = _refined(blocks, weight)
    bit = F.expr("shiftleft(1L, block)")
    told = blocks.join(subs, ["bucket", "sub"]).groupBy("ctx").agg(
        F.bit_or(F.when(F.col("n") > 1, bit).otherwise(0)).alias("sure"),
        F.bit_or(F.when(F.col("on") & ((F.col("n") == 1) | (F.col("ctx") == F.col("leader"))), bit).otherwise(0)).alias("on"),
    )
    told = written(told, "told")
    discard(blocks)
    known = contexts.filter("NOT many").join(told.filter("sure <> 0"), "ctx").select("text_key", "place", F.explode(F.sequence(F.lit(0), F.lit(span // width))).alias("block"), "sure")
    known = known.filter(F.expr("(sure >> block) & 1 = 1")).select("text_key", "place", (F.col("block") * width).alias("o1"), (F.col("block") * width + width - 1).alias("o2"))

    # Single offsets.
    going = contexts.join(told.filter("on <> 0"), "ctx")
    offsets = written(per_batch(going, _offset_rows(length, width), "ctx long, offset int, window long, settled boolean"), "offsets")
    windows = offsets.groupBy("window").agg(F.sum(F.when(F.col("settled"), 2).otherwise(1)).alias("n")).filter("n > 1").select("window")
    single = offsets.filter("NOT settled").join(windows, "window", "left_semi").join(contexts.select("ctx", "text_key", "place"), "ctx")
    single = single.select("text_key", "place", F.col("offset").alias("o1"), F.col("offset").alias("o2"))

    part = known.union(single).withColumns({"o1": F.greatest("o1", lo), "o2": F.least("o2", hi)}).filter("o1 <= o2")
    part = part.select("text_key", (at - F.col("o2")).alias("lo"), (at - F.col("o1")).alias("hi"))
    runs = whole.union(part).distinct()
    out = written(runs.groupBy("text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "runs")  # bounded by the length of one text
    discard(live, seen, contexts, told, offsets)
    return out


def removed(raw: bytes, runs, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed stretches of a text."""
    turn = np.zeros(len(raw) + 2, np.int32)
    lo = np.fromiter((r["lo"] for r in runs), np.int64, len(runs))
    hi = np.fromiter((r["hi"] for r in runs), np.int64, len(runs))
    np.add.at(turn, lo + 1, 1)
    np.add.at(turn, hi + length + 1, -1)
    gone = np.cumsum(turn)[: len(raw) + 1] > 0
    gone = np.concatenate([gone, [False]])
    edge = np.flatnonzero(gone[1:] != gone[:-1])
    return edge[0::2], edge[1::2]


def _cut(length: int):
    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        out = {k: [] for k in ("text_key", "n_removed", "n_spans", "kept_sha256", "kept_text")}
        for key, text, runs in zip(batch["text_key"], batch["body"], batch["runs"]):
            raw = text.encode("utf-8", "surrogatepass")
            starts, ends = removed(raw, runs, length)
            kept = [raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)])]
            out["text_key"].append(key)
            out["n_removed"].append(int((ends - starts).sum()))
            out["n_spans"].append(len(starts))
            out["kept_sha256"].append(hashlib.sha256(b"".join(kept)).hexdigest())
            # A character that is only partly left goes as a whole.
            out["kept_text"].append("".join(k.decode("utf-8", "ignore") for k in kept))
        return pd.DataFrame(out)

    return fn


def cut_texts(docs: DataFrame, length: int = 200, width: int = 13) -> DataFrame:
    """(text_key, n_removed, n_spans, kept_sha256, kept_text), one row for each different text that loses bytes."""
    body = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(_text_key(body).alias("text_key"), body.alias("body"))
    runs = _runs(docs, length, width)
    cut = per_batch(texts.join(runs, "text_key"), _cut(length), "text_key long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return cut.groupBy("text_key").agg(*[F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", "kept_text")])


def repeats(docs: DataFrame, length: int = 200, width: int = 13) -> DataFrame:
    """One row per input row: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    body = F.coalesce(F.col("text"), F.lit(""))
    cut = written(cut_texts(docs, length, width).drop("kept_text"), "cut")
    rows = docs.select("doc_id", _text_key(body).alias("text_key"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return rows.join(cut, "text_key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")
    )


def _without(length: int, columns: list[str]):
    """Cuts the runs in the last column out of ``text``; all other columns pass through."""
    text_at = columns.index("text")
    chars_at = columns.index("n_chars") if "n_chars" in columns else None

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = list(batch.columns[:-1])
        runs = batch.column(len(out))
        texts = out[text_at].to_pylist()
        changed = np.flatnonzero(np.asarray(runs.is_valid()))
        for i in changed:
            raw = texts[i].encode("utf-8", "surrogatepass")
            starts, ends = removed(raw, runs[i].as_py(), length)
            # A character that is only partly left goes as a whole.
            texts[i] = "".join(raw[a:b].decode("utf-8", "ignore") for a, b in zip([0, *ends], [*starts, len(raw)]))
        out[text_at] = pa.array(texts, out[text_at].type)
        if chars_at is not None:
            chars = out[chars_at].to_pylist()
            for i in changed:
                chars[i] = len(texts[i])
            out[chars_at] = pa.array(chars, out[chars_at].type)
        return pa.RecordBatch.from_arrays(out, names=columns)

    return fn


def cut_repeats(docs: DataFrame, length: int = 200, width: int = 13) -> DataFrame:
    """All rows with their columns; ``text`` without the repeated stretches, ``n_chars`` (if there) counted anew where it changed.

    Rows meet their runs in one join and are cut where they lie, so whole texts move once.
    """
    runs = _runs(docs, length, width)
    name = "runs"
    while name in docs.columns:
        name += "_"
    key = _text_key(F.coalesce(F.col("d.text"), F.lit("")))
    rows = docs.alias("d").join(runs.alias("r"), key == F.col("r.text_key"), "left").select("d.*", F.col("r.runs").alias(name))
    return per_arrow_batch(rows, _without(length, docs.columns), docs.schema)


@BOOK.query("op9_bucket_pointer_dedup")
def bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` covered by a 200-byte string that starts anywhere else."""
    return repeats(documents(spark, sf_dir), 200)
