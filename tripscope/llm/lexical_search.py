"""Ranked lexical search over a length-stratified index.

Documents with the same length normaliser ``m`` form a stratum. Within a stratum the postings of a term are grouped by its frequency
``tf``, so the impact of a term is a function of (term, m, tf) and is computed once for each, never per posting.

*Index.* Texts are read once: a forward table has each document's terms with their frequencies. The corpus counts follow from it, and
with them ``m``. Strata are cut into blocks of bounded size (a stratum may hold any share of the documents), and each block is inverted
on its own into one row. The index covers every document and every term; it serves any later set of items.

*Search.* The bound of a stratum for an item is the sum of its terms' impacts at their highest frequency there. Each item visits its
strata from the highest bound down: the first visits give a threshold, the k-th score found, and only strata whose bound reaches it are
visited after that. Inside a stratum each block is held against its own bound first. No score is estimated: what is not visited cannot
rank among the first k. Items are taken in sets of at most ``TERM_PAIRS`` (item, term) pairs, which is what tasks receive of them.

Defined cases: a null or empty text has no terms, counts nowhere and is never found; an item without terms or without matches has no
rows; rows that repeat an item id are one item with the terms of all of them; rows that repeat a document id are documents of their own,
with a place each; a null document id ranks after the others of equal score; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tripscope.llm.common import documents, per_arrow_batch, table, written
from tripscope.plans.registry import Book

BOOK = Book()
#: A block holds at most this many documents and about this many terms of text; one longer document is a block of its own.
BLOCK_DOCS = 2048
BLOCK_TERMS = 1 << 19
#: (item, term) pairs searched for together; an item with more distinct terms is searched for alone.
TERM_PAIRS = 1 << 16
#: The first visits of an item cover at least this many documents per wanted row.
FIRST_DOCS = 64
#: Visits of a set are broadcast up to this many (item, stratum) pairs, 12 bytes each, and joined by shuffle beyond it.
BROADCAST_VISITS = 1 << 20
#: A worker holds the counted terms of texts up to about this many before it hands them on.
HELD_TERMS = 1 << 17
#: The number of blocks per stratum is broadcast up to this many strata, 16 bytes each.
BROADCAST_STRATA = 100_000
#: Scores are kept for this many (item, document) pairs at a time.
CELLS = 1 << 21

# Bytes outside terms become spaces, A-Z become a-z; every byte of a character above 0x7F belongs to a term.
_KEEP = bytes(c if chr(c).isalnum() or c > 0x7F else 0x20 for c in range(256))
_TO_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in _KEEP)

FORWARD = "id long, n long, terms array<binary>, tfs array<int>, turn long"
INDEX = (
    "m long, block long, ids array<long>, n_terms long, terms array<binary>, dfs array<int>, max_tfs array<int>, run_of array<int>, run_tf array<int>, run_start array<int>, postings array<int>"
)
FOUND = "item long, number int, id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_TERMS).split(b" ") if text else []


def _counted(text: str | None) -> Counter:
    counts = Counter(terms_of(text))
    counts.pop(b"", None)
    return counts


def _lists(values: list, sizes: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)), pa.array(values, kind))


def forward(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, tfs, turn) per document with a term; ``turn`` deals the documents of a stratum to its blocks."""

    def packed(ids: list, rows: list[Counter], turn: int) -> pa.RecordBatch:
        sizes = [len(c) for c in rows]
        columns = [
            pa.array(ids, pa.int64()), pa.array([c.total() for c in rows], pa.int64()), _lists([t for c in rows for t in c], sizes, pa.binary()),
            _lists([f for c in rows for f in c.values()], sizes, pa.int32()), pa.array(range(turn, turn + len(rows)), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "tfs", "turn"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, held, ids, rows = 0, 0, [], []
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                counts = _counted(text.as_py())
                if counts:
                    ids.append(i.as_py())
                    rows.append(counts)
                    held += len(counts)
                # Counted texts are large as objects, so few of them are held at a time.
                if held > HELD_TERMS:
                    yield packed(ids, rows, turn)
                    turn, held, ids, rows = turn + len(rows), 0, [], []
        if rows:
            yield packed(ids, rows, turn)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, FORWARD)


def _inverted(group: pa.Table) -> pa.Table:
    """One index row from the forward rows of a block."""
    group = group.combine_chunks()
    terms = group["terms"].combine_chunks()
    sizes = np.diff(terms.offsets.to_numpy())
    coded = terms.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    tf = group["tfs"].combine_chunks().flatten().to_numpy()
    code = coded.indices.to_numpy()
    order = np.lexsort((doc, -tf, code))
    code, tf, doc = code[order], tf[order], doc[order]
    starts_term = np.concatenate([[True], code[1:] != code[:-1]])
    starts_run = starts_term | np.concatenate([[True], tf[1:] != tf[:-1]])
    at_run = np.flatnonzero(starts_run)
    at_term = np.flatnonzero(starts_term)
    run_of = np.searchsorted(at_run, at_term)
    dfs = np.diff(np.append(at_term, len(code)))
    flat = lambda values: pa.array([values])
    whole = lambda values: flat(np.asarray(values, np.int32))
    return pa.Table.from_arrays(
        [
            group["m"].slice(0, 1), group["block"].slice(0, 1), pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), group["id"].combine_chunks()),
            pa.array([int(tf.sum(dtype=np.int64))], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary),
            whole(dfs), whole(tf[at_term]), whole(np.append(run_of, len(at_run))), whole(tf[at_run]), whole(np.append(at_run, len(code))), whole(doc),
        ],
        names=["m", "block", "ids", "n_terms", "terms", "dfs", "max_tfs", "run_of", "run_tf", "run_start", "postings"],
    )


class Index(NamedTuple):
    """Blocks of the index with the corpus counts they were built from."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Indexes every document with a term."""
    rows = written(forward(docs, id_col, text_col), "forward")
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    placed = rows.withColumn("m", F.expr(f"50 + (CAST(n AS DECIMAL(19,0)) * {50 * n_docs}BD) div {max(n_terms, 1)}BD"))
    # One row per stratum: their number is bounded by the longest text, not by the number of documents.
    strata = placed.groupBy("m").agg(F.count("*").alias("docs"), F.max("n").alias("longest"))
    cut = written(strata.selectExpr("m", f"ceil(docs / greatest(1, least({BLOCK_DOCS}, {BLOCK_TERMS} div longest))) AS n_blocks"), "strata-blocks")
    if cut.count() <= BROADCAST_STRATA:
        cut = F.broadcast(cut)
    dealt = placed.join(cut, "m").withColumn("block", F.pmod(F.xxhash64("id", "turn"), F.col("n_blocks")))
    # Dealt by stratum and block: a partitioning by stratum alone, which the join may leave, would bring a large stratum into one task.
    dealt = dealt.select("m", "block", "id", "terms", "tfs").repartition("m", "block")
    blocks = dealt.groupBy("m", "block").applyInArrow(_inverted, INDEX)
    return Index(written(blocks, "index"), n_docs, n_terms)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term), each pair once."""

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [(i.as_py(), t) for i, text in zip(batch.column(0), batch.column(1)) for t in _counted(text.as_py())]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())], names=["item", "term"])

    return per_arrow_batch(items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")), split, "item long, term binary").distinct()


_IMPACT = "(1000000000L * {tf}) div (1000L * {tf} + 20L * m)"


class _Queries:
    """The items of one set, as tasks receive them: their terms, weights, and which items hold each term."""

    def __init__(self, weighted: pa.Table):
        """From (item, term, w) rows; a null item id is an item like others."""
        weighted = weighted.combine_chunks()
        coded = pc.dictionary_encode(weighted["item"], null_encoding="encode").combine_chunks()
        named = pc.dictionary_encode(weighted["term"]).combine_chunks()
        self.items, row = coded.dictionary, coded.indices.to_numpy()
        self.terms, at = named.dictionary, named.indices.to_numpy()
        self.weight = np.zeros(len(self.terms), np.int64)
        self.weight[at] = weighted["w"].to_numpy()
        by_item = np.lexsort((at, row))
        self.item_terms, self.item_at = at[by_item], np.searchsorted(row[by_item], np.arange(len(self.items) + 1))
        by_term = np.lexsort((row, at))
        self.term_items, self.term_at = row[by_term], np.searchsorted(at[by_term], np.arange(len(self.terms) + 1))

    def bounds(self, best: np.ndarray) -> np.ndarray:
        """Per item, the sum of its terms' impacts."""
        total = np.concatenate([[0], np.cumsum(best[self.item_terms])])
        return total[self.item_at[1:]] - total[self.item_at[:-1]]


class _Best:
    """The best rows per item that a task has found so far; their k-th score is a bound for what it still looks at."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.rows = [np.empty(0, np.int64)] * 4
        self.more: list[list[np.ndarray]] = []
        self.waiting, self.limit = 0, 2 * k * n_items

    def add(self, item: np.ndarray, score: np.ndarray, missing: np.ndarray, doc: np.ndarray) -> None:
        self.more.append([item, score, missing, doc])
        self.waiting += len(item)
        if self.waiting > self.limit:
            self.cut()

    def cut(self) -> None:
        item, score, missing, doc = (np.concatenate(p) for p in zip(self.rows, *self.more))
        order = np.lexsort((doc, missing, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        last = order[place == self.k - 1]
        self.floor[item[last]] = np.maximum(self.floor[item[last]], score[last])
        kept = order[place < self.k]
        self.rows, self.more, self.waiting = [item[kept], score[kept], missing[kept], doc[kept]], [], 0


def _impacts(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _visit(block: dict, queries: _Queries, best: _Best) -> None:
    """Scores the documents of a block for the items that visit it."""
    m, docs = block["m"], block["ids"]
    visitors = np.asarray(block["items"])
    best.floor[visitors] = np.maximum(best.floor[visitors], block["floors"])
    at = pc.index_in(queries.terms, value_set=block["terms"])
    known = np.flatnonzero(np.asarray(pc.is_valid(at)))
    place = np.asarray(pc.fill_null(at, 0))[known]
    top = np.zeros(len(queries.weight), np.int64)
    top[known] = queries.weight[known] * _impacts(block["max_tfs"][place], m)
    active = visitors[queries.bounds(top)[visitors] >= best.floor[visitors]]
    impact = _impacts(block["run_tf"], m)
    run_len = np.diff(block["run_start"])
    missing, ids = np.asarray(pc.is_null(docs)).astype(np.int64), np.asarray(pc.fill_null(docs, 0))
    step = max(1, CELLS // max(1, len(docs)))
    for begin in range(0, len(active), step):
        chosen = active[begin : begin + step]
        row_of = np.full(len(queries.items), -1)
        row_of[chosen] = np.arange(len(chosen))
        scores = np.zeros((len(chosen), len(docs)), np.int64)
        for t, p in zip(known, place):
            rows = row_of[queries.term_items[queries.term_at[t] : queries.term_at[t + 1]]]
            rows = rows[rows >= 0]
            if len(rows):
                first, end = block["run_of"][p], block["run_of"][p + 1]
                held = block["postings"][block["run_start"][first] : block["run_start"][end]]
                gain = np.zeros(len(docs), np.int64)
                gain[held] = queries.weight[t] * np.repeat(impact[first:end], run_len[first:end])
                scores[rows] += gain
        item, doc = np.nonzero(scores >= best.floor[chosen][:, None])
        best.add(chosen[item], scores[item, doc], missing[doc], ids[doc])


_FLAT = ("max_tfs", "run_of", "run_tf", "run_start", "postings", "items", "floors")


def _scored(blocks: DataFrame, visits: DataFrame, queries: _Queries, k: int) -> DataFrame:
    """The best ``k`` rows per item that each task finds in the strata that ``visits(m, items, floors)`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(queries.items), k)
        for batch in batches:
            names = batch.schema.names
            for r in range(batch.num_rows):
                cells = {name: batch.column(c)[r] for c, name in enumerate(names)}
                block = {n: cells[n].values for n in ("ids", "terms")} | {n: cells[n].values.to_numpy() for n in _FLAT}
                _visit(block | {"m": cells["m"].as_py()}, queries, best)
        best.cut()
        item, score, missing, doc = best.rows
        yield pa.RecordBatch.from_arrays(
            [queries.items.take(pa.array(item)), pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=missing.astype(bool)), pa.array(score, pa.int64())],
            names=["item", "number", "id", "score"],
        )

    reached = blocks.join(visits, "m").select("m", "ids", "terms", *_FLAT)
    return reached.mapInArrow(run, FOUND)


def _first_k(found: DataFrame, k: int) -> DataFrame:
    best_first = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def _by_stratum(wanted: DataFrame) -> DataFrame:
    """``wanted(m, number, floor)`` as one row per stratum; broadcast where its size has been checked."""
    wanted = written(wanted, "visits")
    small = wanted.count() <= BROADCAST_VISITS
    both = F.collect_list(F.struct("number", "floor"))
    grouped = wanted.groupBy("m").agg(both.alias("v")).select("m", F.col("v.number").alias("items"), F.col("v.floor").alias("floors"))
    return F.broadcast(grouped) if small else grouped


def search(index: Index, pairs: DataFrame, k: int) -> DataFrame:
    """(item, rank, id, score): the ``k`` best documents for each item of ``pairs(item, term)``, all if fewer."""
    spark = pairs.sparkSession
    pairs = written(pairs, "item-terms")
    each = index.blocks.select("m", F.explode(F.arrays_zip("terms", "dfs", "max_tfs")).alias("e")).select("m", F.col("e.terms").alias("term"), "e.dfs", "e.max_tfs")
    stats = written(each.join(pairs.select("term").distinct(), "term", "left_semi").groupBy("m", "term").agg(F.sum("dfs").alias("df"), F.max("max_tfs").cast("long").alias("max_tf")), "term-strata")
    weight = F.floor(1000 * F.ln(F.lit(2 * index.n_docs + 2) / (2 * F.col("df") + 1))).alias("w")
    weights = stats.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight).filter("w > 0")
    # A term of no weight adds nothing to any score.
    n_sets = max(1, -(-2 * pairs.count() // TERM_PAIRS))
    weighted = written(pairs.join(weights, "term").withColumn("part", F.pmod(F.xxhash64("item"), F.lit(n_sets))), "weighted")
    docs_of = written(index.blocks.groupBy("m").agg(F.sum(F.size("ids")).alias("docs")), "strata")
    parts = [_search_set(index, stats, docs_of, weighted.filter(F.col("part") == s), k) for s in range(n_sets)]
    found = [p for p in parts if p is not None]
    if not found:
        return spark.createDataFrame([], "item long, rank int, id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select("item", "rank", "id", "score")


def _search_set(index: Index, stats: DataFrame, docs_of: DataFrame, weighted: DataFrame, k: int) -> DataFrame | None:
    spark = weighted.sparkSession
    local = weighted.select("item", "term", "w").toArrow()
    if not local.num_rows:
        return None
    queries = _Queries(local)
    numbers = spark.createDataFrame([(i, n) for n, i in enumerate(queries.items.to_pylist())], "id long, number int")
    numbered = weighted.join(numbers, F.col("item").eqNullSafe(F.col("id")))
    bound = F.sum(F.expr("w * (" + _IMPACT.format(tf="max_tf") + ")")).alias("bound")
    bounds = stats.join(numbered, "term").groupBy("number", "m").agg(bound).join(docs_of, "m")
    down = Window.partitionBy("number").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)
    ordered = written(bounds.withColumn("before", F.coalesce(F.sum("docs").over(down), F.lit(0))), "bounds")
    early = F.col("before") < FIRST_DOCS * k
    first = written(_first_k(_scored(index.blocks, _by_stratum(ordered.filter(early).select("m", "number", F.lit(1).cast("long").alias("floor"))), queries, k), k), "first-visits")
    floors = first.filter(F.col("rank") == k).select("number", F.col("score").alias("floor"))
    rest = ordered.filter(~early).join(floors, "number", "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long"))).filter("bound >= floor")
    later = _scored(index.blocks, _by_stratum(rest.select("m", "number", "floor")), queries, k)
    return _first_k(first.drop("rank").union(later), k)


_SQL = r"""
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS r FROM documents),
d AS (SELECT * FROM lowered WHERE len(terms) > 0),
stats AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
norm AS (SELECT r, doc_id, 50 + ((50 * len(terms) * n_docs) // n_terms) AS m FROM d, stats),
posting AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM posting GROUP BY term), stats),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM wanted JOIN weight USING (term) JOIN posting USING (term) JOIN norm USING (r) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM scored JOIN norm USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@BOOK.query("op11_lexical_search", _SQL)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all ``documents`` for each ``benchmark`` item."""
    index = build_index(documents(spark, sf_dir))
    found = search(index, item_terms(table(spark, sf_dir, "benchmark")), 50)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
