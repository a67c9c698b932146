"""What a chain of filters removes in every order of its filters, by forward-backward path counting on the subset lattice.

A state of the lattice is the set of filters already applied, an edge applies one more. What an edge removes depends on its state alone,
not on the order that led there, so a document is reduced to one mask of the filters it fails, masks are counted per part, and every
edge's removals follow from those counts. The orders that use an edge are the paths from the empty set to its state (forward) times the
paths from its far end to the full set (backward): they weight the edge for the Shapley value, and each order's steps are read from the
same edges. Texts are read once; after the counts nothing grows with the documents.

Defined cases: a null text is empty, a null part is the empty string; a null id is neither smaller than another nor identical to a
smaller one; rows that repeat an id count each, and a label holds for all rows of its id (repeated label rows: if any says so); a filter
whose condition is null does not fail; an empty table gives no parts and so no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripscope.llm.common import documents, table, written
from tripscope.plans.registry import Book

BOOK = Book()
#: 7! orders of 7 steps are 35,280 rows per part; more filters are better looked at in groups.
MOST_FILTERS = 7
_WORD_GAP = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n", "good", "toxic")


def forward_counts(n: int) -> list[int]:
    """For each set of ``n`` filters, as bits, the number of paths that reach it from the empty set."""
    paths = [1] + [0] * (2**n - 1)
    for state in range(1, 2**n):
        paths[state] = sum(paths[state ^ (1 << f)] for f in range(n) if state >> f & 1)
    return paths


def backward_counts(n: int) -> list[int]:
    """For each set, the number of paths from it to the full set."""
    paths = [0] * (2**n - 1) + [1]
    for state in range(2**n - 2, -1, -1):
        paths[state] = sum(paths[state | (1 << f)] for f in range(n) if not state >> f & 1)
    return paths


def lattice_edges(n: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders through this edge)."""
    ahead, behind = forward_counts(n), backward_counts(n)
    edges = [(s, f, ahead[s] * behind[s | (1 << f)]) for s in range(2**n) for f in range(n) if not s >> f & 1]
    assert sum(w for _, _, w in edges) == n * factorial(n)
    return edges


def order_steps(letters: str) -> list[tuple[str, int, int, int]]:
    """(order, step, state before it, its filter) of every order."""
    rows = []
    for order in permutations(range(len(letters))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(letters[g] for g in order), step, state, f))
            state |= 1 << f
    return rows


def _edge_array(edges: list[tuple[int, int, int]]) -> Column:
    return F.from_json(F.lit(str([{"state": s, "f": f, "orders": w} for s, f, w in edges]).replace("'", '"')), "array<struct<state:int,f:int,orders:long>>")


def audit(masks: DataFrame, letters: str) -> DataFrame:
    """Every order's steps from ``masks(part, mask, n, good, toxic)``, counts per part and mask of failed filters (bit i: ``letters[i]``)."""
    k = len(letters)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters, not {k}")
    spark = masks.sparkSession
    edges = lattice_edges(k)
    bit = F.expr("shiftleft(1, e.f)")
    fails = F.col("mask").bitwiseAND(bit) != 0
    alive = F.col("mask").bitwiseAND(F.col("e.state")) == 0
    # One row per part, mask and edge: at most 2^k masks a part. Every edge is kept for every part, so zeros come out as rows.
    spread = masks.select("part", "mask", *COUNTS, F.explode(_edge_array(edges)).alias("e"))

    def total(which: Column, count: str = "n") -> Column:
        return F.sum(F.when(which, F.col(count)).otherwise(0)).cast("long")

    per_edge = spread.groupBy("part", F.col("e.f").alias("f"), F.col("e.state").alias("state"), F.col("e.orders").alias("orders")).agg(
        total(alive & ~fails).alias("kept"), total(alive & fails).alias("removed"), total(~alive & fails).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"), total(alive & fails, "good").alias("good_lost"), total(alive & fails, "toxic").alias("toxic_lost"),
    )
    shapley = per_edge.groupBy("part", "f").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    valued = per_edge.join(shapley, ["part", "f"])
    # n! * n rows, fixed by the number of filters (at most 35,280), whatever the data: safe to broadcast.
    steps = spark.createDataFrame(order_steps(letters), "filter_order string, step int, state int, f int")
    return valued.join(F.broadcast(steps), ["state", "f"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) from ``rows(id, part, mask)`` and ``labels(doc_id, quality, toxic)``."""
    marked = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("quality") == 1).alias("q"), F.max(F.col("toxic") == 1).alias("t"))
    # Equal rows meet before the join, so that an id in many rows is one row of it.
    seen = rows.groupBy("id", "part", "mask").agg(F.count("*").alias("n"))
    both = seen.join(marked.filter("q OR t"), F.col("id") == F.col("label_id"), "left")

    def of(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias({"q": "good", "t": "toxic"}[flag])

    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("q"), of("t"))


def repeats_of_smaller(rows: DataFrame) -> DataFrame:
    """``rows(id, digest, ...)`` with ``repeats``: whether a smaller id has the same digest.

    The smallest id of each digest is found by a map-side minimum. Rows are then joined on id and digest together, never on the digest
    alone, so the copies of one text are spread over all tasks.
    """
    first = written(rows.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True)), "first-of-text")
    joined = rows.join(first, ["id", "digest"], "left")
    return joined.withColumn("repeats", F.col("id").isNotNull() & F.col("first").isNull()).drop("first")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters A to D on a text that is not null."""
    words = F.filter(F.split(text, _WORD_GAP), lambda w: w != "")
    n_words = F.size(words)
    chars = F.char_length(text)
    upper = chars - F.char_length(F.translate(text, _UPPER, ""))
    return {
        "A": n_words < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n_words,
        "C": 100 * upper > 5 * chars,
        "D": text.rlike("[#$%&*|]"),
    }


def _bits(filters: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters.values())])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask) per row: bits 0 to 3 are the filters A to D, bit 4 is E, a text that a smaller id has too."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), _bits(text_filters(text)).alias("mask")
        ),
        "failures",
    )
    marked = repeats_of_smaller(rows)
    return marked.select("id", "part", F.col("mask").bitwiseOR(F.when(F.col("repeats"), F.lit(16)).otherwise(F.lit(0))).alias("mask"))


_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
first AS (SELECT body, min(doc_id) AS low FROM t GROUP BY body),
w AS (SELECT t.*, string_split_regex(body, '[\x20\x09-\x0D]+') AS pieces FROM t),
m AS (
    SELECT w.doc_id, w.part, len(list_filter(pieces, lambda x: x <> '')) AS nw, len(list_distinct(list_filter(pieces, lambda x: x <> ''))) AS nd,
        length(w.body) AS chars, length(w.body) - length(regexp_replace(w.body, '[A-Z]', '', 'g')) AS upper,
        regexp_matches(w.body, '[#$%&*|]') AS d, coalesce(w.doc_id > first.low, false) AS e
    FROM w JOIN first ON w.body = first.body),
l AS (SELECT doc_id, bool_or(quality = 1) AS q, bool_or(toxic = 1) AS x FROM labels GROUP BY doc_id),
f AS (
    SELECT m.part, nw < 50 AS "A", 100 * nd < 65 * nw AS "B", 100 * upper > 5 * chars AS "C", d AS "D", e AS "E", coalesce(q, false) AS q, coalesce(x, false) AS x
    FROM m LEFT JOIN l ON l.doc_id = m.doc_id),
failed AS (
    SELECT part, CASE WHEN "A" THEN 'A' ELSE '' END || CASE WHEN "B" THEN 'B' ELSE '' END || CASE WHEN "C" THEN 'C' ELSE '' END
        || CASE WHEN "D" THEN 'D' ELSE '' END || CASE WHEN "E" THEN 'E' ELSE '' END AS fails, count(*) AS n, count(*) FILTER (q) AS good, count(*) FILTER (x) AS bad
    FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
    SELECT a.c || b.c || c.c || d.c || e.c AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT o, s::INT AS step, o[s] AS letter, o[1:s - 1] AS before FROM orders, range(1, 6) r(s)),
out AS (
    SELECT part, o, step, letter,
        sum(n) FILTER (translate(fails, before || letter, '') = fails) AS kept,
        sum(n) FILTER (contains(fails, letter) AND translate(fails, before, '') = fails) AS removed,
        sum(n) FILTER (contains(fails, letter) AND translate(fails, before, '') <> fails) AS redundant,
        sum(n) FILTER (fails = letter) AS unique_fails,
        sum(good) FILTER (contains(fails, letter) AND translate(fails, before, '') = fails) AS good_lost,
        sum(bad) FILTER (contains(fails, letter) AND translate(fails, before, '') = fails) AS toxic_lost
    FROM failed, steps GROUP BY ALL)
SELECT part, o AS filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM out
"""


@BOOK.query("op12_filter_audit", _SQL)
def filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the filters A to E remove from ``documents`` in each of their 120 orders, per source."""
    counts = mask_counts(failures(documents(spark, sf_dir)), table(spark, sf_dir, "labels"))
    return audit(counts, "ABCDE")
