"""Quality rules as a bitmask ledger.

Each rule is evaluated once per text: the ledger has the measurements and one long with a bit for every rule that failed. Policies are
named sets of rules with a version; applying one to the ledger is a bitwise AND, so policies can change without reading texts again. An
ablation counts, per policy and rule, what the rule rejects, what it alone rejects, and what would be rejected without it, from
counts per distinct mask (map-side), however many rows share one.

Defined cases: a null or empty text has no words and fails ``few_words``; ids may be null or repeat, each row has its own entry; an empty
table gives an empty ledger; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripscope.llm.common import documents
from tripscope.plans.registry import Book

BOOK = Book()
WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_bytes", "n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "longest_word"]
LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)


def _per(part: str, whole: str, percent: int) -> Column:
    """Whether ``part`` is over a percentage of ``whole``."""
    return 100 * F.col(part) > percent * F.col(whole)




def rules() -> dict[str, Column]:
    """Failure condition of each rule over the measurements; the place in this dict is the rule's bit."""
    return {
        "few_words": F.col("n_words") < 20,
        "repeated_words": _per("n_repeat_words", "n_words", 30),
        "many_words": F.col("n_words") > 2_000_000,
        "many_symbols": _per("n_symbols", "n_words", 40),
        "repeated_lines": (F.col("n_lines") >= 4) & _per("n_dup_lines", "n_lines", 50),
        "long_words": F.col("word_chars") > 25 * F.col("n_words"),
        "short_words": (F.col("n_words") > 0) & (F.col("word_chars") < 2 * F.col("n_words")),
        "upper_case": _per("n_upper", "word_chars", 60),
        "digits": _per("n_digits", "word_chars", 50),
        "endless_word": F.col("longest_word") > 1000,
    }


class Policy(NamedTuple):
    name: str
    version: int
    rules: tuple[str, ...]


BASE = ("few_words", "repeated_words")
POLICIES = [
    Policy("base", 1, BASE),
    Policy("prose", 1, (*BASE, "many_symbols", "repeated_lines", "upper_case")),
    Policy("prose", 2, (*BASE, "many_symbols", "repeated_lines", "upper_case", "digits", "long_words", "endless_word")),
]


def mask_of(names: tuple[str, ...]) -> int:
    order = list(rules())
    return sum(1 << order.index(n) for n in names)


def _repeat_words(words: list[bytes]) -> int:
    """Words in windows of ``WINDOW`` words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
    # Ids of 2, 4 and 8 words from ids of half as many.
    width = 1
    while width < WINDOW:
        pairs = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        distinct, ids = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
        width *= 2
    again = np.flatnonzero(np.bincount(ids)[ids] > 1)
    turn = np.zeros(len(words) + 1, np.int64)
    np.add.at(turn, again, 1)
    np.add.at(turn, again + WINDOW, -1)
    return int((np.cumsum(turn)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of a text, in the order of ``MEASURES``; words are split at ASCII white space."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blank = len(raw) - sum(map(len, words))
    seen, again, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                again += 1
            seen.add(line)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    longest = max(map(len, words), default=0)
    return len(raw), len(text), len(words), len(text) - blank, symbols, again, _repeat_words(words), lines, upper, digits, longest


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([measure(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, rows.T.copy())], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, the measurements, and ``failed``, the mask of failed rules."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measured, LEDGER)
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, fails in enumerate(rules().values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return rows.withColumn("failed", mask)


def rejected(policy: Policy, mask: str = "failed") -> Column:
    return F.col(mask).bitwiseAND(F.lit(mask_of(policy.rules)).cast("long")) != 0


def apply_policies(entries: DataFrame, policies: list[Policy] = POLICIES) -> DataFrame:
    """The ledger with a column ``kept_<name>_v<version>`` for each policy."""
    return entries.withColumns({f"kept_{p.name}_v{p.version}": ~rejected(p) for p in policies})


def ablations(entries: DataFrame, policies: list[Policy] = POLICIES) -> DataFrame:
    """Per policy and rule: rows in all, rejected by the policy, failing the rule, rejected by it alone, rejected without it."""
    counts = entries.groupBy("failed").agg(F.count("*").alias("n"))
    cells = [F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(mask_of(p.rules)).cast("long").alias("all"), F.lit(mask_of((r,))).cast("long").alias("one")) for p in policies for r in p.rules]
    each = counts.select("failed", "n", F.explode(F.array(*cells)).alias("c")).select("failed", "n", "c.*")
    hit, own = F.col("failed").bitwiseAND(F.col("all")), F.col("failed").bitwiseAND(F.col("one"))

    def rows(where: Column, name: str) -> Column:
        return F.sum(F.when(where, F.col("n")).otherwise(0)).alias(name)

    return each.groupBy("policy", "version", "rule").agg(
        F.sum("n").alias("n_rows"), rows(hit != 0, "n_rejected"), rows(own != 0, "n_failed"), rows((own != 0) & (hit == own), "n_alone"),
        rows(hit.bitwiseAND(F.bitwise_not(F.col("one"))) != 0, "n_without"),
    )


_SQL = """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
    w AS (SELECT doc_id, body, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
    p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
    g AS (SELECT doc_id, i, CASE WHEN lead(word, 7) OVER d IS NOT NULL THEN concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d,
            lead(word, 3) OVER d, lead(word, 4) OVER d, lead(word, 5) OVER d, lead(word, 6) OVER d, lead(word, 7) OVER d) END AS win
          FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g WHERE win IS NOT NULL) WHERE n > 1),
    rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
    l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM t)
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
    m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(body, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(l.n, 0) AS n_lines,
            coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(body, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(body, '[^0-9]', '', 'g')) AS n_digits,
            coalesce(list_max(list_transform(ws, lambda x: strlen(x))), 0) AS longest
          FROM w LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
    f AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (n_words > 2000000)::INT + 8 * (100 * n_symbols > 40 * n_words)::INT
            + 16 * (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::INT + 32 * (word_chars > 25 * n_words)::INT
            + 64 * (n_words > 0 AND word_chars < 2 * n_words)::INT + 128 * (100 * n_upper > 60 * word_chars)::INT + 256 * (100 * n_digits > 50 * word_chars)::INT
            + 512 * (longest > 1000)::INT AS BIGINT) AS failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & (1 + 2 + 8 + 16 + 32 + 128 + 256 + 512)) = 0 AS kept, failed FROM f
"""


@BOOK.query("op3_bitmask_ledger", _SQL)
def bitmask_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of ``documents`` with the verdict of the newest policy."""
    entries = ledger(documents(spark, sf_dir))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rejected(POLICIES[0]).alias("base_failed"), (~rejected(POLICIES[-1])).alias("kept"), "failed"
    )
