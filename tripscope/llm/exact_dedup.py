"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Only DataFrame functions. Each step counts its keys with map-side combine and hands on the keys that occur more than once, so a row
whose length or prefix is its own is settled without hashing its content. Group sizes come from aggregates joined back to narrow rows
(id, hash), never from a window over a group, so a group of copies may hold any share of the rows.

Defined cases: a null text equals an empty one; a null id ranks below every id; rows that repeat both id and text are one document and
get one answer (``drop_copies`` leaves a single such row); an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripscope.llm.common import documents, written
from tripscope.plans.registry import Book

BOOK = Book()
PREFIX_CHARS = 256


def _keyed(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), text.alias("body"), F.octet_length(text).alias("len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix")
    )


def refined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, hash_all: bool = False) -> DataFrame:
    """(id, digest, shared) per row: ``digest`` is the SHA-256 of the text where length and prefix are shared with another row.

    ``hash_all`` also fills the digest of rows that were settled earlier, for reports that list it.
    """
    keyed = _keyed(docs, id_col, text_col, prefix_chars)
    lengths = keyed.groupBy("len").count().filter("count > 1").select("len")
    prefixes = keyed.select("len", "prefix").join(lengths, "len", "left_semi").groupBy("len", "prefix").count().filter("count > 1")
    flagged = keyed.join(prefixes.select("len", "prefix", F.lit(True).alias("shared")), ["len", "prefix"], "left")
    shared = F.coalesce(F.col("shared"), F.lit(False))
    digest = F.sha2(F.col("body"), 256)
    return flagged.select("id", (digest if hash_all else F.when(shared, digest)).alias("digest"), shared.alias("shared"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, hash_all: bool = False) -> DataFrame:
    """One row per input row: (id, digest, keep_id, group_size, kept); the largest id of equal texts stays."""
    rows = written(refined(docs, id_col, text_col, prefix_chars, hash_all), "exact")
    groups = (
        rows.filter("shared").groupBy("digest").agg(F.max("id").alias("largest"), F.count("*").alias("n")).filter("n > 1")
        .withColumn("found", F.lit(True))
    )
    # Rows settled early keep a digest of their own, so the join runs on the digest alone.
    out = rows.join(groups, "digest", "left")
    found = F.col("found").isNotNull()
    keep = F.when(found, F.col("largest")).otherwise(F.col("id"))
    return out.select(
        "id", "digest", keep.alias("keep_id"), F.when(found, F.col("n")).otherwise(F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    groups = written(exact_groups(docs, id_col, text_col).filter("group_size > 1").select("id", "digest", "kept"), "copies")
    gone = groups.filter(~F.col("kept")).select("id", "digest").distinct()
    digest = F.sha2(F.coalesce(F.col(f"d.`{text_col}`"), F.lit("")), 256)
    same = (digest == F.col("g.digest")) & F.col(f"d.`{id_col}`").eqNullSafe(F.col("g.id"))
    left = docs.alias("d").join(gone.alias("g"), same, "left_anti")
    if groups.filter("kept").groupBy("id", "digest").count().filter("count > 1").limit(1).count():
        name = "digest"
        while name in docs.columns:
            name += "_"
        left = left.withColumn(name, F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)).dropDuplicates([id_col, name]).drop(name)
    return left


@BOOK.query(
    "op10_progressive_exact_dedup",
    """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
         g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
    SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256 FROM t JOIN g USING (body)
    """,
)
def progressive_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of ``documents``: which row stays, and how many there are."""
    groups = exact_groups(documents(spark, sf_dir), hash_all=True)
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
