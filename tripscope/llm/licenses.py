"""Licence scans with ordered signature rules, DataFrame functions only.

A text is scanned in four steps, all within its row, so nothing is shuffled and long texts are read whole:

1. *Gate*: one regex over the raw text asks whether any rule can match at all.
2. *Keywords*: the text is brought to words in lower case with single spaces; rules whose keyword does not occur are left out.
3. *Rules*: the remaining regexes give detections as ranges of words.
4. *Suppression*: detections are swept in the order of start, length and priority. One that lies inside a detection of the same or
   better priority is dropped, so ``gnu general public license`` yields to ``... version 3`` around it.

The phrases in ``license_rules.BASE`` are counted wherever they stand and are never suppressed. The score is the weight of the best rule
that stays: 0.95 for an identifier or link, 0.9 for a grant or base phrase, 0.8 for a sentence of the licence, 0.6 for a bare name.

Defined cases: a null or empty text has no words and no labels; ids may be null or repeat, each row is scanned by itself; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripscope.llm import license_rules
from tripscope.llm.common import documents
from tripscope.plans.registry import Book

BOOK = Book()
#: A word in raw text; with A-Z in lower case it is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WEIGHTS = {1: 0.95, 2: 0.9, 3: 0.8, 4: 0.6}
PRIORITIES = sorted(WEIGHTS)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules() -> list[tuple[str, str, int, str, bool]]:
    """(label, keyword, priority, regex, base) of every rule, base phrases first."""
    out = [(label, phrase, 2, phrase, True) for phrase, label in license_rules.BASE.items()]
    for line in license_rules.RULES.strip().splitlines():
        label, keyword, priority, regex = (part.strip() for part in line.split(" | "))
        out.append((label, keyword, int(priority), regex, False))
    return out


def _rule_table() -> Column:
    rows = [
        F.struct(
            F.lit(label).alias("label"), F.lit(keyword).alias("keyword"), F.lit(priority).alias("priority"),
            F.lit(f"(?<![^ ])(?:{regex})(?![^ ])").alias("regex"), F.lit(base).alias("base"),
        )
        for label, keyword, priority, regex, base in rules()
    ]
    return F.array(*rows)


def _count(text: Column) -> Column:
    """Words in a stretch of text."""
    bare = F.trim(text)
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1)


def _places(text: Column, regex: Column) -> Column:
    """(start, end) in words of all matches, from the words between and in them."""
    parts = F.arrays_zip(F.split(text, regex, -1).alias("between"), F.regexp_extract_all(text, regex, F.lit(0)).alias("match"))

    def add(acc: Column, part: Column) -> Column:
        start = acc["at"] + _count(part["between"])
        end = start + F.coalesce(_count(part["match"]), F.lit(0))
        found = F.when(part["match"].isNull(), acc["found"]).otherwise(F.array_append(acc["found"], F.struct(start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), found.alias("found"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))
    return F.aggregate(parts, empty, add, lambda acc: acc["found"])


_DETECTION = "array<struct<start:int,longest:int,priority:int,label:string,base:boolean>>"


def _detections(text: Column, table: Column) -> Column:
    """All matches of the rules whose keyword occurs; ``longest`` is the end negated, so that sorting puts the longer first."""
    hit = F.filter(table, lambda r: F.contains(text, r["keyword"]))
    each = F.transform(hit, lambda r: F.transform(_places(text, r["regex"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("longest"), r["priority"].alias("priority"), r["label"].alias("label"), r["base"].alias("base"))))
    return F.array_sort(F.flatten(each)).cast(_DETECTION)


def _kept(found: Column) -> Column:
    """Detections that lie in none of the same or better priority before them."""

    def add(acc: Column, d: Column) -> Column:
        end = -d["longest"]
        inside = reduce(lambda a, b: a | b, [(acc[f"end{p}"] >= end) & (d["priority"] >= p) for p in PRIORITIES])
        ends = [F.when(d["priority"] == p, F.greatest(acc[f"end{p}"], end)).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in PRIORITIES]
        return F.struct(*ends, F.when(inside & ~d["base"], acc["kept"]).otherwise(F.array_append(acc["kept"], d)).alias("kept"))

    start = F.struct(*[F.lit(-1).alias(f"end{p}") for p in PRIORITIES], F.array().cast(_DETECTION).alias("kept"))
    return F.aggregate(found, start, add, lambda acc: acc["kept"])


def _labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_words, found, kept), the detections before and after suppression."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    gate = raw.rlike("(?i)" + "|".join(license_rules.STEMS))
    words = F.translate(F.array_join(F.regexp_extract_all(raw, F.lit(WORD), F.lit(0)), " "), _UPPER, _LOWER)
    n_words = F.when(gate, F.lit(None)).otherwise(F.regexp_count(raw, F.lit(WORD)))
    rows = docs.select(F.col(id_col).alias("id"), n_words.alias("plain"), F.when(gate, words).alias("words"))
    rows = rows.withColumn("found", F.when(F.col("words").isNotNull(), _detections(F.col("words"), _rule_table())))
    rows = rows.withColumn("kept", F.when(F.size("found") > 0, _kept(F.col("found"))))
    none = F.array().cast(_DETECTION)
    return rows.select(
        "id", F.coalesce("plain", _count(F.col("words"))).cast("long").alias("n_words"), F.coalesce("found", none).alias("found"), F.coalesce("kept", none).alias("kept")
    )


@BOOK.query("op1_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document, with the places of the base phrases."""
    base = F.filter("found", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"].cast("long"))
    weight = reduce(lambda rest, p: F.when(F.exists("kept", lambda d: d["priority"] == p), F.lit(WEIGHTS[p])).otherwise(rest), reversed(PRIORITIES), F.lit(0.0))
    return scan(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"), _labels(F.col("kept")).alias("labels"), weight.alias("score"),
    )
