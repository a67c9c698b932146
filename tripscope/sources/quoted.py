"""CSV whose quoted fields hold line breaks, read in parallel.

Spark's own multi-line mode reads a file in one task, since a split cannot know whether it begins inside a quoted field. Quotes tell: a
place lies inside one exactly if an odd number of quotes stands before it in its file. So each block counts its quotes, a prefix over the
blocks of a file gives the parity each one begins with, and lines are told apart into those that begin a row and those that go on with
one. Only rows of several lines are put together by grouping; all others are parsed where they lie.

A quote inside a quoted field is doubled. Lines end with LF or CRLF, and breaks inside fields stay as they are. The first line of a file
is its heading. A file with an odd number of quotes is refused: no reading of it is right.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, seq, line, quotes): a block is a split of a file, ``seq`` the order of lines inside it."""
    text = spark.read.option("lineSep", "\n").text(paths)
    place = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    return place.withColumn("quotes", F.length("line") - F.length(F.translate("line", '"', "")))


def _odd(c: Column) -> Column:
    return F.pmod(c, F.lit(2)) == 1


def rows_of_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, first, text): every row of the files as text, heading lines marked ``first``."""
    lines = _lines(spark, paths)
    within = Window.partitionBy("file", "block").orderBy("seq")
    upto = F.coalesce(F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.withColumn("before", upto)
    # Per block: quotes, and lines that begin a row if the block begins outside or inside quotes. One row per block.
    blocks = numbered.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.count_if(~_odd(F.col("before"))).alias("if_outside"), F.count_if(_odd(F.col("before"))).alias("if_inside")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entered = blocks.withColumn("inside", _odd(F.coalesce(F.sum("quotes").over(earlier), F.lit(0))))
    starts = F.when(F.col("inside"), F.col("if_inside")).otherwise(F.col("if_outside"))
    offsets = entered.select("file", "block", "inside", F.coalesce(F.sum(starts).over(earlier), F.lit(0)).alias("rows_before"))
    broken = blocks.groupBy("file").agg(F.sum("quotes").alias("quotes")).filter(_odd(F.col("quotes"))).select("file").limit(5).collect()
    if broken:
        raise ValueError("unbalanced quotes in " + ", ".join(r["file"] for r in broken))
    placed = numbered.join(offsets, ["file", "block"])
    begins = _odd(F.col("before")) == F.col("inside")
    placed = placed.withColumn("begins", begins).withColumn("row", F.col("rows_before") + F.sum(F.when(F.col("begins"), 1).otherwise(0)).over(within))
    alone = placed.filter(F.col("begins") & ~_odd(F.col("quotes"))).select("file", "row", F.col("line").alias("text"))
    # Lines of rows that go on: a row of many lines is one field with as many breaks, so a group is as large as its row.
    pieces = placed.filter(~F.col("begins") | _odd(F.col("quotes"))).groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "line"))).alias("parts"))
    joined = pieces.select("file", "row", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("text"))
    return alone.unionByName(joined).select("file", (F.col("row") == 1).alias("first"), F.regexp_replace("text", "\r\\z", "").alias("text"))


def read_quoted(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of files with one heading, every column text; short rows are padded with nulls, blank lines are no rows."""
    rows = rows_of_text(spark, paths)
    head = rows.filter("first").select("text").first()
    if head is None:
        raise ValueError("no heading in " + ", ".join(paths))
    names = next(csv.reader([head["text"]]))
    schema = StructType([StructField(n, StringType()) for n in names])
    body = rows.filter(~F.col("first") & F.col("text").rlike(r"[^\x00-\x20]"))
    parsed = F.from_csv(F.col("text"), schema.simpleString(), {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"})
    return body.select(parsed.alias("r")).select("r.*")
